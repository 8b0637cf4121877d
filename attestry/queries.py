"""Registered queries over the driver's tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import asof, assess, names, scan
from .plans import catalog, grammar
from .sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- findings -------------------------------------------------------------------------------------------------------

#: Notices of known licenses in the simple form that SQL dialects share: label, party, regex.
SIMPLE = (
    ("apache2", "FIRST_PARTY", r"(?i)licensed under the apache license, version 2"),
    ("mit", "THIRD_PARTY", r"(?i)released under the mit license"),
    ("gpl3", "THIRD_PARTY", r"(?i)gnu general public license, version 3"),
    ("cc_by_nc", "FORBIDDEN", r"(?i)licensed under cc by-nc"),
)
_SIMPLE_SQL = ", ".join(f"('{n}', '{p}', '{r}')" for n, p, r in SIMPLE)
WORD_RE = r"(?i)(licen[sc]e|warranty|liability|patent|herein|hereby|jurisdiction)"


def doc_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), catalog.PERMISSIVE).withColumnRenamed("id", "doc_id")


def doc_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.file_verdicts(doc_findings(spark, sf_dir), "doc_id")


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(table(spark, sf_dir, "pages").select("page_id", "html"), catalog.PERMISSIVE, "page_id", "html").withColumnRenamed("id", "page_id")


def generic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), catalog.GENERIC)
    return found.groupBy("party", "match_type").agg(F.count("*").alias("n_findings"), F.countDistinct("id").alias("n_docs"))


def doc_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.coalesce_comments(doc_findings(spark, sf_dir), "doc_id")


def notices(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, label, party: which simple notices a document holds."""
    held = F.array_compact(F.array(*[F.when(F.col("text").rlike(r), F.struct(F.lit(n).alias("label"), F.lit(p).alias("party"))) for n, p, r in SIMPLE]))
    return docs.select("doc_id", "source", "lang", F.explode(held).alias("h")).select("doc_id", "source", "lang", "h.*")


_NOTICES = f"""n AS (SELECT d.doc_id, d.source, d.lang, r.label, r.party FROM documents d JOIN (VALUES {_SIMPLE_SQL}) r(label, party, re) ON regexp_matches(d.text, r.re))"""


def known_license_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(table(spark, sf_dir, "documents"))
    return n.groupBy("doc_id").agg(F.max(scan.party_rank(F.col("party"))).alias("rank"), F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))


KNOWN_LICENSE_SQL = f"""WITH {_NOTICES} SELECT doc_id, CAST(max(CASE party WHEN 'FIRST_PARTY' THEN 0 WHEN 'THIRD_PARTY' THEN 1 WHEN 'UNKNOWN' THEN 2 ELSE 3 END) AS INTEGER) AS rank, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM n GROUP BY doc_id"""


def license_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(table(spark, sf_dir, "documents")).groupBy("lang", "label").agg(F.countDistinct("doc_id").alias("n_docs"))


def rule_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(table(spark, sf_dir, "documents")).select("doc_id", "label", "party")


def party_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden before third-party before first-party: the first that holds."""
    t = F.col("text")
    hit = lambda party: T.found_any(t, [r for _, p, r in SIMPLE if p == party])
    party = F.when(hit("FORBIDDEN"), "FORBIDDEN").when(hit("THIRD_PARTY"), "THIRD_PARTY").when(hit("FIRST_PARTY"), "FIRST_PARTY").when(t.rlike(r"(?i)licen[sc]e"), "UNKNOWN").otherwise("NONE")
    return table(spark, sf_dir, "documents").select("doc_id", party.alias("party"))


_ANY = {p: " OR ".join(f"regexp_matches(text, '{r}')" for _, q, r in SIMPLE if q == p) for p in ("FORBIDDEN", "THIRD_PARTY", "FIRST_PARTY")}
PARTY_CASCADE_SQL = f"""SELECT doc_id, CASE WHEN {_ANY["FORBIDDEN"]} THEN 'FORBIDDEN' WHEN {_ANY["THIRD_PARTY"]} THEN 'THIRD_PARTY' WHEN {_ANY["FIRST_PARTY"]} THEN 'FIRST_PARTY' WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'UNKNOWN' ELSE 'NONE' END AS party FROM documents"""


def match_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scan.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", WORD_RE, 1)
    return m.select(F.col("id").alias("doc_id"), F.col("pos").cast("int").alias("pos"), "whole")


MATCH_EXPLODE_SQL = f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{WORD_RE}') AS a FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS pos, a[i] AS whole FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM t)"""


def match_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scan.matches(table(spark, sf_dir, "documents"), "doc_id", "text", r"(?i)(licen[sc]e)", 1)
    return m.filter("pos = 1").select(F.col("id").alias("doc_id"), "start", "end", "start_line")


MATCH_OFFSETS_SQL = r"""WITH t AS (SELECT doc_id, text, regexp_extract(text, '(?i)licen[sc]e') AS w FROM documents), s AS (SELECT doc_id, text, strpos(text, w) - 1 AS p, length(w) AS n FROM t WHERE w <> '')
SELECT doc_id, CAST(p AS INTEGER) AS start, CAST(p + n AS INTEGER) AS "end", CAST(1 + length(substring(text, 1, greatest(p - 1, 0))) - length(replace(substring(text, 1, greatest(p - 1, 0)), chr(10), '')) AS INTEGER) AS start_line FROM s"""


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", T.line_number(F.col("text"), half).alias("line"), T.line_number(F.col("text"), half, strict=True).alias("strict_line"))


LINE_NUMBERS_SQL = """WITH h AS (SELECT doc_id, text, length(text) // 2 AS p FROM documents), q AS (SELECT doc_id, substring(text, 1, greatest(p - 1, 0)) AS a, substring(text, 1, p) AS b FROM h)
SELECT doc_id, CAST(1 + length(a) - length(replace(a, chr(10), '')) AS INTEGER) AS line, CAST(1 + length(b) - length(replace(b, chr(10), '')) AS INTEGER) AS strict_line FROM q"""


def truncate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.searched(F.col("text"))).cast("long").alias("n_searched"))


def entity_unquote(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", T.unquote(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


def normalize_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_license(F.col("text")).cast("binary")).alias("digest"))


_KEPT = grammar.URL.replace("'", "''")
NORMALIZE_SQL = rf"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '(?i){_KEPT}|</') AS m, regexp_split_to_array(text, '(?i){_KEPT}|</') AS g FROM documents)
SELECT doc_id, md5(trim(array_to_string(list_transform(range(1, len(g) + 1), lambda i: regexp_replace(g[i], '[\s\p{{Z}}*/#\x{{B7}}\x{{A7}}\x{{AD}}\x{{B6}}\x{{A0}}]+', ' ', 'g') || coalesce(m[i], '')), ''), ' ')) AS digest FROM t"""


def normalize_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.normalize_owner(F.concat("s_name", F.lit(". All rights reserved."))).alias("owner"))


def owner_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner notices made from customer names."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/* Copyright (C) 2019 "), F.translate("c_name", "#", "-"), F.lit(" */")).alias("t"))
    found = scan.scan(c, catalog.PERMISSIVE.owner("first", "customer-0+1[0-9]{0,12}"), "c_custkey", "t")
    return found.select(F.col("id").alias("c_custkey"), "party", "match_type", "start", "end")


OWNER_SQL = """SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^Customer#0+1[0-9]*$') THEN 'FIRST_PARTY' ELSE 'THIRD_PARTY' END AS party, 'AUTHOR_OWNER' AS match_type, CAST(22 AS INTEGER) AS start, CAST(22 + length(c_name) AS INTEGER) AS "end" FROM customer"""


def path_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", (~F.col("url").rlike(files.DEFAULT_SKIP) & ~F.col("url").rlike("[0-9]{2}$")).alias("taken"))


def always_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("full_path", T.full_path(F.lit("web"), F.col("url")))
    return p.select("page_id", T.found_any(F.col("full_path"), ["(?i)legal", "/[a-m][^/]*$"]).alias("always_review"))


def exclude_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike("(?i)licen[sc]e"))
    return d.select("doc_id", T.found_any(F.col("text"), ["Apache", "version 3"]).alias("excluded"))


# --- verdicts -------------------------------------------------------------------------------------------------------


def simple_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(table(spark, sf_dir, "documents")).withColumn("match_type", F.lit("LICENSE"))


def file_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess.file_verdicts(simple_findings(spark, sf_dir), "doc_id").select("doc_id", "verdict")


FILE_VERDICT_SQL = f"""WITH {_NOTICES}, v AS (SELECT doc_id, max(CASE party WHEN 'FIRST_PARTY' THEN 0 WHEN 'THIRD_PARTY' THEN 1 WHEN 'UNKNOWN' THEN 2 ELSE 3 END) AS k FROM n GROUP BY doc_id)
SELECT doc_id, CASE k WHEN 0 THEN 'FIRST_PARTY' WHEN 1 THEN 'THIRD_PARTY' WHEN 2 THEN 'UNKNOWN' ELSE 'FORBIDDEN' END AS verdict FROM v"""


def change_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source as one change of all its documents; sources with an even number allow third parties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    ranks = assess.file_verdicts(simple_findings(spark, sf_dir), "doc_id").select("doc_id", "rank")
    f = docs.join(ranks, "doc_id", "left").withColumn("third_party_allowed", F.col("source").rlike("[02468]$")).withColumn("always_review", F.lit(False))
    return assess.change_verdicts(f, "source").select("source", "review", "vote")


CHANGE_VERDICT_SQL = f"""WITH {_NOTICES}, v AS (SELECT source, max(CASE party WHEN 'FIRST_PARTY' THEN 0 WHEN 'THIRD_PARTY' THEN 1 WHEN 'UNKNOWN' THEN 2 ELSE 3 END) AS k FROM n GROUP BY source),
c AS (SELECT d.source, coalesce(k, 0) > 1 OR (coalesce(k, 0) = 1 AND NOT regexp_matches(d.source, '[02468]$')) AS review FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN v ON v.source = d.source)
SELECT source, review, CAST(CASE WHEN review THEN -1 ELSE 2 END AS INTEGER) AS vote FROM c"""


SHORT_WORDS = "(?i)(the|der|les|con)"


def clustered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short words of each document in gap sessions: a new one 6 lines and 300 characters behind the last word."""
    m = scan.matches(scan.spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", SHORT_WORDS, 1)
    w = Window.partitionBy("row_no").orderBy("pos")
    far = (F.col("start_line") - F.lag("end_line").over(w) >= 6) & (F.col("start") - F.lag("end").over(w) >= 300)
    return m.withColumn("opens", F.coalesce(far, F.lit(True)).cast("int")).withColumn("session", F.sum("opens").over(w))


_CLUSTERS = f"""t AS (SELECT doc_id, regexp_extract_all(text, '{SHORT_WORDS}') AS m, regexp_split_to_array(text, '{SHORT_WORDS}') AS g FROM documents),
p AS (SELECT doc_id, unnest(m) AS w, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM t),
c AS (SELECT doc_id, i, gap, length(w) AS n, sum(length(gap) + length(w)) OVER o AS e, sum(length(gap) - length(replace(gap, chr(10), ''))) OVER o AS lines FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
l AS (SELECT doc_id, i, e - n AS a, e, lines + 1 - CASE WHEN ends_with(gap, chr(10)) THEN 1 ELSE 0 END AS a_line, lines + 1 AS e_line FROM c),
f AS (SELECT *, coalesce(a_line - lag(e_line) OVER o >= 6 AND a - lag(e) OVER o >= 300, TRUE) AS opens FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS session FROM f),
k AS (SELECT doc_id, CAST(session AS BIGINT) AS session, count(*) AS n_words, CAST(min(a) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS "end" FROM s GROUP BY doc_id, session)"""


def unknown_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = clustered_words(spark, sf_dir)
    return m.groupBy(F.col("id").alias("doc_id"), "session").agg(F.count("*").alias("n_words"), F.min("start").alias("start"), F.max("end").alias("end"))


def cluster_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unknown_clusters(spark, sf_dir).filter(F.col("session") <= grammar.CLUSTERS_MAX).groupBy("doc_id").agg(F.count("*").alias("n_clusters"), F.sum("n_words").alias("n_words"))


def unknown_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hint words count only where no known notice stands in the document."""
    docs = table(spark, sf_dir, "documents")
    hints = docs.filter(F.col("text").rlike(WORD_RE)).select("doc_id")
    return hints.join(notices(docs).select("doc_id").distinct(), "doc_id", "left_anti")


def comment_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments not posted yet: those of odd documents are, except where the line is null on one side."""
    c = notices(table(spark, sf_dir, "documents")).select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.when(F.col("doc_id") % 4 != 1, F.lit(1)).alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.col("label").alias("message"), "doc_id")
    prior = c.filter("doc_id % 2 = 1").withColumn("start_line", F.when(F.col("doc_id") % 8 != 1, F.col("start_line")).otherwise(F.lit(7)))
    return assess.new_comments(c, prior.drop("doc_id")).select("path", "start_line", "message")


COMMENT_DEDUPE_SQL = f"""WITH {_NOTICES}, c AS (SELECT 'doc/' || doc_id AS path, CAST(CASE WHEN doc_id % 4 <> 1 THEN 1 END AS INTEGER) AS start_line, label AS message, doc_id FROM n),
p AS (SELECT path, CASE WHEN doc_id % 8 <> 1 THEN start_line ELSE 7 END AS start_line, message FROM c WHERE doc_id % 2 = 1)
SELECT path, start_line, message FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.path = c.path AND p.start_line IS NOT DISTINCT FROM c.start_line AND p.message = c.message)"""


def reviewer_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    existing = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("int").alias("account_id"), F.concat(F.lit("u"), "c_custkey").alias("username"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("email"), F.array(F.concat(F.lit("s"), "c_custkey")).alias("secondary_emails"))
    wanted = c.select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("s"), "c_custkey")).otherwise(F.col("c_name")).alias("reviewer"))
    return assess.missing_reviewers(wanted, existing)


def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a tree: the parent lacks every seventh, has another blob for every fifth, and others besides."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("blob_id"))
    path = F.concat(F.lit("d/"), F.col("doc_id"))
    tree = d.filter("doc_id % 11 <> 0").select(path.alias("path"), F.lit(0o100644).alias("mode"), "blob_id")
    parent = d.filter("doc_id % 7 <> 0").select(F.lit("p").alias("parent"), path.alias("path"), F.lit(0o100644).alias("mode"), F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("blob_id")).alias("blob_id"))
    return files.changed_files(tree, parent).select("path", "status")


TREE_DIFF_SQL = """WITH t AS (SELECT doc_id, source AS b FROM documents WHERE doc_id % 11 <> 0), p AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE source END AS b FROM documents WHERE doc_id % 7 <> 0)
SELECT 'd/' || coalesce(t.doc_id, p.doc_id) AS path, CASE WHEN t.doc_id IS NULL THEN 'deleted' WHEN p.doc_id IS NULL THEN 'added' ELSE 'modified' END AS status FROM t FULL JOIN p ON t.doc_id = p.doc_id WHERE t.b IS DISTINCT FROM p.b"""


def rule_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closest rule names of each market segment."""
    seg = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    rules = spark.createDataFrame([(k,) for k in sorted(catalog.CATALOG)], "rule string")
    pairs = seg.crossJoin(F.broadcast(rules)).withColumn("distance", F.levenshtein("name", "rule"))
    best = Window.partitionBy("name")
    return pairs.withColumn("least", F.min("distance").over(best)).filter("distance = least").select("name", "rule", "distance")


RULE_SUGGEST_SQL = f"""WITH s AS (SELECT DISTINCT c_mktsegment AS name FROM customer), d AS (SELECT name, rule, levenshtein(name, rule) AS distance FROM s, (VALUES {", ".join(f"('{k}')" for k in sorted(catalog.CATALOG))}) r(rule))
SELECT name, rule, CAST(distance AS INTEGER) AS distance FROM d WHERE distance = (SELECT min(distance) FROM d e WHERE e.name = d.name)"""


def word_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents that are no rule name, with the rule names that they may be meant for."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_]+"), 0))).alias("w")).select(F.upper("w").alias("name"))
    rules = spark.createDataFrame([(k,) for k in sorted(catalog.CATALOG)], "known string")
    return names.suggestions(words, rules)


WORD_SUGGEST_SQL = f"""WITH w AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS name FROM documents),
d AS (SELECT name, known, levenshtein(name, known) AS distance FROM w, (VALUES {", ".join(f"('{k}')" for k in sorted(catalog.CATALOG))}) r(known)),
m AS (SELECT name, min(distance) AS least FROM d GROUP BY name)
SELECT d.name, known, CAST(distance AS INTEGER) AS distance FROM d JOIN m ON d.name = m.name AND distance = least WHERE least BETWEEN 1 AND {names.FAR - 1}"""


def event_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum, extremes and quantiles of the events' values by type, merged from the sketches of each day."""
    e = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long")).withColumn("day", F.to_date("ts"))
    daily = sinks.timers(e, "event_type", "day", value="cents")
    return sinks.timer_quantiles(sinks.merged_timers(daily, "event_type"), "event_type")


def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.counters(table(spark, sf_dir, "events"), "event_type")


def version_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the last signup at or before it, as a revision with the policy of its time."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    versions = e.filter("event_type = 'signup'").select(F.col("ts").alias("since"), F.col("event_id").alias("version"))
    return asof.as_of(e.filter("event_type <> 'signup'"), versions, at="ts").select("event_id", "version")


VERSION_SQL = """WITH v AS (SELECT ts, max(event_id) AS version FROM events WHERE event_type = 'signup' GROUP BY ts), e AS (SELECT * FROM events WHERE event_type <> 'signup')
SELECT e.event_id, v.version FROM e ASOF LEFT JOIN v ON e.ts >= v.ts"""


def finding_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scan.matches(table(spark, sf_dir, "documents"), "doc_id", "text", r"(?i)(licen[sc]e)", 1).filter("pos = 1")
    f = m.select(F.lit("UNKNOWN").alias("party"), F.lit("LICENSE").alias("match_type"), "start_line", "end_line", "start", "end", F.col("whole").alias("text"), F.when(F.col("id").isNotNull(), F.array(F.lit("a b.zip"), F.col("id").cast("string"))).alias("path_stack"), F.lit(0).cast("long").alias("size"), F.lit(5).cast("long").alias("elapsed_us"))
    return sinks.finding_lines(f)


FINDING_LINES_SQL = r"""WITH t AS (SELECT doc_id, text, regexp_extract(text, '(?i)licen[sc]e') AS w FROM documents), s AS (SELECT doc_id, text, w, strpos(text, w) - 1 AS p, length(w) AS n FROM t WHERE w <> ''),
l AS (SELECT *, 1 + length(substring(text, 1, greatest(p - 1, 0))) - length(replace(substring(text, 1, greatest(p - 1, 0)), chr(10), '')) AS sl, 1 + length(substring(text, 1, p + n - 1)) - length(replace(substring(text, 1, p + n - 1), chr(10), '')) AS el FROM s)
SELECT 'UNKNOWN LICENSE [' || sl || ',' || el || ') [' || p || ',' || (p + n) || ') ' || n || ' 5us 0 ' || doc_id || '<a%20b.zip> ' || w AS value FROM l"""


def turn_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n_turns"), F.sum(F.col("text").rlike(WORD_RE).cast("long")).alias("n_hints"))


def benchmark_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    found = scan.matches(b, "item_id", "text", WORD_RE, 1).groupBy("id").agg(F.count("*").alias("n"))
    return b.join(found, b["item_id"] == found["id"], "left").select("item_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_findings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        doc_verdicts, doc_findings, page_findings, generic_findings, doc_comments, known_license_docs, license_counts_by_lang, rule_attribution, party_cascade, match_explode, match_offsets, line_numbers, truncate_scan,
        entity_unquote, normalize_license, normalize_owner, owner_findings, path_skip, always_review, exclude_patterns, file_verdict, change_verdict, unknown_clusters, cluster_top10, unknown_suppression, comment_dedupe,
        reviewer_dedupe, tree_diff, rule_suggest, word_suggest, event_timers, scan_counts, version_in_force, finding_lines, turn_scan, benchmark_scan,
    )
}

SQL: dict[str, str] = {
    "known_license_docs": KNOWN_LICENSE_SQL,
    "license_counts_by_lang": f"WITH {_NOTICES} SELECT lang, label, count(DISTINCT doc_id) AS n_docs FROM n GROUP BY lang, label",
    "rule_attribution": f"WITH {_NOTICES} SELECT doc_id, label, party FROM n",
    "party_cascade": PARTY_CASCADE_SQL,
    "match_explode": MATCH_EXPLODE_SQL,
    "match_offsets": MATCH_OFFSETS_SQL,
    "line_numbers": LINE_NUMBERS_SQL,
    "truncate_scan": f"SELECT doc_id, least(length(text), {grammar.SEARCH_MAX}) AS n_searched FROM documents",
    "entity_unquote": """SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, regexp_replace(html, '&quot;|&#34;|</?var>', '"', 'g') AS t FROM pages)""",
    "normalize_license": NORMALIZE_SQL,
    "normalize_owner": "SELECT s_suppkey, s_name AS owner FROM supplier",
    "owner_findings": OWNER_SQL,
    "path_skip": "SELECT page_id, NOT regexp_matches(url, '/[.]git/') AND NOT regexp_matches(url, '[0-9]{2}$') AS taken FROM pages",
    "always_review": "SELECT page_id, regexp_matches('web/' || url, '(?i)legal') OR regexp_matches('web/' || url, '/[a-m][^/]*$') AS always_review FROM pages",
    "exclude_patterns": "SELECT doc_id, regexp_matches(text, 'Apache') OR regexp_matches(text, 'version 3') AS excluded FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e')",
    "file_verdict": FILE_VERDICT_SQL,
    "change_verdict": CHANGE_VERDICT_SQL,
    "unknown_clusters": f"WITH {_CLUSTERS} SELECT * FROM k",
    "cluster_top10": f"WITH {_CLUSTERS} SELECT doc_id, count(*) AS n_clusters, CAST(sum(n_words) AS BIGINT) AS n_words FROM k WHERE session <= {grammar.CLUSTERS_MAX} GROUP BY doc_id",
    "unknown_suppression": f"WITH {_NOTICES} SELECT doc_id FROM documents WHERE regexp_matches(text, '{WORD_RE}') AND doc_id NOT IN (SELECT doc_id FROM n)",
    "comment_dedupe": COMMENT_DEDUPE_SQL,
    "reviewer_dedupe": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 's' || c_custkey ELSE c_name END AS reviewer FROM customer WHERE c_custkey % 3 <> 0",
    "tree_diff": TREE_DIFF_SQL,
    "rule_suggest": RULE_SUGGEST_SQL,
    "word_suggest": WORD_SUGGEST_SQL,
    "scan_counts": "SELECT event_type, count(*) AS n_scans FROM events GROUP BY event_type",
    "version_in_force": VERSION_SQL,
    "finding_lines": FINDING_LINES_SQL,
    "turn_scan": f"SELECT role, count(*) AS n_turns, CAST(sum(CASE WHEN regexp_matches(text, '{WORD_RE}') THEN 1 ELSE 0 END) AS BIGINT) AS n_hints FROM conversations GROUP BY role",
    "benchmark_scan": f"SELECT item_id, len(regexp_extract_all(text, '{WORD_RE}')) AS n_findings FROM benchmark",
}
