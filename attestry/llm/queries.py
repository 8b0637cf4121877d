"""The numbered queries: production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, filter_audit, license_scan, line_dedup, lm_score, mixing, pii, prefix_trie, quality, simhash, suffix_dedup, toxicity, url_filter
from .common import documents

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(documents(spark, sf_dir))


OP1_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


#: Target weights of the production mix; sources not listed share the weight of REST.
WEIGHTS = {"src0": 12, "src1": 6, "src2": 6, "src3": 4, "src4": 4, "src5": 3} | {f"src{i}": 2 for i in range(6, 20)}
REST, BLOCK_DOCS = 1, 8


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.positions(documents(spark, sf_dir), WEIGHTS, REST, BLOCK_DOCS).select("doc_id", "stream", "block", "released", "deadline", "slot", "position")


OP2_SQL = f"""
WITH RECURSIVE w(stream, weight) AS (VALUES {", ".join(f"('={k}', {v})" for k, v in WEIGHTS.items())}, ('rest', {REST})),
d AS (SELECT doc_id, coalesce(w.stream, 'rest') AS stream FROM documents LEFT JOIN w ON w.stream = '=' || source),
r AS (SELECT doc_id, stream, row_number() OVER (PARTITION BY stream ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS n FROM d),
c AS (SELECT stream, weight, (count(*) + {BLOCK_DOCS - 1}) // {BLOCK_DOCS} AS blocks, row_number() OVER (ORDER BY stream) AS i FROM r JOIN w USING (stream) GROUP BY stream, weight),
a AS (SELECT list(weight ORDER BY i) AS w, list(blocks ORDER BY i) AS b, list(stream ORDER BY i) AS s FROM c),
e(t, start, k, rem, pick, block, released, deadline) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), list_transform(b, lambda x: CAST(0 AS BIGINT)), list_transform(b, lambda x: CAST(x AS BIGINT)), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM a
  UNION ALL
  SELECT t, CASE WHEN rem[pick] = 1 THEN t + 1 ELSE start END,
    CASE WHEN rem[pick] = 1 THEN list_transform(k, lambda x: CAST(0 AS BIGINT)) ELSE list_transform(k, lambda x, i: CAST(x + CASE WHEN i = pick THEN 1 ELSE 0 END AS BIGINT)) END,
    list_transform(rem, lambda x, i: CAST(x - CASE WHEN i = pick THEN 1 ELSE 0 END AS BIGINT)), pick, CAST(b[pick] - rem[pick] AS BIGINT),
    CAST(start + (k[pick] * p) // w[pick] AS BIGINT), CAST(start + ((k[pick] + 1) * p + w[pick] - 1) // w[pick] AS BIGINT)
  FROM (SELECT *, CAST(pick_ AS BIGINT) AS pick FROM (SELECT *, list_min(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN rem[i] > 0 AND start + (k[i] * p) // w[i] <= t THEN (((k[i] + 1) * p + w[i] - 1) // w[i]) * 1000 + i END)) % 1000 AS pick_
        FROM (SELECT e.t + 1 AS t, e.start, e.k, e.rem, a.w, a.b, list_sum(list_transform(range(1, len(a.w) + 1), lambda i: CASE WHEN e.rem[i] > 0 THEN a.w[i] ELSE 0 END))::BIGINT AS p FROM e, a WHERE list_sum(e.rem) > 0)))),
f AS (SELECT a.s[pick] AS stream, block, t, released, deadline FROM e, a WHERE t >= 0)
SELECT r.doc_id, r.stream, f.block, f.released, f.deadline, f.t AS slot, f.t * {BLOCK_DOCS} + r.n % {BLOCK_DOCS} AS position
FROM r JOIN f ON r.stream = f.stream AND r.n // {BLOCK_DOCS} = f.block
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def _op4_sql() -> str:
    """Windows of twice a template's length that begin at one of its words, counted by a join of the words with themselves."""
    entries = license_scan.indexed(license_scan.TEMPLATES, {})
    table = ", ".join(f"({k}, '{e.label}', {e.length}, {len(e.ordered)}, {e.need}, '{'(?:[^ ]+ )*'.join(x.decode() + ' ' for x in e.sequence)}')" for k, e in enumerate(entries))
    held = ", ".join(f"({k}, '{x.decode()}')" for k, e in enumerate(entries) for x in e.ordered)
    phrases = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM k WHERE " + " AND ".join(f"w{j or ''} = '{x}'" for j, x in enumerate(phrase.split())) for phrase, label in license_scan.PHRASES.items()
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS a FROM documents),
k AS (SELECT r, i, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM (SELECT r, unnest(a) AS w, generate_subscripts(a, 1) - 1 AS i FROM d) WINDOW o AS (PARTITION BY r ORDER BY i)),
b AS ({phrases}),
f AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
t(t, label, length, size, need, sequence) AS (VALUES {table}),
h AS (SELECT k.r, k.i, k.w, x.t FROM k JOIN (VALUES {held}) x(t, w) ON x.w = k.w),
c AS (SELECT h.r, h.t, h.i, count(DISTINCT g.w) AS n FROM h JOIN t ON t.t = h.t JOIN h g ON g.r = h.r AND g.t = h.t AND g.i BETWEEN h.i AND h.i + 2 * t.length - 1 GROUP BY h.r, h.t, h.i),
m AS (SELECT c.r, t.label, max(n) / CAST(any_value(t.size) AS DOUBLE) AS score FROM c JOIN t ON t.t = c.t JOIN d ON d.r = c.r WHERE n >= need
      GROUP BY c.r, c.t, t.label HAVING bool_or(sequence = '' OR regexp_matches(array_to_string(d.a[c.i + 1 : c.i + 2 * t.length], ' ') || ' ', '^' || sequence))),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT r, label, score FROM m UNION ALL SELECT r, label, 1.0 FROM b) GROUP BY r)
SELECT d.doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN f ON f.r = d.r LEFT JOIN l ON l.r = d.r
"""


OP4_SQL = _op4_sql()


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.copies(documents(spark, sf_dir), benchmark)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.scores(documents(spark, sf_dir), labels)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measures(documents(spark, sf_dir))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM s) GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS shouts
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 1.5 * n_words OR word_chars > 25 * n_words
       OR n_symbols > 0.25 * n_words OR shouts > 0.5 * n_words OR n_dup_lines > 0.5 * n_lines) AS kept
FROM f
"""

def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def _op10_sql() -> str:
    """Hashes of the strings of 1, 2, 4 ... 256 bytes from each byte, each made of two of half its length; 400 bytes are 256, 128 and 16."""
    steps, last = [], "b"
    for k in (1, 2, 4, 8, 16, 32, 64, 128):
        kept = "r, i, n, x" + ", h16" * (k > 16) + f", h{k}" * (k in (16, 128))
        steps.append(f"d{2 * k} AS (SELECT {kept}, hash(h{k}, lead(h{k}, {k}) OVER (PARTITION BY r ORDER BY i)) AS h{2 * k} FROM {last})")
        last = f"d{2 * k}"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, i, n, x, hash(x) AS h1 FROM (SELECT r, unnest(range(0, length(x) // 2)) AS i, length(x) // 2 AS n, unnest(regexp_extract_all(x, '..')) AS x FROM t)),
{", ".join(steps)},
w AS (SELECT r, i, x, CASE WHEN i + 256 <= n THEN h256 END AS p, CASE WHEN i + 400 <= n THEN hash(h256, lead(h128, 256) OVER o, lead(h16, 384) OVER o) END AS q FROM d256 WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, x, CASE WHEN p IS NOT NULL AND count(*) OVER (PARTITION BY p) > 1 THEN i END AS p, CASE WHEN q IS NOT NULL AND count(*) OVER (PARTITION BY q) > 1 THEN i END AS q FROM w),
m AS (SELECT r, i, x, coalesce(i - max(p) OVER o < 256, FALSE) AS shared, coalesce(i - max(q) OVER o < 400, FALSE) AS gone FROM c WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), FALSE) AS opens FROM m),
g AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, count(*) FILTER (WHERE shared) AS n_shared, string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM s GROUP BY r)
SELECT t.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(n_shared, 0) AS n_shared, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN g ON g.r = t.r
"""


OP10_SQL = _op10_sql()


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("digest")


#: Prefixes as lists of turn digests, grouped as they are; CRC-32 by its eight steps a byte.
OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id AS c, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS t, turn,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'t': t, 'w': w} ORDER BY turn NULLS FIRST, t) AS own FROM t GROUP BY c),
z(c, i, crc) AS (SELECT c, 0, 4294967295::BIGINT FROM l UNION ALL
  SELECT c, i + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END
  FROM (SELECT c, i, CASE WHEN i % 8 = 0 THEN xor(crc, unicode(substr(CAST(c AS VARCHAR), i // 8 + 1, 1))::BIGINT) ELSE crc END AS x FROM z WHERE i < 8 * length(CAST(c AS VARCHAR)))),
h AS (SELECT c, xor(crc, 4294967295::BIGINT) % 4 AS h FROM z WHERE i = 8 * length(CAST(c AS VARCHAR))),
b AS (SELECT l.c, list_concat(coalesce(b.own, [])[1:h], l.own[h + 1:]) AS turns FROM l JOIN h USING (c) LEFT JOIN l b ON b.c = l.c - l.c % 20),
p AS (SELECT c, len(turns) AS n, d, list_transform(turns[1:d], lambda x: x.t) AS k, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM b)),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256, count(*) FILTER (WHERE n > d) AS longer FROM p GROUP BY d, k),
s AS (SELECT a.d, a.k, CAST(sum((n.n_convs - 1) * n.w) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE n.longer = 0) AS n_leaves, count(*) FILTER (WHERE n.d = a.d + 1) AS n_children
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM n) n JOIN n a ON a.d = n.up AND a.k = n.k[1:n.up] GROUP BY a.d, a.k)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.d = n.d AND s.k = n.k LEFT JOIN n u ON u.d = n.d - 1 AND u.k = n.k[1:n.d - 1]
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
e AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g'))) > 3 * length(d.text),
     regexp_matches(d.text, '[#$%&*|]'), coalesce(d.doc_id > e.least, FALSE)] AS f
  FROM d JOIN w USING (r) JOIN e ON e.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id),
o AS (SELECT a || b || c || x || y AS filter_order FROM (SELECT unnest(['A','B','C','D','E']) AS a), (SELECT unnest(['A','B','C','D','E']) AS b), (SELECT unnest(['A','B','C','D','E']) AS c),
    (SELECT unnest(['A','B','C','D','E']) AS x), (SELECT unnest(['A','B','C','D','E']) AS y) WHERE len(list_distinct([a, b, c, x, y])) = 5),
s AS (SELECT filter_order, step, strpos('ABCDE', substr(filter_order, step, 1)) AS k, list_transform(range(1, step), lambda i: strpos('ABCDE', substr(filter_order, i, 1))) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, good, toxic, f, count(*) AS n FROM f GROUP BY ALL),
m AS (SELECT part, filter_order, step, k, good, toxic, n, f[k] AS fails, coalesce(list_bool_or(list_transform(before, lambda i: f[i])), FALSE) AS gone, len(list_filter(f, lambda x: x)) AS n_fails FROM g, s),
t AS (SELECT part, filter_order, step, k, CAST(coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT gone AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM m GROUP BY part, filter_order, step, k)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM t
"""


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), model).drop("score")


def _op13_sql() -> str:
    """The gradient steps one after another as tables of (bucket, weight, speed), then the same sums over the pages."""
    u = url_filter
    part = lambda k: f"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {k})"

    def grams(seed: int, n: int) -> str:
        h = str(seed)
        for k in range(n):
            h = f"({h} * {u.FACTOR}::BIGINT + c{seed}[i + {k}]) % {u.PRIME}"
        return f"list_transform(range(1, len(c{seed}) - {n - 2}), lambda i: ({h}) % {u.BUCKETS})"

    def found(source: str) -> str:
        codes = lambda x: f"list_transform(string_split('^' || {x} || '$', ''), lambda x: unicode(x)::BIGINT)"
        every = ", ".join(grams(seed, n) for seed in u.SEEDS for n in u.SIZES)
        return f"SELECT *, list_distinct(flatten([{every}])) AS found FROM (SELECT *, {codes('host')} AS c{u.SEEDS[0]}, {codes('path')} AS c{u.SEEDS[1]} FROM {source})"

    low = f"translate({part(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    labelled = ", ".join([f"('{x}', 1.0)" for x in u.BLOCKED] + [f"('{x}', 0.0)" for x in u.ALLOWED])
    b = u.BUCKETS
    steps = [f"w0 AS (SELECT k, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v FROM (SELECT DISTINCT k FROM f) UNION ALL SELECT {b}, 0.0, 0.0)"]
    for s in range(u.STEPS):
        steps.append(
            f"m{s} AS MATERIALIZED (SELECT i, n, (1 / (1 + exp(-((SELECT w FROM w{s} WHERE k = {b}) + sum(w) / sqrt(n)))) - y) * CASE WHEN y = 1 THEN {u.BLOCKED_SHARE} / {len(u.BLOCKED)} ELSE {1 - u.BLOCKED_SHARE} / {len(u.ALLOWED)} END AS e FROM f JOIN w{s} USING (k) GROUP BY i, n, y), "
            f"g{s} AS (SELECT k, sum(e / sqrt(n)) AS d FROM f JOIN m{s} USING (i, n) GROUP BY k UNION ALL SELECT {b}, sum(e) FROM m{s}), "
            f"w{s + 1} AS MATERIALIZED (SELECT k, round(w + v, 6) AS w, v FROM (SELECT k, w, round({u.MOMENTUM} * v - {u.RATE} * (d + CASE WHEN k < {b} THEN {u.DECAY} * w ELSE 0 END), 6) AS v FROM w{s} JOIN g{s} USING (k)))"
        )
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(u.RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{what(v, h, p)}'" for v, h, p in longest) + " END"
    return f"""
WITH l AS (SELECT row_number() OVER () AS i, y, {low} AS host, {part(2)} AS path FROM (VALUES {labelled}) t(url, y)),
f AS MATERIALIZED (SELECT i, y::DOUBLE AS y, len(found) AS n, unnest(found) AS k FROM ({found("l")})),
{", ".join(steps)},
p AS (SELECT row_number() OVER () AS r, page_id, {low} AS host, {part(2)} AS path FROM pages),
q AS (SELECT r, len(found) AS n, unnest(found) AS k FROM ({found("p")})),
z AS (SELECT r, (SELECT w FROM w{u.STEPS} WHERE k = {b}) + sum(coalesce(w, 0)) / sqrt(any_value(n)) AS z FROM q LEFT JOIN w{u.STEPS} USING (k) GROUP BY r)
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule, coalesce({case(lambda v, h, p: v)}, CASE WHEN coalesce(z, (SELECT w FROM w{u.STEPS} WHERE k = {b})) >= 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN z USING (r)
"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_license_scan": op4_license_scan,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_url_filter": op13_url_filter,
}

SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op4_license_scan": OP4_SQL, "op9_quality": OP9_SQL, "op10_suffix_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_url_filter": OP13_SQL}
