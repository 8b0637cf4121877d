"""Findings of a text: one master pattern, group classification, and an ordered fall-back for unknown evidence.

The master pattern runs once per text inside regexp_replace, which rewrites every match with marks around its groups;
split and posexplode turn that into one row per match.  Texts end there: what is shuffled are the matches, their lengths
and the line ends between them, from which running sums give offsets and lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import grammar
from ..plans.catalog import RuleSet
from ..sources.store import cut

PARTIES = ("FIRST_PARTY", "THIRD_PARTY", "UNKNOWN", "FORBIDDEN")
_MATCH, _FIELD, _END = T.MARKS[:3]


def party_rank(party: Column) -> Column:
    rank = F.when(party == PARTIES[0], 0)
    for i, p in enumerate(PARTIES[1:], 1):
        rank = rank.when(party == p, i)
    return rank


def line_ends(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda variable is bound, a column reference may be inlined."""
    return F.transform(F.array(value), body)[0]


def spread(df: DataFrame) -> DataFrame:
    """Texts dealt over all cores where the input has fewer splits than cores; other inputs are read as they lie."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(4 * n)


def chosen_pattern(text: Column, index: grammar.RuleIndex) -> Column:
    """The master pattern of a text: only the alternatives whose literals it holds, each in its place; null where there are none.

    First the few roots are looked for; roots lead to alternatives, whose other literals are looked for then.  What is looked
    for in an ordinary text does not grow with the rules.  No literal holds a quotation mark or a blank, so preparing a
    text makes none that was not there.
    """
    joined = lambda seps, xs: seps[0].join(joined(seps[1:], x) for x in xs) if seps else xs  # noqa: E731  nested lists as one string
    table = lambda xs: F.split(F.lit("\x01".join(xs)), "\x01")  # noqa: E731  folded to one literal
    alternatives = index.alternatives
    roots, patterns = table(index.roots), table([a.pattern for a in alternatives])
    needs = table([joined("\x02\x03\x04", [b.sets for b in a.branches]) for a in alternatives])
    led = table([",".join(str(k) for k, a in enumerate(alternatives) if any(r in b.roots for b in a.branches)) for r in index.roots])
    some = lambda xs, made: F.when(F.size(xs) > 0, made)  # noqa: E731  else null

    def pattern(held: Column) -> Column:
        def part(place: int, groups: int, made) -> Column:
            own = [k for k, a in enumerate(alternatives) if a.place == place]
            here = F.filter(held, lambda k: k.between(own[0], own[-1])) if own else F.array().cast("array<int>")
            every = F.array_join(F.transform(here, lambda k: F.concat(F.lit("(?:"), F.get(patterns, k), F.lit(")"))), "|")
            # a part left out keeps its groups, empty, so that the others keep their numbers
            return let(every, lambda c: F.when(c == "", F.lit(grammar.NEVER + "()" * groups)).otherwise(made(c)))

        before, between, behind = map(F.lit, grammar.WORDS)
        parts = [part(0, 1, lambda c: F.concat(F.lit("("), c, F.lit(")"))), *[part(k, n, lambda c: c) for k, n in enumerate(grammar.GROUPS_OF_PARTS, 1)], part(5, 0, lambda c: F.concat(before, c, between, c, behind))]
        return F.concat(F.lit(grammar.HEAD), F.array_join(F.array(*parts), "|"), F.lit(grammar.TAIL))

    def searched(t: Column) -> Column:
        one_of = lambda s: F.exists(F.split(s, "\x04"), lambda x: F.contains(t, x))
        fits = lambda k: F.exists(F.split(F.get(needs, k), "\x02"), lambda b: F.forall(F.split(b, "\x03"), one_of))
        led_to = lambda there: F.array_sort(F.array_distinct(F.flatten(F.transform(there, lambda i: F.split(F.get(led, i), ",").cast("array<int>")))))
        there = F.array_compact(F.transform(roots, lambda x, i: F.when(F.contains(t, x), i)))
        return let(there, lambda xs: some(xs, let(F.filter(led_to(xs), fits), lambda ks: some(ks, pattern(ks)))))

    return let(T.folded(text), searched)


def matches(df: DataFrame, id_col: str, text_col: str, regex: str, groups: int, most: int | None = None, gate: grammar.RuleIndex | None = None) -> DataFrame:
    """id, row_no, pos, whole, groups (array), start, end, start_line, end_line, lines_before, fresh_line: one row per match.

    lines_before: line ends before the match; fresh_line: 1 if one of them stands right before it.  row_no tells texts
    with equal ids apart.  most: how many characters of a text are searched; all of them without it.  gate: the index of the
    regex's rules; texts without any of its literals are not searched, the others for the alternatives whose literals they hold.
    """
    marks = _MATCH + "".join(f"{_FIELD}${i}" for i in range(1, groups + 1)) + f"{_FIELD}$0{_END}"
    raw = F.col(f"`{text_col}`")
    text = T.searched(raw, most)
    pattern = chosen_pattern(raw, gate) if gate else F.lit(regex)  # no filter: that would be moved before the texts are dealt over the cores
    split = let(pattern, lambda p: F.when(p.isNotNull(), F.split(F.regexp_replace(text, p, F.lit(marks)), _MATCH, -1)))
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row_no"), F.explode(F.array(split)).alias("parts"))
    parts = base.filter(F.size("parts") > 1).select("id", "row_no", F.posexplode("parts").alias("pos", "part"))
    halves = F.split("part", _END, 2)
    fields = F.split(halves[0], _FIELD, -1)
    behind = F.when(F.col("pos") > 0, F.get(halves, F.lit(1))).otherwise(F.col("part"))
    rows = parts.select(
        "id", "row_no", "pos", F.when(F.col("pos") > 0, F.get(fields, F.lit(groups + 1))).alias("whole"), F.when(F.col("pos") > 0, F.slice(fields, 2, groups)).alias("groups"),
        F.length(behind).alias("gap"), line_ends(behind).alias("gap_lines"), F.when(behind != "", F.endswith(behind, F.lit("\n"))).alias("gap_fresh"),
    )
    order = Window.partitionBy("row_no").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("lines", F.coalesce(line_ends(F.col("whole")), F.lit(0))).withColumn("size", F.coalesce(F.length("whole"), F.lit(0)))
    rows = rows.withColumn("at", F.sum(F.col("gap") + F.col("size")).over(upto) - F.col("gap")).withColumn("seen", F.sum(F.col("gap_lines") + F.col("lines")).over(upto) - F.col("gap_lines"))
    fresh = F.coalesce(F.lag("gap_fresh").over(order), F.lag(F.endswith("whole", F.lit("\n"))).over(order), F.lit(False)).cast("int")
    rows = rows.withColumn("fresh_line", fresh).filter("pos > 0")
    rows = rows.select("id", "row_no", "pos", "whole", "groups", (F.col("at") - F.col("size")).cast("int").alias("start"), F.col("at").cast("int").alias("end"), (F.col("seen") - F.col("lines")).cast("int").alias("lines_before"), "fresh_line")
    return rows.withColumn("start_line", line_within(F.lit(0))).withColumn("end_line", line_within(F.length("whole")))


def line_within(offset: Column) -> Column:
    """Line of a place in a match.  The first character of a line counts to the line before."""
    inside = line_ends(F.substring(F.col("whole"), F.lit(1), offset - 1))
    return (1 + F.col("lines_before") + F.when(offset <= 0, -F.col("fresh_line")).otherwise(inside)).cast("int")


def _license_party(c: Column, r: RuleSet) -> Column:
    return F.when(T.full_match(c, r.forbidden_licenses), "FORBIDDEN").when(T.full_match(c, r.third_licenses), "THIRD_PARTY").when(T.full_match(c, r.first_licenses), "FIRST_PARTY")


def _owner_party(c: Column, r: RuleSet) -> Column:
    return F.when(T.owner_match(c, r.forbidden_owners), "FORBIDDEN").when(T.owner_match(c, r.third_owners), "THIRD_PARTY").when(T.owner_match(c, r.first_owners), "FIRST_PARTY")


def group_places() -> Column:
    """The groups of a match that hold anything: group, raw, g_start, g_end (in the match), from what stands before each.

    Where what stands before a group begins with the match, its length is the place; in the repeated part of the pattern a
    group is that of its last turn, so the last place of what was caught around it counts.
    """
    g, out = F.col("groups"), []
    for number, (before, raw, after, repeated) in enumerate(grammar.GROUPS, 1):
        part = lambda i: F.lit("") if not i else F.coalesce(F.get(g, F.lit(i - 1)), F.lit(""))
        a = F.length(part(before))
        if repeated:
            around = F.concat(part(before), part(raw), part(after))
            a = a + F.length("whole") - F.call_function("locate", F.reverse(around), F.reverse(F.col("whole"))) + 1 - F.length(around)
        out.append(F.struct(F.lit(number).alias("group"), part(raw).alias("raw"), a.cast("int").alias("a"), (a + F.length(part(raw))).cast("int").alias("b")))
    return F.filter(F.array(*out), lambda x: F.trim(x["raw"]) != "")


def scan(df: DataFrame, rules: RuleSet, id_col: str = "doc_id", text_col: str = "text", most: int | None = grammar.SEARCH_MAX) -> DataFrame:
    """id, ord, party, match_type, text, start_line, end_line, start, end: the findings of each text in order.

    most: the search window in characters; None scans whole texts.
    """
    m = matches(spread(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))), id_col, text_col, rules.master, grammar.GROUP_COUNT, most, rules.gate)
    # the matches are few; written once, the master pattern runs once
    m = cut(m.select("id", "row_no", "pos", "whole", "start", "end", "start_line", "end_line", "lines_before", "fresh_line", group_places().alias("groups"), T.normalize_license(F.col("whole")).alias("shown")), "matches")

    # groups: excluded and blank ones go, the others always give a finding
    g = m.select("*", F.explode("groups").alias("g")).select("*", "g.*").drop("g")
    g = g.filter(~T.found_any(F.col("raw"), rules.excludes))
    g = g.withColumn("sl", line_within(F.col("a"))).withColumn("el", line_within(F.col("b"))).withColumn("g_start", F.col("start") + F.col("a")).withColumn("g_end", F.col("start") + F.col("b"))
    g = g.withColumn("lic", T.normalize_license(F.col("raw"))).withColumn("own", T.normalize_owner(F.col("lic")))
    known, owner = _license_party(F.col("lic"), rules), _owner_party(F.col("own"), rules)
    says_license = F.lower("lic").rlike("licen[sc]e")
    unknown = (F.col("group") <= 3) | says_license
    g = g.withColumn("known", known)
    g = g.withColumn("party", F.coalesce("known", F.when(unknown, F.lit("UNKNOWN")), owner, F.lit("THIRD_PARTY")))
    g = g.withColumn("match_type", F.when(F.col("known").isNotNull() | unknown, "LICENSE").otherwise("AUTHOR_OWNER"))
    found = g.select("id", "row_no", F.lit(0).alias("late"), "pos", "group", "party", "match_type", F.col("shown").alias("text"), F.col("sl").alias("start_line"), F.col("el").alias("end_line"), F.col("g_start").alias("start"), F.col("g_end").alias("end"))

    # fall-back: matches that gave nothing, while no license has been seen
    per = found.groupBy("row_no", "pos").agg(F.count("*").alias("built"), F.sum(F.when(F.col("match_type") == "LICENSE", 1).otherwise(0)).alias("licenses"))
    order = Window.partitionBy("row_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = m.drop("groups", "lines_before", "fresh_line").join(per, ["row_no", "pos"], "left").na.fill(0, ["built", "licenses"])
    f = f.withColumn("before", F.sum("licenses").over(order)).withColumn("ever", F.sum("licenses").over(Window.partitionBy("row_no")))
    f = f.filter((F.col("built") == 0) & (F.col("before") == 0) & ~F.col("shown").rlike(r"(?i)\Ano copyright(?:able)?") & ~T.found_any(F.col("whole"), rules.excludes))
    f = f.withColumn("own", T.normalize_owner(F.col("shown"))).withColumn("lp", _license_party(F.col("shown"), rules)).withColumn("op", _owner_party(F.col("own"), rules))
    f = f.withColumn("hit", F.coalesce("lp", "op"))
    vague = F.col("hit").isNull()
    prior = Window.partitionBy("row_no", "vague").orderBy("pos")
    f = f.withColumn("vague", vague)
    far = (F.col("start_line") - F.lag("end_line").over(prior) >= 6) & (F.col("start") - F.lag("end").over(prior) >= 300)
    f = f.withColumn("opens", F.when(F.col("vague"), F.coalesce(far, F.lit(True))).otherwise(F.lit(False)))
    f = f.withColumn("session", F.sum(F.col("opens").cast("int")).over(order)).filter(F.col("session") <= grammar.CLUSTERS_MAX)
    by_hit = f.filter(~F.col("vague")).select("id", "row_no", F.lit(0).alias("late"), "pos", F.lit(0).alias("group"), F.col("hit").alias("party"), F.when(F.col("lp").isNotNull(), "LICENSE").otherwise("AUTHOR_OWNER").alias("match_type"), F.col("shown").alias("text"), "start_line", "end_line", "start", "end")
    words = F.array_sort(F.collect_list(F.struct("pos", "shown")))
    clusters = f.filter(F.col("vague") & (F.col("ever") == 0)).groupBy("row_no", "session").agg(
        F.first("id").alias("id"), F.min("pos").alias("pos"), F.array_join(F.transform(words, lambda x: x["shown"]), "...").alias("text"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("start").alias("start"), F.max("end").alias("end"))
    clusters = clusters.select("id", "row_no", F.lit(1).alias("late"), "pos", F.lit(0).alias("group"), F.lit("UNKNOWN").alias("party"), F.lit("LICENSE").alias("match_type"), "text", "start_line", "end_line", "start", "end")
    every = found.unionByName(by_hit).unionByName(clusters)
    number = Window.partitionBy("row_no").orderBy("late", "pos", "group")
    return every.select("id", F.row_number().over(number).alias("ord"), "party", "match_type", "text", "start_line", "end_line", "start", "end")
