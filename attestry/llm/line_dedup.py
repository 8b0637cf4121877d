"""Line dedup with compressed per-document keep bitmaps.

Line keys become 128-bit hashes; occurrences (hash, document, position) are range-partitioned by hash, sorted within
by document and position, and streamed: the first document of a run keeps its lines, later ones lose theirs once
enough documents hold the key.  Only positions travel back, as runs of kept lines per document, never text.

A key that alone holds more than 1/1024 of all occurrences, or more than TASK_ROWS, would burden one range.  Document counts
and last documents of such keys are pre-aggregated and broadcast, and their occurrences are judged in place; the limit rises
with the table where more than SENT_KEYS keys could pass it, so what is sent is bounded at every size.

Defined cases: null or empty text is one empty line, kept.  Documents are told apart by doc_id, null being one that ranks
below every other: rows that share a doc_id count once among the holders of a line, and each keeps or loses it alike, exact
repetitions included.  The largest doc_id keeps a line in all its rows and places.  Texts of any length are split whole; an
array of a text's lines is in memory at a time.  An empty table gives an empty result.  Further columns pass through,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, crowd, cut, let, packed, two_hashes


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def row_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc_id, rid, pos, h1, h2 of every line whose key has min_chars code points."""
    text = F.col(f"`{text_col}`")
    lines = df.select(F.col(f"`{id_col}`").alias("doc_id"), row_id(text).alias("rid"), F.posexplode(split_lines(text)).alias("pos", "line"))
    # a key is no longer than its line: most short lines never get a key
    keyed = lines.filter(F.length("line") >= min_chars).select("doc_id", "rid", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    h1, h2 = two_hashes(F.col("key"))
    return keyed.select("doc_id", "rid", "pos", h1.alias("h1"), h2.alias("h2"))


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, hot_share: float = 1 / 1024, hot_least: int = 4096) -> DataFrame:
    """doc_id, rid, pos of the lines that go."""
    occ = cut(occurrences(df, id_col, text_col, min_chars), "line-occurrences")
    total = occ.count()
    many = crowd(total, hot_least, hot_share)
    hot_keys = occ.groupBy("h1", "h2").count().filter(F.col("count") > many).select("h1", "h2")  # at most total / many keys
    n_hot = 0
    if total > many:
        hot_keys = cut(hot_keys, "line-hot")
        n_hot = hot_keys.count()
    cold = occ
    gone = []
    if n_hot:
        hot_occ = occ.join(F.broadcast(hot_keys), ["h1", "h2"])
        holders = hot_occ.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        facts = holders.groupBy("h1", "h2").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("last_doc")).filter(F.col("n_docs") >= min_docs)
        gone.append(hot_occ.join(F.broadcast(facts), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).select("doc_id", "rid", "pos"))
        cold = occ.join(F.broadcast(hot_keys), ["h1", "h2"], "left_anti")
    run = Window.partitionBy("h1", "h2")
    stream = run.orderBy(F.col("doc_id").desc_nulls_last())
    ranked = cold.repartitionByRange("h1", "h2").select(
        "doc_id", "rid", "pos", "h1", "h2", F.dense_rank().over(stream).alias("rank"), F.first("doc_id").over(stream).alias("last_doc"))
    judged = ranked.withColumn("n_docs", F.max("rank").over(run)).filter((F.col("n_docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    gone.append(judged.select("doc_id", "rid", "pos"))
    return gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """doc_id, rid, runs, n_dropped: each document's dropped lines as sorted runs (first, last), a run-length bitmap."""
    def runs(p: Column) -> Column:
        starts = F.filter(p, lambda x, i: ~F.get(p, i - 1).eqNullSafe(x - 1))
        ends = F.filter(p, lambda x, i: ~F.get(p, i + 1).eqNullSafe(x + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

    sets = dropped.groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("p"))
    return sets.select("doc_id", "rid", F.size("p").cast("long").alias("n_dropped"), let(F.sort_array("p"), runs).alias("runs"))


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines outside the runs: one slice between each two neighbours."""
    after = lambda k: F.coalesce(F.get(runs, k - 1)["last"] + 1, F.lit(0))  # noqa: E731  first line behind run k - 1
    upto = lambda k: F.coalesce(F.get(runs, k)["first"], F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda k: F.slice(lines, after(k) + 1, upto(k) - after(k))))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """row (all columns of df), kept_text, n_lines, n_dropped, runs."""
    maps = drop_bitmaps(dropped_lines(df, id_col, text_col, **how))
    text = F.col(f"`{text_col}`")
    docs = df.select(packed(df).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), row_id(text).alias("rid"), text.alias("text"))
    m = maps.select(F.col("doc_id").alias("m_doc"), F.col("rid").alias("m_rid"), "runs", "n_dropped")
    both = docs.join(m, F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("rid") == F.col("m_rid")), "left")
    kept = let(split_lines(F.col("text")), lambda ls: F.array_join(kept_lines(ls, F.col("runs")), "\n"))
    newlines = F.size(split_lines(F.col("text"))).cast("long")
    return both.select("row", F.when(F.col("runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
                       newlines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "runs")


def strip_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df with repeated lines taken out of its text; every other column as it was."""
    out = dedup_lines(df, id_col, text_col, **how)
    changed = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row")[text_col])
    return out.select(*[(changed.alias(c) if c == text_col else F.col("row")[c].alias(c)) for c in df.columns])


def digest(df: DataFrame) -> DataFrame:
    out = dedup_lines(df)
    return out.select(F.col("row")["doc_id"].alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
