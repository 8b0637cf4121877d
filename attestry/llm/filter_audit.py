"""Filter interaction audit: what each of five filters removes at each place of each order, and what would go anyway.

A relational word pipeline: words are exploded, counted by (document, word) and then by document for totals and distinct
words.  The other flags come from the text itself, exact copies from hashes of the texts.  Flags and word counts meet in
an outer join and make a mask of failed filters for each document; a part of the table becomes 32 conditional counts,
from which all 120 orders follow by arithmetic.

Copies of a text fail the same filters but for the duplicate filter, so they are counted together before they are shuffled:
one row for each task, text, part and label.  A text, word, part or repeated row that holds a third of the table makes no large
group anywhere.  A text moves once, to the task that counts its words.

Defined cases: a null text is empty; it has no words, fails A and no other filter but, if an earlier text is empty too, E.  Very long
texts are rows of words like any other.  A null lang is the part "", as is an empty one.  Documents with a null doc_id
are identical to no smaller one and make none a duplicate; equal ids are not smaller than each other, so rows
repeated with their id each count and are no duplicates of each other.  A document counts as good or toxic if any of its label
rows says so; null labels say nothing.  A table without rows gives no parts.  Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

FILTERS = "ABCDE"
MASKS = range(1 << len(FILTERS))
SYMBOLS = "#$%&*|"


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def _keyed(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """k1, k2: a document, by its id and text."""
    doc, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.xxhash64(doc, text).alias("k1"), F.xxhash64(F.lit(7), F.coalesce(doc, F.lit(0)), text).alias("k2"), *more)


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2, n_words, n_distinct of the documents that have words; words of rows repeated with their id add up.

    Texts are dealt by document first, so that both counts need no shuffle of words: a text is smaller than its pairs of
    (document, word).  The input split is part of the key, so a row repeated everywhere is dealt over all tasks.
    """
    dealt = _keyed(df, id_col, text_col, F.spark_partition_id().alias("split"), F.col(f"`{text_col}`").alias("text")).repartition("k1", "k2", "split")
    each = dealt.select("k1", "k2", "split", F.explode(words(F.col("text"))).alias("word"))
    by_word = each.groupBy("k1", "k2", "split", "word").agg(F.count("*").alias("n"))
    by_doc = by_word.groupBy("k1", "k2", "split").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))
    return by_doc.groupBy("k1", "k2").agg(F.sum("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def text_flags(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """k1, k2, doc_id, part, h1, h2 (the text), caps, symbol (filters C and D), n: rows that are equal in all of these."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    cols = [
        F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"),
        (100 * capitals.cast("long") > 3 * F.length(text).cast("long")).alias("caps"), text.rlike(f"[{SYMBOLS}]").alias("symbol"),
    ]
    return _keyed(df, id_col, text_col, *cols).groupBy("k1", "k2", "doc_id", "part", "h1", "h2", "caps", "symbol").agg(F.count("*").alias("n"))


def masks(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask (bit k: fails filter k), good, toxic, n: how many documents."""
    flags = text_flags(df, id_col, text_col, part_col)
    # the words of rows repeated under several parts were counted together
    times = flags.groupBy("k1", "k2").agg(F.sum("n").alias("times"))
    counted = times.join(word_counts(df, id_col, text_col), ["k1", "k2"], "left")
    total = F.coalesce(F.col("n_words"), F.lit(0)) / F.col("times")
    few, dull = total < 200, 100 * F.coalesce(F.col("n_distinct"), F.lit(0)) < 50 * total
    by_words = counted.select("k1", "k2", few.alias("few"), dull.alias("dull"))
    # null ids, which no label names, are dealt over all tasks
    aside = F.when(F.col("doc_id").isNull(), F.pmod("k1", F.lit(4096))).otherwise(0)
    said = labels.groupBy(F.col("doc_id").alias("l_doc")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    said = said.withColumn("l_aside", F.lit(0))
    docs = flags.withColumn("aside", aside.cast("int"))
    docs = docs.join(said, (F.col("doc_id") == F.col("l_doc")) & (F.col("aside") == F.col("l_aside")), "left").join(by_words, ["k1", "k2"], "left")
    failed = [F.col("few"), F.col("dull"), F.col("caps"), F.col("symbol")]
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failed)), F.lit(0))
    docs = docs.select("h1", "h2", "part", "doc_id", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), mask.cast("int").alias("mask"), "n")
    # one cell for each text, part and label: how many documents, how many have its smallest id, how many none
    cells = docs.groupBy("h1", "h2", "part", "good", "toxic", "mask").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    first = F.col("least") == F.min("least").over(Window.partitionBy("h1", "h2"))
    cells = cells.select("part", "good", "toxic", "mask", "n", (F.col("n_null") + F.when(first, F.col("n_least")).otherwise(0)).alias("originals"))
    both = F.array(F.struct("mask", F.col("originals").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(bit("E"))).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    return cells.select("part", "good", "toxic", F.inline(both)).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def conditional_counts(by_mask: DataFrame) -> DataFrame:
    """part, n, good, toxic: arrays of 32 counts, by mask."""
    def columns(name: str, counts: Column) -> list[Column]:
        return [F.sum(F.when((F.col("mask") == k) & counts, F.col("n")).otherwise(0)).cast("long").alias(f"{name}{k}") for k in MASKS]

    wide = by_mask.groupBy("part").agg(*columns("n", F.lit(True)), *columns("good", F.col("good")), *columns("toxic", F.col("toxic")))
    return wide.select("part", *[F.array(*[F.col(f"{name}{k}") for k in MASKS]).alias(name) for name in ("n", "good", "toxic")])


def orders() -> Column:
    """All steps of all orders: order, step, name, b (the filter's bit), before (bits of the filters before it)."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            rows.append({"filter_order": "".join(order), "step": step, "b": bit(name), "before": before})
            before |= bit(name)
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,b:int,before:int>>")


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = conditional_counts(masks(df, labels, id_col, text_col, part_col))
    steps = counts.select("part", "n", "good", "toxic", F.inline(orders()))
    b, before = F.col("b"), F.col("before")

    def total(counts: str, holds) -> Column:
        return F.aggregate(F.transform(F.col(counts), lambda c, k: F.when(holds(k), c).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, c: a + c)

    fails = lambda k: k.bitwiseAND(b) != 0
    removed = lambda k: fails(k) & (k.bitwiseAND(before) == 0)
    # how many orders have no other failed filter of the mask before this one
    wins = {m: factorial(len(FILTERS)) // m.bit_count() for m in MASKS if m}
    turns = F.array(*[F.lit(wins.get(m, 0)).cast("long") for m in MASKS])
    shapley = F.aggregate(F.transform(F.col("n"), lambda c, k: F.when(fails(k), c * F.get(turns, k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, c: a + c)
    return steps.select(
        "part", "filter_order", "step", total("n", lambda k: k.bitwiseAND(b.bitwiseOR(before)) == 0).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda k: fails(k) & (k.bitwiseAND(before) != 0)).alias("redundant"), total("n", lambda k: k == b).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), shapley.alias("shapley"),
    )
