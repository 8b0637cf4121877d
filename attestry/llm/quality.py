"""Quality rules as a short-circuit cascade.

Each rule is a Column that is true where a document fails it.  Cost and selectivity of every rule are measured on a
sample, rules are ordered by rejections per second of cost, and the verdict is one CASE expression whose branches
Spark evaluates in that order and leaves at the first failure.  The order changes speed only, never the verdict.

Defined cases: a null text has no words and fails; an empty text likewise; repeated rows are judged alike; an empty
table gives an empty result; further columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RE, cut, let, packed, words


@dataclass(frozen=True)
class Thresholds:
    min_words: int = 50
    max_repeat_share: float = 0.5
    min_mean_word: float = 1.5
    max_mean_word: float = 25.0
    max_symbols_per_word: float = 0.25
    max_shouts_per_word: float = 0.5
    max_dup_line_share: float = 0.5


def count_words(w: Column) -> Column:
    return F.size(w).cast("long")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long")


def shouts(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("!"))


def written_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^ \t-\r]"))


def dup_lines(text: Column) -> Column:
    return let(written_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Window hashes are sorted with their positions, so equal windows stand side by side: n log n for any text.  Texts
    without a repeated window skip the sort.
    """
    n = F.size(w)

    def marked(s: Column) -> Column:
        same = lambda a, b: F.get(s, a)["h"].eqNullSafe(F.get(s, b)["h"])
        hit = F.filter(s, lambda x, k: same(k, k - 1) | same(k, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def counted(g: Column) -> Column:
        pairs = F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(F.sort_array(pairs), marked))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n < 4, F.lit(0)).otherwise(let(windows, counted)).cast("long")


def rules(text: Column, w: Column, t: Thresholds = Thresholds()) -> dict[str, Column]:
    """Name to a Column that is true where the rule rejects."""
    n = F.size(w)
    return {
        "few_words": n < t.min_words,
        "word_length": let(word_chars(w), lambda c: (c < t.min_mean_word * n) | (c > t.max_mean_word * n)),
        "symbols": symbols(text) > t.max_symbols_per_word * n,
        "shouting": shouts(text) > t.max_shouts_per_word * n,
        "dup_lines": let(written_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)) > t.max_dup_line_share * F.size(x)),
        "repeats": 100 * repeat_words(w) > 100 * t.max_repeat_share * n,
    }


def with_words(df: DataFrame, text: str) -> DataFrame:
    """One row per document: row (all its columns), text, w (its words, computed once)."""
    base = df.select(packed(df).alias("row"), F.col(f"`{text}`").alias("text"))
    return base.select("row", "text", F.explode(F.array(words(F.col("text")))).alias("w"))


def measured_order(df: DataFrame, text: str = "text", thresholds: Thresholds = Thresholds(), sample_rows: int = 2000) -> list[str]:
    """Rule names, most rejections per second first, as measured on about sample_rows documents."""
    names = list(rules(F.col("text"), F.col("w"), thresholds))
    total = df.count()
    if not total:
        return names
    share = min(1.0, sample_rows / total)
    sample = cut(with_words(df.select(F.col(f"`{text}`").alias("text")).sample(fraction=share, seed=1), "text").select("text", "w").coalesce(4), "quality-sample")

    def timed(c: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(F.count_if(c)).first()[0]
        return time.perf_counter() - began, hits

    timed(F.size("w") < 0)
    floor, _ = timed(F.size("w") < 0)
    rate = {}
    for name, rejects in rules(F.col("text"), F.col("w"), thresholds).items():
        s, hits = timed(rejects)
        rate[name] = hits / max(s - floor, 1e-3)
    return sorted(names, key=lambda x: -rate[x])


def verdict(order: list[str], rejects: dict[str, Column]) -> Column:
    """True where no rule rejects; branches are tried in the given order and the first hit ends the evaluation."""
    first, *rest = order
    chain = reduce(lambda c, name: c.when(rejects[name], F.lit(False)), rest, F.when(rejects[first], F.lit(False)))
    return chain.otherwise(F.lit(True))


def judge(df: DataFrame, text: str = "text", thresholds: Thresholds = Thresholds(), sample_rows: int = 2000) -> DataFrame:
    """df's columns as struct row, and kept."""
    order = measured_order(df, text, thresholds, sample_rows)
    d = with_words(df, text)
    return d.select("row", verdict(order, rules(F.col("text"), F.col("w"), thresholds)).alias("kept"))


def keep_good(df: DataFrame, text: str = "text", thresholds: Thresholds = Thresholds(), sample_rows: int = 2000) -> DataFrame:
    """The documents that pass every rule, with all their columns."""
    return judge(df, text, thresholds, sample_rows).filter("kept").select("row.*")


def measures(df: DataFrame, text: str = "text", id_col: str = "doc_id", thresholds: Thresholds = Thresholds(), sample_rows: int = 2000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    order = measured_order(df, text, thresholds, sample_rows)
    t, w = F.col("text"), F.col("w")
    d = with_words(df, text).select(
        F.col("row")[id_col].alias("doc_id"), "text", "w", count_words(w).alias("n_words"), word_chars(w).alias("word_chars"),
        symbols(t).alias("n_symbols"), dup_lines(t).alias("n_dup_lines"), F.explode(F.array(repeat_words(w))).alias("n_repeat_words"),
    )
    n, chars, rep = F.col("n_words"), F.col("word_chars"), F.col("n_repeat_words")
    failed = (n < 50) | (100 * rep > 50 * n)
    # The measures the digest shows anyway stand in for the expressions they came from.
    known = rules(t, w, thresholds) | {
        "few_words": n < thresholds.min_words,
        "word_length": (chars < thresholds.min_mean_word * n) | (chars > thresholds.max_mean_word * n),
        "symbols": F.col("n_symbols") > thresholds.max_symbols_per_word * n,
        "repeats": 100 * rep > 100 * thresholds.max_repeat_share * n,
    }
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                    F.when(failed, F.lit(False)).otherwise(verdict(order, known)).alias("kept"))
