"""Sinks: finding lines, errors, metrics and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def finding_lines(findings: DataFrame, stack: str = "path_stack", size: str = "size", elapsed: str = "elapsed_us") -> DataFrame:
    """value: PARTY TYPE [lines) [offsets) length time size path text."""
    span = F.format_string("%s %s [%d,%d) [%d,%d) %d %dus %d ", "party", "match_type", "start_line", "end_line", "start", "end", F.length("text"), F.col(elapsed), F.col(size))
    return findings.select(F.concat(span, T.path_stack(F.col(stack)), F.lit(" "), T.escaped_path(F.col("text"))).alias("value"))


def write_lines(findings: DataFrame, path: str, **columns: str) -> None:
    finding_lines(findings, **columns).write.mode("overwrite").text(path)


def errors(texts: DataFrame) -> DataFrame:
    return texts.filter(F.col("error").isNotNull()).select("path_stack", "error")


def exit_code(texts: DataFrame) -> int:
    """0 without errors, 2 with."""
    return 0 if errors(texts).isEmpty() else 2


def observed(texts: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """texts, and counts that are filled when it is read: files, bytes, the longest, errors."""
    o = Observation(name)
    return texts.observe(o, F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.count("error").alias("errors")), o


def write_review(verdicts: DataFrame, comments: DataFrame, path: str, batch: int = 0) -> None:
    """Both under a folder of the batch, replacing what stands there; read back, batch is a column."""
    verdicts.write.mode("overwrite").parquet(f"{path}/verdicts/batch={batch}")
    comments.write.mode("overwrite").parquet(f"{path}/comments/batch={batch}")


def counters(scanned: DataFrame, *by: str) -> DataFrame:
    """n_scans by the given columns (project, branch), and where scanned has them: n_errors, total_us and max_us of
    elapsed_us, n_bytes and max_bytes of size, n_binary files with odd bytes."""
    made = [F.count("*").alias("n_scans")]
    if "error" in scanned.columns:
        made.append(F.count("error").alias("n_errors"))
    if "elapsed_us" in scanned.columns:
        made += [F.sum("elapsed_us").alias("total_us"), F.max("elapsed_us").alias("max_us")]
    if "size" in scanned.columns:
        made += [F.sum("size").alias("n_bytes"), F.max("size").alias("max_bytes")]
    if "n_odd" in scanned.columns:
        made.append(F.count_if(F.col("n_odd") > 0).alias("n_binary"))
    return scanned.groupBy(*by).agg(*made)


def throughput(scanned: DataFrame, seconds: float) -> DataFrame:
    """counters of everything, with files and bytes a second; the largest file and the longest time are the high-water marks."""
    rate = lambda c: F.col(c) / F.lit(max(seconds, 1e-9))
    return counters(scanned).withColumns({"files_per_s": rate("n_scans"), "bytes_per_s": rate("n_bytes")})


# --- timers ---------------------------------------------------------------------------------------------------------

#: Size of a quantile sketch: the rank of a quantile is then within RANK_ERROR of the one asked for, in 99 of 100 cases.
SKETCH_K, RANK_ERROR = 400, 0.0072


def timers(scanned: DataFrame, *by: str, value: str = "elapsed_us") -> DataFrame:
    """n, total, least, most and a sketch of the values by the given columns (project, branch); few rows, however much was scanned.

    Null values are not counted; a group with no other value has n 0 and no sketch.  Null groups are groups.
    """
    v = F.col(f"`{value}`").cast("long")
    made = scanned.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_bigint(v, SKETCH_K).alias("sketch"))
    return made.withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))


def merged_timers(made: DataFrame, *by: str) -> DataFrame:
    """Timers of several batches as one row for each group, as if all had been scanned at once."""
    return made.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def timer_quantiles(made: DataFrame, *by: str, ranks: dict[str, float] | None = None) -> DataFrame:
    """by, n, total, least, most, mean and the quantiles by name; null where a group has no values."""
    some = F.col("n") > 0
    q = [F.when(some, F.kll_sketch_get_quantile_bigint("sketch", F.lit(r))).alias(k) for k, r in (ranks or {"p50": 0.5, "p90": 0.9, "p99": 0.99}).items()]
    return made.select(*by, "n", "total", "least", "most", F.when(some, F.col("total") / F.col("n")).alias("mean"), *q)


def write_timers(made: DataFrame, path: str, batch: int = 0) -> None:
    """The timers of a batch under its own folder: a repeated batch replaces what it wrote."""
    made.write.mode("overwrite").parquet(f"{path}/timers/batch={batch}")


def read_timers(spark: SparkSession, path: str, *by: str) -> DataFrame:
    """The timers of all batches written so far, merged."""
    return merged_timers(spark.read.parquet(f"{path}/timers"), *by)
