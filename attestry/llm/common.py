"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import cut, shared_dir  # noqa: F401  used by the operators

#: The characters [\x20\x09-\x0D], as text and as a Java regex class.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = r"[ \t-\r]"
#: So many rows of one key at most are left to one task; so many keys at most are broadcast.
TASK_ROWS, SENT_KEYS = 4_000_000, 1 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what one Arrow batch holds: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda variable is bound, a column reference may be inlined."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RE + "+"))


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that names made inside an operator cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def two_hashes(c: Column) -> list[Column]:
    """128 bits of hash: xxhash64 from two seeds."""
    return [F.xxhash64(c), F.xxhash64(F.lit(7), c)]


def crowd(total: int, least: int = 4096, share: float = 1 / 1024) -> int:
    """Rows of a key beyond which it is taken apart: a share of all rows, TASK_ROWS at most, unless more than SENT_KEYS keys
    could pass that."""
    return max(least, min(int(total * share), TASK_ROWS), total // SENT_KEYS)
