"""Mixing sources to target weights by Pfair scheduling.

Every source is a stream of equal blocks.  With weight w of a total W, its k-th block is released at slot
floor(k W / w) and due at ceil((k + 1) W / w).  Earliest deadline first over the released blocks puts each block between
its release and its deadline, so at every slot each source is within one block of its exact share.  When a source ends,
the others go on with their weights renormalised, from that slot as zero; nothing is dropped or repeated.

Within such a stretch the schedule repeats after W slots.  The plan is therefore a short table made from weights and
block counts alone: per stretch and source the slots of one period.  There is no bound on sources or weights: a plan of
over SENT_SLOTS slots is not sent to the tasks but written and joined.  Streams are divided into ranges of blocks, and a
block meets the stretches within its range only: a source that holds most rows is joined by many tasks, and the rows of a
join do not grow with the number of stretches.  Blocks find their slot there by arithmetic.  Ranks within a source come from
counts of hash buckets plus ranks within a bucket, so such a source is ranked by many tasks as well.

The plan has a row for each stretch and each source still left in it: the driver passes them on part by part and keeps no
more than a part, but time grows with the square of the sources that have a weight.

Defined cases: sources without a weight, null included, share the stream `rest`; a last block may be short; rows with
equal id are ordered by the hash of their other columns, and equal rows get different positions; rows without an id are
dealt by the hash of all their columns; texts of any length pass through unread; an empty table gives an empty result; all
columns pass through as struct row, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush
from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, shared_dir

#: So many slots of a plan are sent to all tasks; a larger plan is a table that is joined.
SENT_SLOTS = 1 << 18
#: Blocks in a range where the plan is a table.
RANGE_BLOCKS = 4096
REST = "rest"


def period(weights: dict[str, int], left: dict[str, int]) -> tuple[dict[str, list[int]], int | None]:
    """Slots of each stream within one period, by earliest deadline among released blocks, ties by name; and the slot at
    which a stream runs out of its left blocks, where the list ends, or None."""
    total = sum(weights.values())
    waiting: list[tuple[int, str, int]] = []
    ready: list[tuple[int, str, int]] = []
    for name in weights:
        heappush(waiting, (0, name, 0))
    slots: dict[str, list[int]] = {name: [] for name in weights}
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, name, k = heappop(waiting)
            heappush(ready, (-(-(k + 1) * total // weights[name]), name, k))
        _, name, k = heappop(ready)
        slots[name].append(t)
        if k + 1 == left[name]:
            return slots, t
        heappush(waiting, ((k + 1) * total // weights[name], name, k + 1))
    return slots, None


def plan(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[dict]:
    """Rows (stream, first, n, base, weight, total, slots): blocks first ... first + n - 1 of a stream in one stretch.

    A stretch lists the slots of one period, or of itself where it is shorter, so all lists hold no more slots than there
    are blocks.
    """
    left, done, base = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0
    while left:
        g = gcd(*[weights[k] for k in left])
        w = {k: weights[k] // g for k in sorted(left)}
        total = sum(w.values())
        slots, last = period(w, left)
        end = 1 + (last if last is not None else min((n - 1) // w[k] * total + slots[k][(n - 1) % w[k]] for k, n in left.items()))
        for k in w:
            n = end // total * w[k] + bisect_left(slots[k], end % total)
            yield {"stream": k, "first": done[k], "n": n, "base": base, "weight": w[k], "total": total, "slots": slots[k]}
            done[k] += n
            left[k] -= n
        base += end
        left = {k: n for k, n in left.items() if n}


_PLAN = "stream string, first bigint, n bigint, base bigint, weight bigint, total bigint, slots array<bigint>"


def plan_table(spark: SparkSession, rows: Iterator[dict], blocks: int) -> tuple[DataFrame, int]:
    """The plan by ranges of blocks, and the blocks in a range: from a literal, to be broadcast, while it is small; else from a
    table in the shared folder, written part by part."""
    path, part, size, widest = None, [], 0, 1

    def literal() -> DataFrame:
        shape = "array<struct<" + _PLAN.replace(" ", ":").replace(",:", ",") + ">>"
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(part)), shape)))

    for r in rows:
        if not r["n"]:
            continue
        part.append(r)
        size += len(r["slots"]) + 8
        widest = max(widest, len(r["slots"]))
        if size > SENT_SLOTS:
            path = path or f"{shared_dir(spark)}/mixing-plan-{uuid.uuid4().hex}"
            literal().write.mode("append").parquet(path)
            part, size = [], 0
    if path is None:  # ranges so wide that they repeat SENT_SLOTS slots at most
        width = max(64, -(-blocks * widest // SENT_SLOTS))
        return F.broadcast(by_range(literal(), width)), width
    if part:
        literal().write.mode("append").parquet(path)
    return by_range(spark.read.schema(_PLAN).parquet(path), RANGE_BLOCKS), RANGE_BLOCKS


def by_range(stretches: DataFrame, width: int) -> DataFrame:
    """Each stretch once for every range of width blocks that it meets, with the slots of its blocks there or of one period,
    whichever are fewer; skip: blocks of the stretch before the first of those slots."""
    number = lambda block: F.floor(block / F.lit(width)).cast("long")
    at = stretches.withColumn("range", F.explode(F.sequence(number(F.col("first")), number(F.col("first") + F.col("n") - 1))))
    low = F.greatest(F.lit(0), F.col("range") * width - F.col("first"))
    high = F.least(F.col("n"), (F.col("range") + 1) * width - F.col("first"))
    at = at.withColumns({"low": low, "high": high, "turn": low % F.col("weight")})
    part = F.slice("slots", F.col("turn").cast("int") + 1, (F.col("high") - F.col("low")).cast("int"))
    within = F.col("turn") + F.col("high") - F.col("low") <= F.col("weight")
    return at.withColumn("slots", F.when(within, part).otherwise(F.col("slots"))).withColumn("skip", F.when(within, F.col("turn")).otherwise(F.lit(0))).drop("low", "high", "turn")


def positions(df: DataFrame, weights: dict[str, int], rest: int = 1, block_docs: int = 8, id_col: str = "doc_id", source_col: str = "source", bucket_rows: int = 100_000) -> DataFrame:
    """row, doc_id, stream, block, released, deadline, slot, position (order of the mix)."""
    if min([rest, *weights.values()]) < 1 or any(int(w) != w for w in weights.values()):
        raise ValueError("weights must be whole numbers from 1")
    spark = df.sparkSession
    shares = {f"={k}": v for k, v in weights.items()} | {REST: rest}
    source = F.col(f"`{source_col}`")
    stream = F.when(source.isin(list(weights)), F.concat(F.lit("="), source)).otherwise(F.lit(REST))
    d = F.col(f"`{id_col}`")
    base = df.select(packed(df).alias("row"), d.alias("doc_id"), stream.alias("stream"), F.md5(F.coalesce(d.cast("string"), F.concat(F.lit("null "), F.xxhash64(packed(df)).cast("string"))).cast("binary")).alias("h"))

    sizes = {r["stream"]: r["n"] for r in base.groupBy("stream").agg(F.count("*").alias("n")).collect()}  # one row for each weight at most
    blocks = {k: -(-n // block_docs) for k, n in sizes.items()}
    schedule, width = plan_table(spark, plan(blocks, shares), sum(blocks.values()))

    digits, total = 1, sum(sizes.values())
    while total / 16**digits > bucket_rows and digits < 8:
        digits += 1
    base = base.withColumn("bucket", F.substring("h", 1, digits))
    counts = base.groupBy("stream", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("stream").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("stream", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("stream", "bucket").orderBy("h", "doc_id", F.xxhash64("row"))
    ranked = base.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["stream", "bucket"])
    n = F.col("offset") + F.col("r")
    block = F.floor(n / block_docs)
    placed = ranked.select("row", "doc_id", "stream", block.alias("block"), F.floor(block / width).alias("range"), (n % block_docs).alias("within"))
    mine = (F.col("block") >= F.col("first")) & (F.col("block") < F.col("first") + F.col("n"))
    k, w, tot = F.col("block") - F.col("first"), F.col("weight"), F.col("total")
    joined = placed.join(schedule, ["stream", "range"]).filter(mine)
    whole = lambda c: c.cast("long")
    out = joined.select(
        "row", "doc_id", "stream", "block", "within", (F.col("base") + F.floor(k * tot / w)).alias("released"), (F.col("base") + F.ceil((k + 1) * tot / w)).alias("deadline"),
        (F.col("base") + F.floor(k / w) * tot + F.get("slots", (k % w - F.col("skip")).cast("int"))).alias("slot"),
    )
    return out.select("row", "doc_id", "stream", whole(F.col("block")).alias("block"), whole(F.col("released")).alias("released"), whole(F.col("deadline")).alias("deadline"), whole(F.col("slot")).alias("slot"), whole(F.col("slot") * block_docs + F.col("within")).alias("position"))


def mix(df: DataFrame, weights: dict[str, int], rest: int = 1, block_docs: int = 8, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of df with slot and position, the order of the mix."""
    names = [c for c in ("slot", "position") if c not in df.columns]
    return positions(df, weights, rest, block_docs, id_col, source_col).select("row.*", *names)
