"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An alignment is worth +1 for an equal word, -1 for a changed, added or left-out one; the best local one counts.  Score is
its value over the item's words; a copy is a score of `least` or more with at least `least_words` words, that is a value
of `need` or more.  With m equal words and e edits the equal words form e + 1 runs at most, so at least
m - e - 1 >= need - 1 of the item's word pairs stand unbroken in the copy.

The corpus is scanned once to count the items' word pairs.  The rarest pairs of an item become its seeds, so many that
fewer than need - 1 pairs are left: every copy holds a seed, wherever its edits are, and pairs that no document holds
count among the seeds without harm.  A second scan joins seeds to documents, keeps the places where need - 1 of the
item's pairs stand as near together as an alignment allows, and aligns them.  Both filters only skip what cannot be a copy.

Test items are taken in blocks of at most `block_bytes` of text, so what executors receive is bounded; more items
mean more blocks, and every document meets every block.

Defined cases: null or empty text holds no copy; null or empty items, and items of fewer than `shortest` words, match
nothing; repeated rows give equal results; of alignments that tie the one that ends first counts; texts of any length are
searched whole; empty tables give an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .license_scan import words

PAIR = 2  # words of a seed; the count of unbroken ones above holds for pairs
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("n_seeds", T.LongType())]))
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("n_seeds", pa.int64())]))


@dataclass(frozen=True)
class Settings:
    shortest: int = 2
    least: float = 0.5
    least_words: int = 8
    block_bytes: int = 16 << 20


class Block:
    """Test items as word numbers, and their pairs of words."""

    def __init__(self, items: list[tuple[int, str]], s: Settings):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.items: list[np.ndarray] = []
        for item_id, text in items:
            w = words((text or "").encode())
            if len(w) >= max(PAIR, s.shortest):
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64))
        self.grams = [self.hashes(x)[1] for x in self.items]
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.grams]))
        self.grams = [self.lookup(g) for g in self.grams]
        self.need = [math.ceil(max(s.least * len(x), min(s.least_words, len(x))) - 1e-9) for x in self.items]

    def numbers(self, w: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(x, 0) for x in w), np.int64, len(w))

    def hashes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs made of the items' words only, and their hashes."""
        n = len(ids) - PAIR + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = np.concatenate([[0], np.cumsum(ids > 0)])
        at = np.flatnonzero(inside[PAIR:] - inside[:-PAIR] == PAIR)
        h = np.zeros(len(at), np.uint64)
        for k in range(PAIR):
            h = (h ^ ids[at + k].astype(np.uint64)) * _MIX[k % len(_MIX)]
            h ^= h >> np.uint64(29)
        return at, h

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Index in known, or -1."""
        if not len(self.known):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[i] == h, i, -1)


def seeds(block: Block, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pair numbers with the item of each seed."""
    rows = set()
    for k, number in enumerate(block.grams):
        enough = len(number) - max(1, block.need[k] - 1) + 1
        rows.update((int(x), k) for x in number[np.argsort(counts[number], kind="stable")[:enough]])
    table = np.array(sorted(rows), np.int64).reshape(-1, 2)
    return table[:, 0], table[:, 1]


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: best value, first and last place of the alignment in part.

    A row's gaps within part are a running maximum, so each row is a few array operations.
    """
    n = len(part)
    j = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for x in item:
        step = np.where(part == x, 1, -1)
        up = row - 1
        new, start = np.zeros(n + 1, np.int64), j.copy()
        diagonal = row[:-1] + step
        take = diagonal > 0
        new[1:][take] = diagonal[take]
        start[1:][take] = begin[:-1][take]
        lower = up > new
        new[lower], start[lower] = up[lower], begin[lower]
        slope = new + j
        run = np.maximum.accumulate(slope)
        where = np.maximum.accumulate(np.where(slope == run, j, 0))
        row = run - j
        begin = np.where(row > 0, start[where], j)
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k - 1)
    return best


def regions(places: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Stretches of a document around seeds no further apart than reach."""
    cuts = np.flatnonzero(np.diff(places) > reach)
    first, last = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(places) - 1]])
    return [(int(places[a]), int(places[b])) for a, b in zip(first, last, strict=True)]


def crowded(places: np.ndarray, n: int, reach: int) -> np.ndarray:
    """First and last places of every n consecutive ones that lie within reach."""
    if len(places) < n:
        return places[:0]
    first, last = places[: len(places) - n + 1], places[n - 1 :]
    near = last - first <= reach
    return np.unique(np.concatenate([first[near], last[near]]))


def matches(block: Block, table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, at: np.ndarray, number: np.ndarray) -> list[dict]:
    """Copies of the block's items in one document; at and number: its known pairs."""
    gram, item = table
    lo, hi = np.searchsorted(gram, number, "left"), np.searchsorted(gram, number, "right")
    if not (hi > lo).any():
        return []
    size = hi - lo
    index = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    found = []
    for k, n in zip(*np.unique(item[index], return_counts=True), strict=True):
        text, need = block.items[k], block.need[k]
        reach = 2 * len(text)
        places = crowded(at[np.isin(number, block.grams[k])], max(1, need - 1), reach)
        best = (0, 0, 0)
        for a, b in regions(places, reach) if len(places) else ():
            a, b = max(0, a - reach), min(len(ids), b + reach + PAIR)
            part = ids[a:b]
            if np.isin(text, part).sum() < need:
                continue
            value, first, last = align(text, part)
            if value > best[0]:
                best = (value, a + first, a + last)
        if best[0] >= need:
            found.append({"item_id": block.ids[k], "score": best[0] / len(text), "first_word": best[1], "last_word": best[2], "n_seeds": int(n)})
    return found


def _known_grams(b: pa.Array, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of a batch that hold pairs of the block: index, word numbers, places and pair numbers."""
    parts = [block.numbers(words(x.as_py() or b"")) for x in b.cast(pa.binary())]
    gap = np.zeros(1, np.int64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    at, h = block.hashes(np.concatenate([y for p in parts for y in (p, gap)]) if parts else gap)
    number = block.lookup(h)
    at, number = at[number >= 0], number[number >= 0]
    doc = np.searchsorted(ends, at, "right")
    there = np.unique(doc)
    for i, lo, hi in zip(there.tolist(), np.searchsorted(doc, there, "left"), np.searchsorted(doc, there, "right"), strict=True):
        mine = slice(lo, hi)
        yield i, parts[i], at[mine] - (ends[i] - len(parts[i]) - 1), number[mine]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).filter("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        yield [(r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def tag(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", settings: Settings = Settings(), hits: str = "hits") -> DataFrame:
    """df with one more column: the benchmark items each document holds a copy of."""
    small_batches(df.sparkSession)
    out, names = df, []
    for items in blocks_of(benchmark, item_col, item_text, settings.block_bytes):
        block = Block(items, settings)

        def count(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(block.known), np.int64)
            for b in batches:
                for _, _, _, number in _known_grams(b.column(0), block):
                    np.add.at(total, number, 1)
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["gram", "n"])

        counts = np.zeros(len(block.known), np.int64)
        for r in df.select(F.col(f"`{text_col}`")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most a block's n-grams
            counts[r["gram"]] = r["n"]
        table = seeds(block, counts)
        at_col = df.columns.index(text_col)

        def search(batches: Iterator[pa.RecordBatch], block=block, table=table) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: list[list] = [[] for _ in range(b.num_rows)]
                for i, ids, at, number in _known_grams(b.column(at_col), block):
                    found[i] = matches(block, table, ids, at, number)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _HITS)], [*b.schema.names, "found"])

        names.append(f"{hits}_{len(names)}_")
        out = out.mapInArrow(search, T.StructType([*out.schema.fields, T.StructField(names[-1], HITS)]))
    fields = [F.col(f"`{c}`") for c in df.columns]
    return out.select(*fields, (F.concat(*names) if len(names) > 1 else F.col(names[0])).alias(hits))


def copies(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word, n_seeds: one row for each document and item it copies."""
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return tag(base, benchmark, settings=settings).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def keep_clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The documents without a copy of a test item, with all their columns."""
    name = "hits" + "_" * sum(c.startswith("hits") for c in df.columns)
    return tag(df, benchmark, text_col, settings=settings, hits=name).filter(F.size(f"`{name}`") == 0).drop(name)
