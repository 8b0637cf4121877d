"""Removal of repeated byte strings by blockwise suffix sorting over a cover sample.

Every suffix that could start a repeated string of `length` bytes is filed under a cover position inside its window:
the leftmost smallest k-gram hash among the window's k-grams.  Equal windows choose the same cover position at the
same offset, so suffixes of one bucket (same k-gram) and offset are the only ones that can tie.  A residue-based
difference cover would need an offset that depends on the pair compared, which cannot be a shuffle key; a cover chosen
by content plays its part here: about 2 in 386 positions are sampled, and two tied suffixes meet at a sampled one.

One bucket is sorted at a time.  Its sampled positions are ranked once by what follows and once by what precedes, with
the common prefix lengths of neighbours; a tie between suffixes is then decided by those two ranks, never by reading
bytes again.  Small buckets compare each two members, all buckets of a batch at once.  Buckets hold only k-grams that
occur twice or more; of each text only one copy takes part, and of places of a text with equal surroundings only one,
so a periodic text files a few places.

A bucket of over `bucket_max` such places, wherever they stand (a passage in a large share of all documents), is not
gathered: its windows are hashed to 128 bits and counted with map-side combination, whatever their number.

Two lengths are searched in one pass: strings of `length` bytes are removed, and strings of `passage` bytes (about 50
words) are reported as n_shared, the bytes they cover.  The cover of the shorter windows holds that of the longer ones.

Defined cases: null text is empty; texts shorter than `length` lose nothing; exact copies of at least that length lose
all their bytes in every copy (repeated rows are copies); texts of any length are read whole, and periodic ones cost no
more than others; ties do not arise, as every copy of a string is treated alike; an empty table gives an empty result;
only the id and text columns are read, whatever the others are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .simhash import join_facts

GRAM = 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def text_key(text: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(text)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def gram_hashes(text: bytes) -> np.ndarray:
    """Hash of the GRAM bytes from each position."""
    n = len(text) - GRAM + 1
    eight = lambda at: np.ndarray((n,), "<u8", text, at, (1,))
    h = eight(0) * _A
    h ^= h >> np.uint64(29)
    h += eight(8)
    h *= _B
    h ^= h >> np.uint64(32)
    h *= _C
    return h


def window_minima(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by minima of block heads and tails."""
    n = len(key)
    full = -(-n // w) * w
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(-1, w)
    heads = np.minimum.accumulate(rows, axis=1).ravel()
    tails = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tails[: n - w + 1], heads[w - 1 : n])


def cover(text: bytes, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions, their k-gram hashes, and for each length (rows) the smallest and largest offset of the windows
    filed under each position; a smallest offset above the largest where there are none.  lengths: ascending."""
    h = gram_hashes(text)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    pos = lo = hi = None
    for k, length in enumerate(lengths):
        if len(text) < length:
            break
        at = (window_minima(key, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        mine = at[first]
        if pos is None:  # positions of longer windows are among those of the shortest
            pos = mine
            lo, hi = np.ones((len(lengths), len(pos)), np.int64), np.zeros((len(lengths), len(pos)), np.int64)
        there = np.searchsorted(pos, mine)
        lo[k, there], hi[k, there] = mine - last, mine - first
    return pos, h[pos].view(np.int64), lo, hi


@dataclass
class Placed:
    """The cover of a text; of places with equal surroundings one is kept, and all of them are repeated."""

    pos: np.ndarray
    gram: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    keep: np.ndarray
    again: np.ndarray

    @classmethod
    def of(cls, text: bytes, lengths: tuple[int, ...]) -> Placed:
        pos, gram, lo, hi = cover(text, lengths)
        there = lo <= hi
        left, right = np.where(there, hi, 0).max(0), np.where(there, np.array(lengths)[:, None] - lo, 0).max(0)
        keep, again = np.ones(len(pos), bool), np.zeros(len(pos), bool)
        order = np.argsort(gram, kind="stable")
        same = gram[order][1:] == gram[order][:-1]
        twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        seen: dict[tuple, int] = {}
        for i, p, a, b, *ends in zip(*[x[twice].tolist() for x in (np.arange(len(pos)), pos, left, right, *lo, *hi)], strict=True):
            first = seen.setdefault((text[p - a : p + b], *ends), i)
            if first != i:
                keep[i] = False
                again[i] = again[first] = True
        return cls(pos, gram, lo, hi, left, right, keep, again)

    def repeated(self, kind: int, length: int) -> np.ndarray:
        """(s, e) ranges, merged, of the windows that stand twice in the text as their whole surroundings do."""
        use = self.again & (self.lo[kind] <= self.hi[kind])
        s, e = self.pos[use] - self.hi[kind, use], self.pos[use] - self.lo[kind, use] + length
        if not len(s):
            return np.zeros((0, 2), np.int64)
        top = np.maximum.accumulate(e)
        gap = np.flatnonzero(s[1:] > top[:-1])
        return np.stack([s[np.concatenate([[0], gap + 1])], top[np.concatenate([gap, [len(s) - 1]])]], 1)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def ranges_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def tied_offsets(left: list[bytes], right: list[bytes], lo: list[int], hi: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each sampled position of a bucket the offset ranges whose windows occur at another one.

    left: what precedes, reversed; right: what follows.
    """
    n = len(left)

    def ranked(side: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        order = sorted(range(n), key=side.__getitem__)
        return np.array(order), np.array([common_prefix(side[a], side[b]) for a, b in zip(order, order[1:])])

    by_right, same_right = ranked(right)
    by_left, same_left = ranked(left)
    least, most = np.array(lo), np.array(hi)
    hit = np.zeros((int(most.max()) + 1, n), bool)
    code = np.empty(n, np.int64)
    mine = np.empty(n, np.int64)
    for o in range(int(least.min()), len(hit)):
        code[by_right] = np.concatenate([[0], np.cumsum(same_right < length - o)])
        mine[by_left] = np.concatenate([[0], np.cumsum(same_left < o)])
        there = np.flatnonzero((least <= o) & (o <= most))
        _, back, count = np.unique(code[there] * n + mine[there], return_inverse=True, return_counts=True)
        hit[o, there] = count[back] > 1
    return [ranges_of(np.ascontiguousarray(hit[:, x])) for x in range(n)]


def common_lengths(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many bytes agree from places a and b of data on, forwards (step 1) or backwards (-1), most at most."""
    out, live, done = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    k = np.arange(64)
    while len(live):
        i = a[live, None] + step * (done + k)
        j = b[live, None] + step * (done + k)
        top = len(data) - 1
        differ = (data[np.clip(i, 0, top)] != data[np.clip(j, 0, top)]) | (done + k >= most[live, None])
        same = np.where(differ.any(1), differ.argmax(1), 64)
        out[live] += same
        live = live[same == 64]
        done += 64
    return out


@dataclass
class Filed:
    """Sampled positions, sorted by gram: one row each, with the bytes around it in data."""

    gram: np.ndarray
    text: np.ndarray  # (n, 2) hash of the text
    pos: np.ndarray
    lo: np.ndarray  # (lengths, n)
    hi: np.ndarray
    left: np.ndarray  # bytes before the position
    again: np.ndarray  # repeated within its text
    kind: np.ndarray  # where 0 or more: no place, but a range [pos, upto) that is repeated within its text
    upto: np.ndarray
    data: np.ndarray
    at: np.ndarray  # (n + 1) places in data

    @classmethod
    def of(cls, table: pa.Table, n_lengths: int) -> Filed:
        t = table.combine_chunks()
        col = lambda c: t.column(c).to_numpy(zero_copy_only=False)
        around = t.column("around").chunk(0)
        at = np.frombuffer(around.buffers()[1], np.int32)[around.offset : around.offset + len(around) + 1].astype(np.int64)
        lo, hi = (np.stack([col(f"{x}{k}") for k in range(n_lengths)]).astype(np.int64) for x in ("lo", "hi"))
        return cls(col("gram"), np.stack([col("t1"), col("t2")], 1), col("pos"), lo, hi, col("left").astype(np.int64), col("again"), col("kind"), col("upto"), np.frombuffer(around.buffers()[2], np.uint8), at)

    def around(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def spans(self, rows: np.ndarray, least: np.ndarray, most: np.ndarray, kind: int, length: int) -> np.ndarray:
        """(kind, t1, t2, s, e) of ranges of repeated offsets."""
        return np.stack([np.full(len(rows), kind), self.text[rows, 0], self.text[rows, 1], self.pos[rows] - most, self.pos[rows] - least + length], 1)


PAIRS_MAX = 48


def repeated_in_buckets(f: Filed, lengths: tuple[int, ...]) -> np.ndarray:
    """(kind, t1, t2, s, e): what is repeated within the buckets of f."""
    n = len(f.gram)
    start = np.flatnonzero(np.concatenate([[True], f.gram[1:] != f.gram[:-1]]))
    size = np.diff(np.concatenate([start, [n]]))
    told = np.flatnonzero(f.kind >= 0)
    out = [np.stack([f.kind[told], f.text[told, 0], f.text[told, 1], f.pos[told], f.upto[told]], 1).astype(np.int64)]
    done = np.zeros(n, bool)  # rows with the same surroundings as another one: all their windows are repeated
    members: dict[int, list[np.ndarray]] = {}
    for a, k in zip(start.tolist(), size.tolist(), strict=True):
        if k == 1 or (f.kind[a : a + k] >= 0).all():
            continue
        if k == 2:
            members.setdefault(2, []).append(np.array([a, a + 1]))
            continue
        kinds: dict[tuple, list[int]] = {}
        for i in range(a, a + k):
            kinds.setdefault((f.around(i), *f.lo[:, i].tolist(), *f.hi[:, i].tolist()), []).append(i)
        for same in kinds.values():
            if len(same) > 1:
                done[same] = True
        if len(kinds) > 1:
            members.setdefault(len(kinds), []).append(np.array([same[0] for same in kinds.values()]))
    whole = np.flatnonzero(done & ~f.again)
    for kind, length in enumerate(lengths):
        rows = whole[f.lo[kind, whole] <= f.hi[kind, whole]]
        out.append(f.spans(rows, f.lo[kind, rows], f.hi[kind, rows], kind, length))
    done |= f.again
    few = [np.stack(v) for k, v in members.items() if k <= PAIRS_MAX]
    if few:
        pairs = np.concatenate([np.stack([m[:, i].ravel(), m[:, j].ravel()], 1) for m in few for i, j in [np.triu_indices(m.shape[1], 1)]])
        for at in range(0, len(pairs), 65_536):
            out += compared(f, pairs[at : at + 65_536], done, lengths)
    for k, groups in members.items():
        for m in groups if k > PAIRS_MAX else ():
            around, left = [f.around(i) for i in m], f.left[m].tolist()
            for kind, length in enumerate(lengths):
                use = np.flatnonzero(f.lo[kind, m] <= f.hi[kind, m])
                if len(use) < 2:
                    continue
                ties = tied_offsets([around[x][: left[x]][::-1] for x in use], [around[x][left[x] :] for x in use], f.lo[kind, m[use]].tolist(), f.hi[kind, m[use]].tolist(), length)
                found = [(m[x], a, b) for x, spans in zip(use, ties, strict=True) if not done[m[x]] for a, b in spans]
                if found:
                    rows, a, b = np.array(found).T
                    out.append(f.spans(rows, a, b, kind, length))
    return np.concatenate(out)


def compared(f: Filed, pairs: np.ndarray, done: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Spans of the rows of pairs, each two compared byte by byte."""
    a, b = pairs.T
    middle = f.at[:-1] + f.left
    after = common_lengths(f.data, middle[a], middle[b], np.minimum(f.at[a + 1] - middle[a], f.at[b + 1] - middle[b]), 1)
    before = common_lengths(f.data, middle[a] - 1, middle[b] - 1, np.minimum(f.left[a], f.left[b]), -1)
    rows, place = np.unique(pairs, return_inverse=True)
    place = place.reshape(pairs.shape)
    out = []
    for kind, length in enumerate(lengths):
        edge = np.zeros((len(rows), length + 2), np.int32)  # where ranges of offsets begin and end
        for side, x in ((0, a), (1, b)):
            least, most = np.maximum(length - after, f.lo[kind, x]), np.minimum(before, f.hi[kind, x])
            use = (least <= most) & ~done[x]
            np.add.at(edge, (place[use, side], least[use] + 1), 1)
            np.add.at(edge, (place[use, side], most[use] + 2), -1)
        inside = np.cumsum(edge, 1) > 0
        i, first = np.nonzero(inside[:, 1:] & ~inside[:, :-1])
        _, last = np.nonzero(inside[:, :-1] & ~inside[:, 1:])
        out.append(f.spans(rows[i], first, last - 1, kind, length))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPANS = "kind int, t1 long, t2 long, s long, e long"
_SPAN_TYPES = [pa.int32(), *[pa.int64()] * 4]


def _spans(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, i], t) for i, t in enumerate(_SPAN_TYPES)], ["kind", "t1", "t2", "s", "e"])


def repeated_spans(df: DataFrame, lengths: tuple[int, ...], bucket_max: int, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(kind, t1, t2, s, e): byte ranges covered by repeated windows, by number of the length and text; and (t1, t2, text) of the texts concerned."""
    raw = df.select(F.col(f"`{text_col}`").alias("text")).filter(F.octet_length("text") >= lengths[0])
    numbers = range(len(lengths))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, grams, times, twice = [], [], [], []
            for x in b.column(0).cast(pa.binary()):
                text = x.as_py()
                c = Placed.of(text, lengths)
                g, n = np.unique(c.gram[c.keep], return_counts=True)
                keys.append(np.broadcast_to(np.array(text_key(text)), (len(g), 2)))
                grams.append(g)
                times.append(n)
                twice.append(np.isin(g, c.gram[c.again]))
            if keys:
                k = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(np.concatenate(times)), pa.array(np.concatenate(twice))], ["gram", "t1", "t2", "times", "twice"])

    sampled = raw.mapInArrow(sample, "gram long, t1 long, t2 long, times long, twice boolean")
    sampled = cut(sampled.groupBy("gram", "t1", "t2").agg(F.max("times").alias("times"), F.bool_or("twice").alias("twice")), "cover-sample")  # copies of a text count once
    shared = cut(sampled.groupBy("gram").agg(F.count("*").alias("n"), F.sum("times").alias("places"), F.bool_or("twice").alias("twice")).filter("places > 1 or twice"), "cover-shared")
    facts = shared.select("gram", "n", (F.col("places") > bucket_max).alias("hot"))
    wanted = join_facts(sampled.select("gram", "t1", "t2"), facts, "gram", "n", sampled.count())
    wanted = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("gram", "hot")).alias("grams"))  # a text's own

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            keys, take = [], []
            for i, x in enumerate(b.column(0).cast(pa.binary())):
                k = text_key(x.as_py())
                if k not in seen:
                    seen.add(k)
                    keys.append(k)
                    take.append(i)
            if take:
                yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], b.column(0).take(pa.array(take))], ["t1", "t2", "text"])

    texts = raw.mapInArrow(once, "t1 long, t2 long, text string").join(wanted, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    texts = cut(texts, "cover-texts")

    places = "gram long, hot boolean, t1 long, t2 long, pos long, " + "".join(f"lo{k} int, hi{k} int, " for k in numbers) + "left int, again boolean, kind int, upto long, around binary"
    names = [x.split()[0] for x in places.split(", ")]

    def file_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t1, t2 = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                text = b.column(2)[i].cast(pa.binary()).as_py()
                wanted = b.column(3)[i].values
                grams, hot = wanted.field("gram").to_numpy(), wanted.field("hot").to_numpy(zero_copy_only=False)
                order = np.argsort(grams)
                grams, hot = grams[order], hot[order]
                c = Placed.of(text, lengths)
                at = np.minimum(np.searchsorted(grams, c.gram), len(grams) - 1)
                use = np.flatnonzero(c.keep & (grams[at] == c.gram))
                n = len(use)
                cols = [c.gram[use], hot[at[use]], np.full(n, t1), np.full(n, t2), c.pos[use], *[x[k, use].astype(np.int32) for k in numbers for x in (c.lo, c.hi)], c.left[use].astype(np.int32), c.again[use], np.full(n, -1, np.int32), np.full(n, -1)]
                for a in range(0, n, 4096):
                    part = slice(a, a + 4096)
                    around = [text[p - x : p + y] for p, x, y in zip(c.pos[use][part].tolist(), c.left[use][part].tolist(), c.right[use][part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*[pa.array(x[part]) for x in cols], pa.array(around, pa.binary())], names)
                for k in numbers if c.again.any() else ():  # under a key of their own, so that they are spread
                    r = c.repeated(k, lengths[k])
                    n = len(r)
                    cols = [r[:, 0] * 0x5851F42D4C957F2D ^ t1, np.zeros(n, bool), np.full(n, t1), np.full(n, t2), r[:, 0], *[np.full(n, x, np.int32) for _ in numbers for x in (1, 0)], np.zeros(n, np.int32), np.ones(n, bool), np.full(n, k, np.int32), r[:, 1]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(x)) for x in cols], pa.array([b""] * n, pa.binary())], names)

    filed = texts.mapInArrow(file_suffixes, places)

    def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            waiting.append(b)
            size += b.num_rows
            if size >= 8192 and waiting[0].column(0)[0] != b.column(0)[-1]:
                table = pa.Table.from_batches(waiting)
                gram = table.column("gram").to_numpy()
                whole = int(np.searchsorted(gram == gram[-1], True))  # the last bucket may go on
                yield _spans(repeated_in_buckets(Filed.of(table.slice(0, whole), len(lengths)), lengths))
                waiting = table.slice(whole).to_batches()
                size = sum(x.num_rows for x in waiting)
        if size:
            yield _spans(repeated_in_buckets(Filed.of(pa.Table.from_batches(waiting), len(lengths)), lengths))

    cold = filed.filter("not hot").drop("hot").repartition("gram").sortWithinPartitions("gram")
    spans = cold.mapInArrow(sort_buckets, _SPANS)

    if not shared.filter(F.col("places") > bucket_max).isEmpty():

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for t1, t2, pos, left, around, *ends in zip(*[b.column(c).to_pylist() for c in ("t1", "t2", "pos", "left", "around", *[f"{x}{k}" for k in numbers for x in ("lo", "hi")])], strict=True):
                    for k, length in enumerate(lengths):
                        lo, hi = ends[2 * k : 2 * k + 2]
                        rows += [(*text_key(around[left - o : left - o + length]), k, t1, t2, pos - o) for o in range(lo, hi + 1)]
                for a in range(0, len(rows), 16_384):
                    cols = np.array(rows[a : a + 16_384], np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["w1", "w2", "kind", "t1", "t2", "s"])

        of_hot = texts.filter(F.exists("grams", lambda g: g["hot"])).mapInArrow(file_suffixes, places).filter("hot")
        hashed = cut(of_hot.mapInArrow(windows, "w1 long, w2 long, kind long, t1 long, t2 long, s long").select(F.struct("w1", "w2").alias("w"), "kind", "t1", "t2", "s"), "cover-windows")
        counts = hashed.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1")

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for kind, t1, t2, starts in zip(*[b.column(i).to_pylist() for i in range(3)], b.column(3), strict=True):
                    s = np.sort(starts.values.to_numpy())
                    gap = np.flatnonzero(np.diff(s) > 1)
                    first, last = s[np.concatenate([[0], gap + 1])], s[np.concatenate([gap, [len(s) - 1]])]
                    out.append(np.stack([np.full(len(first), x) for x in (kind, t1, t2)] + [first, last + lengths[kind]], 1))
                yield _spans(np.concatenate(out))

        starts = join_facts(hashed, counts, "w", "n", hashed.count()).groupBy("kind", "t1", "t2", F.shiftright("s", 15).alias("block")).agg(F.collect_list("s").alias("starts"))
        spans = spans.unionByName(starts.select("kind", "t1", "t2", "starts").mapInArrow(runs, _SPANS))
    return spans, texts.select("t1", "t2", "text")


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, bucket_max: int = 8192, passage: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, spans (array of [start, end) in bytes)."""
    small_batches(df.sparkSession)
    lengths = tuple(sorted({length, passage}))
    removal, report = lengths.index(length), lengths.index(passage)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1).cast(pa.binary()):
                text = x.as_py() or b""
                rows.append((*text_key(text), len(text), hashlib.sha256(text).hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], ["doc_id", "t1", "t2", "n_bytes", "sha"])

    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    described = cut(docs.mapInArrow(describe, "doc_id long, t1 long, t2 long, n_bytes long, sha string").withColumn("t", F.struct("t1", "t2")), "texts")
    spans, texts = repeated_spans(df, lengths, bucket_max, text_col)
    per_text = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("kind", "s", "e")).alias("found"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                text = b.column(2)[i].cast(pa.binary()).as_py()
                found = b.column(3)[i].as_py()
                gone, held = (merged([(x["s"], x["e"]) for x in found if x["kind"] == k]) for k in (removal, report))
                kept, at = [], 0
                for s, e in gone:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                out.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), sum(e - s for s, e in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest(), sum(e - s for s, e in held), [{"start": s, "end": e} for s, e in gone]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["t1", "t2", "n_removed", "n_spans", "kept_sha256", "n_shared", "spans"])

    stripped = texts.join(per_text, ["t1", "t2"]).select("t1", "t2", "text", "found").mapInArrow(strip, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, n_shared long, spans array<struct<start:long,end:long>>")
    classes = described.groupBy("t").agg(F.count("*").alias("n"))
    facts = classes.join(stripped.select(F.struct("t1", "t2").alias("t"), "n_removed", "n_spans", "kept_sha256", "n_shared", "spans"), "t", "left")
    facts = facts.withColumn("copies", F.col("n") > 1)
    out = join_facts(described.select("doc_id", "t", "n_bytes", "sha"), cut(facts, "text-facts"), "t", "n", described.count())
    whole = F.col("copies") & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copies") & (F.col("n_bytes") >= passage), F.col("n_bytes")).otherwise(F.coalesce("n_shared", zero)).alias("n_shared"),
        F.when(whole, F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
    )


def digest(df: DataFrame) -> DataFrame:
    return removals(df).drop("spans")
