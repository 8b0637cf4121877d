"""SimHash near-dedup by Golay-code fuzzy hashing.

Fingerprint: bit i of 64 is set where more than half of the document's shingle hashes have it set.

Search at Hamming distance 2: a fingerprint is cut into segments of 22, 21 and 21 bits, each padded with zeros to the
23 bits of the binary Golay code.  Of three segments at least one is equal for any two fingerprints at distance 2
(pigeonhole), and its successor differs in 2 bits at most.  The middle of two such segments lies within 3 of some
codeword (the code is perfect), so both segments lie within 4 of it: every segment gets the indices of all codewords
within 4 - one, or six - as keys, and a key is (equal segment, its bits, codeword of the successor): at most 18 keys a
fingerprint, none of which two linked fingerprints can fail to share.  Candidates are joined by key and verified.

A key shared by many fingerprints would give all their pairs.  Those fingerprints instead get one key for each of the
65 values within one bit: whatever shares such a value is within 2 bits of each other, so its members link to one of
them without pairs, exactly, and no group holds over 65 members.

Components: alternating large-star and small-star steps on the links, written to the shared folder after each round.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle make
one shingle of the whole sequence; equal fingerprints are one node, so repeated rows never make pairs; a null doc_id is
in its component but never names it; an empty table gives an empty result; only id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crowd, cut, packed, small_batches

GOLAY = 0b101011100011  # generator polynomial of the [23, 12, 7] code
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width
SEED = 42


def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator."""
    x = x.astype(np.int64)
    for i in range(22, 10, -1):
        x = np.where((x >> i) & 1, x ^ (GOLAY << (i - 11)), x)
    return x


@lru_cache(1)
def near_errors() -> np.ndarray:
    """For each of the 2048 syndromes the error patterns of weight 4 or less, first one repeated up to six."""
    from itertools import combinations

    e = np.array([sum(1 << b for b in c) for k in range(5) for c in combinations(range(23), k)], np.int64)
    s = syndrome(e)
    order = np.argsort(s, kind="stable")
    e, s = e[order], s[order]
    first = np.searchsorted(s, np.arange(2048))
    count = np.bincount(s, minlength=2048)
    return e[first[:, None] + np.where(np.arange(6) < count[:, None], np.arange(6), 0)]


def codewords(segment: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within 4 of each segment; where there is one only, it is repeated."""
    return (segment.astype(np.int64)[:, None] ^ near_errors()[syndrome(segment)]) >> 11


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the row of fp each belongs to."""
    fp = fp.view(np.uint64)
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    keys, rows = [], []
    for i in range(3):
        k = (np.int64(i) << 40) | (parts[i] << 12)[:, None] | codewords(parts[(i + 1) % 3])
        fresh = np.ones(k.shape, bool)
        fresh[:, 1:] = k[:, 1:] != k[:, :1]
        keys.append(k[fresh])
        rows.append(np.nonzero(fresh)[0])
    return np.concatenate(keys), np.concatenate(rows)


def flip_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 65): the value itself and those one bit away."""
    masks = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return (fp.view(np.uint64)[:, None] ^ masks).view(np.int64)


def shingles(text: bytes, size: int) -> list[bytes]:
    """Shingles of words, repeats included, as UTF-8; bytes.lower() and bytes.split() treat A-Z and [\\x20\\x09-\\x0D] only."""
    w = text.lower().split()
    if len(w) <= size:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*[w[i:] for i in range(size)], strict=False)))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    s = shingles(text, size)
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in s), np.uint64, len(s))


def simhash(h: np.ndarray) -> int:
    """Fingerprint as a signed 64-bit integer."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for texts of any length
        bits = np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """doc_id, fp."""
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(shingle_hashes(x.as_py() or b"", size)) for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(work, "doc_id long, fp long")


def near_links(nodes: DataFrame, bucket_max: int = 64) -> DataFrame:
    """a, b: links between distinct fp values that connect all values within 2 bits of each other."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            keys, rows = golay_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    def flipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(flip_keys(fp).ravel()), pa.array(np.repeat(fp, 65))], ["key", "fp"])

    keys = nodes.select("fp").mapInArrow(keyed, "key long, fp long")
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keys.join(counts, "key"), "golay-keys")
    small = shared.filter(F.col("n") <= bucket_max)
    other = small.select("key", F.col("fp").alias("b"))
    pairs = small.select("key", F.col("fp").alias("a")).join(other, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    crowded = shared.filter(F.col("n") > bucket_max).select("fp").distinct().mapInArrow(flipped, "key long, fp long")
    balls = crowded.groupBy("key").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)  # 65 at most
    stars = balls.select("a", F.explode("all").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: for each node of links (a, b), the smallest node reachable."""

    def mins(sym: DataFrame) -> DataFrame:
        return sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def large_star(e: DataFrame) -> DataFrame:
        s = both(e)
        return s.filter("v > u").join(mins(s), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        s = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        m = s.groupBy("u").agg(F.min("v").alias("m"))
        moved = s.join(m, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        return moved.union(m.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    now = state(e)
    for _ in range(max_rounds):
        if not now[0]:
            break
        e = cut(small_star(large_star(e)), "links")
        before, now = now, state(e)
        if before == now:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.union(e.select("a", "a").distinct()).toDF("node", "root")


def join_facts(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, hot_least: int = 4096) -> DataFrame:
    """rows joined with facts, which has one row per key and in n the rows of that key.

    Keys over 1/1024 of all rows, or over TASK_ROWS, are broadcast, SENT_KEYS at most; the others are shuffled.
    """
    many = crowd(total, hot_least)
    if total <= many:
        return rows.join(facts.drop(n), key)
    hot, cold = facts.filter(F.col(n) > many).drop(n), facts.filter(F.col(n) <= many).drop(n)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bucket_max: int = 64) -> DataFrame:
    """doc_id, fp, component_id: components of fingerprints linked at 2 or fewer differing bits."""
    fps = cut(fingerprints(df, id_col, text_col, size), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprint-nodes")
    roots = components(near_links(nodes, bucket_max))
    linked = cut(roots.join(nodes.select(F.col("fp").alias("node"), "least"), "node"), "fingerprint-roots")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("node").alias("fp"), "component_id")
    facts = nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return join_facts(fps, facts, "fp", "n", fps.count())


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def digest(df: DataFrame) -> DataFrame:
    g = groups(df)
    return g.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


# --- Near duplicates by similarity -----------------------------------------------------------------------------------

BANDS, BAND_ROWS = 24, 5
_MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key for each band of min-wise hashes of a non-empty set."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    x = h ^ (h >> np.uint64(31))
    for at in range(0, len(x), 2048):
        least = np.minimum(least, (x[at : at + 2048, None] * _MULTIPLIERS).min(0))
    mixed = np.zeros(BANDS, np.uint64)
    for k in least.reshape(BANDS, BAND_ROWS).T:
        mixed = (mixed ^ k) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return ((mixed << np.uint64(5)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bucket_max: int = 32) -> DataFrame:
    """doc_id, r1, r2 (hashes of the text), rank struct best: the document that stays for the row's group.

    Texts are near-duplicates if the sets of their shingles have a Jaccard similarity of `similarity` or more; groups are
    the components.  Candidates share a Golay key of their fingerprints or a band of min-wise hashes (fingerprints of
    texts at similarity 0.8 differ in 6 to 14 bits, beyond any Golay search of affordable size); all are verified on the
    sets.  Pairs within a component are not needed: each text is first verified with one member of its largest key, then
    members of small keys in pairs and those of crowded keys with 17 of them.  Texts whose crowded keys then still hold
    different components are joined exactly: their shingles are ordered by frequency, texts in different components that
    share one of the first (prefix filter) and can reach the similarity (positions, bitmaps) are verified.
    """
    small_batches(df.sparkSession)
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(raw).alias("r1"), F.xxhash64(F.lit(7), raw).alias("r2"), raw.alias("text"))

    def key_of(text: bytes) -> tuple[int, int]:
        d = xxhash.xxh3_128_digest(b" ".join(text.lower().split()))
        return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, keys = [], []
            for x in b.column(3).cast(pa.binary()):
                text = x.as_py()
                t.append(key_of(text))
                h = shingle_hashes(text, size)
                golay = golay_keys(np.array([simhash(h)]))[0] | (np.int64(1) << 62)
                keys.append(np.concatenate([golay, band_keys(np.unique(h))]) if len(h) else golay[:1])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([k[0] for k in t], pa.int64()), pa.array([k[1] for k in t], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "r1", "r2", "t1", "t2", "keys"])

    signed = cut(docs.mapInArrow(sign, "doc_id long, r1 long, r2 long, t1 long, t2 long, keys array<long>"), "signatures")
    nodes = signed.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "r1", "r2")).alias("best"), F.min("keys").alias("keys"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    keyed = nodes.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(counts, "key"), "near-keys")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            keys, bodies = [], []
            for x in b.column(0).cast(pa.binary()):
                if (k := key_of(text := x.as_py())) not in seen:
                    seen.add(k)
                    keys.append(k)
                    bodies.append(np.unique(shingle_hashes(text, size).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], pa.array(bodies, pa.binary())], ["t1", "t2", "body"])

    asked = shared.select("node").distinct().join(nodes.select("node", "t1", "t2"), "node")
    bodies = docs.select("text").mapInArrow(sets, "t1 long, t2 long, body binary").join(asked, ["t1", "t2"]).dropDuplicates(["t1", "t2"]).select("node", "body")
    bodies = cut(bodies, "near-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same >= similarity * (len(x) + len(y) - same) - 1e-9)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.distinct().join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
        both = with_a.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b").select("a", "b", "x", "y")
        return cut(both.mapInArrow(verify, "a long, b long"), "near-links")

    def apart(members: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Members of keys whose members are not all in one component yet, with their component."""
        placed = members.join(components(links), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
        mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("key")
        return cut(placed.join(mixed, "key"), name)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))

    # each text with the most central member of its largest key: the one whose keys hold most texts
    weights = shared.groupBy("node").agg(F.max_by("key", "n").alias("key"), F.sum("n").alias("weight"))
    hubs = shared.join(weights.select("node", "weight"), "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    largest = weights.join(hubs, "key").filter("hub <> node")
    links = verified(ordered(largest.select(F.col("hub").alias("u"), F.col("node").alias("v"))))

    # small keys in pairs, crowded ones with 17 members
    placed = apart(shared, links, "near-keys-left")
    few = placed.filter(F.col("n") <= bucket_max)
    other = few.select("key", F.col("node").alias("b"), F.col("part").alias("q"))
    pairs = few.select("key", F.col("node").alias("a"), "part").join(other, "key").filter("a < b and part <> q").select("a", "b")
    many = placed.filter(F.col("n") > bucket_max).withColumn("salt", F.pmod("node", F.lit(16)))
    hubs = many.groupBy("key", "salt").agg(F.min(F.struct("node", "part")).alias("sub"))
    tops = many.groupBy("key").agg(F.min(F.struct("node", "part")).alias("top"))
    spokes = many.join(hubs, ["key", "salt"]).join(tops, "key")
    stars = spokes.filter("sub.part <> part").select(F.col("sub.node").alias("u"), F.col("node").alias("v")).union(spokes.filter("top.part <> part").select(F.col("top.node").alias("u"), F.col("node").alias("v")))
    links = cut(links.union(verified(pairs.union(ordered(stars)))), "near-links")

    # texts of crowded keys that still hold several components: an exact set-similarity join between the components
    rest = apart(many.select("key", "node"), links, "near-keys-apart").select("node", "part").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, part, body in zip(*[c.to_pylist() for c in b.columns], strict=True):
                t = np.frombuffer(body, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), k)) for k in (node, part, len(t))] + [pa.array(t)], ["node", "part", "size", "token"])

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parity of the tokens at each of 512 bits: two sets differ in as many tokens at least as their bitmaps in bits."""
        for b in batches:
            odd = [np.bincount((np.frombuffer(x, np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(23), minlength=512) & 1 for x in b.column(1).to_pylist()]
            words = np.packbits(np.array(odd, np.uint8).reshape(-1, 512), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(w)) for w in words.T]], ["node", *bits])

    bits = [f"bits{k}" for k in range(8)]
    maps = rest.join(bodies, "node").select("node", "body").mapInArrow(bitmaps, "node long, " + ", ".join(f"{x} long" for x in bits))
    tokens = cut(rest.join(bodies, "node").select("node", "part", "body").mapInArrow(spread, "node long, part long, size long, token int"), "near-tokens")
    held = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("token", "df", F.col("df").alias("n"))
    ranked = join_facts(tokens, held, "token", "n", tokens.count())
    own = Window.partitionBy("node")  # the tokens of one text; those that no other component holds stand first
    at = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token")) - 1
    heads = cut(ranked.withColumn("at", at).filter(F.col("at") <= F.col("size") - F.ceil(similarity * F.col("size") - 1e-9)).join(maps, "node"), "near-heads")
    sizes = heads.groupBy("token", "part").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    outside = heads.join(sizes, "token").filter("part <> main").select("token", F.col("node").alias("u"), F.col("part").alias("p"), F.col("size").alias("m"), F.col("at").alias("i"), "main", *[F.col(x).alias(f"u_{x}") for x in bits])
    differ = reduce(Column.__add__, [F.bit_count(F.col(x).bitwiseXOR(F.col(f"u_{x}"))) for x in bits])
    common = F.least(F.least("at", "i") + F.least(F.col("size") - F.col("at"), F.col("m") - F.col("i")), (F.col("size") + F.col("m") - differ) / 2)  # at most
    close = (F.col("part") != F.col("p")) & ((F.col("part") == F.col("main")) | (F.col("u") < F.col("node"))) & (common >= similarity * (F.col("size") + F.col("m") - common) - 1e-9)
    links = links.union(verified(ordered(outside.join(heads, "token").filter(close).select("u", F.col("node").alias("v")))))
    grouped = nodes.select("node", "t1", "t2", "best").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    leaders = grouped.groupBy("root").agg(F.min("best").alias("leader"))
    return grouped.join(leaders, "root").select("t1", "t2", "best", "leader")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df with one document of each near-duplicate group: the one with the smallest id."""
    leaders = near_duplicates(df, id_col, text_col, **how).select("leader").distinct().select(F.col("leader.doc_id").alias("l_doc"), F.col("leader.r1").alias("l1"), F.col("leader.r2").alias("l2"))
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(packed(df).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(raw).alias("r1"), F.xxhash64(F.lit(7), raw).alias("r2"))
    kept = rows.join(leaders, (F.col("r1") == F.col("l1")) & (F.col("r2") == F.col("l2")) & F.col("id").eqNullSafe(F.col("l_doc")), "left_semi")
    return kept.dropDuplicates(["r1", "r2", "id"]).select("row.*")
