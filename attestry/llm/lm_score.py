"""Document scores by a gated recurrent language model.

Counts: every training document's tokens are counted with Spark.  From the counts come the base score (smoothed
unigram) and the model's vocabulary: the most frequent tokens, in classes of neighbouring frequency.

Model: a GRU whose output is factored, P(class | state) P(word | class, state).  A token outside the vocabulary is one of
`others` words by its ending, times its smoothed share among the other tokens of that ending, so every text has a
probability.  Training is truncated backpropagation through time in numpy: one task warms the net up on `warm_docs`
documents, then replicas go on over all training documents, read whole in one pass.  Documents are dealt to replicas by
the hash of their id and read in its order, one replica for `replica_tokens` tokens, so the number of executors or cores
changes no score; the replicas' parameters are averaged in groups of `fan_in`, level by level.

Scoring reads whole documents in windows and carries the state across them.

Arrow splits, counts and places the tokens of a batch; tokens() and numbered() say the same for one text.

The tokens sent to all tasks are the `frequent` most frequent ones of 256 bytes or less; counts of all others are
joined.

Defined cases: null text is empty and consists of its end token; a null doc_id is hashed as an empty text; repeated rows
get equal results each; no training tokens give counts of zero, an untrained model and finite scores; an empty table
gives an empty result; texts of any length are read whole, in windows; ties in frequency or in the order of documents are
broken by the token and by the hash of the text; only id and text columns are read, whatever the others are called.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

END = b" "  # no word holds a blank


@dataclass(frozen=True)
class Settings:
    frequent: int = 131_072
    vocabulary: int = 4_096
    class_size: int = 64
    others: int = 80
    width: int = 24
    streams: int = 512
    window: int = 32
    warm_docs: int = 1_500
    replica_tokens: int = 1 << 22
    fan_in: int = 32
    rate: float = 0.15
    folds: int = 7
    held_fold: int = 2


def tokens(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then the end; bytes methods treat ASCII only."""
    return [*text.lower().split(), END]


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts, as tokens has them, one text behind another, and how many each text has; the ends are not made."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    lists = pc.ascii_split_whitespace(low)
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(low), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    if empty.any():  # an empty text is one empty word there
        flat, n = flat.filter(pc.greater(pc.binary_length(flat), 0)), np.where(empty, 0, n)
    return flat.cast(pa.binary()), n


def crc_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def token_key(x: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(x)
    return h - (1 << 64) if h >> 63 else h


class Net:
    """GRU with class-factored softmax.  Word k belongs to class k // class_size."""

    def __init__(self, n_words: int, s: Settings, params: list[np.ndarray] | None = None, counts: np.ndarray | None = None):
        """counts: of each word; the output starts from their shares."""
        self.n, self.h, self.size = n_words, s.width, s.class_size
        self.classes = -(-n_words // s.class_size)
        if params is None:
            r = np.random.default_rng(5)
            d = h = s.width
            draw = lambda *shape: (r.standard_normal(shape) / math.sqrt(shape[-2])).astype(np.float32)
            words = np.zeros((self.classes, self.size), np.float32)
            words.ravel()[n_words:] = -1e9  # places without a word
            tops = np.zeros(self.classes, np.float32)
            if counts is not None:
                words.ravel()[:n_words] = np.log(counts + 1)
                tops = np.log(np.exp(words.astype(np.float64)).sum(1)).astype(np.float32)
                words -= tops[:, None]
                tops -= np.float32(math.log(counts.sum() + n_words))
            params = [draw(n_words, d) * np.float32(math.sqrt(n_words) * 0.1), draw(d, 3 * h), draw(h, 3 * h), np.zeros(3 * h, np.float32), draw(h, self.classes), tops, draw(self.classes, h, self.size), words]
        self.p = params
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """A work array of this shape; each name's memory is used again and again, as fresh pages cost more than what is done in them."""
        n, kind = math.prod(shape), self.p[2].dtype
        if name not in self.rooms or len(self.rooms[name]) < n or self.rooms[name].dtype != kind:
            self.rooms[name] = np.empty(n, kind)
        return self.rooms[name][:n].reshape(shape)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """The weights of the three gates one behind another."""
        return np.ascontiguousarray(x.reshape(len(x), 3, self.h).transpose(1, 0, 2))

    def states(self, inputs: np.ndarray, h: np.ndarray, end: int, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """States for inputs (steps, streams), in a work array; an end as input starts a document with a zero state.

        Then what training needs, if it is kept: states before, gates, and what the state before adds to the gates.
        """
        emb, wx, wh, b = self.p[:4]
        (steps, streams), k = inputs.shape, self.h
        table, wh3 = self.gates(emb @ wx + b), self.gates(wh)
        table[:2] *= -1
        wh3[:2] *= -1
        held = steps if keep else 1
        out, before, x3, g3 = self.room("out", steps, streams, k), self.room("before", held, streams, k), self.room("x3", held, 3, streams, k), self.room("g3", held, 3, streams, k)
        going = inputs != end
        for t in range(steps):
            at = t if keep else 0
            x, g, h = x3[at], g3[at], np.multiply(h, going[t][:, None], out=before[at])
            np.take(table, inputs[t], axis=1, out=x, mode="clip")
            np.matmul(h, wh3, out=g)
            rz, n = x[:2], x[2]
            rz += g[:2]
            np.exp(rz, out=rz)
            rz += 1
            np.reciprocal(rz, out=rz)
            new = np.multiply(x[0], g[2], out=out[t])
            n += new
            n *= -2  # tanh by way of exp, which numpy has vectorized
            np.exp(n, out=n)
            n += 1
            np.divide(2, n, out=n)
            n -= 1
            np.subtract(h, n, out=new)
            new *= x[1]
            new += n
            h = new
        return out, before, x3, g3

    def output(self, states: np.ndarray, targets: np.ndarray, size: int = 2048) -> Iterator[tuple]:
        """In parts of rows with targets of one class: numbers of the rows, where they stand in the order of classes, class, targets within
        it, states with a constant, output weights of classes and of the class's words side by side, the exponentials of both in a work
        array, their two sums, log P(target | state).

        A part stays in the cache.
        """
        wc, bc, ww, bw = self.p[4:]
        m, q, k = self.size, self.classes, self.h
        c = targets // m
        order = np.argsort(c.astype(np.uint16) if q <= 1 << 16 else c, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=q))])
        goals = (targets - c * m)[order] + q
        rows = self.room("rows", len(targets), k + 1)
        rows[:, :k], rows[:, k] = np.take(states, order, axis=0, out=self.room("sorted", len(targets), k), mode="clip"), 1
        w = np.empty((k + 1, q + m), wc.dtype)
        w[:k, :q], w[k, :q] = wc, bc
        ones = np.ones(max(q, m), wc.dtype)
        places = np.arange(size) * (q + m)

        def sums(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return p[:, :q] @ ones[:q], p[:, q:] @ ones[:m]

        for i in np.flatnonzero(np.diff(bounds)).tolist():
            w[:k, q:], w[k, q:] = ww[i], bw[i]
            for a in range(bounds[i], bounds[i + 1], size):
                here = slice(a, min(a + size, bounds[i + 1]))
                mine, goal = rows[here], goals[here]
                p = np.matmul(mine, w, out=self.room("p", len(mine), q + m))
                picked = p[:, i] + p.ravel()[places[: len(mine)] + goal]
                with np.errstate(over="ignore"):
                    np.exp(p, out=p)
                tops, words = sums(p)
                if not 1e-30 < min(tops.min(), words.min()) <= max(tops.max(), words.max()) < 1e30:  # out of the range of exp
                    np.matmul(mine, w, out=p)
                    for part in (p[:, :q], p[:, q:]):
                        top = part.max(1, keepdims=True)
                        part -= top
                        picked -= top[:, 0]
                    tops, words = sums(np.exp(p, out=p))
                yield order[here], here, i, goal, mine, w, p, tops, words, picked - np.log(tops * words)

    def log_prob(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of P(target | state), row by row."""
        out = np.empty(len(targets), states.dtype)
        for rows, *_, lp in self.output(states, targets):
            out[rows] = lp
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, end: int, into: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray, float]:
        """Truncated backpropagation through one window; the last state is handed on without gradient."""
        emb, wx, wh = self.p[:3]
        k, q, (steps, streams) = self.h, self.classes, inputs.shape
        out, before, x3, g3 = self.states(inputs, h, end, True)
        goal = targets.ravel()
        n = len(goal)
        g = [np.empty_like(x) for x in self.p] if into is None else into
        for x in g:
            x.fill(0)
        back, by_class = self.room("back", n, k), self.room("by_class", n, k)
        order, loss = np.empty(n, np.int64), 0.0
        for rows, here, c, at, mine, w, d, tops, words, lp in self.output(out.reshape(n, k), goal):
            loss -= float(lp.sum())
            d[:, :q] *= (1 / tops)[:, None]
            d[:, q:] *= (1 / words)[:, None]
            d[:, c] -= 1
            d[np.arange(len(d)), at] -= 1
            both = mine.T @ d
            g[4] += both[:k, :q]
            g[5] += both[k, :q]
            g[6][c] += both[:k, q:]
            g[7][c] += both[k, q:]
            np.matmul(d, w[:k].T, out=by_class[here])
            order[here] = rows
        back[order] = by_class
        back = back.reshape(steps, streams, k)
        dx, dg, up = self.room("dx", steps, 3, streams, k), self.room("dg", 3, streams, k), self.room("up", 3, streams, k)
        to_state, wh_g = self.gates(wh).transpose(0, 2, 1), np.zeros((3, k, k), wh.dtype)
        hz, carry = self.room("hz", streams, k), np.zeros((streams, k), wh.dtype)
        going = inputs != end
        for t in range(steps - 1, -1, -1):
            dh, old, (r, z, new), (dr, dz, dn) = back[t], before[t], x3[t], dx[t]
            dh += carry
            np.multiply(dh, z, out=hz)
            dh -= hz  # dh * (1 - z)
            np.multiply(new, new, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= dh
            np.subtract(old, new, out=dz)
            dz *= dh
            dz *= z
            np.multiply(dn, r, out=dg[2])
            np.subtract(1, r, out=dr)
            dr *= dg[2]
            dr *= g3[t, 2]
            dg[:2] = dx[t, :2]
            wh_g += old.T @ dg
            np.matmul(dg, to_state, out=up)
            np.add(up[0], up[1], out=carry)
            carry += up[2]
            carry += hz
            carry *= going[t][:, None]
        g[2][:] = wh_g.transpose(1, 0, 2).reshape(k, 3 * k)
        flat = inputs.ravel()
        order = np.argsort(flat.astype(np.uint16) if len(emb) <= 1 << 16 else flat, kind="stable")
        there, first = np.unique(flat[order], return_index=True)
        rows = order + order // streams * (2 * streams)  # of the first gate: a step has three times as many rows
        by_word = np.hstack([np.add.reduceat(np.take(dx.reshape(-1, k), rows + i * streams, axis=0, out=by_class, mode="clip"), first) for i in range(3)])
        g[0][there] = by_word @ wx.T
        g[1][:], g[3][:] = emb[there].T @ by_word, by_word.sum(0)
        for x in g:
            x /= n
        return g, out[-1].copy(), loss / n


def train(net: Net, docs: Iterator[np.ndarray], s: Settings, end: int, rate: float) -> int:
    """Adagrad over windows of parallel streams; returns the number of tokens seen.  docs: token numbers, ending with end."""
    sizes = np.cumsum([x.size for x in net.p])
    whole = np.concatenate([x.ravel() for x in net.p])
    net.p = [x.reshape(y.shape) for x, y in zip(np.split(whole, sizes[:-1]), net.p, strict=True)]
    slope, past = np.empty_like(whole), np.full_like(whole, 1e-6)
    slopes = [x.reshape(y.shape) for x, y in zip(np.split(slope, sizes[:-1]), net.p, strict=True)]
    seen, waiting, size = 0, [], 0
    block = s.streams * s.window * 8

    def learn(stream: np.ndarray) -> int:
        per = len(stream) // s.streams
        if not per:
            return 0
        rows = stream[: per * s.streams].reshape(s.streams, per).T
        inputs = np.vstack([np.full((1, s.streams), end), rows[:-1]])
        h = np.zeros((s.streams, net.h), np.float32)
        for t in range(0, per, s.window):
            _, h, _ = net.gradients(inputs[t : t + s.window], rows[t : t + s.window], h, end, slopes)
            norm = math.sqrt(float(np.vdot(slope, slope)))
            np.multiply(slope, np.float32(min(1.0, 1.0 / max(norm, 1e-9))), out=slope)
            for a in range(0, len(whole), 8192):  # in the cache
                here = slice(a, a + 8192)
                past[here] += slope[here] * slope[here]
                slope[here] /= np.sqrt(past[here])
                slope[here] *= np.float32(rate)
                whole[here] -= slope[here]
        return per * s.streams

    for d in docs:
        waiting.append(d)
        size += len(d)
        if size >= block:
            seen += learn(np.concatenate(waiting))
            waiting, size = [], 0
    return seen + (learn(np.concatenate(waiting)) if waiting else 0)


def document_log_probs(net: Net, docs: list[np.ndarray], end: int, cells: int = 131_072) -> np.ndarray:
    """Natural log-likelihood of whole documents, longest first in one batch that shrinks; state carried across windows.

    A window is as long as `cells` tokens of the documents still read allow.
    """
    size = np.array([len(x) for x in docs])
    order = np.argsort(-size, kind="stable")
    first = np.concatenate([[0], np.cumsum(size)])[order]
    flat = np.concatenate([*docs, [end]])
    size = size[order]
    total = np.zeros(len(docs))
    h = np.zeros((len(docs), net.h), np.float32)
    last = np.full(len(docs), end)
    t, longest = 0, int(size.max(initial=0))
    while t < longest:
        live = int((size > t).sum())
        steps = min(max(16, cells // live), longest - t)
        at = t + np.arange(steps)[:, None]
        there = at < size[:live]
        part = flat[np.where(there, first[:live] + at, len(flat) - 1)]
        inputs = np.vstack([last[None, :live], part[:-1]])
        out = net.states(inputs, h[:live], end)[0]
        lp = net.log_prob(out[there], part[there])
        total[:live] += np.bincount(np.nonzero(there)[1], weights=lp, minlength=live)
        h, last = out[-1].copy(), part[-1]
        t += steps
    back = np.empty(len(docs))
    back[order] = total
    return back


class Places(dict):
    """Place of each frequent token in the arrays of Corpus; for others -1 less the number of their ending."""

    def __init__(self, tokens: list[bytes], others: int):
        super().__init__(zip(tokens, range(len(tokens)), strict=True))
        self.others = others

    def __missing__(self, x: bytes) -> int:
        return -1 - ending(x, self.others)

    def __reduce__(self):
        return Places, (list(self), self.others)


@dataclass
class Corpus:
    """What scoring needs of the counts."""

    n: int
    v: int
    places: Places  # of the frequent tokens
    number: np.ndarray  # the model's word for each of them; those below others stand for all other tokens, by ending
    value: np.ndarray  # log10(count + 1) of each
    end: int
    others: int
    weights: np.ndarray  # count of each of the model's words
    other_log: np.ndarray  # log10 of what shares among the other tokens of an ending are taken of


def count_tokens(df: DataFrame) -> DataFrame:
    """token (binary), n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(waiting, pa.binary()))
            waiting.clear()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["token", "n"])

        ends = size = 0
        for b in batches:
            words, n = split_texts(b.column(0))
            waiting.append(words)
            size, ends = size + len(words), ends + len(n)
            if size > 4_000_000:
                yield flush()
                size = 0
        yield flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["token", "n"])

    return df.select("text").mapInArrow(work, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def ending(x: bytes, others: int) -> int:
    return zlib.crc32(x[-3:]) % others


def gather(counts: DataFrame, s: Settings) -> Corpus:
    last = F.when(F.octet_length("token") > 3, F.substring("token", -3, 3)).otherwise(F.col("token"))
    groups = counts.groupBy((F.crc32(last) % s.others).alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # `others` rows at most
    sizes, kinds = ({r["e"]: r[c] for r in groups} for c in ("n", "v"))
    n, v = sum(sizes.values()), sum(kinds.values())
    top = counts.filter(F.octet_length("token") <= 256).orderBy(F.desc("n"), "token").limit(s.frequent).toArrow()
    known = dict(zip(top.column("token").to_pylist(), top.column("n").to_pylist(), strict=True))
    words = [END, *[x for x in list(known)[: s.vocabulary - s.others - 1] if x != END]]
    for x in words:
        e = ending(x, s.others)
        sizes[e], kinds[e] = sizes.get(e, 0) - known.get(x, 0), kinds.get(e, 0) - (x in known)
    frequent = list(dict.fromkeys([*words, *known]))
    number = np.array([*range(s.others, s.others + len(words)), *[ending(x, s.others) for x in frequent[len(words) :]]])
    value = np.log10(np.array([known.get(x, 0) for x in frequent]) + 1.0)
    weights = np.array([*[sizes.get(e, 0) for e in range(s.others)], *[known.get(x, 0) for x in words]])
    return Corpus(n, v, Places(frequent, s.others), number, value, s.others, s.others, weights, np.log10([sizes.get(e, 0) + kinds.get(e, 0) + 1.0 for e in range(s.others)]))


def numbered(t: list[bytes], c: Corpus) -> np.ndarray:
    """The model's words for the tokens of a text."""
    at = np.fromiter(map(c.places.__getitem__, t), np.int64, len(t))
    return np.where(at < 0, -1 - at, c.number[at])


def placed(texts: pa.Array, known: pa.Array, c: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Places of the tokens of texts, one text behind another, with the bounds of the texts; positions of the tokens that are not
    frequent, and these tokens.  known: the frequent tokens, END first."""
    words, n = split_texts(texts)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    at = np.zeros(bounds[-1], np.int64)  # ends have place 0
    word = np.ones(len(at), bool)
    word[bounds[1:] - 1] = False
    found = pc.index_in(words, value_set=known)
    at[word] = found.fill_null(-1).to_numpy()
    seldom = np.flatnonzero(at < 0)
    others = words.filter(found.is_null()).to_pylist()
    at[seldom] = [-1 - ending(x, c.others) for x in others]
    return at, bounds, seldom, others


def known_of(c: Corpus) -> pa.Array:
    return pa.array(list(c.places), pa.binary())


def fitted(train_docs: DataFrame, c: Corpus, s: Settings) -> Net:
    """Warm-up in one task on a bounded sample, then one round of replicas over all training documents, averaged."""
    n_words = len(c.weights)
    shapes = [x.shape for x in Net(n_words, s, counts=c.weights).p]

    def packed(net: Net, seen: int, r: int) -> pa.RecordBatch:
        n = len(net.p)
        return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([seen] * n, pa.int64()), pa.array([x.astype("<f4").tobytes() for x in net.p], pa.binary()), pa.array([r] * n, pa.int64())], ["part", "seen", "body", "replica"])

    def unpacked(rows: list) -> list[np.ndarray]:
        by = {r["part"]: np.frombuffer(r["body"], "<f4") for r in rows}
        return [by[i].reshape(shape).copy() for i, shape in enumerate(shapes)]

    def replica(start: list[np.ndarray] | None, rate: float):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = known_of(c)

            def read(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
                at, bounds, *_ = placed(b.column("text"), known, c)
                yield from zip(b.column("replica").to_pylist(), np.split(np.where(at < 0, -1 - at, c.number[at]), bounds[1:-1]), strict=True)

            rows = (x for b in batches for x in read(b))
            for r, mine in groupby(rows, key=lambda x: x[0]):  # sorted by replica
                net = Net(n_words, s, None if start is None else [x.copy() for x in start], c.weights)
                seen = train(net, (x for _, x in mine), s, c.end, rate)
                yield packed(net, seen, r)

        return work

    schema = "part int, seen long, body binary, replica long"
    top = train_docs.select("key").orderBy("key").limit(s.warm_docs).agg(F.max("key")).first()[0]
    sample = train_docs.filter(F.col("key") <= F.lit(top)).orderBy("key", F.xxhash64("text")).limit(s.warm_docs) if top is not None else train_docs.limit(0)
    warm = sample.select("text", F.lit(0).cast("long").alias("replica")).coalesce(1).mapInArrow(replica(None, s.rate), schema).filter("seen > 0").collect()
    if not warm:
        return Net(n_words, s, counts=c.weights)
    start = unpacked(warm)
    replicas = max(1, round(c.n / s.replica_tokens))
    hashed = F.xxhash64("text")
    dealt = train_docs.select("text", "key", hashed.alias("k2"), F.pmod(F.xxhash64("key", hashed), F.lit(replicas)).alias("replica")).repartition(replicas, "replica")
    each = cut(dealt.sortWithinPartitions("replica", "key", "k2").select("text", "replica").mapInArrow(replica(start, s.rate / 4), schema), "lm-replicas")

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for b in batches:
            for part, seen, body, group in zip(*[x.to_pylist() for x in b.columns], strict=True):
                t = total.setdefault((part, group), [0, 0.0])
                t[0] += seen
                t[1] = t[1] + np.frombuffer(body, "<f4").astype(np.float64) * seen
        rows = [(k[0], t[0], (t[1] / t[0]).astype("<f4").tobytes(), k[1]) for k, t in total.items() if t[0]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.int64()))], ["part", "seen", "body", "replica"])

    while replicas > 1:
        replicas = -(-replicas // s.fan_in)
        grouped = each.select("part", "seen", "body", F.floor(F.col("replica") / s.fan_in).cast("long").alias("replica"))
        each = grouped.repartition(replicas * len(shapes), "part", "replica").sortWithinPartitions("part", "replica", "seen").mapInArrow(average, schema)
        if replicas > 1:
            each = cut(each, "lm-average")
    mean = each.select("part", "seen", "body").filter("seen > 0").collect()
    return Net(n_words, s, unpacked(mean) if len(mean) == len(shapes) else start)


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    s = settings
    small_batches(df.sparkSession)
    d = F.col(f"`{id_col}`")  # a null id has a key too
    docs = df.select(d.cast("long").alias("doc_id"), (crc_of(d) % s.folds == s.held_fold).alias("held_out"), F.col(f"`{text_col}`").alias("text"), F.shiftrightunsigned(F.xxhash64(F.coalesce(d.cast("string"), F.lit(""))), 1).alias("key"))
    learn = docs.filter(~F.col("held_out")).select("key", "text")
    counts = cut(count_tokens(learn), "token-counts")
    c = gather(counts, s)
    net = fitted(learn, c, s)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        ids: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lp = document_log_probs(net, ids, c.end) / math.log(10)
            cols = [[r[i] for r in rows] for i in range(8)]
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            out = pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(cols, types, strict=True)], pa.array(lp)], ["doc_id", "held_out", "n_tokens", "known", "base", "other", "rare", "times", "lm"])
            rows.clear()
            ids.clear()
            return out

        known = known_of(c)
        for b in batches:
            if not b.num_rows:
                continue
            at, bounds, seldom, others = placed(b.column(2), known, c)
            often = at >= 0
            words, value = np.where(often, c.number[at], -1 - at), np.where(often, c.value[at], 0)
            taken = np.where(words < c.others, value, 0)
            less = np.where(words < c.others, c.other_log[np.minimum(words, c.others - 1)], 0)
            n_known, base, other = (np.add.reduceat(x, bounds[:-1]).tolist() for x in ((value > 0).astype(np.int64), value, taken - less))
            part = np.searchsorted(seldom, bounds).tolist()
            for i, (doc_id, held) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                tf = Counter(others[part[i] : part[i + 1]])  # their counts come by a join
                rows.append((doc_id, held, int(bounds[i + 1] - bounds[i]), n_known[i], base[i], other[i], [token_key(x) for x in tf], list(tf.values())))
            ids.extend(np.split(words, bounds[1:-1]))
            size += len(words)
            if size > 2_000_000:
                yield flush()
                size = 0
        if rows:
            yield flush()

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, other double, rare array<long>, times array<int>, lm double"
    read = docs.select("doc_id", "held_out", "text").mapInArrow(measure, schema).withColumn("row_no", F.monotonically_increasing_id())
    read = cut(read, "lm-documents")

    # tokens beyond the frequent ones: their counts are joined by hash
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([token_key(x) for x in b.column(0).to_pylist()], pa.int64()), b.column(1)], ["token", "c"])

    cold = counts.mapInArrow(hashed, "token long, c long")
    rare = read.select("row_no", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row_no", F.col("r.rare").alias("token"), F.col("r.times").alias("k"))
    seen = rare.join(cold, "token")
    sums = seen.groupBy("row_no").agg(F.sum("k").alias("rare_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("rare_log"))
    joined = read.drop("rare", "times").join(sums, "row_no", "left")
    extra, zero = F.coalesce("rare_log", F.lit(0.0)), F.lit(0).cast("long")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"), F.lit(c.n).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * math.log10(c.n + c.v + 1)).alias("base_score"),
        (F.col("lm") + F.col("other") + extra).alias("score"),
    )
