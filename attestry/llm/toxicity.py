"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

A lexicon of words and word beginnings is learned from labelled rows: terms that stand in toxic documents far more often
than in others.  Every text is then scanned whole.  Words of the lexicon match exactly, beginnings by prefix, and
misspelled words by running a Levenshtein automaton of the token along the trie of all lexicon words.  Two runs of
letters around one digit or symbol ("id1ot") are tried as one token as well; more such characters are more than one
edit away from any word.  Each hit is weighed by
its surroundings: between quotation marks or behind a reporting verb it counts as quotation, near an address (you, du,
tu ...) as abuse.  A logistic model over these counts, fitted on other labelled rows than the lexicon, gives the score.

The fit uses a bounded sample: at most `max_rows` labelled training rows, those with the smallest hashes.  Every row is
scored.  labels, lang, source and doc_id are never inputs of a score.

Defined cases: null text is empty; an empty text has no hits and the score of a text without hits; a null doc_id counts
as held out; repeated label rows count once; without usable labels (none, or of one class) the score is 0 for all;
texts of any length are read whole; ties do not arise; an empty table gives an empty result; columns other than id, text
and the label are not read, whatever they are called.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WORD = re.compile(r"[^\W\d_]+")
#: A word and one digit or symbol right behind it, then, not taken, the word that follows at once.
BROKEN = re.compile(r"(?<![^\W\d_])([^\W\d_]++)([^\w\s]|[\d_])(?=([^\W\d_]++))")
PREFIXES = (4, 5, 6)
QUOTES = "\"“”„«»‘’"
REPORTING = frozenset("said says wrote called calling quoted quote dit écrit cité sagte schrieb zitiert dijo escribió citó".split())
ADDRESS = frozenset("you your youre ya u du dich dein ihr euch tu te toi vous tú ti usted".split())
WINDOW = 5
FEATURES = 8


def crc_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


class Trie:
    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def within(self, token: str, most: int) -> str | None:
        """A term at edit distance most or less: states (place in the token, edits so far) move along the trie's edges."""
        n = len(token)
        stack, seen = [(self.root, 0, 0)], set()
        while stack:
            node, i, e = stack.pop()
            if "" in node and n - i + e <= most:
                return node[""]
            if (key := (id(node), i, e)) in seen:
                continue
            seen.add(key)
            if i < n and (child := node.get(token[i])) is not None:
                stack.append((child, i + 1, e))
            if e < most:
                if i < n:
                    stack.append((node, i + 1, e + 1))
                for c, child in node.items():
                    if c:
                        stack.append((child, i, e + 1))
                        if i < n and c != token[i]:
                            stack.append((child, i + 1, e + 1))
        return None


@dataclass
class Lexicon:
    words: frozenset[str]
    stems: frozenset[str]
    fuzzy: tuple[str, ...]
    trie: Trie = field(init=False)
    halves: dict[int, list[tuple[int, frozenset[str], frozenset[str]]]] = field(init=False)

    def __post_init__(self):
        # One edit leaves a half of the word as it is: by token length, the halves a misspelled token must begin or end with.
        self.trie = Trie(list(self.fuzzy))
        self.halves = {}
        for n in {len(w) + d for w in self.fuzzy for d in (-1, 0, 1)}:
            near = [w for w in self.fuzzy if abs(len(w) - n) <= 1]
            sizes = {len(w) // 2 for w in near} | {len(w) - len(w) // 2 for w in near}
            self.halves[n] = [(k, frozenset(w[:k] for w in near if len(w) // 2 == k), frozenset(w[-k:] for w in near if len(w) - len(w) // 2 == k)) for k in sorted(sizes)]

    def kind(self, token: str) -> int:
        """1 word, 2 misspelled word, 3 beginning, 0 none."""
        if token in self.words:
            return 1
        for k in PREFIXES:
            if len(token) > k and token[:k] in self.stems:
                return 3
        return self.misspelled(token)

    def misspelled(self, token: str) -> int:
        """2 for a misspelled word, 0 for others."""
        for k, heads, tails in self.halves.get(len(token), ()):
            if token[:k] in heads or token[-k:] in tails:
                return 2 if self.trie.within(token, 1) else 0
        return 0


def features(text: str, lex: Lexicon, cache: dict[str, int]) -> list[float]:
    out = [0.0] * FEATURES
    low = text.lower()
    kinds = {}
    broken = {a + c + b for a, c, b in BROKEN.findall(low)}
    for token in {*WORD.findall(low), *broken}:
        k = cache.get(token)
        if k is None:
            if len(cache) > 500_000:
                cache.clear()
            k = cache[token] = lex.misspelled(token) if token in broken else lex.kind(token)
        if k:
            kinds[token] = k
    if not kinds:
        return out
    tokens = list(WORD.finditer(low))
    if any(x in kinds for x in broken):
        # a broken word takes the place of its parts, unless one of them is a hit by itself
        parts, tokens = tokens, []
        for m in parts:
            last = tokens[-1] if tokens else None
            if last and m.start() - last.end() == 1 and low[last.start() : m.end()] in kinds and not (last[0] in kinds or m[0] in kinds):
                tokens[-1] = re.compile(".+", re.DOTALL).match(low, last.start(), m.end())
            else:
                tokens.append(m)
    hits: set[str] = set()
    for i, m in enumerate(tokens):
        k = kinds.get(m[0])
        if not k:
            continue
        hits.add(m[0])
        near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        before, after = low[near[0].start() : m.start()], low[m.end() : near[-1].end() + 2]
        quoted = (any(q in before for q in QUOTES) and any(q in after for q in QUOTES)) or any(x[0] in REPORTING for x in tokens[max(0, i - WINDOW) : i])
        out[(k - 1) * 2 + quoted] += 1
        out[6] += not quoted and any(x[0] in ADDRESS for x in near)
    out = [math.log1p(x) for x in out[:7]]
    return [*out, math.log1p(len(hits))]


def labelled(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """crc, toxic and text of the bounded training sample; labels of at most max_rows rows are broadcast."""
    rows = labels.select(F.col(f"`{id_col}`").alias("lid"), F.col(f"`{label_col}`").cast("int").alias("toxic")).filter("lid is not null and toxic is not null")
    rows = rows.groupBy("lid").agg(F.max("toxic").alias("toxic")).filter(crc_of(F.col("lid")) % 5 != 0)
    chosen = rows.orderBy(F.xxhash64("lid"), "lid").limit(max_rows)
    docs = df.select(F.col(f"`{id_col}`").alias("lid"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return docs.join(F.broadcast(chosen), "lid").select((crc_of(F.col("lid")) % 5).alias("fold"), "toxic", "text")


def learn_lexicon(train: DataFrame, min_docs: int = 4, precision: float = 0.9) -> Lexicon:
    """All terms in at least min_docs toxic documents of which the given share of all their documents is toxic.

    Their number is bounded by the words of the bounded training sample; none is left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            keys = list(total)
            b = pa.RecordBatch.from_arrays([pa.array([k[0] == "^" for k in keys], pa.bool_()), pa.array([k[1:] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], ["stem", "term", "n", "toxic"])
            total.clear()
            bad.clear()
            return b

        total: Counter[str] = Counter()
        bad: Counter[str] = Counter()
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = {x for x in WORD.findall(text.lower()) if len(x) >= 4}
                terms = {"=" + x for x in w} | {"^" + x[:k] for x in w for k in PREFIXES if len(x) > k}
                total.update(terms)
                if toxic:
                    bad.update(terms)
            if len(total) > 400_000:
                yield flush()
        yield flush()

    counts = train.select("toxic", "text").mapInArrow(count, "stem boolean, term string, n long, toxic long").groupBy("stem", "term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    good = counts.filter((F.col("toxic") >= min_docs) & (F.col("toxic") >= precision * F.col("n"))).orderBy("stem", "term").collect()
    words = [r["term"] for r in good if not r["stem"]]
    return Lexicon(frozenset(words), frozenset(r["term"] for r in good if r["stem"]), tuple(words))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps; classes weigh as they come."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + ridge * np.r_[w[:-1], 0]
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits."""
    small_batches(df.sparkSession)
    train = labelled(df, labels, id_col, text_col, label_col, max_rows)
    lex = learn_lexicon(train.filter("fold in (1, 2)"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t, lex, cache) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["toxic", "x"])

    seen = train.filter("fold in (3, 4)").select("toxic", "text").mapInArrow(measure, "toxic int, x array<double>").toArrow()  # max_rows small rows at most
    y = np.array(seen.column("toxic").to_pylist(), float)
    w = fit(np.array(seen.column("x").to_pylist(), float), y) if len(y) and 0 < y.mean() < 1 else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            x = np.array([features(t or "", lex, cache) for t in b.column(2).to_pylist()], float).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) if w is not None else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(np.round(np.expm1(x[:, 7])).astype(np.int64))], ["doc_id", "held_out", "score", "predicted", "n_hits"])

    d = F.col(f"`{id_col}`")
    rows = df.select(d.cast("long").alias("doc_id"), (crc_of(d) % 5 == 0).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, n_hits long")
