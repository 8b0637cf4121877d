"""License notices by phrase and by exact set-similarity containment.

Base: places where a phrase's words stand consecutively.  Method: every template is a set of words ordered by how many
documents of the corpus hold each, rarest first.  A window of twice the template's length matches when it holds the
template's share of words (containment).  Such a window must hold one of the template's first |T| - need + 1 words
(prefix filter), needs a text with need of its words (length filter), and after its first hit at place i can reach at
most |T| - i words (positional filter).  Around the hits the window slides over every start; the filters only skip
windows that cannot match, so none is missed, wherever it stands.  Short templates must stand in their order as well.

Defined cases: null text is empty: no words, null first_word and last_word, empty labels, score 0.  Repeated rows
give equal results, an empty table an empty result; texts of any length are scanned whole; ties do not arise; only the id and text columns are read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.  On UTF-8 bytes: separators become a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    share: float = 0.8
    ordered: bool = False


#: Short notices must stand whole and in their order; longer texts may be edited.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", 1.0, True),
    Template("mit", "Released under the MIT License", 1.0, True),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", 1.0, True),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", 1.0, True),
    Template("agpl", "GNU Affero General Public License", 1.0, True),
    Template("lgpl", "GNU Lesser General Public License", 1.0, True),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", 1.0, True),
    Template("cc-by-4.0", "Creative Commons Attribution 4.0 International License", 1.0, True),
    Template("mpl-2.0", "Mozilla Public License, Version 2.0", 1.0, True),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", 0.9),
    Template("epl", "Eclipse Public License", 1.0, True),
    Template("bsl-1.0", "Boost Software License, Version 1.0", 1.0, True),
    Template("bsd", "BSD 3-Clause License", 1.0, True),
    Template("bsd", "BSD 2-Clause License", 1.0, True),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at www.apache.org/licenses/LICENSE-2.0"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("public-domain", "This is free and unencumbered software released into the public domain"),
)


@dataclass(frozen=True)
class Entry:
    """A template ready to be searched."""

    label: str
    length: int  # in words
    ordered: tuple[bytes, ...]  # distinct words, rarest first
    need: int
    sequence: tuple[bytes, ...] = ()  # where not empty, all words in the order in which they must stand

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.ordered[: len(self.ordered) - self.need + 1]


def indexed(templates: tuple[Template, ...], freq: dict[bytes, int]) -> list[Entry]:
    out = []
    for t in templates:
        w = words(t.text.encode())
        ordered = tuple(sorted(set(w), key=lambda x: (freq.get(x, 0), x)))
        out.append(Entry(t.label, len(w), ordered, math.ceil(t.share * len(ordered) - 1e-9), tuple(w) if t.ordered else ()))
    return out


def most_held(part: list[bytes], e: Entry) -> int:
    """The most distinct template words in any window of part, counted up and down as it slides."""
    span, counts, n, best = 2 * e.length, dict.fromkeys(e.ordered, 0), 0, 0
    for j, x in enumerate(part):
        if j >= span and (old := part[j - span]) in counts:
            counts[old] -= 1
            n -= not counts[old]
        if x in counts:
            n += not counts[x]
            counts[x] += 1
            best = max(best, n)
    return best


def windows_held(w: list[bytes], at: dict[bytes, list[int]], e: Entry) -> float:
    """The largest containment that reaches need over all windows of w; 0 if none does.  at: places of all template words."""
    span, best = 2 * e.length, 0
    if sum(x in at for x in e.ordered) < e.need:
        return 0.0
    for i, token in enumerate(e.prefix):
        if len(e.ordered) - i < max(e.need, best + 1):  # positional: what is left cannot do
            break
        near: list[list[int]] = []  # stretches of the text whose windows hold the token
        for p in at.get(token, ()):
            if near and p - span < near[-1][1]:
                near[-1][1] = p + span
            else:
                near.append([max(0, p - span + 1), p + span])
        for a, b in near:
            best = max(best, most_held(w[a:b], e))
    return best / len(e.ordered) if best >= e.need else 0.0


def stands_in_order(at: dict[bytes, list[int]], e: Entry) -> bool:
    """Whether the words of the template follow one another, others between them or not, within a window."""
    for begin in at.get(e.sequence[0], ()):
        place = begin
        for x in e.sequence[1:]:
            there = at.get(x, ())
            k = bisect_right(there, place)
            if k == len(there) or there[k] >= begin + 2 * e.length:
                break
            place = there[k]
        else:
            return True
    return False


def blocks_held(w: list[bytes], at: dict[bytes, list[int]], e: Entry) -> float:
    """As windows_held, over the windows that start at multiples of the template's length only; no query uses it.

    The largest containment that reaches need over the blocks of w; 0 if none does.  at: places of template words.
    """
    span, seen, best = 2 * e.length, set(), 0
    for i, token in enumerate(e.prefix):
        if len(e.ordered) - i < max(e.need, best):  # positional: what is left cannot do
            break
        for p in at.get(token, ()):
            for k in (p // e.length, p // e.length - 1):
                if k < 0 or k in seen:
                    continue
                seen.add(k)
                block = w[k * e.length : k * e.length + span]
                if len(block) >= e.need:
                    best = max(best, len(set(e.ordered).intersection(block)))
    return best / len(e.ordered) if best >= e.need else 0.0


def phrase_places(w: list[bytes], joined: bytes, phrase: bytes) -> list[int]:
    """Word index of each start of phrase; joined is b' w1 w2 ... '."""
    places, size, at, seen, index = [], phrase.count(b" ") + 1, joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        index += joined.count(b" ", seen, at)
        seen = at
        places.append(index)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return places


def word_frequencies(df: DataFrame, text_col: str, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """Documents of the whole corpus that hold each wanted word; as many entries as wanted has at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for b in batches:
            for cell in b.column(0).cast(pa.binary()):
                for x in wanted.intersection(words(cell.as_py() or b"")):
                    counts[x] = counts.get(x, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = df.select(F.col(f"`{text_col}`")).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in found.collect()}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    small_batches(df.sparkSession)
    wanted = frozenset(x for t in templates for x in words(t.text.encode()))
    entries = indexed(templates, word_frequencies(df, text_col, wanted))
    keys = frozenset(x for e in entries for x in e.prefix)
    coded = [(p.encode(), label) for p, label in phrases.items()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cell in b.column(1).cast(pa.binary()):
                w = words(cell.as_py() or b"")
                joined = b" %b " % b" ".join(w)
                places, base = [], set()
                for phrase, label in coded:
                    if got := phrase_places(w, joined, phrase):
                        places += got
                        base.add(label)
                labels, score = set(base), 1.0 if base else 0.0
                if not keys.isdisjoint(w):
                    at: dict[bytes, list[int]] = {}
                    for i, x in enumerate(w):
                        if x in wanted:
                            at.setdefault(x, []).append(i)
                    for e in entries:
                        if (held := windows_held(w, at, e)) and (not e.sequence or stands_in_order(at, e)):
                            labels.add(e.label)
                            score = max(score, held)
                rows.append((len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(work, SCHEMA)
