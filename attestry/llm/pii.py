"""Personal data with offset-preserving deobfuscation.

Base detectors read the source text.  Transducers then rewrite disguises - look-alike letters, foreign digits,
zero-width marks, addresses spaced letter by letter, spelled digits, letters for digits, at/dot words - into plain
characters while keeping, for each character written, the source range it came from.  The same detectors run on the
rewritten text and their hits are mapped back; those that touch no base span of their kind are added.

Secrets - key blocks, tokens of known form, long random values given to a name such as token or password - are spans
of their own kind, kept apart from personal data.

Defined cases: null text is empty and has no spans; empty text likewise; texts of any length are read whole in one
linear pass per detector; repeated rows give equal results; of spans that tie the base one stays; an empty table gives an
empty result; columns other than id and text are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain.  No local part holds an @, so each @ is tried once, with what stands before it."""
    done = last = 0
    at = text.find("@")
    while at >= 0:
        floor = start = max(done, last)
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        last = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield Span("email", start, m.end())
            done = m.end()
        at = text.find("@", max(last, done))


def addresses(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield Span("ip", m.start(), m.end())


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield Span("card", m.start(), m.end())


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            yield Span("phone", m.start(), m.end())


DETECTORS = dict(zip(KINDS, (emails, addresses, cards, phones), strict=True))


def detect(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += emails(text)
    if "." in text:
        found += addresses(text)
    found += cards(text)
    if "+" in text:
        found += phones(text)
    return found


#: Letters of other alphabets that look like ASCII ones.
LOOKALIKES = dict(zip("АВЕКМНОРСТХавекмнорстухіјѕԁΑΒΕΖΗΙΚΜΝΟΡΤΥΧοѐ", "ABEKMHOPCTXabekmhopctyxijsdABEZHIKMNOPTYXoe", strict=True))
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: Digit words from zero to nine in four languages.
DIGIT_WORDS = {
    w: str(d)
    for line in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for d, w in enumerate(line.split())
}
_DIGIT_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: at and dot, in brackets or as words; plain words only count together (name at host dot org).
_AT_WORD, _DOT_WORD = r"at|chez|arroba", r"dot|punkt|point|punto"
ODD = re.compile(rf"[Ͱ-ϿЀ-ԯ٠-٩۰-۹०-९₀-₉①-⑳！-～\U0001d400-\U0001d7ff{ZERO_WIDTH}]")
SPELLED = re.compile(rf"(?i)(?<!\w)(?:(?:plus|{_DOT_WORD}|{_DIGIT_WORD}|[0-9])[\x20,-]{{1,3}}){{6,}}(?:{_DIGIT_WORD}|[0-9])(?!\w)")
_SPELLED_PART = re.compile(rf"(?i)(plus|{_DOT_WORD}|{_DIGIT_WORD}|[0-9])[\x20,-]*")
#: An address with a blank between each two characters: j o h n @ x . o r g.
SPACED = re.compile(r"(?<![A-Za-z0-9@])(?:[A-Za-z0-9._%+-]\x20)+@\x20(?:[A-Za-z0-9.-]\x20)+[A-Za-z0-9](?![A-Za-z0-9@])")
#: An address joined by underscores: john_at_example_dot_com.
UNDERSCORED = re.compile(rf"(?i)(?<=[A-Za-z0-9])_(?:{_AT_WORD})_[A-Za-z0-9-]+(?:_(?:{_DOT_WORD})_[A-Za-z0-9-]+)+")
_UNDERSCORED_PART = re.compile(rf"(?i)_(?:({_AT_WORD})|(?:{_DOT_WORD}))_")
#: A number after + in which letters stand for the digits they look like: +1-555-O12-3456.
CONFUSED = re.compile(r"\+[0-9][\x20().0-9OoIl-]{6,}(?![A-Za-z])")
_CONFUSED_PART = re.compile(r"[OoIl](?=[OoIl]*[0-9])|(?<=[0-9])[OoIl]")
_OPEN, _SHUT = r"[\[({<]\x20?", r"\x20?[\])}>]"
BRACKETED = re.compile(rf"(?i)\x20?{_OPEN}(?:({_AT_WORD}|@)|({_DOT_WORD}|\.)){_SHUT}\x20?")
PLAIN = re.compile(rf"(?i)(?<=[\w.%+-])\x20(?:{_AT_WORD})\x20(?=[A-Za-z0-9-]{{1,63}}(?:\x20(?:{_DOT_WORD})\x20[A-Za-z0-9-]{{1,63}})+)")
#: A host joined to a plain or bracketed at: name@host dot org.
JOINED = re.compile(rf"(?i)@[A-Za-z0-9-]{{1,63}}\x20(?:{_DOT_WORD})\x20(?=[A-Za-z0-9])")
PLAIN_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9-])\x20(?:{_DOT_WORD})\x20(?=[A-Za-z0-9])")


class Tape:
    """A text with the source range [starts[i], ends[i]) of each of its characters."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """With each [a, b) replaced; edits in order, without overlap.  New characters stand for the whole range."""
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            text.append(new)
            starts += [self.starts[a]] * len(new)
            ends += [self.ends[b - 1]] * len(new)
            at = b
        return Tape("".join([*text, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, s: Span) -> Span:
        return Span(s.kind, self.starts[s.start], self.ends[s.end - 1])


def plain_char(c: str) -> str:
    if c in ZERO_WIDTH:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


def letters_pass(t: Tape) -> Tape:
    edits = [(m.start(), m.end(), p) for m in ODD.finditer(t.text) if (p := plain_char(m[0])) != m[0]]
    return t.rewritten(edits) if edits else t


def spaced_pass(t: Tape) -> Tape:
    """Letter-by-letter addresses lose their blanks, underscores around at and dot become signs."""
    if " @ " in t.text:
        edits = [(k, k + 1, "") for m in SPACED.finditer(t.text) for k in range(m.start() + 1, m.end(), 2)]
        t = t.rewritten(edits) if edits else t
    if "_" in t.text:
        edits = [(p.start(), p.end(), "@" if p[1] else ".") for m in UNDERSCORED.finditer(t.text) for p in _UNDERSCORED_PART.finditer(t.text, m.start(), m.end())]
        t = t.rewritten(edits) if edits else t
    return t


def confused_pass(t: Tape) -> Tape:
    if "+" not in t.text:
        return t
    edits = [(p.start(), p.end(), "0" if p[0] in "Oo" else "1") for m in CONFUSED.finditer(t.text) for p in _CONFUSED_PART.finditer(t.text, m.start(), m.end())]
    return t.rewritten(edits) if edits else t


def digits_pass(t: Tape) -> Tape:
    """A run of seven or more spelled or single digits becomes the number it spells."""
    edits = []
    for m in SPELLED.finditer(t.text):
        for p in _SPELLED_PART.finditer(t.text, m.start(), m.end()):
            word = p[1].lower()
            edits.append((p.start(), p.end() if p.end() < m.end() else p.end(1), "+" if word == "plus" else "." if word in _DOT_WORD.split("|") else DIGIT_WORDS.get(word, word)))
    return t.rewritten(edits) if edits else t


def at_dot_pass(t: Tape) -> Tape:
    edits = [(m.start(), m.end(), "@" if m[1] else ".") for m in BRACKETED.finditer(t.text)]
    if edits:
        t = t.rewritten(edits)
    low = t.text.lower()
    if any(f" {w} " in low for w in _DOT_WORD.split("|")):
        ats = [(m.start(), m.end(), "@") for m in PLAIN.finditer(t.text)]
        edits = []
        for k, (a, b, _) in enumerate(ats):
            edits.append(ats[k])
            upto = ats[k + 1][0] if k + 1 < len(ats) else len(t.text)
            at = b
            while (host := re.compile(r"[A-Za-z0-9-]{1,63}").match(t.text, at)) and (d := PLAIN_DOT.match(t.text, host.end())) and d.end() <= upto:
                edits.append((d.start(), d.end(), "."))
                at = d.end()
        # a host joined to a bracketed at: name@host dot org
        for m in re.finditer(r"@[A-Za-z0-9-]{1,63}", t.text):
            at = m.end()
            while d := PLAIN_DOT.match(t.text, at):
                edits.append((d.start(), d.end(), "."))
                host = re.compile(r"[A-Za-z0-9-]{1,63}").match(t.text, d.end())
                at = host.end() if host else d.end()
        edits = sorted(set(edits))
        if edits:
            t = t.rewritten(edits)
    return t


_BRACKET_HINT = re.compile(rf"(?i){_OPEN}(?:{_AT_WORD}|@|{_DOT_WORD}|\.){_SHUT}")


def changeable(text: str) -> bool:
    """False where no pass has anything to begin with; tested against running them all."""
    if (not text.isascii() and ODD.search(text)) or ("@" in text and JOINED.search(text)):
        return True
    low = text.lower()
    if (" @ " in text and SPACED.search(text)) or ("_" in text and UNDERSCORED.search(text)) or ("+" in text and any(_CONFUSED_PART.search(m[0]) for m in CONFUSED.finditer(text))):
        return True
    plain = " at " in low or " arroba " in low or " chez " in low
    return bool((plain and PLAIN.search(text)) or _BRACKET_HINT.search(text) or SPELLED.search(text))


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in source offsets."""
    if not changeable(text):
        return []
    t = at_dot_pass(confused_pass(digits_pass(spaced_pass(letters_pass(Tape(text))))))
    if t.text == text:
        return []
    found = []
    for s in map(t.source, detect(t.text)):
        if not any(b.kind == s.kind and b.start < s.end and s.start < b.end for b in base):
            found.append(s)
    return found


def spell(spans: list[Span]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (rank[s.kind], s.start, s.end)))


#: Tokens of a published form: cloud access keys, code-host and chat tokens, signed web tokens, private keys.
TOKEN = re.compile(
    r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[oprsu]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]+"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[0-9A-Za-z+/=\s]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"
)
_TOKEN_HINTS = ("AKIA", "gh", "xox", "eyJ", "-----BEGIN")
SECRET_NAMES = ("token", "secret", "passwd", "password", "pwd", "apikey", "api_key", "api-key", "access_key", "access-key", "private_key", "private-key", "credential", "credentials")
ASSIGNED = re.compile(rf"(?i)(?:{'|'.join(SECRET_NAMES)})[\"']?\s{{0,4}}(?::=|=>|[:=])\s{{0,4}}[\"']?([0-9A-Za-z+/_~=.-]{{16,}})")


def secrets(text: str) -> list[Span]:
    """Places of secrets, without overlap.  A value given to a name counts if it mixes letters and digits, eight different characters or more."""
    found = [Span("secret", m.start(), m.end()) for m in TOKEN.finditer(text)] if any(h in text for h in _TOKEN_HINTS) else []
    low = text.lower()
    if any(n in low for n in SECRET_NAMES):
        for m in ASSIGNED.finditer(text):
            v = m[1]
            if len(set(v)) >= 8 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and not any(s.start < m.end(1) and m.start(1) < s.end for s in found):
                found.append(Span("secret", m.start(1), m.end(1)))
    return sorted(found, key=lambda s: s.start)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secrets long, secrets string, n_found long, span_list array<struct<kind:string,start:long,end:long,added:boolean>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts and digest, all spans spelled out and as structs, secrets apart, and how much was found in all."""
    small_batches(df.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "n_added": [], "n_secrets": [], "secrets": [], "n_found": [], "span_list": []}
            for cell in b.column(1):
                text = cell.as_py() or ""
                base = detect(text)
                more = disguised(text, base)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s.kind == k for s in base))
                out["base_sha256"].append(hashlib.sha256(spell(base).encode()).hexdigest())
                out["spans"].append(spell(base + more))
                out["n_added"].append(len(more))
                hidden = secrets(text)
                out["n_secrets"].append(len(hidden))
                out["secrets"].append(",".join(f"{s.start}:{s.end}" for s in hidden))
                out["n_found"].append(len(base) + len(more) + len(hidden))
                out["span_list"].append([{"kind": s.kind, "start": s.start, "end": s.end, "added": i >= len(base)} for i, s in enumerate(base + more + hidden)])
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), kinds]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], ["doc_id", *out])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(work, SCHEMA)


def digest(df: DataFrame) -> DataFrame:
    return scan(df).drop("span_list")
