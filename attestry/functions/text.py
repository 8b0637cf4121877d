"""Text functions as Column expressions; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import grammar

_URL_OPEN, _URL_SHUT = "", ""
#: Marks the scanner puts between the parts of a match; taken out of texts first, one for one.
MARKS = ""


def unquote(c: Column) -> Column:
    """Quotation entities and var tags become quotation marks; offsets refer to the result."""
    return F.regexp_replace(c, r"&quot;|&#34;|</?var>", '"')


def holds(c: Column, literals: list[str] | tuple[str, ...] | str) -> Column:
    """True where one of the literals stands in c."""
    out = F.lit(False)
    for x in literals:
        out = out | F.contains(c, F.lit(x))
    return out


def prepared(c: Column) -> Column:
    """A whole text for the search: marks taken out, entities replaced.  Texts that hold neither are passed on as they are."""
    c = F.coalesce(c, F.lit(""))
    bare = F.when(holds(c, MARKS), F.translate(c, MARKS, " " * len(MARKS))).otherwise(c)
    return F.when(holds(c, "&<"), unquote(bare)).otherwise(bare)


def searched(c: Column, most: int | None = grammar.SEARCH_MAX) -> Column:
    """What is searched of a text: the first `most` characters as prepared (the scanner's own limit), all for None."""
    whole = prepared(c)
    return whole if most is None else F.when(F.octet_length(c) > most, F.substring(whole, 1, most)).otherwise(whole)


def folded(c: Column) -> Column:
    """A text in lower case, with the letters that stand for ASCII ones when case is ignored."""
    c = F.coalesce(c, F.lit(""))
    return F.lower(F.when(holds(c, grammar.FOLDED[0]), F.translate(c, *grammar.FOLDED)).otherwise(c))


def normalize_license(c: Column) -> Column:
    """White space and comment marks become one blank, except inside addresses and closing tags."""
    held = F.regexp_replace(c, f"(?i)({grammar.URL}|<[/])", f"{_URL_OPEN}$1{_URL_SHUT}")
    outside = F.regexp_replace(held, f"{grammar.WS}++(?![^{_URL_OPEN}{_URL_SHUT}]{{0,256}}{_URL_SHUT})", " ")
    plain = F.regexp_replace(c, f"{grammar.WS}++", " ")
    return F.trim(F.when(c.rlike("(?i)https?://|www[.]|</"), F.translate(outside, _URL_OPEN + _URL_SHUT, "")).otherwise(plain))


#: What follows an owner's name.
OWNER_ENDS = (
    "all rights reserved", "licensed under", "released under", "distributed under", "this file", "this program", "this software", "this work", "this code", "this library", "this source", "permission is", "permission to",
    "redistribution and use", "use of this", "see the", "see license", "you may", "the above", "subject to", "under the", "for terms", "for conditions", "for more", "for details", "please see", "please read", "portions of", "based on",
    "derived from", "provided that", "without warranty", "no warranty", "is free software", "is hereby", "may be used", "may be copied", "license:", "licence:", "spdx-license",
)


def normalize_owner(license_text: Column) -> Column:
    return F.trim(F.split(license_text, r"(?i)[\s.,;(]*(?:" + "|".join(x.replace(".", r"\.") for x in OWNER_ENDS) + ")", 2)[0])


def full_match(c: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    regex = grammar.full_match(list(patterns))
    return F.lit(False) if regex is None else F.coalesce(c.rlike(regex), F.lit(False))


def owner_match(c: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    return (F.coalesce(c, F.lit("")) != "") & full_match(c, patterns)


def found_any(c: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """True where one of the raw patterns is found anywhere."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(c.rlike(p), F.lit(False))
    return out


def line_number(text: Column, offset: Column, strict: bool = False) -> Column:
    """Line of a 0-based offset, from 1.  The first character of a line counts to the line before, unless strict."""
    before = F.substring(text, F.lit(1), offset if strict else F.greatest(offset - 1, F.lit(0)))
    return (1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("int")


def fingerprint(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0"))


def escaped_path(c: Column) -> Column:
    for a, b in (("%", "%25"), (" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def path_stack(c: Column) -> Column:
    """Nested names, outermost first, as inner<outer>."""
    names = F.transform(F.reverse(c), escaped_path)
    return F.concat(F.array_join(names, "<"), F.repeat(F.lit(">"), F.greatest(F.size(c) - 1, F.lit(0))))


def printable_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^[^\p{Print}]+", "_BINARY_"), r"[^\p{Print}]+", "_BINARY_")


def full_path(project: Column, path: Column) -> Column:
    return F.concat_ws("/", project, path)
