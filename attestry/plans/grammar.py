"""Simplified patterns to Java regular expressions, and the master pattern of a rule set.

A simplified pattern is a regular expression in which a blank stands for any run of white space or comment marks, and
the wildcards .* and .+ stand for a bounded number of words.  Everything is bounded, so no text makes matching
explode.  Spark SQL's regex functions use the same dialect, so the result is a literal for rlike and regexp_replace.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Limits of the grammar.
NAME_MAX, WORDS_MAX, SPACE_MAX, YEARS_MAX = 30, 35, 47, 30
SEARCH_MAX, CLUSTERS_MAX = 262_144, 10

FLAGS = "(?imsu)"
#: White space, comment marks and the signs that pass for them.
WS = r"[\s\p{Z}*/#·§­¶ ]"
SPACE = f"{WS}{{1,{SPACE_MAX}}}"
MAYBE_SPACE = f"{WS}{{0,{SPACE_MAX}}}"
NOT_SPACE = r"[^\s\p{Z}]"
URL = r"(?:https?://|www\.)[\p{L}\p{N}._~:/?#@!$&'*+,;=%-]{1,200}"
_NAME = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}.,&'@+_<>’-]{0," + str(NAME_MAX - 1) + "}"
_YEARS = rf"(?:19|20)[0-9]{{2}}(?:[\s,\-–]{{1,3}}(?:(?:19|20)?[0-9]{{2}}|present)){{0,{YEARS_MAX}}}"


class PatternError(ValueError):
    pass


def _check(p: str) -> None:
    """No capturing groups, no blank inside a character class, not empty."""
    if not p.strip():
        raise PatternError("empty pattern")
    in_class = escaped = False
    for i, c in enumerate(p):
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif in_class:
            if c == "]":
                in_class = False
            elif c.isspace():
                raise PatternError(f"blank inside a character class: {p!r}")
        elif c == "[":
            in_class = True
        elif c == "(" and not re.match(r"\(\?(?:[:=!>]|<[=!]|[a-z-]+[:)])", p[i:]):
            raise PatternError(f"capturing group: {p!r}")
    if in_class:
        raise PatternError(f"open character class: {p!r}")


def expand(p: str) -> str:
    """The Java regex of a simplified pattern; wildcards at its edges stay plain .* for full matches."""
    _check(p)
    head = bool(re.match(r"\.[*+]", p))
    tail = bool(re.search(r"(?<!\\)\.[*+]$", p))
    body = re.sub(r"^\.[*+]", "", p) if head else p
    body = re.sub(r"(?<!\\)\.[*+]$", "", body) if tail else body
    words = f"(?:{MAYBE_SPACE}{NOT_SPACE}{{1,{NAME_MAX}}})"
    body = re.sub(r" *(?<!\\)\.\* *", lambda m: f"\x00{words}{{0,{WORDS_MAX}}}{MAYBE_SPACE}", body)
    body = re.sub(r" *(?<!\\)\.\+ *", lambda m: f"\x00{words}{{1,{WORDS_MAX}}}{MAYBE_SPACE}", body).replace("\x00", "")
    body = re.sub(r"\x20+\?", lambda m: MAYBE_SPACE, body)
    body = re.sub(r"\x20+", lambda m: SPACE, body)
    return (".*" if head else "") + body + (".*" if tail else "")


def embedded(p: str) -> str:
    """An expanded pattern without its edge wildcards."""
    p = p.removeprefix(".*")
    return p[:-2] if p.endswith(".*") and not p.endswith("\\.*") else p


#: Words that hint at an unknown license or contract.
CONTRACT_WORDS = (
    r"no copyright(?:able)?", r"agreement", r"amendment", r"contract(?:or|ual)?s?", r"licen[sc]e[edrs]{0,2}", r"licensing", r"sub-?licen[sc]e", r"without (?:any )?warrant(?:y|ies)", r"warrant(?:y|ies)", r"liabilit(?:y|ies)", r"liable", r"indemnif(?:y|ication)",
    r"patents?", r"trademarks?", r"royalt(?:y|ies)(?:-free)?", r"jurisdiction", r"governing law", r"herein(?:after)?", r"hereby", r"thereof", r"derivative works?", r"redistribut(?:e|ed|ion)", r"all rights reserved", r"permission (?:is|to)",
    r"public domain", r"copyright(?:able|ed)?", r"(?:gnu )?(?:\p{L}{1,20} )?public licen[sc]e", r"SPDX-License-Identifier", r"terms (?:and|of)", r"non-?commercial", r"intellectual property", r"proprietary", r"confidential",
)


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _atom_end(p: str, i: int) -> int:
    """Where the atom of a regex that begins at i ends: a group, a class, an escape or one character."""
    if p[i] == "\\":
        return p.index("}", i) + 1 if p[i + 1 : i + 2] in "pP" and p[i + 2 : i + 3] == "{" else i + 2
    if p[i] == "[":
        i += 2
        while p[i] != "]":
            i += 2 if p[i] == "\\" else 1
        return i + 1
    if p[i] == "(":
        i += 1
        while p[i] != ")":
            i = _atom_end(p, i)
    return i + 1


def _alternatives(p: str) -> list[str]:
    out, begun, i = [], 0, 0
    while i < len(p):
        if p[i] == "|":
            out.append(p[begun:i])
            begun = i + 1
            i += 1
        else:
            i = _atom_end(p, i)
    return [*out, p[begun:]]


def first_characters(p: str) -> frozenset[str] | None:
    """The characters, in lower case, a match of p can begin with; None where that cannot be said or p can be empty."""
    out: set[str] = set()
    for alt in _alternatives(p):
        i, open_end = 0, True
        while i < len(alt) and open_end:
            j = _atom_end(alt, i)
            atom = alt[i:j]
            times = re.match(r"(?:[?*+]|\{[0-9]+(?:,[0-9]*)?\})[?+]?", alt[j:])
            i = j + (times.end() if times else 0)
            if re.match(r"\(\?<?[=!]", atom) or atom in ("\\b", "\\A", "^"):
                continue
            if atom.startswith("(?:"):
                found = first_characters(atom[3:-1])
            elif atom[0] == "[":
                found = None if re.search(r"[\\^&-]", atom[1:-1]) else frozenset(atom[1:-1])
            elif atom[0] == "\\":
                found = None if atom[1].isalnum() else frozenset(atom[1])
            else:
                found = None if atom[0] in "(.$" else frozenset(atom)
            if found is None:
                return None
            out |= found
            open_end = bool(times) and times[0][0] in "?*" or bool(times) and times[0].startswith("{0")
        if open_end:
            return None
    return frozenset(c.lower() for c in out)


def by_first_character(patterns: list[str]) -> str:
    """The alternation of patterns in their order, but only those are tried that can begin with the character at hand."""
    firsts = [first_characters(p) for p in patterns]
    lists: dict[tuple[int, ...], str] = {}
    letters = sorted(set().union(*[f for f in firsts if f is not None]))
    for c in letters:
        here = tuple(k for k, f in enumerate(firsts) if f is None or c in f)
        lists[here] = lists.get(here, "") + _in_class(c)
    out = [f"(?=[{chars}])(?:{_any([patterns[k] for k in here])})" for here, chars in lists.items()]
    anywhere = [p for p, f in zip(patterns, firsts, strict=True) if f is None]
    if anywhere:
        known = "".join(lists.values())
        out.append((f"(?![{known}])" if known else "") + f"(?:{_any(anywhere)})")
    return "|".join(out)


def requirements(p: str) -> list[list[frozenset[str]]] | None:
    """For each branch of p, sets of literals in lower case: every match of the branch holds one of each set.

    None where a branch has no such set, so that nothing is known of its matches.
    """
    out: list[list[frozenset[str]]] = []
    for alt in _alternatives(p):
        found: list[frozenset[str]] = []
        run, i = "", 0
        while i < len(alt):
            j = _atom_end(alt, i)
            atom = alt[i:j]
            times = re.match(r"(?:[?*+]|\{[0-9]+(?:,[0-9]*)?\})[?+]?", alt[j:])
            i = j + (times.end() if times else 0)
            if re.match(r"\(\?<?[=!]", atom) or atom in ("\\b", "\\A", "^", "$"):
                continue
            literal = atom[1:] if atom[0] == "\\" and not atom[1].isalnum() else atom if len(atom) == 1 and atom != "." else ""
            if literal and not times:
                run += literal
                continue
            found, run = found + [frozenset([run.lower()])] * bool(run), ""
            optional = times and (times[0][0] in "?*" or times[0].startswith("{0"))
            if not optional and atom[0] == "(" and (atom[1] != "?" or atom.startswith("(?:")) and (inner := requirements(atom[3:-1] if atom[1] == "?" else atom[1:-1])):
                # of several branches, the literals of a set of each: the rarest ones, and the others that all branches have
                found += inner[0] if len(inner) == 1 else list(dict.fromkeys(frozenset().union(*[pick(x, key=_least_rarity) for x in inner]) for pick in (max, min)))
        found += [frozenset([run.lower()])] * bool(run)
        if not found:
            return None
        out.append(found)
    return out


def _least_rarity(literals: frozenset[str]) -> float:
    return min(map(_rarity, literals))


def anchors(p: str) -> frozenset[str] | None:
    """Literals, in lower case, one of which stands in every match of p; None where no such set is seen."""
    branches = requirements(p)
    return None if branches is None else frozenset().union(*[max(x, key=_least_rarity) for x in branches])


def _rarity(literal: str) -> float:
    """Digits are common, letters beyond ASCII are not."""
    return sum(0.25 if c.isdigit() else 1 if c.isascii() else 4 for c in literal)


#: The characters beyond ASCII that stand for ASCII letters when case is ignored, and those letters.
FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")


def full_match(patterns: list[str]) -> str | None:
    """A regex that is true for whole texts matching one of the expanded patterns; None for no patterns."""
    return f"{FLAGS}\\A(?:{_any(patterns)})\\z" if patterns else None


NEVER = "(?!)"

#: Groups of the master pattern, by number of finding: what stands before, the group itself, what stands behind, and whether
#: it is in the repeated part.  1 known license 2 "provided under the ... license" 3 "License: ..." line 4 author
#: 5, 6 owner behind years, owner before years 7, 8 the same in following lines.
GROUPS = ((0, 1, 0, False), (2, 3, 0, False), (4, 5, 0, False), (6, 7, 0, False), (8, 9, 0, False), (10, 11, 12, False), (13, 14, 0, True), (15, 16, 17, True))
GROUP_COUNT = 17
#: How many groups the parts behind the known licenses have.
GROUPS_OF_PARTS = (2, 2, 2, 10)


def _around(owners: list[str]) -> list[str]:
    """The alternatives of the master pattern behind the known licenses, with the groups above."""
    owner_words = f"{_NAME}(?:[\\x20\\t]{{1,4}}{_NAME}){{0,{WORDS_MAX}}}"
    extra = _any([embedded(p) for p in owners])
    name = f"(?:{extra}|{owner_words})" if extra else owner_words
    sign = rf"(?:copyright(?:ed|s)?(?:{MAYBE_SPACE}(?:\(c\)|©|&copy;))?|\(c\)|©|&copy;)"
    gap = r"[\s,:\p{Z}*/#-]{1,47}"
    claim = rf"(?:({sign}{gap}{_YEARS}{gap}(?:by{SPACE})?)({name})|({sign}{gap})({name})({gap}{_YEARS}))"
    follow = rf"(?:{WS}{{1,{SPACE_MAX}}}{claim}){{0,5}}"
    return [
        rf"(\b(?:is|are){SPACE}(?:distributed|provided|released|made{SPACE}available|licensed){SPACE}under{SPACE}(?!this\b))((?:{NOT_SPACE}{{1,{NAME_MAX}}}{SPACE}){{1,12}}?licen[sc]es?)\b",
        rf"(\blicen[sc]e[\x20\t]*:[\x20\t]*)({NOT_SPACE}{{1,{NAME_MAX}}}(?:[\x20\t]{{1,4}}{NOT_SPACE}{{1,{NAME_MAX}}}){{0,9}})",
        rf"(\b(?:the{SPACE}authors?{SPACE}of{SPACE}this{SPACE}software{SPACE}(?:is|are){SPACE}|authors?[\x20\t]*:[\x20\t]*))({name})",
        rf"{claim}{follow}",
    ]


#: The pattern around its alternatives: a match begins where a word begins, no other place tries them.
HEAD, TAIL = FLAGS + r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}(©&<\"'.])(?:", ")"


#: What stands around the alternation of contract words, which comes twice.
WORDS = (r"\b(?:", rf")(?:{SPACE}(?:", r")){0,35}\b")


def master(third: list[str], first: list[str], forbidden: list[str], owners: list[str]) -> str:
    """One alternation; the first alternative that matches wins."""
    known = by_first_character([embedded(p) for p in (*third, *first, *forbidden)]) or NEVER
    contract = by_first_character([expand(p) for p in CONTRACT_WORDS])
    return HEAD + _any([f"({known})", *_around(owners), contract.join(WORDS)]) + TAIL


@dataclass(frozen=True)
class Branch:
    """What a text must hold to match: one of the roots, and one literal of each set."""

    roots: tuple[str, ...]
    sets: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Alternative:
    """A part of the master pattern, the place it has there, and what a text must hold for it: all of one branch."""

    place: int
    pattern: str
    branches: tuple[Branch, ...]


@dataclass(frozen=True)
class RuleIndex:
    """From literals to the alternatives of a master pattern.

    roots: a few literals, one of which stands in every text that can match at all.  alternatives: known licenses (place 0), the
    four parts with groups of their own (1 to 4), contract words (5).
    """

    roots: tuple[str, ...]
    alternatives: tuple[Alternative, ...]


def rule_index(third: list[str], first: list[str], forbidden: list[str], owners: list[str]) -> RuleIndex | None:
    """The index of a rule set; None where some alternative can match a text without any literal."""
    placed = [(0, embedded(p)) for p in (*third, *first, *forbidden)] + list(enumerate(_around(owners), 1)) + [(5, expand(p)) for p in CONTRACT_WORDS]
    known = [requirements(p) for _, p in placed]
    if any(r is None for r in known):
        return None
    roots = _roots([branch for r in known for branch in r])

    def made(sets: list[frozenset[str]]) -> Branch:
        rooted = next(s for s in sets if all(any(r in x for r in roots) for x in s))
        return Branch(tuple(r for r in roots if any(r in x for x in rooted)), tuple(tuple(sorted(s)) for s in dict.fromkeys(sets)))

    return RuleIndex(roots, tuple(Alternative(k, guarded(p), tuple(map(made, r))) for (k, p), r in zip(placed, known, strict=True)))


def guarded(p: str) -> str:
    """p behind a look at the next character, where only some can begin a match of it."""
    firsts = first_characters(p)
    return p if firsts is None else f"(?=[{''.join(map(_in_class, sorted(firsts)))}]){p if len(_alternatives(p)) == 1 else f'(?:{p})'}"


def _in_class(c: str) -> str:
    return "\\" + c if c.isascii() and not c.isalnum() else c


def _roots(branches: list[list[frozenset[str]]]) -> tuple[str, ...]:
    """A small set of literals that holds, for each branch, a part of every literal of one of its sets."""
    chosen: list[str] = []
    covered = lambda x: any(r in x for r in chosen)
    cost = lambda s: sum(1 + 4096 * 4.0 ** -_rarity(x) for x in s if not covered(x))  # noqa: E731  a search each, more for short ones, which let most texts through
    for branch in sorted(branches, key=lambda sets: (len(sets), sorted(map(sorted, sets)))):
        chosen += sorted(x for x in min(branch, key=lambda s: (cost(s), sorted(s))) if not covered(x))
    return tuple(sorted(x for x in set(chosen) if not any(y != x and y in x for y in chosen)))
