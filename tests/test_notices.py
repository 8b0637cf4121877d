import bz2
import gzip
import io
import itertools
import os
import random
import tarfile
import time
import zipfile

import pytest
import regex
from pyspark.sql import functions as F

from attestry import cli
from attestry.functions import text as T
from attestry.operators import assess, scan
from attestry.plans import catalog, grammar, policy
from attestry.sources import files, sinks, store
from attestry.streaming import revisions

P = catalog.PERMISSIVE


def found(spark, texts, rules=P):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in scan.scan(df, rules).orderBy("id", "ord").collect():
        out[r["id"]].append(r)
    return out


# --- grammar and catalog --------------------------------------------------------------------------------------------


def test_expand():
    assert grammar.expand(".*x y.*").startswith(".*x[") and grammar.expand(".*x y.*").endswith("y.*")
    assert grammar.embedded(grammar.expand(".+a.*")) == "a"
    for bad in ("", "(a)", "(?<n>a)", "[a b]", "[a"):
        with pytest.raises(grammar.PatternError):
            grammar.expand(bad)
    for good in (r"\(a\)", "(?:a|b)", "(?i:a)", "(?<!x)a", "[(a-d)]"):
        grammar.expand(good)


def test_wildcards_are_bounded(spark):
    p = grammar.full_match([grammar.expand("free .* software")])
    rows = [("free software",), ("free and open\n * software",), ("free " + "x " * 60 + "software",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(F.col("t").rlike(p)).collect()]
    assert got == [True, True, False]


def test_every_rule_in_every_role(spark):
    for name, role in itertools.product(catalog.CATALOG, ("first", "third", "forbidden")):
        r = catalog.RuleSet().add(role, name)
        assert getattr(r, f"{role}_licenses") or getattr(r, f"{role}_owners")
    assert catalog.RuleSet().exclude("MIT").excludes
    with pytest.raises(catalog.UnknownRule, match="MIT"):
        catalog.find_rule("MTI")
    with pytest.raises(catalog.UnknownRule, match="ZLIB"):
        catalog.find_rule("nothing like it at all")
    assert P.signature() == catalog.RuleSet(**{f: getattr(P, f) for f in P.__dataclass_fields__}).signature() != catalog.GENERIC.signature()


# --- scanning -------------------------------------------------------------------------------------------------------

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("// License: apache2\n", {("LICENSE", "FIRST_PARTY")}), ("# SPDX-License-Identifier: BSD-2-Clause\n", {("LICENSE", "THIRD_PARTY")}), ("/*\n * " + MIT + "\n */", {("LICENSE", "THIRD_PARTY")}),
        ("\u00a9 1998, 2003-2005 by River Works", {("AUTHOR_OWNER", "THIRD_PARTY")}), ("Not a contribution.", {("LICENSE", "FORBIDDEN")}), ('designated as "Not a Contribution."', set()),
        ("Any liability for a patent of Foo", {("LICENSE", "UNKNOWN")}), ("This file is licensed under the GNU General Public License, version 3.", {("LICENSE", "THIRD_PARTY")}), ("GNU Affero General Public License", {("LICENSE", "FORBIDDEN")}),
        ("once released under Y", {("LICENSE", "FORBIDDEN")}), ("nothing here", set()), ("", set()), (None, set()), ("no copyright in this table", set()),
        ("Authors: Ada Brook", {("AUTHOR_OWNER", "THIRD_PARTY")}), ("the tool is made available under the Blue Harbour Licence", {("LICENSE", "UNKNOWN")}), ("Do What The Fuck You Want To Public License", {("LICENSE", "FORBIDDEN")}),
    ],
)
def test_snippets(spark, text, expected):
    assert {(r["match_type"], r["party"]) for r in found(spark, [text])[0]} == expected


def test_unknown_evidence(spark):
    r = found(spark, ["A patent on the wheel,\nand a trademark for its royalties"])[0]
    assert [x["text"] for x in r] == ["patent...trademark...royalties"]
    far = "patent" + "\n" * 10 + "x" * 400 + "\nroyalty"
    assert len(found(spark, [far])[0]) == 2
    many = ("\n" * 10 + "x " * 200 + "patent ") * 14
    assert len(found(spark, [many])[0]) == grammar.CLUSTERS_MAX
    assert [x["party"] for x in found(spark, [far + "\nReleased under the MIT License."])[0]] == ["THIRD_PARTY"]


NOTICES = [
    "Copyright 2019 Foo\nCopyright 2020 Foo", "author: thor", "Copyright 2019 Foo\nCopyright 2019 Foo\nCopyright 2019 Foo\n", "x\n\nCopyright (c) Foo Works 2001\n# Copyright Bar 2002, 2003\n# copyright 2004 by Baz",
    "\nlicense: mit\nLicensed under the MIT License.\r\nThe author of this software is Ann Other. All rights reserved", "is licensed under the licensed under license of licenses", "herein\nhereby\n\nCopyright Foobar 2020\nCopyright Foo 2021\npatent",
    "", "no notice", "Ünder the Apache License 2.0\n\U0001F600 (c) 1999 Ü Works",
]


def test_matches_are_those_of_another_engine(spark):
    """Places, lines and groups of the master pattern as the regex module finds them, with and without the split by first character."""
    plain = grammar.by_first_character
    texts = [*NOTICES, "\n".join(NOTICES), policy.probe_text(40)]
    for rules in (P, P.owner("first", "foo works?.*")):
        grammar.by_first_character = grammar._any
        try:
            undivided = regex.compile(rules.master)
        finally:
            grammar.by_first_character = plain
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        m = scan.matches(df, "doc_id", "text", rules.master, grammar.GROUP_COUNT).withColumn("g", scan.group_places())
        got = {i: [] for i in range(len(texts))}
        for r in m.orderBy("id", "pos").collect():
            got[r["id"]].append((r["whole"], r["start"], r["end"], r["start_line"], r["end_line"], [(g["group"], r["start"] + g["a"], r["start"] + g["b"]) for g in r["g"]]))
        for pattern in (undivided, regex.compile(rules.master)):
            for i, t in enumerate(texts):
                line = lambda at: 1 + t.count("\n", 0, max(at - 1, 0))  # noqa: E731, B023
                want = [
                    (x[0], x.start(), x.end(), line(x.start()), line(x.end()), [(k, *x.span(raw)) for k, (_, raw, _, _) in enumerate(grammar.GROUPS, 1) if x[raw] and x[raw].strip(" ")])
                    for x in pattern.finditer(t)
                ]
                assert got[i] == want, t[:80]


def test_group_offsets(spark):
    a, b = found(spark, NOTICES[:2]).values()
    assert [(r["start"], r["end"]) for r in a] == [(15, 18), (34, 37)] and [(r["start"], r["end"]) for r in b] == [(8, 12)]


def test_anchors():
    a = grammar.anchors
    assert a("(?:the )?(?:mit|expat) licen[cs]e") == {" licen"} and a("ab?c{2}def") == {"def"} and a("x(?:long|longer)y?") == {"long", "longer"} and a("copyright|\\(C\\)|©") == {"copyright", "(c)", "©"}
    assert a("(?!not)abc(?=z)de") == {"abcde"} and a("a(b{0,3}c)+d") == {"a"} and a("[ab]+|word") is None and a("x?") is None and a(".*") is None
    need = grammar.requirements
    assert need("ab[cd]ef|gh") == [[{"ab"}, {"ef"}], [{"gh"}]] and need("(?:aa19|bbb20)x") == [[{"aa19", "bbb20"}, {"x"}]] and need("ab|c?") is None
    assert need("(?:red[xy]7|blue[xy]8)") == [[{"red", "blue"}, {"7", "8"}]]
    assert grammar._roots([[frozenset({"license"})], [frozenset({"licen"})], [frozenset({"rarely", "often"}), frozenset({"license"})]]) == ("licen",)


def test_rules_share_roots():
    """Every match holds a root; twice the rules, of the same kind, need no more of them."""
    g = P.gate
    assert all(b.roots and set(b.roots) <= set(g.roots) and all(b.sets) for a in g.alternatives for b in a.branches)
    more = P.license("third", *[f"the works license number {k}" for k in range(len(g.alternatives))])
    assert len(more.gate.alternatives) == 2 * len(g.alternatives) and more.gate.roots == g.roots


def test_pattern_of_a_text(spark):
    """A text is searched for what it can hold only, in the order of the master pattern."""
    df = spark.createDataFrame([(0, "nothing"), (1, "&copy; nobody"), (2, "a PATENT, and the MIT license"), (3, "Copyright 2019 X"), (4, "terms of")], "doc_id long, text string")
    got = [r[0] for r in df.orderBy("doc_id").select(scan.chosen_pattern(F.col("text"), P.gate)).collect()]
    assert got[:2] == [None, None] and "patents?" in got[2] and "mit" in got[2] and "apache" not in got[2] and "jurisdiction" not in got[2]
    assert all(regex.compile(p).groups == grammar.GROUP_COUNT for p in got if p) and "19|20" in got[3] and "mit" not in got[3]


def test_texts_passed_over_hold_no_match(spark):
    """The same matches with and without the look at literals, whatever the case and whichever letters stand for ASCII ones."""
    odd = str.maketrans({"s": "\u017f", "k": "\u212a", "i": "\u0131", "S": "\u017f", "K": "\u212a", "I": "\u0130"})
    texts = [y for x in NOTICES for y in (x, x.upper(), x.lower(), x.translate(odd), x.title())] + [policy.probe_text(40), "", "plain words only", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rules in (P, catalog.GENERIC, P.owner("first", "foo works?.*")):
        assert rules.gate
        plain, gated = (scan.matches(df, "doc_id", "text", rules.master, grammar.GROUP_COUNT, None, g).drop("row_no").collect() for g in (None, rules.gate))
        assert plain and sorted(map(str, plain)) == sorted(map(str, gated))
    assert P.license("third", "(?:a|b?)").gate is None


def test_first_characters():
    f = grammar.first_characters
    assert f("(?:gnu )?(?:affero|agpl)") == {"g", "a"} and f("(?<!as )not") == {"n"} and f("[ab]c|\\(d") == {"a", "b", "("} and f("x{0,3}?y") == {"x", "y"}
    assert f(".a") is None and f("a?") is None and f("\\p{L}x") is None and f("") is None and f("[^a]b") is None


def test_texts_with_equal_or_no_ids(spark):
    df = spark.createDataFrame([(None, "Copyright 2019 Foo"), (None, "Copyright 2019 Bar"), (1, "author: A"), (1, "author: A")], "doc_id long, text string")
    assert sorted((r["id"] or 0, r["ord"], r["start"]) for r in scan.scan(df, P).collect()) == [(0, 1, 15), (0, 1, 15), (1, 1, 8), (1, 1, 8)]


def test_policy_changes_party(spark):
    t = ["Copyright 2020 Example Works", "// License: apache2"]
    own = P.owner("forbidden", "example works.*")
    assert [found(spark, t, own)[i][0]["party"] for i in (0, 1)] == ["FORBIDDEN", "FIRST_PARTY"]
    assert found(spark, t, P.exclude_pattern("apache2"))[1] == []
    assert {r["party"] for r in found(spark, [MIT, "Licensed under the Apache License, Version 2.0"], catalog.GENERIC)[0]} == {"UNKNOWN"}


def test_offsets_and_lines(spark):
    r = found(spark, ["line one\nline two\n  Released under the MIT License. end"])[0][0]
    assert (r["start"], r["start_line"]) == (20, 3)
    text = "ab\ncd\n"
    lines = spark.range(7).select(T.line_number(F.lit(text), F.col("id").cast("int")).alias("a"), T.line_number(F.lit(text), F.col("id").cast("int"), True).alias("b")).collect()
    assert [x["a"] for x in lines] == [1 + text[: max(i - 1, 0)].count("\n") for i in range(7)] and [x["b"] for x in lines] == [1 + text[:i].count("\n") for i in range(7)]


def test_probe_is_quick(spark):
    assert policy.probe(spark, P) < 8
    for rules in (P, catalog.GENERIC, P.license("third", "the blue boat works license .* of the harbour")):
        text = policy.probe_text(rules=rules)
        assert 200_000 < len(text) <= 1025 * 256 and found(spark, [text], rules)[0] == []
        df = spark.createDataFrame([(text,)], "t string").select(scan.chosen_pattern(F.col("t"), rules.gate).alias("p"))
        tried = df.first()["p"]
        plain = [a for a in rules.gate.alternatives if any(all(x.isalnum() for x in y) for b in a.branches for y in [sum(b.sets, ())])]
        assert len(plain) > len(rules.gate.alternatives) // 4 and all(a.pattern in tried for a in plain)


def test_normalisers(spark):
    rows = [("  a\n * b // c ",), ("see https://x.org/a/b#c now",), ("</b>  x",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.normalize_license(F.col("t"))).collect()]
    assert got == ["a b c", "see https://x.org/a/b#c now", "</b> x"]
    assert spark.range(1).select(T.normalize_owner(F.lit("Jane Doe. All rights reserved. x"))).first()[0] == "Jane Doe"
    assert spark.range(1).select(T.unquote(F.lit("a&quot;b&#34;c<var>d</var>"))).first()[0] == 'a"b"c"d"'
    assert spark.range(1).select(T.path_stack(F.array(F.lit("a b.zip"), F.lit("c.tar"), F.lit("d%")))).first()[0] == "d%25<c.tar<a%20b.zip>>"
    assert spark.range(1).select(T.printable_name(F.lit("\x00\x01ab\x02c"))).first()[0] == "_BINARY_ab_BINARY_c"


WHOLE = {
    "mit": ("MIT License\n\nCopyright (c) 2011 Ann Other\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.", "THIRD_PARTY"),
    "bsd": ("Copyright 2003 Ann Other. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice in the documentation.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.", "THIRD_PARTY"),
    "apache": ("   Licensed under the Apache License, Version 2.0 (the \"License\");\n   you may not use this file except in compliance with the License.\n   You may obtain a copy of the License at\n\n     http://www.apache.org/licenses/LICENSE-2.0\n\n"
        "   Unless required by applicable law or agreed to in writing, software\n   distributed under the License is distributed on an \"AS IS\" BASIS,\n   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "FIRST_PARTY"),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "FORBIDDEN"),
    "gpl words": ("The tool is licensed under the GPL.", "FORBIDDEN"), "gpl 3": ("The tool is licensed under the GPL version 3.", "THIRD_PARTY"), "gpl 2": ("GNU General Public License, version 2", "THIRD_PARTY"),
}


def test_whole_license_texts(spark):
    names = list(WHOLE)
    out = found(spark, [WHOLE[k][0] for k in names])
    for i, k in enumerate(names):
        assert out[i] and {r["party"] for r in out[i]} == {WHOLE[k][1]}, (k, out[i])


def test_normalize_license_everywhere(spark):
    """Outside addresses and closing tags runs of white space and comment marks become a blank; by another engine."""
    r = random.Random(3)
    texts = ["".join(r.choice(["a", " ", "\n", "*", "/", "#", "</b>", "https://x.y/a#b", "www.q.r/*s", "\u00a0", "\u00b7", "//"]) for _ in range(r.randrange(40))) for _ in range(200)]
    kept = regex.compile(f"(?i)({grammar.URL}|</)")
    want = ["".join(x if i % 2 else regex.sub(f"{grammar.WS}+", " ", x) for i, x in enumerate(kept.split(t))).strip(" ") for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [x[1] for x in sorted(df.select("i", T.normalize_license(F.col("t"))).collect())] == want


# --- verdicts -------------------------------------------------------------------------------------------------------

L, O = "LICENSE", "AUTHOR_OWNER"
ONE, THREE, UNK, BAD = "FIRST_PARTY", "THIRD_PARTY", "UNKNOWN", "FORBIDDEN"


@pytest.mark.parametrize(
    ("matches", "verdict"),
    [([(THREE, O)], THREE), ([(ONE, L), (UNK, O)], UNK)],
)
def test_verdicts(spark, matches, verdict):
    d = spark.createDataFrame([("f", p, m) for p, m in matches], "f string, party string, match_type string")
    assert assess.file_verdicts(d, "f").first()["verdict"] == verdict


def test_every_mix_of_findings(spark):
    """All sets of parties and kinds: the worst party counts, except that owners from outside yield to an own license."""
    kinds = list(itertools.product((ONE, THREE, UNK, BAD), (L, O)))
    mixes = [m for n in range(1, 4) for m in itertools.combinations(kinds, n)]
    d = spark.createDataFrame([(i, p, m) for i, mix in enumerate(mixes) for p, m in mix], "f int, party string, match_type string")
    got = {r["f"]: r["verdict"] for r in assess.file_verdicts(d, "f").collect()}
    for i, mix in enumerate(mixes):
        counted = [p for p, m in mix if (p, m) != (THREE, O) or (ONE, L) not in mix]
        assert got[i] == max(counted, key=[ONE, THREE, UNK, BAD].index), mix


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(ONE, O, 1), (ONE, L, 30), (ONE, L, 62)], [(ONE, L, 1, 30), (ONE, L, 62, 62)]),
    ],
)
def test_comments(spark, rows, expected):
    d = spark.createDataFrame([("f", i, p, m, f"t{i}", n, n) for i, (p, m, n) in enumerate(rows)], "f string, ord int, party string, match_type string, text string, start_line int, end_line int")
    got = assess.coalesce_comments(d, "f").orderBy("n").collect()
    assert [(r["party"], r["match_type"], r["start_line"], r["end_line"]) for r in got] == expected


def test_comments_by_hand(spark):
    """Random findings in order of lines against the fold written as a loop."""
    r = random.Random(12)
    rows, want = [], {}
    for f in range(60):
        line, fold = 1, []
        for i in range(r.randrange(1, 12)):
            line += r.choice([0, 1, 5, 20, 39, 41, 60, 61])
            party, kind, end = r.choice([ONE, THREE, BAD]), r.choice([L, O]), line + r.choice([0, 0, 3])
            rows.append((f, i, party, kind, f"t{i}", line, end))
            last = fold[-1] if fold else None
            if last and last[0] == party and end <= last[2] + assess.LINES_FROM_START and line <= last[3] + assess.LINES_FROM_END:
                fold[-1] = [party, L if L in (kind, last[1]) else O, last[2], max(last[3], end)]
            else:
                fold.append([party, kind, line, end])
        want[f] = fold
    d = spark.createDataFrame(rows, "f int, ord int, party string, match_type string, text string, start_line int, end_line int")
    got = {f: [] for f in want}
    for x in assess.coalesce_comments(d, "f").orderBy("f", "n").collect():
        got[x["f"]].append([x["party"], x["match_type"], x["start_line"], x["end_line"]])
    assert got == want


def test_messages(spark):
    m = lambda p, t, rank, ok: spark.range(1).select(assess.message(F.lit(p), F.lit(t), F.lit("x"), F.lit(rank), F.lit(ok), F.lit("proj"))).first()[0]
    assert m(THREE, L, 1, True) == "Third-party license allowed in repository proj:\n\nx"
    assert m(THREE, O, 3, False) == "Third-party author or owner disallowed in repository proj:\n\nx"
    assert m(BAD, L, 3, False) == "Disapproved license :\n\nx".replace(" :", " :") and m(UNK, L, 2, False).startswith("Unrecognized license")


def test_dedupe(spark):
    shape = "path string, start_line int, end_line int, message string"
    want = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, 2, "y"), ("b", None, None, "z")], shape)
    prior = spark.createDataFrame([("a", 1, None, "x"), ("b", 3, None, "z")], shape)
    assert {r["message"] for r in assess.new_comments(want, prior).collect()} == {"y", "z"}
    people = spark.createDataFrame([(7, "u7", "Seven", "s@x", ["other@x"])], "account_id int, username string, name string, email string, secondary_emails array<string>")
    asked = spark.createDataFrame([("u7",), ("7",), ("other@x",), ("new",)], "reviewer string")
    assert [r["reviewer"] for r in assess.missing_reviewers(asked, people).collect()] == ["new"]


# --- policy ---------------------------------------------------------------------------------------------------------

INI = """
# comment
[plugin "notices"]
  enable = true
  reviewer = a@x
  reviewer = "b@x"
  firstParty = APACHE2
  thirdPartyPattern = license foo bar.*
  alwaysReviewPath = /PATENT
  thirdPartyAllowedProjects = ^ext/
  timeTestMax = 8
"""


def test_policy():
    p = policy.read_policy(policy.parse_sections(INI)["plugin notices"])
    assert not p.failed and p.enabled and p.values["reviewer"] == ["a@x", "b@x"] and p.rules.first_licenses and p.rules.third_licenses and p.always_review == ["/PATENT"]
    bad = {"firstParty": ["NOPE"], "thirdPartyPattern": ["foo"], "alwaysReviewPath": ["("], "exclude": [""], "fromAccountId": ["x"]}
    q = policy.read_policy(bad)
    assert q.failed and q.rules is None and {m.key for m in q.messages} == set(bad)
    found = policy.check_project(p, {}, {"refs/heads/*": False}, {})
    assert {(m.severity, m.key) for m in found} == {("ERROR", "reviewLabel"), ("WARNING", "fromAccountId")}
    assert policy.formatted(policy.Message("ERROR", "k", "v", "bad")) == "k = v\n    ^\nbad"


def test_changed_policy(spark):
    e = spark.createDataFrame([("Root", "refs/meta/config", ["project.config"]), ("Root", "refs/heads/main", ["project.config"]), ("x", "refs/meta/config", ["project.config"]), ("Root", "refs/meta/config", ["groups"])], "project string, branch string, files array<string>")
    assert policy.config_events(e, "Root").count() == 1
    new, old = (policy.read_policy(policy.parse_sections(t)["plugin notices"]) for t in (INI, INI.replace("APACHE2", "MIT")))
    judge = lambda current, text, push=True: policy.judge_change(new, current, text, push=push)
    assert judge(new, "no token") == policy.Outcome(False, [])
    good, slow, other = policy.token(5, new.signature()), policy.token(8_000_001, new.signature()), policy.token(5, "another")
    assert not judge(old, f"x\n\n{good}").rejected and not judge(None, good).messages
    for text in ("no token", slow, other, f"{good}\n{good}"):
        assert judge(old, text).rejected and judge(None, text).rejected
        under_review = judge(old, text, push=False)
        assert not under_review.rejected and {m.severity for m in under_review.messages} == {"WARNING"} and len(under_review.comments) == len(policy.TOKEN.findall(text))
    assert judge(old, f"a\n{slow}", False).comments[0][:2] == (2, 0)
    words = policy.read_policy({**new.values, "cc": ["c@x"]})  # rules as before: no token is asked for
    assert not policy.judge_change(words, new, "no token", push=True).rejected
    assert policy.judge_change(policy.read_policy({"firstParty": ["NOPE"]}), new, good, push=True).rejected
    assert [m.severity for m in policy.check_project(policy.read_policy({"reviewLabel": ["L"], "reviewer": ["r"], "fromAccountId": ["1"]}), {"L": ["+2"]}, {}, {1: {"name": "n", "email": "e", "username": "u"}})] == ["HINT"]


def test_tokens():
    for micros in (0, 1, 95, 2_500_000, 7_999_999):
        t = policy.token(micros, "abc")
        assert policy.read_tokens(f"Tidy up\n\n{t}\n", "abc") == [micros] and policy.read_tokens(t, "other") == [-1]
        assert not policy.must_report([micros], 8)
    for limit in (1, 3):
        assert not policy.must_report([limit * 1_000_000], limit) and policy.must_report([limit * 1_000_000 + 1], limit) and policy.must_report([-1], limit)
    assert policy.must_report([], 8) and policy.must_report([4, 4], 8) and not policy.must_report([], 0)
    order = ["fast", "a little slow", "slow", "far too slow", "unusable"]
    assert [policy.tier(s) for s in (0.2, 1.01, 2.5, 30, 600)] == order and [policy.tier(s) for s in (1, 2, 10, 60)] == order[:-1]


def test_token_places():
    t = policy.token(5, "a")
    assert policy.token_places(f"Fix\n\nx {t}\n") == [(3, 2, 3, 2 + len(t))]


def test_cli(spark, tmp_path):
    (tmp_path / "a.c").write_text("// License: apache2\n")
    (tmp_path / "b.zip").write_bytes(build_zip([("n.txt", b"Not a contribution.")]))
    (tmp_path / "p.config").write_text(INI)
    run = lambda *a: cli.scan_files(spark, cli.parser().parse_args(["scan", *map(str, a)]), out, io.StringIO())
    out = io.StringIO()
    assert run("--deep", "--rules", "permissive", tmp_path / "a.c", tmp_path / "b.zip") == 0
    lines = out.getvalue().splitlines()
    assert len(lines) == 2 and lines[0].startswith("FIRST_PARTY LICENSE [1,1) [3,19)") and "FORBIDDEN" in lines[1] and "n.txt<" in lines[1]
    assert run() == 1 and run(tmp_path) == 2
    out, err = io.StringIO(), io.StringIO()
    names = io.BytesIO(f"{tmp_path / 'a.c'}\0{tmp_path / 'b.zip'}\0".encode())
    assert cli.scan_files(spark, cli.parser().parse_args(["scan", "-f", "-", "-0", "--deep", "-v", "--rules", "permissive"]), out, err, names) == 0
    assert len(out.getvalue().splitlines()) == 2 and err.getvalue().startswith("2 files, ")
    out = io.StringIO()
    assert cli.probe_policy(spark, cli.parser().parse_args(["probe", "plugin notices", str(tmp_path / "p.config")]), out) == 0
    assert policy.TOKEN.search(out.getvalue())


# --- sources and sinks ----------------------------------------------------------------------------------------------


def test_decode():
    odd = bytes(range(0x80, 0x100))
    want = "".join("™" if b in (0x85, 0x99) else "*" if b in (0x87, 0xB7) else "ö" if b == 0x94 else " " if b in (0xA0, 0xA7, 0xAD, 0xB6) else "©" if b == 0xA9 else "®" if b == 0xAE else chr(b) if b >= 0xC0 else "?" for b in odd)
    assert "".join(files.decode(b"x\n" + bytes([b]))[2:] for b in odd) == want
    assert files.decode("naïve 😀".encode()) == "naïve 😀"
    binary = bytes([0x80]) * 10_000
    assert len(files.decode(binary)) == files.BUFFER
    latin = ("caf\u00e9 cr\u00e8me br\u00fbl\u00e9e\n" * 500_000).encode("latin-1")
    began = time.perf_counter()
    text, odd, first = files.decode_counted(latin)
    assert time.perf_counter() - began < 8 and first == 3 and odd > files.BUFFER // 17 and len(text) < 2 * files.BUFFER
    sparse = ("caf\u00e9\n" * 1_600_000).encode("latin-1")  # never more odd bytes than lines: read to its end
    began = time.perf_counter()
    assert len(files.decode(sparse)) == 8_000_000 and time.perf_counter() - began < 8
    one = b"x\n" * 5000 + "\u20ac".encode() * 800 + b"\xe9" + "na\u00efve".encode()
    assert files.decode_counted(one) == ("x\n" * 5000 + "\u20ac" * 800 + "\u00e9na\u00efve", 1, 10_800)
    for k in range(2040, 2056):  # a character across the end of a buffer
        assert files.decode(b"\n" * 9 + b"a" * k + "\u20ac\U0001f600".encode() + b"\xff") == "\n" * 9 + "a" * k + "\u20ac\U0001f600\u00ff"


def build_tar(named):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n, b in named:
            i = tarfile.TarInfo(n)
            i.size = len(b)
            t.addfile(i, io.BytesIO(b))
    return out.getvalue()


def build_zip(named):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in named:
            z.writestr(n, b)
    return out.getvalue()


def build_ar(named):
    return b"!<arch>\n" + b"".join(f"{n + '/':<16}{0:<12}{0:<6}{0:<6}{'100644':<8}{len(b):<10}`\n".encode() + b + b"\n" * (len(b) % 2) for n, b in named)


def build_cpio(named):
    def entry(n, b, mode):
        head = "070701" + "".join(f"{x:08x}" for x in (1, mode, 0, 0, 1, 0, len(b), 0, 0, 0, 0, len(n) + 1, 0))
        part = head.encode() + n.encode() + b"\0"
        part += b"\0" * (-len(part) % 4)
        return part + b + b"\0" * (-len(b) % 4)

    return b"".join(entry(n, b, 0o100644) for n, b in named) + entry("TRAILER!!!", b"", 0)


def test_archives(spark, tmp_path):
    inner = build_zip([("deep.txt", b"Not a contribution.")])
    named = [("a.txt", b"License: apache2"), ("in.zip", inner)]
    (tmp_path / ".git").mkdir()
    contents = {"t.tgz": gzip.compress(build_tar(named)), "z.zip": build_zip(named), "r.a": build_ar(named), "c.cpio": build_cpio(named), "p.txt.bz2": bz2.compress(b"plain"), "broken.zip": b"no zip at all", "x.txt": b"text", ".git/skip": b"skip"}
    for n, b in contents.items():
        (tmp_path / n).write_bytes(b)
    t = files.texts(files.read_files(spark, str(tmp_path)))
    got = {(os.path.basename(r["path"]), *r["path_stack"][1:]): r["text"] for r in t.collect()}
    for a in ("t.tgz", "z.zip", "r.a", "c.cpio"):
        assert got[(a, "a.txt")] == "License: apache2" and got[(a, "in.zip", "deep.txt")] == "Not a contribution."
    assert got[("p.txt.bz2",)] == "plain" and got[("broken.zip",)] == "no zip at all" and got[("x.txt",)] == "text" and len(got) == 11
    assert sinks.exit_code(t) == 0
    verdicts = scan.scan(t.withColumn("key", F.array_join("path_stack", "!")), P, "key").filter("id like '%tgz%'")
    assert {r["party"] for r in verdicts.collect()} == {ONE, BAD}
    assert [files.archive_kind(n) for n in ("x.tar", "x.ZIP", "x.Zip", "x.jar", "x.dmp", "x.arj", "x.txt")] == ["tar", "zip", None, "jar", "dump", "arj", None]
    listing = tmp_path / "list"
    listing.write_bytes(b"\0".join(str(tmp_path / n).encode() for n in ("x.txt", "z.zip")))
    assert files.read_listing(spark, str(listing), zero=True).count() == 2


def test_damaged_entries():
    """What is left of a damaged archive, and an error for what is not."""
    named = [(f"{k}.txt", f"text {k}".encode() * 50) for k in range(4)]
    z = bytearray(build_zip(named))
    z[z.index(b"text 1") + 3] ^= 255
    got = list(files.entries("z.zip", bytes(z)))
    assert [(s[-1], b, e is None) for s, b, e in got] == [("0.txt", named[0][1], True), ("1.txt", b"", False), ("2.txt", named[2][1], True), ("3.txt", named[3][1], True)]
    for name, data in (("t.tar", build_tar(named)), ("c.cpio", build_cpio(named)), ("r.a", build_ar(named))):
        whole = list(files.entries(name, data))
        assert [b for _, b, e in whole if e is None] == [b for _, b in named] and len(whole) == 4
        at = data.index(b"text 2") + 20
        cut = list(files.entries(name, data[:at]))
        assert [b for _, b, e in cut if e is None] == [named[0][1], named[1][1]] and [e for _, _, e in cut if e], name
    assert list(files.entries("x.zip", b"PK no")) == [(("x.zip",), b"PK no", None)]
    bad = bytearray(build_zip(named))
    for k in range(1, 4):
        bad[bad.index(f"text {k}".encode()) + 3] ^= 255
    assert [e is None for _, _, e in files.entries("z.zip", bytes(bad))] == [True, False, False, False]


def test_entry_names_and_metrics(spark, tmp_path):
    (tmp_path / "z.zip").write_bytes(build_zip([("\u0001\u0002a\u0007b.txt", b"x"), ("ok.txt", b"caf\xe9\n")]))
    t = files.texts(files.read_files(spark, str(tmp_path)))
    assert {r["path_stack"][1] for r in t.collect()} == {"_BINARY_a_BINARY_b.txt", "ok.txt"}
    c = sinks.counters(t.withColumn("project", F.lit("p")), "project").first()
    assert (c["n_scans"], c["n_errors"], c["n_bytes"], c["max_bytes"], c["n_binary"]) == (2, 0, 6, 5, 1) and c["max_us"] <= c["total_us"]
    assert sinks.throughput(t, 2.0).first()["files_per_s"] == 1.0


def test_intermediate_tables(spark, monkeypatch):
    kept = store.mark()
    d = store.cut(spark.range(3), "x")
    path = store._written[-1]
    assert d.count() == 3 and store.exists(spark, path)
    store.release(spark, kept)
    assert not store.exists(spark, path) and store.mark() == kept

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Elsewhere)


def test_tree(spark):
    tree = spark.createDataFrame([("a", 0o100644, "1"), ("b", 0o100644, "2"), ("c", 0o120000, "3"), ("e", 0o100755, "5")], "path string, mode int, blob_id string")
    par = spark.createDataFrame([("p", "a", 0o100644, "1"), ("p", "b", 0o100644, "9"), ("p", "d", 0o100644, "4"), ("q", "b", 0o100644, "8")], "parent string, path string, mode int, blob_id string")
    got = {(r["path"], r["status"]) for r in files.changed_files(tree, par).collect()}
    assert got == {("b", "modified"), ("c", "added"), ("d", "deleted"), ("e", "added")}
    assert {r["path"] for r in files.regular(files.changed_files(tree, par.filter("false"))).collect()} == {"a", "b", "e"}


def test_stream(spark, tmp_path):
    pol = policy.read_policy(policy.parse_sections(INI)["plugin notices"] | {"thirdParty": ["MIT"], "forbidden": ["NOT_A_CONTRIBUTION"]})
    rows = [
        ("proj", "main", "r1", "x.c", 0o100644, "// License: apache2"), ("proj", "main", "r2", "y.c", 0o100644, MIT), ("ext/p", "main", "r3", "y.c", 0o100644, MIT), ("proj", "main", "r4", "PATENT", 0o100644, "text"),
        ("proj", "refs/meta/config", "r5", "y.c", 0o100644, MIT), ("proj", "main", "r6", "z.c", 0o100644, "// License: apache2\n\nNot a contribution."),
    ]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, revisions.SCHEMA).coalesce(1).write.json(src)
    for _ in range(2):
        q = revisions.start(spark, src, out, str(tmp_path / "cp"), lambda: pol)
        q.awaitTermination()
        spark.createDataFrame([(*rows[1][:2], "r2", "y.c", 0o100644, MIT)], revisions.SCHEMA).coalesce(1).write.mode("append").json(src)
    votes = {r["revision"]: r["vote"] for r in spark.read.parquet(f"{out}/verdicts").collect()}
    assert votes == {"r1": 2, "r2": -1, "r3": 2, "r4": -1, "r6": -1}
    c = spark.read.parquet(f"{out}/comments").collect()
    assert len([x for x in c if x["revision"] == "r2"]) == 1
    assert {(x["revision"], x["unresolved"]) for x in c} == {("r1", False), ("r2", True), ("r3", False), ("r4", True), ("r6", False), ("r6", True)}


# --- queries --------------------------------------------------------------------------------------------------------

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
def test_queries_agree_with_sql(spark):
    import duckdb

    from attestry import queries

    c = duckdb.connect()
    for t in "customer supplier documents pages benchmark conversations events".split():
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, DATA)
        names = sorted(df.columns)
        mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
        other = c.sql(sql)
        assert sorted(other.columns) == names, name
        at = [other.columns.index(n) for n in names]
        assert sorted((tuple(r[i] for i in at) for r in other.fetchall()), key=str) == mine, name


def test_entry_imports_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['attestry.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 25 and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_matches_search_whole_texts(spark, tmp_path):
    from attestry import queries

    n = 262_144
    text = "the x" + "y" * n + "\n" * 9 + "z" * 400 + " the license"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    at = text.index("license")
    (r,) = queries.match_offsets(spark, str(tmp_path)).collect()
    assert (r["doc_id"], r["start"], r["end"], r["start_line"]) == (1, at, at + 7, 10)
    (r,) = queries.finding_lines(spark, str(tmp_path)).collect()
    assert f"[{at},{at + 7})" in r["value"]
    assert queries.unknown_clusters(spark, str(tmp_path)).count() == 2
    (r,) = queries.cluster_top10(spark, str(tmp_path)).collect()
    assert (r["n_clusters"], r["n_words"]) == (2, 2)
    assert queries.truncate_scan(spark, str(tmp_path)).first()["n_searched"] == n


def test_finding_lines_of_every_document(spark, tmp_path):
    """Negative, null and repeated numbers give the rows that the SQL gives."""
    import duckdb

    from attestry import queries

    rows = [(-5, "a license"), (None, "no\nlicence here"), (None, "x" * 30 + " license"), (4, "the license"), (4, "y" * 9 + "\n\nlicense"), (6, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("finding_lines", "match_offsets"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        other = c.sql(queries.SQL[name])
        at = [other.columns.index(x) for x in df.columns]
        assert sorted(map(str, df.collect())) and sorted((tuple(r) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in other.fetchall()), key=str), name
