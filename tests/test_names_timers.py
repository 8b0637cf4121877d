"""Nearest names, timers and voters, each against a brute-force version."""

import random

from attestry.operators import names
from attestry.plans import policy
from attestry.sources import sinks


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def changed(r, s, n):
    for _ in range(n):
        i, c = r.randrange(len(s) + 1), r.choice("abé")
        s = r.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])
    return s


def test_near_names_are_those_of_all_pairs(spark):
    r = random.Random(8)
    base = ["".join(r.choice("ab") for _ in range(n)) for n in [0, 1, 2, 3, 5, 8, 12, 20, 22, 23, 24, 25, 26, 27, 28, 30, 45, 60, 90] for _ in range(3)]
    known = [*base, base[9], "x" * 3000, None]
    asked = [changed(r, r.choice(base), r.randrange(0, 4)) for _ in range(400)] + ["", None, "x" * 2998, "x" * 1500 + "yy" + "x" * 1498, "x" * 2997, "x" * 3000, *base[:5]]
    a = spark.createDataFrame([(x, 1) for x in asked], "name string, key int")
    b = spark.createDataFrame([(x, "n") for x in known], "known string, distance string")
    a_set, b_set = {x for x in asked if x is not None}, {x for x in known if x is not None}

    def far(x, y):
        if abs(len(x) - len(y)) > 2:
            return 9
        if len(x) < 1000:
            return distance(x, y)
        return {"x" * 3000: 0, "x" * 2998: 2, "x" * 1500 + "yy" + "x" * 1498: 2}[x]

    table = {(x, y): far(x, y) for x in a_set for y in b_set}
    for most in (1, 2):
        assert sorted(names.near(a, b, most=most).collect()) == sorted((x, y, d) for (x, y), d in table.items() if d <= most)
    least = {x: min(table[x, y] for y in b_set) for x in a_set}
    want = sorted((x, y, d) for (x, y), d in table.items() if d == least[x] and 0 < d < 3)
    assert want and sorted(names.suggestions(a, b).collect()) == want
    assert names.suggestions(a.limit(0), b).count() == names.suggestions(a, b.limit(0)).count() == 0


def test_near_names_make_no_cross_join(spark):
    plan = names.near(spark.range(9).selectExpr("string(id) AS name"), spark.range(9).selectExpr("string(id) AS known"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_timers(spark, tmp_path):
    """Quantiles merged from batches lie within the stated error of the exact ranks; a repeated batch counts once."""
    r = random.Random(9)
    data = [(p, b, int(r.lognormvariate(8, 2))) for p, b, n in (("p", "main", 30_000), ("p", "dev", 5_000), ("q", "main", 3), (None, "main", 50)) for _ in range(n)]
    r.shuffle(data)
    empty = [("e", "main", None)] * 2
    for k in [0, 1, 2, 3, 2]:
        part = [*data[k::4], *empty[k : k + 1]]
        made = sinks.timers(spark.createDataFrame(part, "project string, branch string, elapsed_us long"), "project", "branch")
        sinks.write_timers(made, str(tmp_path), k)
    kept = sinks.read_timers(spark, str(tmp_path), "project", "branch")
    out = {(x["project"], x["branch"]): x for x in sinks.timer_quantiles(kept, "project", "branch").collect()}
    assert len(out) == 5
    gone = out["e", "main"]
    assert gone["n"] == 0 and gone["p50"] is None and gone["mean"] is None
    for key in (("p", "main"), ("p", "dev"), ("q", "main"), (None, "main")):
        v, got = sorted(x for p, b, x in data if (p, b) == key), out[key]
        assert (got["n"], got["total"], got["least"], got["most"]) == (len(v), sum(v), v[0], v[-1])
        for name, rank in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
            below, upto = sum(x < got[name] for x in v) / len(v), sum(x <= got[name] for x in v) / len(v)
            assert below - 2 * sinks.RANK_ERROR <= rank <= upto + 2 * sinks.RANK_ERROR, (key, name)


def test_voters(spark):
    lines = [
        ("a", "refs/heads/*", "label-L", "-2..+2 group Owners"), ("a", "refs/meta/config", "label-L", "  -1..+1 group Owners"),
        ("b", "refs/heads/*", "label-L", "+2"), ("b", "refs/meta/config", "label-M", "-2..+2 group Owners"), ("b", "refs/heads/x", "label-L", "-2..+2 group Owners"),
        ("c", "refs/meta/config", "label-L", "-2..+2\tgroup  Nested Ones"), ("c", "refs/heads/*", "label-L", "-2..+2 group Circle"),
        ("d", "refs/heads/*", None, None), ("d", "refs/meta/config", "label-L", ""),
    ]
    access = spark.createDataFrame(lines, "project string, ref string, key string, value string")
    got = {(r["project"], r["ref"]): r["may_approve"] for r in policy.voters(access, "L").collect()}
    assert {k for k, ok in got.items() if ok} == {("a", "refs/heads/*"), ("b", "refs/heads/*"), ("c", "refs/meta/config"), ("c", "refs/heads/*")} and len(got) == 8
    members = spark.createDataFrame([("Owners", "ann"), ("Nested Ones", "group Inner"), ("Inner", "group Owners"), ("Circle", "group Loop"), ("Loop", "group Circle"), ("Null", None)], "group string, member string")
    assert {r["group"] for r in policy.populated(members).collect()} == {"Owners", "Inner", "Nested Ones"}
    got = {(r["project"], r["ref"]) for r in policy.voters(access, "L", members).collect() if r["may_approve"]}
    assert got == {("a", "refs/heads/*"), ("c", "refs/meta/config")}
    assert policy.voters(access.limit(0), "L", members.limit(0)).count() == 0


def test_voters_of_random_groups(spark):
    r = random.Random(10)
    for _ in range(3):
        rows = [(f"g{r.randrange(30)}", f"group g{r.randrange(30)}" if r.random() < 0.9 else "u") for _ in range(40)]
        full = {g for g, m in rows if m == "u"}
        while more := {g for g, m in rows if m[6:] in full} - full:
            full |= more
        assert {x["group"] for x in policy.populated(spark.createDataFrame(rows, "group string, member string")).collect()} == full
