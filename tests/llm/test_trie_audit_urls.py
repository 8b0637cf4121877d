"""Prefix trie, filter audit and URL filter against brute-force versions, and on every odd case."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from attestry.llm import filter_audit, prefix_trie, queries, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# --- prefix trie ------------------------------------------------------------------------------------------------------


def conversations():
    r = random.Random(3)
    rows = []
    for c in [*range(-25, 130), 4000, 4001, 2**40]:
        for turn in range(r.choice([0, 0, 1, 2, 3, 5, 8])):
            text = "hello there" if turn == 0 and r.random() < 0.5 else r.choice(["yes", "no", "a b c", None, "", " \t ", f"own {c}"])
            rows.append((c, r.choice([turn, turn, None, 0]), r.choice(["user", "user", None]), text))
    rows += [(60, t, "user", f"line {t}") for t in range(3000)] + [(61, t, "user", f"line {t}") for t in range(2990)] + [(62, 0, "user", "word " * 50_000)]
    rows += rows[:40] + [(None, 0, "user", "lost"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, sha(sha(role or "") + sha(text or "")), text or ""))
    for c in own:
        own[c].sort(key=lambda x: x[:3])
    rem = lambda c: int(math.fmod(c, 20))  # noqa: E731  the sign of c, as in SQL
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - rem(c), [])[:h] + own[c][h:]
    node = {}
    for c in sorted(built):
        key, up = "", None
        for d, x in enumerate([None, *built[c]]):
            key = sha(key + x[2]) if x else "root"
            n = node.setdefault((d, key), {"conv_id": c, "n_convs": 0, "up": up, "ends": [], "w": len(WORD.findall(x[3])) if x else 0, "children": set()})
            if up:
                node[up]["children"].add((d, key))
            n["n_convs"] += 1
            up = (d, key)
        node[up]["ends"].append(c)
    for at in sorted(node, reverse=True):
        n = node[at]
        n["saved"] = (n["n_convs"] - 1) * n["w"] + sum(node[k]["saved"] for k in n["children"])
        n["leaves"] = sum(node[k]["leaves"] for k in n["children"]) or 1
    return collections.Counter(
        (n["conv_id"], d, node[n["up"]]["conv_id"] if n["up"] else None, n["n_convs"], len(n["children"]), n["leaves"], n["saved"], sha(",".join(map(str, n["ends"])))) for (d, _), n in node.items()
    )


def test_prefix_trie(spark):
    rows = conversations()
    shape = "conv_id long, turn long, role string, text string, depth int, digest string, ends int, t int"
    df = spark.createDataFrame([(*x, 1, "x", 2, 3) for x in rows], shape).repartition(5)
    got = prefix_trie.nodes(df)
    want = brute_trie(rows)
    assert collections.Counter(tuple(r) for r in got.drop("digest").collect()) == want
    assert sum(want.values()) > 3000
    assert prefix_trie.nodes(spark.createDataFrame([], shape)).count() == 0
    assert prefix_trie.nodes(spark.createDataFrame([(None, 1, "user", "x", 1, "x", 2, 3)], shape)).columns == got.columns


def test_ends_are_hashed_in_order(spark):
    """More ends at one node than a block holds, numerically ascending."""
    ids = list(range(-300, 20_000))
    p = spark.createDataFrame([(i, b"\1" * 32, True) for i in random.Random(1).sample(ids, len(ids))] + [(7, b"\2" * 32, True), (8, b"\3" * 32, False)], "conv_id long, digest binary, ends boolean")
    got = {bytes(r["digest"])[0]: r["ends_sha256"] for r in prefix_trie.end_hashes(p).collect()}
    assert got == {1: sha(",".join(map(str, ids))), 2: sha("7")}


# --- filter audit -----------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    text_of = lambda t: t or ""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[text_of(t)] = min(i, least.get(text_of(t), i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, t, lang in rows:
        t = text_of(t)
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        worth = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [d for d in left if d[1][f]]
                kept = [d for d in left if not d[1][f]]
                redundant = sum(d[1][f] for d in mine) - len(removed)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                out[part, "".join(order), step] = [len(kept), len(removed), redundant, alone, sum(d[2] for d in removed), sum(d[3] for d in removed)]
                worth[f] += len(removed)
                left = kept
        for (p, order, step), x in out.items():
            if p == part:
                x.append(worth[order[step - 1]])
    return out


def test_filter_audit(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice([f"w{r.randrange(600)}", "Word", "#tag", "so", "so"][: r.choice([1, 2, 5])]) for _ in range(r.choice([0, 5, 190, 200, 260]))) for _ in range(60)]
    texts += [None, "", " \t\n", "X" * 40, "é|" * 300, "long " * 30_000, "A b c " * 80, "a" * 97 + "ABC", "a" * 96 + "ABCD"]
    rows = [(i, t, r.choice(["en", "de", None, "", "e'n"])) for i, t in enumerate(texts * 2)]
    rows += rows[:20] + [(3, texts[3], "fr"), (3, texts[4], "en"), (None, texts[5], "en"), (None, texts[5], "en"), (None, None, None), (-4, texts[6], "de")] + [(7, texts[7], "en")] * 30
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 140, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*x, 1, 2, "z") for x in rows], "doc_id long, text string, lang string, k1 int, n int, word string").repartition(5)
    ls = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = {(x["part"], x["filter_order"], x["step"]): list(x)[3:] for x in filter_audit.audit(df, ls).collect()}
    assert got == brute_audit(rows, labels)
    assert filter_audit.audit(df.limit(0), ls).count() == 0
    some = filter_audit.audit(df, ls.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert list(some) == [0, 0, 600 * len({x[2] or "" for x in rows})]


# --- URL filter -------------------------------------------------------------------------------------------------------


def brute_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


def brute_buckets(host, path, buckets, sizes):
    out = set()
    for seed, text in ((1, f"^{host}$"), (2, f"^{path}$")):
        codes = [ord(c) for c in text]
        for n in sizes:
            for i in range(len(codes) - n + 1):
                h = seed
                for c in codes[i : i + n]:
                    h = (h * 65_599 + c) % 2_147_483_647
                out.add(h % buckets)
    return out


def brute_model(labelled, buckets, sizes, steps):
    x = [(sorted(brute_buckets(*brute_parts(u), buckets, sizes)), y) for u, y in labelled if y is not None]
    yes = sum(y for _, y in x)
    w, v = collections.Counter(), collections.Counter()
    for _ in range(steps):
        d = collections.Counter()
        for b, y in x:
            z = w["bias"] + sum(w[k] for k in b) / math.sqrt(len(b))
            e = (1 / (1 + math.exp(-z)) - y) * (0.4 / yes if y else 0.6 / (len(x) - yes))
            d["bias"] += e
            for k in b:
                d[k] += e / math.sqrt(len(b))
        for k in d:
            v[k] = round(0.9 * v[k] - 8 * (d[k] + (0 if k == "bias" else 1e-3 * w[k])), 6)
        for k in d:
            w[k] = round(w[k] + v[k], 6)
    return w


URLS = [
    "http://a.com/", "http://com/x", "http://com", "https://www.example.com/en/1", "https://WWW.Example.COM/en/", "http://example.com/en/x?y=/z", "http://myexample.com/en/", "http://m.example.com/en", "x://a.net/es/", "x://a.net/es",
    "x://net/fr/?q", "http://spam-casino.org/en/7", "http://thing.org/en/7", "HTTP://X.org:80/p#://q.com/", "://", ":///only/path", "no scheme", "", None, "a\nb://Ünï.net/é/\nline?x", "q://😀.org/😀😀", "http://" + "long" * 20_000 + ".org/" + "p" * 100_000,
]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def test_url_filter(spark):
    labelled = [("http://casino-spam.org/en/win", True), ("http://spam.net/de/casino", True), ("http://library.org/en/book", False), ("http://thinking.net/fr/a?b", False), ("http://museum.org/de/", False), ("no label", None), (None, False)]
    table = spark.createDataFrame(labelled, "url string, blocked boolean")
    model = url_filter.train(table, buckets=512, sizes=(2, 3), steps=5)
    want = brute_model(labelled, 512, (2, 3), 5)
    assert abs(model.bias - want["bias"]) < 1e-5 and all(abs(w - want[k]) < 1e-5 for k, w in enumerate(model.weights))
    pages = spark.createDataFrame([(i, u, "h", "r", 1.0) for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, rule string, score double")
    got = url_filter.judge(pages, model)
    rows = {r["page_id"]: r for r in got.collect()}
    assert len(rows) == 2 * len(URLS)
    for i, u in enumerate(URLS * 2):
        host, path = brute_parts(u)
        rule = brute_rule(host, path)
        b = brute_buckets(host, path, 512, (2, 3))
        p = 1 / (1 + math.exp(-(model.bias + sum(model.weights[k] for k in b) / math.sqrt(max(len(b), 1)))))
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[0] if rule else None)
        assert r["verdict"] == (rule[1] if rule else "block" if p >= 0.5 else "allow")
        assert r["score"] is None if rule else abs(r["score"] - p) < 1e-9
    assert {rows[11]["verdict"], rows[12]["verdict"]} == {"block", "allow"}
    assert url_filter.judge(pages.limit(0), model).count() == 0
    nothing = url_filter.train(table.limit(0), buckets=16)
    assert {r["verdict"] for r in url_filter.judge(pages, nothing, rules=()).collect()} == {"allow"}


def test_production_model_on_urls_it_has_not_seen(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    bad = ["https://m.royal-casino.example.org/en/12", "http://adult-videos-free.example.org/de/3", "https://cheap-pills-online.example.org/en/77", "http://ads-tracker.example.org/en/1"]
    good = ["https://www.museums.example.org/en/12", "http://library-news.example.org/de/3", "https://gardens.example.org/en/77", "http://blog.riverside.example.org/fr/1"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, model).collect()}
    assert [got[i] for i in range(8)] == ["block"] * 4 + ["allow"] * 4


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_filter_audit", "op13_url_filter"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("conversations", "documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    made = con.execute(queries.SQL[name])
    columns = [c[0] for c in made.description]
    assert sorted(columns) == sorted(df.columns)
    want = collections.Counter(made.fetchall())
    assert want and collections.Counter(tuple(r) for r in df.select(*columns).collect()) == want
