"""The pipeline against a brute-force version of each stage on its own input."""

import random
import re
import string
from collections import Counter, defaultdict

import corpus_pipeline
from attestry.llm import queries

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANK = " \t\n\x0b\x0c\r"


def write_tables(spark, folder):
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))
    line = "A line that stands in very many documents of this little corpus."
    items = [(k, prose(30)) for k in range(4)]
    texts = [prose(120) for _ in range(30)]
    texts += [texts[0]] * 4 + [texts[1].replace(texts[1].split()[50], "changed")]
    texts += [prose(80) + "\n" + line + "\n" + prose(20) for _ in range(8)]
    texts += [prose(60) + " " + t + " " + prose(60) for _, t in items]
    texts += [prose(5), "same words here " * 60, "LOUD!! " * 5 + " ".join(x + "!!" for x in prose(70).split()), prose(60).replace(" ", "## "), None, ""]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return [(i, t) for i, t, *_ in rows], items


def good(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if x.strip(BLANK)]
    return len(w) >= 50 and 2 * len(covered) <= len(w) and len(re.findall(r"[#*$%&|<>]", t)) <= 0.25 * len(w) and t.count("!") <= 0.5 * len(w) and len(lines) - len(set(lines)) <= 0.5 * len(lines)


def brute(docs, items):
    docs = {i: t for i, t in docs if good(t)}
    yield docs
    key = lambda x: x.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs.items():
        for x in t.split("\n"):
            holders[key(x)].add(i)
    docs = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i) for i, t in docs.items()}
    yield docs
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.translate(LOWER).split()) for i, t in docs.items())}
    group = {i: i for i in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                n = len(sets[a] & sets[b])
                if group[a] != group[b] and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
                    group[a] = group[b] = min(group[a], group[b])
    docs = {i: t for i, t in docs.items() if group[i] == i}
    yield docs
    docs = {i: t for i, t in docs.items() if not any(x in t for _, x in items)}
    yield docs


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    wants = list(brute(rows, items))
    assert len(rows) > len(wants[0]) == len(wants[1]) > len(wants[2]) > len(wants[3])
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want, name
        assert docs.columns == columns
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["text"] for r in out} == wants[-1]
    assert sorted({r["slot"] for r in out}) == list(range(len({r["slot"] for r in out}))) and len({r["position"] for r in out}) == len(out)


def test_empty(spark, tmp_path):
    folder = str(tmp_path)
    write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_registry():
    assert [n for n in queries.QUERIES if re.match(r"op\d+_", n)] == list(queries.QUERIES) and len(queries.QUERIES) == 13
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
