"""Archives read in pieces by tasks, against whole files in rows; damaged bytes of every kind."""

import bz2
import collections
import gzip
import io
import lzma
import os
import random
import resource
import signal
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F
from test_notices import build_ar, build_cpio, build_tar, build_zip

from attestry.sources import archives, files

BUILD = {"ar": build_ar, "cpio": build_cpio, "tar": build_tar, "zip": build_zip}
PACK = {".gz": gzip.compress, ".bz2": bz2.compress, ".xz": lzma.compress}
NAMED = [(f"{k}.txt", f"text {k} ".encode() * (40 + k)) for k in range(6)]


def test_readers_give_places():
    for kind, build in BUILD.items():
        data = build(NAMED)
        f = io.BytesIO(data)
        found = list(archives.places(kind, f, len(data)))
        assert [p.name for p in found] == [n for n, _ in NAMED]
        r = random.Random(1)
        for k in r.sample(range(6), 6):  # in any order
            assert archives.content(f, found[k]) == NAMED[k][1]
        if kind != "zip":
            assert list(archives.streamed(kind, io.BytesIO(data))) == NAMED


def test_names_and_methods():
    long = "a/very/long/path/of/a/file.txt"
    table = (long + "/\n").encode()
    ar = b"!<arch>\n" + f"{'//':<48}{len(table):<10}`\n".encode() + table + b"\n" * (len(table) % 2) + f"{'/0':<48}{3:<10}`\n".encode() + b"abc\n" + f"{'#1/4':<48}{6:<10}`\n".encode() + b"n\0\0\0xy" + f"{'/':<48}{2:<10}`\n".encode() + b"zz"
    f = io.BytesIO(ar)
    assert [(p.name, archives.content(f, p)) for p in archives.places("ar", f)] == [(long, b"abc"), ("n", b"xy")]
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            z.writestr("x.txt", b"many words " * 100)
            z.writestr("folder/", b"")
        assert [archives.content(out, p) for p in archives.places("zip", out)] == [b"many words " * 100]


def test_every_reader_ends():
    """Random bytes, random damage, cut ends: rows or an error each, in bounded time and memory."""
    signal.signal(signal.SIGALRM, lambda *_: pytest.fail("a reader does not end"))
    r = random.Random(7)
    cases = [("x.a", b"!<arch>\n" + f"{'n/':<48}{-60:<10}`\n".encode() + b"tail"), ("x.a", b"!<arch>\n" + f"{'#1/-5':<48}{9:<10}`\n".encode() + b"tail of it")]
    for kind, build in BUILD.items():
        whole = build(NAMED)
        for end in ("", *PACK):
            name = f"x.{kind}{end}"
            for _ in range(40):
                data = bytearray(whole)
                for _ in range(r.choice([1, 3, 30])):
                    data[r.randrange(len(data) if r.random() < 0.5 else 120)] = r.randrange(256)
                data = PACK[end](bytes(data)) if end else bytes(data)
                if end and r.random() < 0.7:
                    at = r.randrange(len(data))
                    data = data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :]
                cases.append((name, data[: r.randrange(len(data))] if r.random() < 0.3 else data))
            cases.append((name, r.randbytes(5000)))
        cases.append(("outer.zip", build_zip([("in." + kind, bytes(data))])))
    for name, data in cases:
        signal.alarm(20)
        found = list(files.entries(name, data))
        assert found and all(isinstance(b, bytes) and s[0] == name for s, b, _ in found), name
        signal.alarm(0)


@pytest.mark.parametrize("end", PACK)
def test_damaged_compression_is_text(spark, end, tmp_path):
    """Damaged in the middle: alone and nested the file is taken as it is, and nothing else is lost."""
    data = bytearray(PACK[end](random.Random(2).randbytes(4000)))
    for k in range(len(data) // 2, len(data) // 2 + 40):
        data[k] ^= 255
    data = bytes(data)
    assert list(files.entries("a.txt" + end, data)) == [(("a.txt" + end,), data, None)]
    nested = build_zip([("a.txt" + end, data), ("b.txt", b"kept")])
    assert list(files.entries("n.zip", nested)) == [(("n.zip", "a.txt" + end), data, None), (("n.zip", "b.txt"), b"kept", None)]
    (tmp_path / ("a.tar" + end)).write_bytes(data)
    (tmp_path / "n.zip").write_bytes(nested)
    for t in (files.texts(files.read_files(spark, str(tmp_path))), files.texts_of(spark.createDataFrame([(str(x),) for x in tmp_path.iterdir()], "path string"))):
        assert sorted((len(r["path_stack"]), r["size"], r["error"]) for r in t.collect()) == [(1, len(data), None), (2, 4, None), (2, len(data), None)]


def rows_of(t):
    short = lambda p: os.path.basename(p)
    return collections.Counter((short(r["path"]), *r["path_stack"][1:], r["size"], r["text"], r["error"] is not None) for r in t.collect())


def test_pieces_equal_whole_files(spark, tmp_path):
    inner = build_zip([("deep.txt", b"Not a contribution."), ("more.tar", build_tar(NAMED[:2]))])
    named = [*NAMED, ("in.zip", inner), ("caf\u00e9\x01.txt", b"odd name"), ("empty", b"")]
    plain = [(n, b) for n, b in named if n.isascii()]
    for kind, build in BUILD.items():
        data = build(named if kind in ("tar", "zip") else plain)
        (tmp_path / f"x.{kind}").write_bytes(data)
        (tmp_path / f"cut.{kind}").write_bytes(data[: len(data) * 2 // 3])
        for end, pack in PACK.items():
            (tmp_path / f"p.{kind}{end}").write_bytes(pack(data))
    for n, b in {"t.tgz": gzip.compress(build_tar(named)), "broken.zip": b"no zip", "x.txt": b"text", "e.txt": b"", "y.txt.xz": lzma.compress(b"packed"), "no.tar": b"\0" * 700}.items():
        (tmp_path / n).write_bytes(b)
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "skipped").write_bytes(b"skipped")
    folder = files.read_files(spark, str(tmp_path))
    names = folder.select("path")
    whole = rows_of(files.texts(folder))
    assert len(whole) > 60 and not any("skipped" in x for x in whole)
    for size in (files.RANGE_BYTES, 600):
        assert rows_of(files.texts_of(names, range_bytes=size)) == whole
    flat = files.texts_of(names, deep=False)
    assert rows_of(flat) == rows_of(files.texts(folder, deep=False))
    gone = files.texts_of(spark.createDataFrame([(str(tmp_path / "not.there"),), ("",), (None,)], "path string")).collect()
    assert len(gone) == 1 and gone[0]["error"].startswith("FileNotFoundError")
    listing = tmp_path / "list"
    listing.write_bytes(b"\0".join(str(tmp_path / n).encode() for n in ("x.txt", "x.zip", "x.txt")))
    assert sorted(r[0] for r in files.listed(spark, str(listing), zero=True).collect()) == [str(tmp_path / "x.txt"), str(tmp_path / "x.zip")]


def test_one_archive_is_many_tasks(spark, tmp_path):
    """Entries of one archive are read by several tasks, whose memory does not grow with it."""
    path = tmp_path / "big.tar"
    body = b"a line of an ordinary file\n" * 2000
    with tarfile.open(path, "w") as t:
        for k in range(1500):
            i = tarfile.TarInfo(f"{k}.txt")
            i.size = len(body)
            t.addfile(i, io.BytesIO(body))
    t = files.texts_of(spark.createDataFrame([(str(path),)], "path string"), range_bytes=4 << 20)
    per = t.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    assert sum(r["n"] for r in per) == 1500 and len(per) >= 8 and max(r["bytes"] for r in per) < path.stat().st_size // 3
    with archives.opened(str(path)) as f:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        assert sum(1 for _ in archives.places("tar", f, path.stat().st_size)) == 1500
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 20_000
