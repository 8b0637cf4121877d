"""Sources: files, listings, archives, trees and policy files as DataFrames."""

from __future__ import annotations

import codecs
import io
import time
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.policy import Policy, parse_sections, read_policy
from . import archives, store
from .archives import UNREADABLE, archive_kind, decompressed

DEFAULT_SKIP = r"[/][.]git[/]"
MAX_NESTING, BAD_ENTRIES = 10, 3
BUFFER = 2048

# Characters for single bytes that are not UTF-8; from 0xC0 the Latin-1 character, else "?".
ODD_BYTES = {0x85: "™", 0x99: "™", 0x87: "*", 0xB7: "*", 0x94: "ö", 0xA0: " ", 0xA7: " ", 0xAD: " ", 0xB6: " ", 0xA9: "©", 0xAE: "®"}


_odd: list[int] = []


def _odd_byte(e: UnicodeError) -> tuple[str, int]:
    _odd.append(e.start)
    b = e.object[e.start]
    return (chr(b) if b >= 0xC0 else ODD_BYTES.get(b, "?")), e.start + 1


codecs.register_error("attestry-odd-byte", _odd_byte)


def decode_counted(data: bytes) -> tuple[str, int, int | None]:
    """Text of bytes that are mostly UTF-8, the number of odd bytes, and the place in the text of the first.

    One pass, a buffer at a time.  Reading ends at the first buffer end with more odd bytes than line ends.
    """
    try:
        return data.decode(), 0, None
    except UnicodeDecodeError:
        pass
    decoder = codecs.getincrementaldecoder("utf-8")("attestry-odd-byte")
    out, lines, odd, held, first = [], 0, 0, 0, None
    for at in range(0, len(data), BUFFER):
        _odd.clear()
        part = decoder.decode(data[at : at + BUFFER], at + BUFFER >= len(data))
        if _odd and first is None:
            first = len(data[: held + _odd[0]].decode())
        held = at + BUFFER - len(decoder.getstate()[0])
        odd += len(_odd)
        lines += part.count("\n")
        out.append(part)
        if odd > lines and at + BUFFER < len(data):
            _odd.clear()
            out.append(decoder.decode(b"", True))
            odd += len(_odd)
            break
    return "".join(out), odd, first


def decode(data: bytes) -> str:
    return decode_counted(data)[0]


def entries(name: str, data: bytes, stack: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], bytes, str | None]]:
    """(path stack, bytes, error) of a file, or of the entries of an archive, nested archives included.

    A file that cannot be unpacked or read as the archive its name promises is taken as it is.  After a good entry each unreadable
    one gives an error and the next is tried, three times at most; where the archive itself breaks off, that is an error of
    the archive.
    """
    plain, body = decompressed(name, data)
    yield from _unfolded((*stack, name), archive_kind(plain), io.BytesIO(body), len(body), lambda: body)


def _unfolded(here: tuple[str, ...], kind: str | None, f: BinaryIO, size: int | None, whole: Callable[[], bytes]) -> Iterator[tuple[tuple[str, ...], bytes, str | None]]:
    """The entries of an archive, or the whole file where it gives none."""
    if kind in archives.READERS and len(here) <= MAX_NESTING:
        seen = bad = 0
        reader = archives.places(kind, f, size)
        while bad <= BAD_ENTRIES:
            try:
                place = next(reader)
            except StopIteration:
                break
            except UNREADABLE as e:  # nothing comes behind it
                if seen:
                    yield here, b"", said(e)
                break
            try:
                body = archives.content(f, place)
            except UNREADABLE as e:
                bad += 1
                if not seen:
                    break
                yield (*here, place.name), b"", said(e)
                continue
            seen += 1
            yield from entries(place.name, body, here)
        if seen:
            return
    yield here, whole(), None


def said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def read_files(spark: SparkSession, paths: str | list[str], skip: tuple[str, ...] = (DEFAULT_SKIP,), recursive: bool = True) -> DataFrame:
    """path, length, content; paths are filtered before any content is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    for s in skip:
        df = df.filter(~F.col("path").rlike(s))
    return df.select("path", "length", "content")


def read_named(spark: SparkSession, names: DataFrame, column: str = "value", skip: tuple[str, ...] = (DEFAULT_SKIP,)) -> DataFrame:
    """The files whose paths stand in a column, as rows with their bytes.  Spark's reader takes a list of paths, so the names
    pass through the driver; texts_of reads them in tasks."""
    names = names.select(F.col(column).alias("value")).filter("value <> ''")
    for s in skip:
        names = names.filter(~F.col("value").rlike(s))
    return read_files(spark, [r["value"] for r in names.distinct().toLocalIterator()], skip=())


def listed(spark: SparkSession, listing: str, zero: bool = False) -> DataFrame:
    """path: the names of a listing, separated by newlines or NULs."""
    return spark.read.text(listing, lineSep="\0" if zero else "\n").select(F.col("value").alias("path")).filter("path <> ''").distinct()


def read_listing(spark: SparkSession, listing: str, zero: bool = False, skip: tuple[str, ...] = (DEFAULT_SKIP,)) -> DataFrame:
    """Files named by a listing, separated by newlines or NULs."""
    return read_named(spark, spark.read.text(listing, lineSep="\0" if zero else "\n"), "value", skip)


Found = tuple[tuple[str, ...], bytes, str | None]
_TEXTS = "path string, path_stack array<string>, size long, text string, error string, n_odd long, first_odd long, elapsed_us long"
_KINDS = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def _decoded(found: Iterator[tuple[str, Found]], rows_most: int = 64, bytes_most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of texts of (path, what was found there): bounded by rows, and by bytes but for a single large one."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], [x.split()[0] for x in _TEXTS.split(", ")])

    rows: list[tuple] = []
    held = 0
    began = time.perf_counter()
    for path, (stack, body, error) in found:
        text, n_odd, first_odd = decode_counted(body)
        now = time.perf_counter()
        rows.append((path, list(stack), len(body), text, error, n_odd, first_odd, int((now - began) * 1e6)))
        held += len(body)
        began = now
        if len(rows) >= rows_most or held >= bytes_most:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def _clean(texts: DataFrame) -> DataFrame:
    return texts.withColumn("path_stack", F.transform("path_stack", lambda x, i: F.when(i > 0, T.printable_name(x)).otherwise(x)))  # names of entries


def texts(files: DataFrame, deep: bool = True) -> DataFrame:
    """path, path_stack, size, text, error, n_odd, first_odd, elapsed_us: one row for each file or archive entry, decoded.

    n_odd, first_odd: bytes that are no UTF-8, and the place of the first; elapsed_us: time of unpacking and decoding.  Whole
    files stand in rows here, of 2 GB at most; texts_of reads larger archives.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[str, Found]]:
            for b in batches:
                for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    data = content.as_py() or b""
                    for x in entries(path, data) if deep else [((path,), decompressed(path, data)[1], None)]:
                        yield path, x

        yield from _decoded(found())

    return _clean(files.select("path", "content").mapInArrow(work, _TEXTS))


# --- files read by tasks --------------------------------------------------------------------------------------------

#: About so many bytes of an archive are one task's; files up to LARGEST bytes are read whole.
RANGE_BYTES, LARGEST = 64 << 20, (1 << 31) - (1 << 20)
#: Archives that can be read forward only; a zip archive has its index at its end.
STREAMED = ("ar", "cpio", "tar")
_PLACES = "path string, name string, at long, size long, how string, error string"


def _placed(path: str) -> Iterator[tuple]:
    """Rows of _PLACES: one for each entry of an archive that can be read in pieces, else one for the file."""
    try:
        with archives.opened(path) as f:
            size = f.size()
            kind = None if archives.compression(path) else archive_kind(path)
            seen = False
            if kind in archives.READERS:
                reader = archives.places(kind, f, size)
                while True:
                    try:
                        p = next(reader)
                        if not seen:  # an archive counts as one once an entry of it can be read
                            archives.content(f, p)
                            seen = True
                    except StopIteration:
                        break
                    except UNREADABLE as e:
                        if seen:
                            yield path, None, size, 0, "error", said(e)
                        break
                    yield path, p.name, p.at, p.size, p.how, None
            if not seen:
                yield path, None, 0, size, "whole", None
    except UNREADABLE as e:
        yield path, None, 0, 0, "error", said(e)


def _whole_file(path: str, size: int, deep: bool) -> Iterator[Found]:
    """A file that is no archive or cannot be read in pieces; compressed archives are read as streams, an entry at a time."""
    packed = archives.compression(path)
    kind = archive_kind(packed[1]) if packed and deep else None
    if kind in STREAMED:
        seen = False
        try:
            with archives.opened(path) as f, archives.COMPRESSED[packed[0]](f) as plain:
                for name, body in archives.streamed(kind, plain):
                    seen = True
                    yield from entries(name, body, (path,))
        except UNREADABLE as e:
            if seen:
                yield (path,), b"", said(e)
        if seen:
            return
    if size > LARGEST:
        yield (path,), b"", f"ValueError: {size} bytes are more than a row can hold"
        return
    with archives.opened(path) as f:
        data = f.read()
    # an archive that gives no entry is a text like any other file
    tried = archive_kind(path) in archives.READERS or kind in STREAMED
    yield from [((path,), decompressed(path, data)[1], None)] if tried or not deep else entries(path, data)


def _read_places(batches: Iterator[pa.RecordBatch], deep: bool) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple[str, Found]]:
        open_path, f = None, None
        try:
            for b in batches:
                for path, name, at, size, how, error in zip(*[b.column(x.split()[0]).to_pylist() for x in _PLACES.split(", ")], strict=True):
                    try:
                        if how == "error":
                            yield path, ((path,), b"", error)
                        elif how == "whole":
                            for x in _whole_file(path, size, deep):
                                yield path, x
                        else:
                            if open_path != path:
                                if f:
                                    f.close()
                                open_path, f = path, archives.opened(path)
                            if size > LARGEST:
                                raise ValueError(f"{size} bytes are more than a row can hold")
                            for x in entries(name, archives.content(f, archives.Place(name, at, size, how)), (path,)):
                                yield path, x
                    except UNREADABLE as e:
                        yield path, ((path,) if name is None else (path, name), b"", said(e))
        finally:
            if f:
                f.close()

    yield from _decoded(found())


def places_of(names: DataFrame, column: str = "path", skip: tuple[str, ...] = (DEFAULT_SKIP,), deep: bool = True) -> DataFrame:
    """path, name, at, size, how, error: an index of the entries of all archives named, and a row for each other file."""
    named = names.select(F.col(f"`{column}`").alias("path")).filter("path <> ''")
    for s in skip:
        named = named.filter(~F.col("path").rlike(s))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [x.split() for x in _PLACES.split(", ")]
        kinds = [pa.string() if kind == "string" else pa.int64() for _, kind in columns]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c for c, _ in columns])

        rows: list[tuple] = []
        for b in batches:
            for path in b.column("path").to_pylist():
                for row in _placed(path) if deep else _unopened(path):
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return named.repartition(4 * names.sparkSession.sparkContext.defaultParallelism).mapInArrow(work, _PLACES)


def _unopened(path: str) -> Iterator[tuple]:
    try:
        with archives.opened(path) as f:
            yield path, None, 0, f.size(), "whole", None
    except UNREADABLE as e:
        yield path, None, 0, 0, "error", said(e)


def texts_of(names: DataFrame, column: str = "path", skip: tuple[str, ...] = (DEFAULT_SKIP,), deep: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As texts, of files that stand as paths or URIs in a column; neither names nor files pass through the driver.

    One task walks the headers of an archive and writes where its entries lie; then every range of about range_bytes is
    another task's, which opens the archive and reads its entries one at a time.  Compressed archives are one task's stream.
    Memory holds an entry, never an archive.  Damaged entries give error rows, however many; a file that cannot
    be opened gives one.  The files must be in a store that Arrow can open; read_files takes what only Spark reads.
    """
    index = store.cut(places_of(names, column, skip, deep), "places")
    total = index.agg(F.sum("size")).first()[0] or 0
    n = max(names.sparkSession.sparkContext.defaultParallelism, -(-total // range_bytes))
    dealt = index.repartition(n, "path", F.floor(F.col("at") / range_bytes)).sortWithinPartitions("path", "at")
    return _clean(dealt.mapInArrow(lambda batches: _read_places(batches, deep), _TEXTS))


REGULAR = (0o100644, 0o100755, 0o100664)


def changed_files(tree: DataFrame, parents: DataFrame) -> DataFrame:
    """path, mode, blob_id, status: entries of a commit's tree that differ from its parents' trees.

    tree: path, mode, blob_id.  parents: parent, path, mode, blob_id; none for a first commit.  An entry counts as
    changed if it differs from every parent (or there is none); paths missing from the tree are deletions.
    """
    p = parents.select("parent", F.col("path").alias("p_path"), F.col("mode").alias("p_mode"), F.col("blob_id").alias("p_blob"))
    same = tree.join(p, (F.col("path") == F.col("p_path")) & F.col("mode").eqNullSafe(F.col("p_mode")) & F.col("blob_id").eqNullSafe(F.col("p_blob")), "left_semi").select("path")
    new = tree.join(same, "path", "left_anti")
    status = new.join(p.select(F.col("p_path").alias("path")).distinct().withColumn("was", F.lit(True)), "path", "left")
    gone = p.select(F.col("p_path").alias("path"), "p_mode", "p_blob").join(tree.select("path"), "path", "left_anti").groupBy("path").agg(F.max("p_mode").alias("mode"), F.max("p_blob").alias("blob_id"))
    return status.select("path", "mode", "blob_id", F.when(F.col("was"), "modified").otherwise("added").alias("status")).unionByName(gone.withColumn("status", F.lit("deleted")))


def regular(files: DataFrame, mode: str = "mode") -> DataFrame:
    return files.filter(F.col(mode).isin(*REGULAR))


def read_policy_file(spark: SparkSession, path: str, section: str) -> Policy:
    rows = spark.read.text(path, wholetext=True).take(1)
    found = parse_sections(rows[0]["value"] if rows else "")
    return read_policy(found.get(section, {}))
