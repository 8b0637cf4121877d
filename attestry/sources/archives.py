"""Archives as places in a file: an index of entries, and the bytes of one entry.

A reader walks the headers of an archive in a seekable file and yields where each entry lies, without reading entries.  So
an archive can be indexed by one task and its entries be read by many.  Compressed archives are read as streams, an entry at a
time.  Every reader ends, whatever the bytes, and raises nothing but UNREADABLE.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

from pyarrow import fs

UNREADABLE = (ValueError, OSError, EOFError, tarfile.TarError, zipfile.BadZipFile, zlib.error, lzma.LZMAError, RuntimeError, NotImplementedError, struct.error, IndexError, OverflowError)

# Archive suffixes, in the order they are tested.
ARCHIVES = (
    ("ar", (".a", ".deb", ".ar", "-ar", "-deb", "-a")),
    ("arj", (".arj",)),
    ("cpio", (".cpio",)),
    ("dump", (".dump", ".dmp")),
    ("jar", (".jar", ".aar", ".apk", ".apex", ".war", ".rar", ".ear", ".sar", ".par", ".kar", "-jar")),
    ("tar", (".tar", "-tar", ".pax")),
    ("zip", (".zip", ".ZIP", "-zip", "-ZIP", ".sfx", ".docx", ".docm", ".xlsx", ".xlsm", ".pptx", ".pptm", ".odf", ".odt", ".odp", ".ods", ".odg")),
)
# Compression suffixes, and what opens a stream of them.
COMPRESSED = {".bz2": bz2.open, ".tbz2": bz2.open, ".gz": gzip.open, ".tgz": gzip.open, "-gz": gzip.open, ".z": gzip.open, ".xz": lzma.open, ".txz": lzma.open, ".lzma": lzma.open}
LONGEST_NAME = 65_536


class Place(NamedTuple):
    """An entry: its name, where its bytes (for zip and sparse entries, its header) begin, how many there are, and how they are packed."""

    name: str
    at: int
    size: int
    how: str


def archive_kind(name: str) -> str | None:
    return next((kind for kind, ends in ARCHIVES if name.endswith(ends)), None)


def compression(name: str) -> tuple[str, str] | None:
    """Suffix of a compressed file, and the file's name without it; None for others."""
    end = next((x for x in COMPRESSED if name.lower().endswith(x)), None)
    if end is None:
        return None
    return end, name[: -len(end)] + (".tar" if end in (".tgz", ".tbz2", ".txz") else "")


def _exactly(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise EOFError("archive ends within an entry")
    return data


def _ar(f: BinaryIO, size: int | None) -> Iterator[Place]:
    if f.read(8) != b"!<arch>\n":
        raise ValueError("not an ar archive")
    at, long_names = 8, b""
    while head := f.read(60):
        if len(head) < 60 or head[58:] != b"`\n":
            raise ValueError("damaged ar header")
        n = int(head[48:58])
        if n < 0:
            raise ValueError("negative ar entry size")
        raw, here, body, left = head[:16], at, at + 60, n
        at = body + n + n % 2
        if raw.startswith(b"//"):
            long_names = _exactly(f, n)
        elif raw[:1] == b"/" and raw[1:].strip().isdigit():
            name = long_names[int(raw[1:]) :].split(b"\n", 1)[0]
            yield Place(name.decode("latin-1").rstrip("/"), body, left, "stored")
        elif raw.startswith(b"#1/"):
            inner = min(int(raw[3:]), n, LONGEST_NAME)
            if inner < 0:
                raise ValueError("negative ar name length")
            yield Place(_exactly(f, inner).rstrip(b"\0").decode("latin-1"), body + inner, n - inner, "stored")
        elif not raw.startswith(b"/") and raw.strip():
            yield Place(raw.decode("latin-1").strip().rstrip("/"), body, left, "stored")
        assert at > here
        f.seek(at)


def _cpio(f: BinaryIO, size: int | None) -> Iterator[Place]:
    at = 0
    while (head := f.read(110))[:6] in (b"070701", b"070702"):
        if len(head) < 110:
            raise EOFError("archive ends within a header")
        n = [int(head[6 + 8 * i : 14 + 8 * i], 16) for i in range(13)]
        mode, length, name_length = n[1], n[6], n[11]
        if min(n) < 0 or name_length > LONGEST_NAME:
            raise ValueError("damaged cpio header")
        name = _exactly(f, name_length)[:-1].decode("latin-1")
        if name == "TRAILER!!!":
            return
        body = at + (110 + name_length + 3) // 4 * 4
        at = body + (length + 3) // 4 * 4
        if mode & 0o170000 == 0o100000:
            yield Place(name, body, length, "stored")
        f.seek(at)
    raise ValueError("cpio archive without its trailer" if at else "not a new-format cpio archive")


def _tar(f: BinaryIO, size: int | None) -> Iterator[Place]:
    with tarfile.open(fileobj=f, mode="r:") as t:
        while (e := t.next()) is not None:
            if e.isfile():
                yield Place(e.name, e.offset, e.size, "sparse") if e.issparse() else Place(e.name, e.offset_data, e.size, "stored")
            t.members.clear()  # else every header stays in memory
    if size is not None:
        f.seek(max(0, size - 512))
        if size % 512 or f.read(512).strip(b"\0"):
            raise EOFError("tar archive without its end")


def _zip(f: BinaryIO, size: int | None) -> Iterator[Place]:
    with zipfile.ZipFile(f) as z:
        for e in z.infolist():
            if not e.is_dir() and (e.external_attr >> 16) & 0o170000 != 0o120000:
                yield Place(e.filename, e.header_offset, e.compress_size, f"zip {e.compress_type} {e.CRC} {e.flag_bits & 1}")


READERS = {"ar": _ar, "cpio": _cpio, "tar": _tar, "jar": _zip, "zip": _zip}
def places(kind: str, f: BinaryIO, size: int | None = None) -> Iterator[Place]:
    return READERS[kind](f, size)


def content(f: BinaryIO, p: Place) -> bytes:
    """The bytes of an entry."""
    f.seek(p.at)
    if p.how == "stored":
        return _exactly(f, p.size)
    if p.how == "sparse":
        with tarfile.open(fileobj=f, mode="r:") as t:
            return t.extractfile(t.next()).read()
    method, crc, secret = map(int, p.how.split()[1:])
    if secret:
        raise RuntimeError("encrypted entry")
    head = _exactly(f, 30)
    if head[:4] != b"PK\3\4":
        raise zipfile.BadZipFile("damaged header of an entry")
    f.seek(p.at + 30 + sum(struct.unpack("<HH", head[26:30])))
    raw = _exactly(f, p.size)
    if method == zipfile.ZIP_DEFLATED:
        unpack = zlib.decompressobj(-15)
        raw = unpack.decompress(raw) + unpack.flush()
    elif method == zipfile.ZIP_BZIP2:
        raw = bz2.decompress(raw)
    elif method == zipfile.ZIP_LZMA:
        skip = 4 + struct.unpack("<H", raw[2:4])[0]
        raw = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[lzma._decode_filter_properties(lzma.FILTER_LZMA1, raw[4:skip])]).decompress(raw[skip:])
    elif method != zipfile.ZIP_STORED:
        raise NotImplementedError(f"compression method {method}")
    if zlib.crc32(raw) != crc:
        raise zipfile.BadZipFile("bad checksum of an entry")
    return raw


def streamed(kind: str, f: BinaryIO) -> Iterator[tuple[str, bytes]]:
    """Names and bytes of the entries of an ar, cpio or tar archive that can only be read forward."""
    if kind == "tar":
        with tarfile.open(fileobj=f, mode="r|") as t:
            while (e := t.next()) is not None:
                if e.isfile():
                    yield e.name, t.extractfile(e).read()
                t.members.clear()
    else:
        for p in places(kind, f):
            yield p.name, content(f, p)


def opened(path: str) -> BinaryIO:
    """A file of any store that Arrow knows, by its path or URI."""
    if re.match(r"\w+://", path):
        store, path = fs.FileSystem.from_uri(path)
    else:
        store, path = fs.LocalFileSystem(), path.removeprefix("file:")
    return store.open_input_file(path)


def decompressed(name: str, data: bytes) -> tuple[str, bytes]:
    """Name without its compression suffix and the bytes; as they were if that fails."""
    if packed := compression(name):
        try:
            with COMPRESSED[packed[0]](io.BytesIO(data)) as f:
                return packed[1], f.read()
        except UNREADABLE:
            return name, data
    return name, data
