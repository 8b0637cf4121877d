"""Command line: scan files, or probe a policy file.

    python -m attestry.cli scan [-f LIST | -f -] [-0] [--deep] [--skip RE]... [-v] [FILE]...
    python -m attestry.cli probe SECTION POLICY_FILE
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import scan
from .plans import catalog, policy
from .sources import files, sinks, store

PRESETS = {"generic": catalog.GENERIC, "permissive": catalog.PERMISSIVE}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="attestry")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("-f", dest="listing")
    s.add_argument("-0", dest="zero", action="store_true")
    s.add_argument("--deep", action="store_true")
    s.add_argument("--skip", action="append")
    s.add_argument("--rules", choices=PRESETS, default="generic")
    s.add_argument("-v", "--verbose", action="store_true")
    s.add_argument("files", nargs="*")
    q = sub.add_parser("probe")
    q.add_argument("section")
    q.add_argument("file")
    return p


def scan_files(spark: SparkSession, args: argparse.Namespace, out=sys.stdout, err=sys.stderr, stdin=sys.stdin.buffer) -> int:
    if bool(args.listing) == bool(args.files):
        print("name files or one listing", file=err)
        return 1
    if args.files:
        if any(os.path.isdir(f) for f in args.files):
            print("a directory is no file", file=err)
            return 2
        names, skip = spark.createDataFrame([(x,) for x in args.files], "path string"), ()
    else:
        skip = tuple(x for x in args.skip if x) if args.skip is not None else (files.DEFAULT_SKIP,)
        if args.listing == "-":
            lines = stdin.read().decode().split("\0" if args.zero else "\n")
            names = spark.createDataFrame([(x,) for x in lines], "path string").distinct()
        else:
            names = files.listed(spark, args.listing, args.zero)
    began, kept = time.perf_counter(), store.mark()
    texts = store.cut(files.texts_of(names, "path", skip, args.deep), "texts")  # read and unpacked once
    keyed = texts.withColumn("key", F.struct("path_stack", "size", "elapsed_us"))
    lines = scan.scan(keyed, PRESETS[args.rules], "key").select("*", "id.*").orderBy("path_stack", "ord")
    for r in sinks.finding_lines(lines).toLocalIterator():
        print(r["value"], file=out)
    if args.verbose:
        s = sinks.throughput(texts, time.perf_counter() - began).first()
        print(f"{s['n_scans']} files, {s['n_bytes']} bytes, largest {s['max_bytes']}, {s['n_binary']} binary, longest {s['max_us']} us, {s['files_per_s']:.1f} files/s", file=err)
    for r in sinks.errors(texts).toLocalIterator():
        print("<".join(reversed(r["path_stack"])), r["error"], file=err)
    code = sinks.exit_code(texts)
    store.release(spark, kept)
    return code


def probe_policy(spark: SparkSession, args: argparse.Namespace, out=sys.stdout) -> int:
    p = files.read_policy_file(spark, args.file, args.section)
    for m in p.messages:
        print(f"{m.severity}: {policy.formatted(m)}", file=out)
    if p.rules is None:
        return 1
    seconds = policy.probe(spark, p.rules)
    print(f"{seconds:.3f} s: {policy.tier(seconds)}\n{policy.token(int(seconds * 1e6), p.signature())}", file=out)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("attestry").getOrCreate()
    return scan_files(spark, args) if args.command == "scan" else probe_policy(spark, args)


if __name__ == "__main__":
    sys.exit(main())
