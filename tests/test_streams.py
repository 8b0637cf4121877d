"""Streams of revisions: what is posted where, and under which policy; the as-of join against brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import asof
from attestry.plans import policy
from attestry.streaming import revisions

FORBID, ALLOW = ('[plugin "notices"]\n enable = true\n alwaysReviewPath = PATENT\n forbidden = MIT\n', '[plugin "notices"]\n enable = true\n alwaysReviewPath = PATENT\n firstParty = MIT\n')
SECTION = "plugin notices"
MIT = "// Released under the MIT license"
T0 = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)


def push(spark, src, rows):
    """rows: project, revision, path, text, change, hours since T0."""
    at = lambda h: None if h is None else T0 + datetime.timedelta(hours=h)
    made = [(p, "main", r, path, 0o100644, text, change, at(h)) for p, r, path, text, change, h in rows]
    spark.createDataFrame(made, revisions.EVENTS).coalesce(1).write.mode("append").json(src)


def posted(spark, out):
    return sorted((r["project"], r["change"] or "", r["revision"], r["path"]) for r in spark.read.parquet(f"{out}/comments").collect())


def test_comments_are_kept_apart(spark, tmp_path):
    """Two projects and two changes with the same paths and findings each get comments; a second patch set repeats none."""
    src, out, rules = str(tmp_path / "in"), str(tmp_path / "out"), policy.read_policy(policy.parse_sections(FORBID)[SECTION])
    run = lambda: revisions.start(spark, src, out, str(tmp_path / "cp"), lambda: rules).awaitTermination()
    push(spark, src, [("p1", "r1", "PATENT", "x", "c1", 0), ("p1", "r1", "a.c", MIT, "c1", 0)])
    run()
    assert posted(spark, out) == [("p1", "c1", "r1", "PATENT"), ("p1", "c1", "r1", "a.c")]
    push(spark, src, [("p2", "r1", "PATENT", "x", "c1", 1), ("p2", "r1", "a.c", MIT, "c1", 1), ("p1", "r7", "a.c", MIT, "c2", 1)])
    run()
    first = [("p1", "c1", "r1", "PATENT"), ("p1", "c1", "r1", "a.c"), ("p1", "c2", "r7", "a.c"), ("p2", "c1", "r1", "PATENT"), ("p2", "c1", "r1", "a.c")]
    assert posted(spark, out) == first
    # patch sets: the same findings again, one of them moved
    push(spark, src, [("p1", "r2", "PATENT", "x", "c1", 2), ("p1", "r2", "a.c", MIT, "c1", 2), ("p2", "r3", "a.c", "\n\n\n" + MIT, "c1", 2), ("p3", "r9", "a.c", MIT, None, 2), ("p3", "r9", "a.c", MIT, None, 2)])
    run()
    assert posted(spark, out) == sorted([*first, ("p2", "c1", "r3", "a.c"), ("p3", "r9", "r9", "a.c")])
    votes = {(r["project"], r["revision"]): r["vote"] for r in spark.read.parquet(f"{out}/verdicts").collect()}
    assert set(votes.values()) == {-1} and len(votes) == 6


def test_posted_comments_expire(spark, tmp_path):
    src, out, rules = str(tmp_path / "in"), str(tmp_path / "out"), policy.read_policy(policy.parse_sections(FORBID)[SECTION])
    for k in range(2):
        push(spark, src, [("p", f"r{k}", "a.c", MIT, "c", k)])
        revisions.start(spark, src, out, str(tmp_path / "cp"), lambda: rules, kept_ms=1).awaitTermination()
    assert len(posted(spark, out)) == 2


def test_policy_of_the_time(spark, tmp_path):
    """A revision is judged by the policy in force when it was pushed, when it is replayed as well."""
    versions = spark.createDataFrame([(T0 + datetime.timedelta(hours=h), p) for h, p in ((10, FORBID), (20, ALLOW), (30, "[plugin \"notices\"]\n forbidden = NO_SUCH_RULE\n"))], "since timestamp, policy string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for again in range(2):
        push(spark, src, [("p", f"r{h}-{again}", "a.c", MIT, f"c{h}-{again}", h) for h in (5, 10, 15, 20, 29, 31)])
        revisions.start(spark, src, out, str(tmp_path / "cp"), versions=lambda: versions, section=SECTION).awaitTermination()
        votes = {r["revision"]: r["vote"] for r in spark.read.parquet(f"{out}/verdicts").collect()}
        assert votes == {f"r{h}-{k}": v for k in range(again + 1) for h, v in ((10, -1), (15, -1), (20, 2), (29, 2))}
    with pytest.raises(ValueError):
        revisions.start(spark, src, out, str(tmp_path / "cp"))


@pytest.mark.parametrize("bucket", ["minute", "day", "year"])
def test_as_of(spark, bucket):
    r = random.Random(5)
    when = lambda: None if r.random() < 0.1 else T0.replace(tzinfo=None) + datetime.timedelta(minutes=r.randrange(6000))
    events = [(k, when(), "e") for k in range(400)]
    versions = [(when(), k) for k in range(40)] + [(T0.replace(tzinfo=None) + datetime.timedelta(minutes=77), k) for k in (100, 99)]
    e = spark.createDataFrame(events, "id long, at timestamp, kind string")
    for some in (versions, []):
        v = spark.createDataFrame(some, "since timestamp, version long")
        known = [x for x in some if x[0] is not None]
        want = {k: max(((s, n) for s, n in known if t is None or s <= t), default=(None, None))[1] for k, t, _ in events}
        got = asof.as_of(e, v, bucket=bucket)
        assert {x["id"]: x["version"] for x in got.collect()} == want and got.columns == ["id", "at", "kind", "version"]
    assert asof.as_of(e.limit(0), v).count() == 0
    assert asof.as_of(e.unionByName(e), v.select(F.col("since"), "version")).count() == 800
