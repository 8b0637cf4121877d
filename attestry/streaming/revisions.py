"""Pushed revisions as streams: a first one reviews each micro-batch, a second keeps what has been posted on each change.

The first stream runs the batch functions, each revision under the policy that was in force at its time, and writes verdicts and
the comments it would make.  The second reads those comments and keeps, keyed by project, change and path, which have been
posted: state that grows with the open changes and expires, so a batch costs what it brings and not what came before.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators import assess, asof, scan
from ..plans.policy import Policy, ordinary_branch, parse_sections, project_enabled, read_policy
from ..sources import sinks, store

SCHEMA = "project string, branch string, revision string, path string, mode int, text string"
#: Also the change that a revision is a patch set of (its own where none is named), and the time it was pushed.
EVENTS = f"{SCHEMA}, change string, at timestamp"
COMMENTS = "project string, change string, revision string, path string, start_line int, end_line int, unresolved boolean, message string"
#: Comments are forgotten when a path of a change has had none for so long.
KEPT = 180 * 24 * 3600 * 1000
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def review(batch: DataFrame, policy: Policy, enabled_by_default: bool = True) -> tuple[DataFrame, DataFrame]:
    """(verdicts by revision, comments by revision and path) of changed files: columns of SCHEMA, and change if there is one.

    Gates and path rules are applied before any text is scanned; files that always need a review are never scanned.
    Revisions of different projects are different, whatever their names.
    """
    change = F.coalesce("change", "revision") if "change" in batch.columns else F.col("revision")
    b = batch.withColumn("change", change).filter(ordinary_branch(F.col("branch")))
    b = b.filter(project_enabled(F.col("project"), policy, F.lit(policy.enabled), enabled_by_default))
    b = b.withColumn("always_review", T.found_any(T.full_path(F.col("project"), F.col("path")), policy.always_review))
    b = b.withColumn("third_party_allowed", T.found_any(F.col("project"), policy.values.get("thirdPartyAllowedProjects", [])))
    b = b.withColumn("pushed", F.struct("project", "change", "revision")).withColumn("file", F.struct("project", "change", "revision", "path"))
    todo = b.filter(~F.col("always_review") & F.col("mode").isin(0o100644, 0o100755))
    found = scan.scan(todo, policy.rules, "file", "text").withColumnRenamed("id", "file")
    files = b.select("file", "pushed", "always_review", "third_party_allowed")
    ranks = assess.file_verdicts(found, "file")
    judged = files.join(ranks, "file", "left")
    by_push = assess.change_verdicts(judged, "pushed")
    verdicts = by_push.select("pushed.*", *[c for c in by_push.columns if c != "pushed"])
    overall = by_push.select("pushed", F.col("rank").alias("overall"))
    c = assess.coalesce_comments(found, "file").join(judged.select("file", "pushed", "rank", "third_party_allowed"), "file").join(overall, "pushed")
    comments = c.select(
        "file.*", "start_line", "end_line",
        (~assess.resolved(F.col("party"), F.col("match_type"), F.col("rank"), F.col("third_party_allowed"))).alias("unresolved"),
        assess.message(F.col("party"), F.col("match_type"), F.col("text"), F.col("overall"), F.col("third_party_allowed"), F.col("file")["project"]).alias("message"),
    )
    always = files.filter("always_review").select("file.*", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(True).alias("unresolved"), F.lit("This path always requires a review.").alias("message"))
    return verdicts, comments.unionByName(always)


def review_as_of(batch: DataFrame, versions: DataFrame, section: str, enabled_by_default: bool = True) -> list[tuple[DataFrame, DataFrame]]:
    """review of each revision under the policy that was in force when it was pushed.

    versions: since (timestamp), policy (the text of a policy file).  Revisions from before the first version, or under one with
    errors, are not reviewed.  A policy is compiled once for a batch, so the driver holds the policies of a batch's
    revisions: as many as there were changes of the policy in its time.
    """
    dealt = store.cut(asof.as_of(batch, versions, value="policy"), "revisions")
    out = []
    for row in dealt.select("policy").filter("policy IS NOT NULL").distinct().collect():
        policy = read_policy(parse_sections(row["policy"]).get(section, {}))
        if not policy.failed and policy.rules is not None:
            out.append(review(dealt.filter(F.col("policy") == row["policy"]).drop("policy"), policy, enabled_by_default))
    return out


def unposted(comments: DataFrame, kept_ms: int = KEPT) -> DataFrame:
    """A stream of comments without those already posted on the same path of the same change of the same project.

    Equal comments have equal lines and message, nulls being equal.  The state of a path is a digest for each comment posted there; it is
    forgotten when nothing has come for kept_ms.
    """
    columns = [c.split()[0] for c in COMMENTS.split(", ")]

    def fresh(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        digests, until = state.get if state.exists else ([], 0)
        seen = set(digests) if now < until else set()
        for part in parts:
            new = []
            for digest in part["digest"]:
                new.append(digest not in seen)
                seen.add(digest)
            yield part.loc[new, columns]
        state.update((sorted(seen), now + kept_ms))
        state.setTimeoutDuration(max(1, kept_ms))

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    digest = F.sha2(F.concat_ws(":", text("start_line"), text("end_line"), F.when(F.col("message").isNull(), "-").otherwise(F.concat(F.lit("="), "message"))), 256)
    key = {f"of_{c}": F.coalesce(F.col(c), F.lit("")) for c in ("project", "change", "path")}
    keyed = comments.withColumns({"digest": digest} | key).groupBy(*key)
    return keyed.applyInPandasWithState(fresh, COMMENTS, "posted array<string>, until long", "append", GroupStateTimeout.ProcessingTimeTimeout)


@dataclass
class Reviews:
    """The two streams as one: reviewing, and posting what is new."""

    reviewing: StreamingQuery
    start_posting: Callable[[], StreamingQuery]
    once: bool
    posting: StreamingQuery | None = field(default=None)

    def __post_init__(self) -> None:
        if not self.once:
            self.posting = self.start_posting()

    def awaitTermination(self, timeout: float | None = None) -> bool | None:  # noqa: N802  as the queries have it
        """Both streams' end; with one trigger only, posting begins when reviewing has ended.  With a timeout, in seconds, whether they ended."""
        until = None if timeout is None else time.monotonic() + timeout
        left = lambda: () if until is None else (max(0.001, until - time.monotonic()),)
        if self.reviewing.awaitTermination(*left()) is False:
            return False
        if self.posting is None:
            self.posting = self.start_posting()
        return self.posting.awaitTermination(*left())

    def stop(self) -> None:
        self.reviewing.stop()
        if self.posting is not None:
            self.posting.stop()

    @property
    def isActive(self) -> bool:  # noqa: N802
        return self.reviewing.isActive or self.posting is not None and self.posting.isActive


def start(spark: SparkSession, source: str, out: str, checkpoint: str, current_policy: Callable[[], Policy] | None = None, versions: Callable[[], DataFrame] | None = None, section: str = "", kept_ms: int = KEPT, **trigger) -> Reviews:
    """Review the revisions landing in source as JSON (EVENTS; change and at may be missing).

    Either current_policy is asked anew for each micro-batch, or versions for the table of policies, of which each revision gets
    the one in force at its time, when it is replayed too.  Verdicts go to out/verdicts, comments to out/comments.  A
    comment is posted once for each path of a change of a project: patch sets do not repeat it, other changes and projects have their own.
    A batch of reviews writes its own folders of out, so one that is run again replaces what it wrote; comments are written once.
    """
    if (current_policy is None) == (versions is None):
        raise ValueError("give current_policy or versions")

    def handle(batch: DataFrame, number: int) -> None:
        kept = store.mark()
        if versions is not None:
            made = review_as_of(batch, versions(), section)
        else:
            policy = current_policy()
            made = [] if policy.failed or policy.rules is None else [review(batch, policy)]
        if made:
            verdicts, comments = (reduce(DataFrame.unionByName, x) for x in zip(*made, strict=True))
            verdicts.write.mode("overwrite").parquet(f"{out}/verdicts/batch={number}")
            comments.write.mode("overwrite").json(f"{out}/wanted/batch={number}")
        store.release(spark, kept)

    trigger = trigger or {"availableNow": True}
    once = bool(trigger.get("availableNow") or trigger.get("once"))

    def start_posting() -> StreamingQuery:
        store.made(spark, f"{out}/wanted")
        wanted = spark.readStream.schema(COMMENTS).option("recursiveFileLookup", "true").json(f"{out}/wanted")
        posting = unposted(wanted, kept_ms).writeStream.format("parquet").option("path", f"{out}/comments").option("checkpointLocation", f"{checkpoint}/posting").trigger(**trigger)
        before = spark.conf.get(NO_DATA)
        spark.conf.set(NO_DATA, "false")  # else batches without data follow each other for ever, to look for expired state
        try:
            return posting.start()
        finally:
            spark.conf.set(NO_DATA, before)

    stream = spark.readStream.schema(EVENTS).json(source)
    reviewing = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{checkpoint}/reviewing").trigger(**trigger).start()
    return Reviews(reviewing, start_posting, once)
