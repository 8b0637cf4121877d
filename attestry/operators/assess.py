"""Verdicts, votes, comments and reviewers from findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import PARTIES, party_rank

#: A comment takes in findings up to so many lines from its start, and so many from its end.
LINES_FROM_START, LINES_FROM_END = 60, 40


def verdict_rank(party: str = "party", match_type: str = "match_type") -> Column:
    """Aggregate: rank of a file's verdict.  Third-party owners beside a first-party license are first-party."""
    p, m = F.col(party), F.col(match_type)
    third_owner = (p == "THIRD_PARTY") & (m == "AUTHOR_OWNER")
    worst = F.coalesce(F.max(F.when(~third_owner, party_rank(p))), F.lit(0))
    own = F.coalesce(F.bool_or((p == "FIRST_PARTY") & (m == "LICENSE")), F.lit(False))
    return F.when((worst == 0) & F.coalesce(F.bool_or(third_owner), F.lit(False)) & ~own, 1).otherwise(worst)


def party_of(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in PARTIES]), rank)


def file_verdicts(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(verdict_rank().alias("rank")).withColumn("verdict", party_of(F.col("rank")))


def change_verdicts(files: DataFrame, change: str, allowed: str = "third_party_allowed", always: str = "always_review") -> DataFrame:
    """change, review, label vote, message.  files: change, rank (null without findings), allowed, always."""
    rank = F.coalesce(F.col("rank"), F.lit(0))
    needs = F.coalesce(F.col(always), F.lit(False)) | (rank > 1) | ((rank == 1) & ~F.coalesce(F.col(allowed), F.lit(False)))
    out = files.groupBy(change).agg(F.bool_or(needs).alias("review"), F.max(rank).alias("rank"))
    return out.select(change, "review", "rank", F.when(F.col("review"), -1).otherwise(2).alias("vote"),
                      F.when(F.col("review"), "Needs review of notices").otherwise("No review of notices needed").alias("message"))


def message(party: Column, match_type: Column, text: Column, overall_rank: Column, allowed: Column, project: Column) -> Column:
    # fixed values: the words of a comment
    head = F.when(party == "FIRST_PARTY", "First-party ").when(party == "THIRD_PARTY", "Third-party ").when(party == "FORBIDDEN", "Disapproved ").otherwise("Unrecognized ")
    kind = F.when(match_type == "LICENSE", "license ").otherwise("author or owner ")
    where = F.when((party == "THIRD_PARTY") & (overall_rank != 0), F.concat(F.when(allowed, "allowed").otherwise("disallowed"), F.lit(" in repository "), project)).otherwise("")
    return F.concat(head, kind, where, F.lit(":\n\n"), text)


def resolved(party: Column, match_type: Column, overall_rank: Column, allowed: Column) -> Column:
    third = party == "THIRD_PARTY"
    return (party == "FIRST_PARTY") | (third & allowed) | (third & (match_type == "AUTHOR_OWNER") & (overall_rank == 0))


def coalesce_comments(findings: DataFrame, *keys: str) -> DataFrame:
    """keys, n, party, match_type, text, start_line, end_line: neighbouring findings of one party as one comment.

    An ordered fold over each file's few findings.  Input columns: keys, ord, party, match_type, text, start_line, end_line.
    """
    one = F.struct("ord", "party", "match_type", "text", "start_line", "end_line")
    shape = "array<struct<party:string,match_type:string,text:string,start_line:int,end_line:int>>"

    def fresh(m: Column) -> Column:
        return F.struct(m["party"].alias("party"), m["match_type"].alias("match_type"), m["text"].alias("text"), m["start_line"].cast("int").alias("start_line"), m["end_line"].cast("int").alias("end_line"))

    def step(acc: Column, m: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        apart = (F.size(acc) == 0) | (last["party"] != m["party"]) | (m["end_line"] > last["start_line"] + LINES_FROM_START) | (m["start_line"] > last["end_line"] + LINES_FROM_END)
        wider = F.struct(
            last["party"].alias("party"), F.when(m["match_type"] == "LICENSE", "LICENSE").otherwise(last["match_type"]).alias("match_type"), F.concat(last["text"], F.lit("..."), m["text"]).alias("text"),
            F.least(last["start_line"], m["start_line"].cast("int")).alias("start_line"), F.greatest(last["end_line"], m["end_line"].cast("int")).alias("end_line"),
        )
        return F.when(apart, F.concat(acc, F.array(fresh(m)))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).cast(shape)

    folded = findings.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("all"))
    return folded.select(*keys, F.posexplode(F.aggregate("all", F.array().cast(shape), step)).alias("n", "c")).select(*keys, "n", "c.*")


def new_comments(wanted: DataFrame, prior: DataFrame, on: tuple[str, ...] = ("path", "start_line", "end_line", "message")) -> DataFrame:
    """wanted without those already posted; nulls are equal."""
    p = prior.select(*[F.col(c).alias(f"p_{c}") for c in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return wanted.join(p, cond, "left_anti")


def identities(people: DataFrame) -> DataFrame:
    """account_id, identity: every name under which a person may be found."""
    names = F.array_compact(F.concat(F.array(F.col("account_id").cast("string"), "username", "name", "email"), F.coalesce("secondary_emails", F.array().cast("array<string>"))))
    return people.select("account_id", F.explode(F.array_distinct(names)).alias("identity"))


def missing_reviewers(wanted: DataFrame, existing: DataFrame, name: str = "reviewer") -> DataFrame:
    """Names in wanted that are no existing reviewer under any of their identities."""
    return wanted.join(identities(existing).select(F.col("identity").alias(name)).distinct(), name, "left_anti")
