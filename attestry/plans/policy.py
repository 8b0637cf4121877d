"""Policy files: parsing, validation, gates, and the time token of a checked policy."""

from __future__ import annotations

import re
import time
from collections.abc import Mapping
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import cut
from . import catalog, grammar

# Keys of a policy file.
LISTS = ("reviewer", "cc", "alwaysReviewPath", "alwaysReview", "matchProjects", "excludeProjects", "thirdPartyAllowedProjects", "exclude", "excludePattern", "firstParty", "thirdParty", "forbidden", "firstPartyPattern", "thirdPartyPattern", "forbiddenPattern")
SINGLE = ("enable", "fromAccountId", "reviewLabel", "timeTestMax")
REGEX_LISTS = ("alwaysReviewPath", "alwaysReview", "matchProjects", "excludeProjects", "thirdPartyAllowedProjects", "excludePattern")
DEFAULT_LABEL, DEFAULT_TIME_MAX = "Copyright-Review", 8
# The bounds in seconds; the words are our own.
TIERS = ((60.0, "unusable"), (10.0, "far too slow"), (2.0, "slow"), (1.0, "a little slow"), (0.0, "fast"))
#: Fixed value: the form of a token.
TOKEN = re.compile(r"Copyright-check: ([0-9a-fA-F]+)\.([0-9a-fA-F]{16})")


@dataclass
class Message:
    severity: str
    key: str
    value: str
    text: str


@dataclass
class Policy:
    values: dict[str, list[str]]
    rules: catalog.RuleSet | None = None
    messages: list[Message] = field(default_factory=list)

    def one(self, key: str, default: str = "") -> str:
        return (self.values.get(key) or [default])[-1]

    @property
    def enabled(self) -> bool | None:
        v = self.one("enable").lower()
        return None if not v else v in ("true", "yes", "on", "1")

    @property
    def label(self) -> str:
        return self.one("reviewLabel", DEFAULT_LABEL)

    @property
    def time_max(self) -> int:
        return int(self.one("timeTestMax", str(DEFAULT_TIME_MAX)))

    @property
    def always_review(self) -> list[str]:
        return [*self.values.get("alwaysReviewPath", []), *self.values.get("alwaysReview", [])]

    @property
    def failed(self) -> bool:
        return any(m.severity == "ERROR" for m in self.messages)

    def signature(self) -> str:
        return f"{xxhash.xxh64_intdigest(repr(sorted(self.values.items()))):016x}"


def parse_sections(text: str) -> dict[str, dict[str, list[str]]]:
    """Sections of repeatable key = value lines; # and ; start comments, a section may have a quoted name."""
    out: dict[str, dict[str, list[str]]] = {}
    section: dict[str, list[str]] | None = None
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line[0] in "#;":
            continue
        if m := re.fullmatch(r"\[\s*([\w.-]+)(?:\s+\"((?:[^\"\\]|\\.)*)\")?\s*\]", line):
            section = out.setdefault(" ".join(x for x in m.groups() if x), {})
        elif section is not None:
            key, _, value = line.partition("=")
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] == '"':
                value = value[1:-1]
            section.setdefault(key.strip(), []).append(value.replace('\\"', '"').replace("\\\\", "\\"))
    return out


def read_policy(values: Mapping[str, list[str]]) -> Policy:
    """Rules and messages of a policy section; no rules where there is an error."""
    p = Policy({k: list(v) for k, v in values.items()})
    rules = catalog.RuleSet()

    def error(key: str, value: str, text: str) -> None:
        p.messages.append(Message("ERROR", key, value, text))

    for key in LISTS:
        for value in p.values.get(key, []):
            if not value.strip():
                error(key, value, "empty value")
                continue
            try:
                if key in REGEX_LISTS:
                    re.compile(re.sub(r"\\p\{[^}]*\}|\\P\{[^}]*\}", "x", value))
                    if key == "excludePattern":
                        rules = rules.exclude_pattern(value)
                elif key == "exclude":
                    rules = rules.exclude(value)
                elif key in ("firstParty", "thirdParty", "forbidden"):
                    rules = rules.add(key.removesuffix("Party"), value)
                elif key.endswith("Pattern"):
                    kind, _, pattern = value.strip().partition(" ")
                    if kind.lower() not in ("owner", "license") or not pattern.strip():
                        error(key, value, "must start with owner or license")
                        continue
                    add = rules.owner if kind.lower() == "owner" else rules.license
                    rules = add(key.removesuffix("Pattern").removesuffix("Party"), pattern.strip())
            except (re.error, ValueError) as e:
                error(key, value, str(e))
    for key in ("timeTestMax", "fromAccountId"):
        if (v := p.one(key)) and not re.fullmatch(r"-?[0-9]+", v):
            error(key, v, "not a whole number")
    if not p.failed:
        p.rules = rules
    return p


def check_project(p: Policy, labels: Mapping[str, list[str]], approvers: Mapping[str, bool], senders: Mapping[int, Mapping[str, object]]) -> list[Message]:
    """Messages about what the policy needs around it.

    labels: values of each configured label; approvers: whether someone may vote +2, by ref; senders: accounts by id with
    name, email, active, username.
    """
    hard = "ERROR" if p.enabled else "WARNING"
    out = [] if p.enabled is not None else [Message("HINT", "enable", "", "no server section switches this on; it applies to no project")]
    if not p.one("reviewLabel"):
        out.append(Message(hard, "reviewLabel", "", "no review label"))
    elif p.label not in labels:
        out.append(Message(hard, "reviewLabel", p.label, "label is not configured"))
    out += [Message(hard, "reviewLabel", p.label, f"nobody may vote +2 on {ref}") for ref, ok in approvers.items() if not ok]
    if not p.values.get("reviewer"):
        out.append(Message("WARNING", "reviewer", "", "no reviewer"))
    sender = int(p.one("fromAccountId", "0") or 0)
    if sender <= 0:
        out.append(Message("WARNING", "fromAccountId", "", "no sending account; the pushing user acts"))
    elif sender not in senders:
        out.append(Message(hard, "fromAccountId", str(sender), "no such account"))
    else:
        who = senders[sender]
        if not who.get("name") or not who.get("email"):
            out.append(Message("WARNING", "fromAccountId", str(sender), "account has no name or email"))
        if not who.get("active", True):
            out.append(Message("WARNING", "fromAccountId", str(sender), "account is inactive"))
        if not who.get("username"):
            out.append(Message("WARNING", "fromAccountId", str(sender), "account has no user name"))
    return out


#: The refs on which someone has to be able to approve, and the vote that approves.
VOTED_REFS, APPROVAL = ("refs/heads/*", "refs/meta/config"), "+2"


def voters(access: DataFrame, label: str, members: DataFrame | None = None) -> DataFrame:
    """project, ref, may_approve: whether somebody can give the label its approving vote, for both refs of every project.

    access: project, ref, key, value, the access lines of project configurations, such as (p, refs/heads/*, label-L, "-2..+2 group
    Owners").  A line counts whose range ends with the approving vote; null and empty lines do not.  With members (group, member) its
    group must also have a member, through groups that are members of it as well (member `group X`), circles allowed.
    """
    spark = access.sparkSession
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    granted = access.filter(F.col("key") == f"label-{label}").filter(F.endswith(F.substring_index(line, " ", 1), F.lit(APPROVAL)))
    granted = granted.select("project", "ref", F.regexp_replace(line, r"^\S+ ?(group )?", "").alias("group"))
    if members is not None:
        granted = granted.join(populated(members), "group", "left_semi")
    refs = spark.createDataFrame([(r,) for r in VOTED_REFS], "ref string")
    wanted = access.select("project").distinct().withColumn("ref", F.explode(F.array(*[F.lit(r) for r in VOTED_REFS])))
    held = granted.join(F.broadcast(refs), "ref").select("project", "ref").distinct().withColumn("found", F.lit(True))
    return wanted.join(held, ["project", "ref"], "left").select("project", "ref", F.coalesce("found", F.lit(False)).alias("may_approve"))


def populated(members: DataFrame, rounds: int = 64) -> DataFrame:
    """group: those with a member that is no group, directly or through groups among their members.

    One round for each level of nesting; a circle of groups without an account stays empty.
    """
    inner = F.col("member").startswith("group ")
    found = members.filter(~inner).select("group").distinct()
    edges = members.filter(inner).select("group", F.substring("member", 7, 1 << 30).alias("inner"))
    edges, found = cut(edges.distinct(), "group-edges"), cut(found, "groups")
    now = found
    for _ in range(rounds):
        now = cut(edges.join(now.withColumnRenamed("group", "inner"), "inner", "left_semi").select("group").distinct().join(found, "group", "left_anti"), "groups-new")
        if now.isEmpty():
            return found
        found = cut(found.unionByName(now), "groups")
    raise ValueError(f"groups are nested over {rounds} deep")


# --- changes of the policy ------------------------------------------------------------------------------------------

#: Where a policy is kept.
CONFIG_REF, CONFIG_FILE = "refs/meta/config", "project.config"


def config_events(events: DataFrame, root_project: str) -> DataFrame:
    """Of events (project, branch, files array, ...) those that change the policy file of the root project."""
    return events.filter((F.col("branch") == CONFIG_REF) & (F.col("project") == root_project) & F.array_contains("files", CONFIG_FILE))


@dataclass
class Outcome:
    """What becomes of a changed policy: a push can be rejected, a change under review gets comments at the tokens."""

    rejected: bool
    messages: list[Message]
    comments: list[tuple[int, int, int, int, str]] = field(default_factory=list)


def judge_change(new: Policy, current: Policy | None, commit_message: str, *, push: bool, default_time_max: int = DEFAULT_TIME_MAX) -> Outcome:
    """Nothing for a policy that equals the current one.  Changed rules need one valid time token in the commit message."""
    if current is not None and new.signature() == current.signature():
        return Outcome(False, [])
    most = new.time_max if not new.failed else default_time_max
    messages, comments = list(new.messages), []
    if new.rules is not None and (current is None or current.rules != new.rules) and most > 0:
        times = read_tokens(commit_message, new.signature())
        if must_report(times, most):
            what = ["token is not of this policy" if t < 0 else f"took {t / 1e6:.3f} s, {tier(t / 1e6)}; {most} s are allowed" if t > most * 1_000_000 else "more than one token" if len(times) > 1 else "valid" for t in times]
            messages += [Message("ERROR" if push else "WARNING", "timeTestMax", str(most), x) for x in what or ["no time token in the commit message; run the probe"]]
            comments = [(*at, x) for at, x in zip(token_places(commit_message), what, strict=True)]
    return Outcome(push and any(m.severity == "ERROR" for m in messages), messages, comments)


def messages_frame(spark: SparkSession, messages: list[Message]) -> DataFrame:
    return spark.createDataFrame([(m.severity, m.key, m.value, m.text) for m in messages], "severity string, key string, value string, message string")


def formatted(m: Message) -> str:
    """The line, a caret under its value, and the message."""
    head = f"{m.key} = "
    return f"{head}{m.value}\n{' ' * len(head)}^\n{m.text}" if m.value else f"no {m.key} key found\n{m.text}"


# --- gates ----------------------------------------------------------------------------------------------------------


def project_enabled(project: Column, p: Policy, by_project: Column, by_default: bool) -> Column:
    match, skip = p.values.get("matchProjects", []), p.values.get("excludeProjects", [])
    wanted = T.found_any(project, match) if match else F.lit(True)
    return wanted & ~T.found_any(project, skip) & F.coalesce(by_project, F.lit(by_default))


def ordinary_branch(branch: Column) -> Column:
    return ~branch.startswith("refs/")


# --- time token -----------------------------------------------------------------------------------------------------


def token(micros: int, signature: str) -> str:
    return f"Copyright-check: {micros:x}.{xxhash.xxh64_intdigest(f'{micros:x}{signature}'):016x}"


def read_tokens(commit_message: str, signature: str) -> list[int]:
    """Microseconds of each token found; -1 for one that is not of this policy."""
    out = []
    for m in TOKEN.finditer(commit_message):
        micros = int(m[1], 16)
        out.append(micros if token(micros, signature).lower() == m[0].lower() else -1)
    return out


def token_places(commit_message: str) -> list[tuple[int, int, int, int]]:
    """Start line and column, end line and column of each token; lines from 1, columns from 0."""
    at = lambda i: (1 + commit_message.count("\n", 0, i), i - (commit_message.rfind("\n", 0, i) + 1))
    return [(*at(m.start()), *at(m.end())) for m in TOKEN.finditer(commit_message)]


def must_report(found: list[int], time_max: int) -> bool:
    """Unless there is exactly one valid token within the limit."""
    return time_max > 0 and not (len(found) == 1 and 0 <= found[0] <= time_max * 1_000_000)


def tier(seconds: float) -> str:
    return next(text for least, text in TIERS if seconds > least or not least)


def probe_text(lines: int = 256, rules: catalog.RuleSet = catalog.PERMISSIVE) -> str:
    """About 1 KiB a line, made from the rules: what begins like their patterns and goes on as long as they allow, matching none.

    For each alternative of the master pattern a line takes the literals its matches hold, so that the scanner cannot pass it over, but
    glued to a letter; then the same literals short of their last letter, with the longest blanks between; then a sign of
    ownership and as many names as an owner may have, without a year.
    """
    index, out = rules.gate, []
    branches = [b for a in index.alternatives for b in a.branches] if index else []
    for k in range(lines):
        words = [s[k % len(s)] for s in branches[k % len(branches)].sets] if branches else []
        glued = " ".join(f"x{w}x" for w in words if w.isalnum())  # in others a word begins inside, and would be found
        short = (" " * grammar.SPACE_MAX).join(f"{w[:-1]}_" for w in words if not any(r in w[:-1] for r in index.roots))
        names = " ".join(f"N{chr(97 + i % 26) * (1 + (i + k) % grammar.NAME_MAX // 2)}" for i in range(grammar.WORDS_MAX + 1))
        line = f"{glued} {short} \u00a9 {names} "
        out.append((line * (1 + 1024 // len(line)))[:1024])
    return "\n".join(out)


def probe(spark: SparkSession, rules: catalog.RuleSet) -> float:
    """Seconds for scanning the probe text of these rules."""
    from ..operators.scan import scan

    def scanned(text: str) -> float:
        began = time.perf_counter()
        scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    scanned(probe_text(8, rules))  # plans and compiles
    return scanned(probe_text(rules=rules))
