"""Summaries of command outputs: a table of rules, each a command pattern and a way to cut its output.

A rule's ways are column expressions on the output's lines, so a million logs are filtered in the
JVM: `head` keeps first lines, `drop` leaves lines out first, `ends` keeps both ends, `count`
counts lines by label and shows the first of them, `top` counts by a captured group, `unique`
masks times and addresses and keeps distinct lines, `kept` keeps matching lines, `mask` hides
secrets, and `summary` parses lines of a known form (`summaries`).  Formats are this engine's own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import summaries
from .arrays import counted, let
from .json_text import skeleton
from .text import head_tail, mask_log, mask_secret


@dataclass(frozen=True)
class Way:
    """A way to cut an output: its kind, what it is set to, and the column expression."""

    kind: str
    args: tuple
    cut: Callable[[Column], Column]

    def __call__(self, text: Column) -> Column:
        return self.cut(text)


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x) != "")


def _first(lines: Column, n: int) -> Column:
    """The first n lines, and how many there were beyond."""

    def cut(x: Column) -> Column:
        more = F.size(x) - n
        shown = F.array_join(F.slice(x, 1, n), "\n")
        return F.when(more > 0, F.concat(shown, F.format_string("\n... %d more", more))).otherwise(shown)

    return let(lines, cut)


def head(n: int) -> Way:
    return Way("head", (n,), lambda text: _first(_lines(text), n))


def drop(pattern: str, n: int) -> Way:
    return Way("drop", (pattern, n), lambda text: _first(F.filter(_lines(text), lambda x: ~x.rlike(pattern)), n))


def kept(pattern: str, n: int) -> Way:
    return Way("kept", (pattern, n), lambda text: _first(F.filter(_lines(text), lambda x: x.rlike(pattern)), n))


def ends(n: int, above: int) -> Way:
    return Way("ends", (n, above), lambda text: head_tail(text, n, above))


def count(n: int, **labels: str) -> Way:
    def cut(lines: Column) -> Column:
        sizes = [F.format_string(f"{k}: %d", F.size(F.filter(lines, _matching(p)))) for k, p in labels.items()]
        shown = F.filter(lines, _matching("|".join(labels.values())))
        return let(_first(shown, n), lambda first: F.concat_ws("\n", F.concat_ws(", ", *sizes), F.nullif(first, F.lit(""))))

    return Way("count", (n, labels), lambda text: let(_lines(text), cut))


def _matching(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def top(pattern: str, n: int) -> Way:
    """The n commonest values of a pattern's first group, with their counts; ties by value."""

    def way(text: Column) -> Column:
        values = F.filter(F.transform(_lines(text), lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")
        return F.array_join(F.transform(F.slice(counted(values), 1, n), lambda p: F.format_string("%d %s", p["n"], p["v"])), "\n")

    return Way("top", (pattern, n), way)


def unique(n: int) -> Way:
    """The last n distinct lines after masking times and addresses."""

    def way(text: Column) -> Column:
        lines = F.array_distinct(F.transform(_lines(text), mask_log))
        return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")

    return Way("unique", (n,), way)


def masked(n: int) -> Way:
    def line(x: Column) -> Column:
        key, value = F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", "")
        return F.when(x.contains("="), F.concat(key, F.lit("="), mask_secret(key, value))).otherwise(x)

    return Way("masked", (n,), lambda text: _first(F.array_sort(F.transform(_lines(text), line)), n))


def summary(cut: Callable[[Column], Column]) -> Way:
    return Way("summary", (), cut)


@dataclass(frozen=True)
class Rule:
    """A command pattern and its way; with `both`, what went to stderr follows what went to stdout."""

    name: str
    command: str
    way: Way
    both: bool = False


GIT = r"^(?:git|yadm)\s+(?:-[Cc]\s+\S+\s+)*"
TESTS = {"passed": r"(?i)\bpass(?:ed|ing)?\b|\bok\b|✓", "failed": r"(?i)\bfail(?:ed|ing|ures?)?\b|✕|✗"}
ERRORS = {"errors": r"(?i)\berror\b", "warnings": r"(?i)\bwarning\b"}

#: The rules' names and command patterns.
RULES = [
    Rule("cargo_build", r"^cargo\s+build", count(15, **ERRORS)), Rule("cargo_test", r"^cargo\s+test", count(5, **TESTS)),
    Rule("cargo_clippy", r"^cargo\s+clippy", count(10, **ERRORS)), Rule("cargo_check", r"^cargo\s+check", count(10, errors=r"(?i)\berror\b")),
    Rule("cat", r"^(?:cat|head|tail)(?:\s|$)", ends(50, 200)),
    Rule("aws_identity", r"^aws\s+sts\s+get-caller-identity", kept("(?i)arn|account", 2)), Rule("aws_ec2", r"^aws\s+ec2\s+describe-instances", kept("(?i)instance|state|\"name\"", 15)),
    Rule("aws_lambda", r"^aws\s+lambda\s+list-functions", kept("(?i)functionname|runtime", 20)), Rule("aws_s3", r"^aws\s+s3\s+ls", summary(summaries.above(30, 20))),
    Rule("curl", r"^curl\s+", drop(r"^[<>*] |^\s*%|^\s*\d+\s+\d+", 80)), Rule("wget", r"^wget\s+", drop(r"\d+%|^--", 20)),
    Rule("docker_images", r"^docker\s+images", head(16)), Rule("docker_logs", r"^docker\s+logs?\s+", unique(50)),
    Rule("kubectl_pods", r"^kubectl\s+(?:get\s+)?pods?", head(20)), Rule("kubectl_services", r"^kubectl\s+(?:get\s+)?services?", head(20)),
    Rule("kubectl_logs", r"^kubectl\s+logs?\s+", unique(50)), Rule("docker_compose_ps", r"^docker\s+compose\s+ps", head(15)),
    Rule("psql", r"^psql(?:\s|$)", head(52)), Rule("mysql", r"^mysql(?:\s|$)", head(52)), Rule("sqlite3", r"^sqlite3(?:\s|$)", head(50)),
    Rule("docker_ps", r"^docker\s+ps(?:\s|$)", head(16)),
    Rule("dotnet_build", r"^dotnet\s+build", top(r"\b((?:CS|MSB|NU)\d+)\b", 10)), Rule("dotnet_test", r"^dotnet\s+test", count(5, **TESTS)),
    Rule("gh_pr_list", r"^gh\s+pr\s+list", head(20)), Rule("gh_pr_view", r"^gh\s+pr\s+view", drop(r"^<!--|!\[", 30)),
    Rule("gh_issue_list", r"^gh\s+issue\s+list", head(20)), Rule("gh_issue_view", r"^gh\s+issue\s+view", head(30)), Rule("gh_run_list", r"^gh\s+run\s+list", head(20)),
    Rule("git_diff", GIT + r"diff(?:\s|$)", summary(summaries.hunks)), Rule("git_log", GIT + r"log(?:\s|$)", drop(r"^(?:Author|Date|Merge):", 100)),
    Rule("git_add", GIT + r"add(?:\s|$)", kept(r"changed|insertion|deletion", 1)), Rule("git_commit", GIT + r"commit(?:\s|$)", kept(r"^\[|changed", 2)),
    Rule("git_push", GIT + r"push(?:\s|$)", kept(r"->|up-to-date|rejected", 5)), Rule("git_pull", GIT + r"pull(?:\s|$)", kept(r"changed|up to date|CONFLICT", 5)),
    Rule("git_status", GIT + "status", summary(summaries.status)),
    Rule("go_test", r"^go\s+test", count(10, **{"ok": r"^ok\b", "failed": r"^(?:FAIL|--- FAIL)"})), Rule("go_build", r"^go\s+build", kept(r"\.go:\d+", 10)),
    Rule("go_vet", r"^go\s+vet", kept(r"\.go:\d+", 10)), Rule("golangci_lint", r"^golangci-lint\s+run", top(r"\(([\w-]+)\)\s*$", 5)),
    Rule("grep", r"^(?:grep|rg|ripgrep)(?:\s|$)", summary(summaries.matches)),
    Rule("npm_install", r"^npm\s+(?:install|ci|i)(?:\s|$)", drop(r"(?i)^npm (?:warn|notice)|funding", 10)), Rule("npm_test", r"^npm\s+(?:run\s+)?test", drop(r"^>", 30)),
    Rule("pnpm_install", r"^pnpm\s+(?:install|i|add)(?:\s|$)", drop(r"(?i)^progress", 10)), Rule("pnpm_list", r"^pnpm\s+(?:list|ls)(?:\s|$)", head(20)),
    Rule("tsc", r"^(?:npx\s+)?tsc(?:\s|$)", summary(summaries.diagnostics("TypeScript", summaries.TSC, (1, 2, 3, 4), 3, "tsc: ok", width=70, unless="(?i)error")), both=True), Rule("eslint", r"^(?:npx\s+)?(?:eslint|biome\s+(?:check|lint))", summary(summaries.lint)),
    Rule("vitest", r"^(?:npx\s+)?vitest\s+run", count(5, **TESTS)), Rule("jest", r"^(?:npx\s+)?(?:jest)(?:\s|$)", count(5, **TESTS)),
    Rule("playwright", r"^(?:npx\s+)?playwright\s+test", count(5, **TESTS)), Rule("next_build", r"^(?:npx\s+)?next\s+build", kept(r"^[┌├└○●λƒ]", 15)),
    Rule("prettier", r"^(?:npx\s+)?prettier\s+", kept(r"^\[warn\]", 10)), Rule("prisma_generate", r"^(?:npx\s+)?prisma\s+generate", drop(r"[█▓░]", 10)),
    Rule("kubectl_get", r"^kubectl\s+get\s+", head(31)),
    Rule("kubectl_apply", r"^kubectl\s+(?:apply|create|delete)\s+", count(0, created=r"created$", configured=r"configured$", deleted=r"deleted", unchanged=r"unchanged$")),
    Rule("kubectl_describe", r"^kubectl\s+describe\s+", kept(r"^(?:Name|Namespace|Status|Events):|^\s+(?:Normal|Warning)\s", 20)),
    Rule("ls", r"^ls(?:\s|$)", summary(summaries.listing)), Rule("pytest", r"^(?:python\s+-m\s+)?pytest(?:\s|$)", summary(summaries.failures), both=True),
    Rule("ruff_check", r"^(?:python3?\s+-m\s+)?ruff\s+check", top(r":\d+:\d+: ([A-Z]+\d+)", 5)), Rule("mypy", r"^(?:python3?\s+-m\s+)?mypy(?:\s|$)", summary(summaries.diagnostics("mypy", summaries.MYPY, (1, 2, 4, 3), 5, "mypy: clean")), both=True),
    Rule("pip_list", r"^(?:python3?\s+-m\s+)?pip\s+list", head(30)), Rule("pip_outdated", r"^(?:python3?\s+-m\s+)?pip\s+.*outdated", head(20)),
    Rule("rake_test", r"^(?:bundle\s+exec\s+)?rake\s+test", kept(r"\d+ (?:runs|tests)", 1)), Rule("rspec", r"^(?:bundle\s+exec\s+)?rspec", kept(r"\d+ examples?|^rspec ", 10)),
    Rule("rubocop", r"^(?:bundle\s+exec\s+)?rubocop", top(r": [CWEF]: (?:\[Correctable\] )?([\w/]+):", 5)),
    Rule("find", r"^find\s+", drop(r"/(?:node_modules|\.git|__pycache__|\.venv)(?:/|$)", 200)), Rule("tree", r"^tree(?:\s|$)", summary(summaries.above(100, 80, without="|".join(map(re.escape, summaries.NOISE_DIRS[:-1])), end=r"^\d+ director"))),
    Rule("env", r"^env(?:\s|$)", masked(40)), Rule("json_structure", r"^(?:jq|python3?\s+-m\s+json\.tool)\s+", summary(lambda text: F.coalesce(skeleton(text), text))),
    Rule("log_dedup", r"^(?:tail\s+-f|journalctl)\s+", unique(100)), Rule("wc", r"^wc(?:\s|$)", summary(summaries.above(20, 15, last=True))), Rule("diff", r"^diff\s+", summary(summaries.above(100, 80))),
    Rule("bundle_install", r"^(?:bundle\s+install|gem\s+install)", drop(r"^Using ", 15)), Rule("terraform_plan", r"^terraform\s+plan(?:\s|$)", kept(r"^Plan:|^\s*# ", 21)),
    Rule("terraform_apply", r"^terraform\s+apply(?:\s|$)", kept(r"complete|Creating|Destroying|Modifying|Error", 20)),
    Rule("terraform_state", r"^terraform\s+state\s+(?:list|show)(?:\s|$)", summary(summaries.above(52, 50))), Rule("terraform_show", r"^terraform\s+show(?:\s|$)", kept(r"^(?:resource|data|#) ", 50)),
]


def bare_command(command: Column) -> Column:
    """The command without the variables set in front of it."""
    return F.btrim(F.regexp_replace(command, r"^(?:\s*[A-Za-z_]\w*=\S*\s+)+", ""))


def match_rule(command: Column) -> Column:
    """The name of the first rule for a command, null for none."""

    def first(bare: Column) -> Column:
        out = F.lit(None).cast("string")
        for rule in reversed(RULES):
            out = F.when(bare.rlike("(?i)" + rule.command), rule.name).otherwise(out)
        return out

    return let(bare_command(command), first)


def filter_outputs(runs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """`runs` (command, stdout) with `rule` and `filtered`; outputs without a rule, or not made shorter, stay.

    A column `stderr`, where there is one, follows stdout in the rules that read both.
    """
    rules = [r for r in RULES if names is None or r.name in names]
    ruled = runs.withColumn("rule", match_rule(F.col("command")))
    out = F.lit(None).cast("string")
    for rule in rules:
        text = F.concat(F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit(""))) if rule.both and "stderr" in runs.columns else F.col("stdout")
        out = F.when(F.col("rule") == rule.name, rule.way(text)).otherwise(out)
    return ruled.withColumn("filtered", out).withColumn(
        "filtered", F.when(F.length("filtered") < F.length("stdout"), F.col("filtered")).otherwise(F.col("stdout"))
    )
