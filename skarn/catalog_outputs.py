"""Registered queries of the command-output rules, one for each way to cut an output, with their SQL.

Outputs are made of LINES by the events' ids, so that each rule meets lines of many forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import register
from .functions import filters
from .plans import adapters as a

#: A command for each rule.
COMMANDS = {
    "cargo_build": "cargo build --release", "cargo_test": "cargo test -q", "cargo_clippy": "cargo clippy", "cargo_check": "cargo check", "cat": "cat a.txt",
    "aws_identity": "aws sts get-caller-identity", "aws_ec2": "aws ec2 describe-instances", "aws_lambda": "aws lambda list-functions", "aws_s3": "aws s3 ls s3://b",
    "curl": "curl -s http://x", "wget": "wget http://x", "docker_images": "docker images", "docker_logs": "docker logs web", "kubectl_pods": "kubectl get pods",
    "kubectl_services": "kubectl get services", "kubectl_logs": "kubectl logs web", "docker_compose_ps": "docker compose ps", "psql": "psql -c x", "mysql": "mysql -e x",
    "sqlite3": "sqlite3 a.db", "docker_ps": "docker ps", "dotnet_build": "dotnet build", "dotnet_test": "dotnet test", "gh_pr_list": "gh pr list", "gh_pr_view": "gh pr view 3",
    "gh_issue_list": "gh issue list", "gh_issue_view": "gh issue view 3", "gh_run_list": "gh run list", "git_diff": "git -C /x diff", "git_log": "git log", "git_add": "git add .",
    "git_commit": "git commit -m x", "git_push": "git push", "git_pull": "git pull", "git_status": "yadm status", "go_test": "go test ./...", "go_build": "go build", "go_vet": "go vet",
    "golangci_lint": "golangci-lint run", "grep": "rg -n x", "npm_install": "npm ci", "npm_test": "npm run test", "pnpm_install": "pnpm add x", "pnpm_list": "pnpm ls",
    "tsc": "npx tsc", "eslint": "biome check", "vitest": "vitest run", "jest": "npx jest", "playwright": "playwright test", "next_build": "next build", "prettier": "prettier --check .",
    "prisma_generate": "prisma generate", "kubectl_get": "kubectl get nodes", "kubectl_apply": "kubectl apply -f x", "kubectl_describe": "kubectl describe pod x", "ls": "ls -la",
    "pytest": "python -m pytest", "ruff_check": "ruff check", "mypy": "mypy .", "pip_list": "pip list", "pip_outdated": "pip index --outdated", "rake_test": "bundle exec rake test",
    "rspec": "rspec", "rubocop": "rubocop", "find": "find . -name x", "tree": "tree", "env": "env", "json_structure": "jq . x", "log_dedup": "journalctl -u x", "wc": "wc -l x",
    "diff": "diff a b", "bundle_install": "bundle install", "terraform_plan": "terraform plan", "terraform_apply": "terraform apply", "terraform_state": "terraform state list",
    "terraform_show": "terraform show",
}
#: What outputs are made of: lines of the forms that the rules look for, and others.
LINES = [
    "error: cannot find value", "warning: unused variable", "test a ... ok", "3 passed, 1 failed", "FAILED tests/a.py::test_x", "E   assert 1 == 2", "ok  pkg/a 0.2s", "--- FAIL: TestB",
    "main.go:12:3: undefined: x (typecheck)", "a.go:9:1: bad (errcheck)", "a.ts(1,2): error TS1005: x", "b.ts(3,4): error TS2304: y", "  3:1  error  no semi  semi", "src/a.py:1:1: F401 unused",
    "src/b.py:7: error: no [arg-type]", "x.cs(1,1): error CS0103: no", "a.rb:1:1: C: [Correctable] Style/Quotes: use", "b.rb:2:2: W: Lint/Void: use", "M  staged.txt", " M changed.txt",
    "?? new.txt", "UU both.txt", "diff --git a/x b/x", "@@ -1 +1 @@", "+added", "-removed", "Author: A", "[main abc1234] message", " 2 files changed, 3 insertions(+)",
    "   abc..def  main -> main", "Everything up-to-date", "npm warn old", "> build", "Progress: 3", "[warn] a.ts", "deployment/web created", "service/web unchanged", "pod/x deleted",
    "Name: web", "Status: Running", "  Warning  BackOff", "12 examples, 1 failure", "7 runs, 9 assertions", "Plan: 3 to add", "  # aws_x.a will be created", "resource \"aws_x\" \"a\" {",
    "aws_x.a: Creating...", "Apply complete!", "Using rake 13", "/src/node_modules/a.js", "./src/a.py", "a/b.rs:fn main", "image.png", "notes.md", "2024-01-02T03:04:05Z 10.0.0.1 up",
    "2024-01-02T03:04:09Z 10.0.0.2 up", "API_TOKEN=abc", "HOME=/root", "  \"Arn\": \"x\",", "  \"State\": 1,", "  \"FunctionName\": \"f\",", "< HTTP/1.1 200", "  % Total", "",
]


def _outputs(s: SparkSession, d: str, names: list[str]) -> DataFrame:
    """Each event's output of one of the rules, 5 to 264 lines long."""
    pick = lambda i: F.element_at(F.array(*map(F.lit, LINES)), ((F.col("event_id") * 7 + i * (F.col("user_id") % 61 + 1)) % len(LINES) + 1).cast("int"))
    n = F.when(F.col("event_id") % 10 == 0, 260).otherwise(F.col("event_id") % 60) + 4
    stdout = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n), pick), "\n")
    command = F.element_at(F.array(*[F.lit(COMMANDS[x]) for x in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    variables = F.when(F.col("event_id") % 4 == 0, "A=1 B_2=x ").otherwise("")
    return a.table(s, d, "events").select("event_id", F.concat(variables, command).alias("command"), stdout.alias("stdout"))


def _run(names: list[str]):
    def run(s: SparkSession, d: str) -> DataFrame:
        cut = filters.filter_outputs(_outputs(s, d, names), names)
        return cut.select("event_id", "rule", F.md5(F.col("filtered").cast("binary")).alias("digest"), F.length("filtered").alias("n_chars"))

    return run


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(values) -> str:
    return "[" + ", ".join(_quoted(v) if isinstance(v, str) else str(v) for v in values) + "]"


FIRST = "array_to_string(x[1:n], chr(10)) || CASE WHEN len(x) > n THEN chr(10) || '... ' || (len(x) - n) || ' more' ELSE '' END"
#: Per way: the rule's parameters by position, the lines that count (x) and the text.
SQL = {
    "head": (["n"], "lines", FIRST),
    "drop": (["p", "n"], "list_filter(lines, lambda v: NOT regexp_matches(v, p))", FIRST),
    "kept": (["p", "n"], "list_filter(lines, lambda v: regexp_matches(v, p))", FIRST),
    "ends": (["n", "above"], "string_split(stdout, chr(10))", "CASE WHEN len(x) > above THEN array_to_string(x[1:n], chr(10)) || chr(10) || '... ' || (len(x) - 2 * n) || ' lines omitted ...' || chr(10) || array_to_string(x[len(x) - n + 1:], chr(10)) ELSE stdout END"),
    "top": (["p", "n"], "list_filter(list_transform(lines, lambda v: regexp_extract(v, p, 1)), lambda v: v <> '')",
            "array_to_string(list_transform(list_sort(list_transform(list_distinct(x), lambda v: {'n': -len(list_filter(x, lambda w: w = v)), 'v': v}))[1:n], lambda t: (-t.n) || ' ' || t.v), chr(10))"),
    "unique": (["n"], r"list_transform(lines, lambda v: regexp_replace(regexp_replace(v, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?Z?', '<time>', 'g'), '\b\d{1,3}(?:\.\d{1,3}){3}\b', '<ip>', 'g'))",
               "array_to_string(list_transform(list_sort(list_transform(list_distinct(x), lambda v: {'k': list_position(x, v), 'v': v})), lambda t: t.v)[greatest(len(list_distinct(x)) - n + 1, 1):], chr(10))"),
    "masked": (["n"], r"list_sort(list_transform(lines, lambda v: CASE WHEN contains(v, '=') THEN split_part(v, '=', 1) || '=' || CASE WHEN regexp_matches(upper(split_part(v, '=', 1)), 'SECRET|KEY|TOKEN|PASSWORD|CREDENTIAL|AUTH') THEN '***' ELSE regexp_replace(v, '^[^=]*=', '') END ELSE v END))", FIRST),
    "count": (["n", "labels", "patterns"], "list_filter(lines, lambda v: len(list_filter(patterns, lambda p: regexp_matches(v, p))) > 0)",
              "array_to_string(list_transform(range(1, len(labels) + 1), lambda i: labels[i] || ': ' || len(list_filter(lines, lambda v: regexp_matches(v, patterns[i])))), ', ') || CASE WHEN len(x) > 0 THEN chr(10) || " + FIRST + " ELSE '' END"),
}


def _sql(kind: str, rules: list[filters.Rule]) -> str:
    columns, lines, text = SQL[kind]

    def values(rule: filters.Rule) -> str:
        args = [rule.way.args[0], list(rule.way.args[1]), list(rule.way.args[1].values())] if kind == "count" else rule.way.args
        return ", ".join(_quoted(v) if isinstance(v, str) else _listed(v) if isinstance(v, list) else str(v) for v in args)

    rows = ", ".join(f"({k}, {_quoted(r.name)}, {values(r)})" for k, r in enumerate(rules))
    stdout = f"array_to_string(list_transform(range(0, n + 1), lambda i: ({_listed(LINES)})[(event_id * 7 + i * (user_id % 61 + 1)) % {len(LINES)} + 1]), chr(10))"
    return f"""WITH r(slot, rule, {', '.join(columns)}) AS (VALUES {rows}),
    e AS (SELECT event_id, user_id, CASE WHEN event_id % 10 = 0 THEN 260 ELSE event_id % 60 END + 4 AS n FROM events), o AS (SELECT event_id, {stdout} AS stdout FROM e),
    l AS (SELECT o.*, list_filter(string_split(stdout, chr(10)), lambda v: trim(v) <> '') AS lines, r.* FROM o JOIN r ON event_id % {len(rules)} = slot),
    x AS (SELECT *, {lines} AS x FROM l), t AS (SELECT event_id, rule, stdout, {text} AS y FROM x)
    SELECT event_id, rule, md5(CASE WHEN length(y) < length(stdout) THEN y ELSE stdout END) AS digest, length(CASE WHEN length(y) < length(stdout) THEN y ELSE stdout END)::INT AS n_chars FROM t"""


for _kind in SQL:
    _rules = [r for r in filters.RULES if r.way.kind == _kind]
    register(f"outputs_{_kind}", _run([r.name for r in _rules]), _sql(_kind, _rules))
_summed = [r.name for r in filters.RULES if r.way.kind == "summary"]
register("outputs_summary", _run(_summed))
