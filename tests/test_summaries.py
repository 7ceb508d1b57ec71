"""Summaries of command outputs against outputs written out by hand, and the registered query against plain Python."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from skarn import catalog_outputs
from skarn.functions import arrays, filters, summaries

from .conftest import SMALL

WAY = {r.name: r.way for r in filters.RULES}
LONG = "src/very/long/folder/names/that/go/on/and/on/file.py"
DIFF = """diff --git a/x.py b/x.py
index 1..2 100644
--- a/x.py
+++ b/x.py
@@ -1,2 +1,3 @@ def f():
 same
-old
+new
+more
diff --git a/y.py b/y.py
--- a/y.py
+++ b/y.py
@@ -9 +9 @@
-gone
Binary files differ"""
PYTEST = """=================== FAILURES ===================
____________________ test_a ____________________
    def test_a():
>       assert 1 == 2
E       assert 1 == 2
E       more
E       and more
____________________ T.test_b[x-1] ____________________
E       ValueError: bad
tests/t.py:9: ValueError
============ short test summary info ============
FAILED tests/t.py::test_a - assert 1 == 2
FAILED tests/t.py::T::test_b[x-1] - ValueError: bad
ERROR tests/u.py - ImportError: no
====== 2 failed, 5 passed, 1 error in 0.3s ======"""
CASES = [
    ("grep", "", "0 matches"),
    ("grep", "no match here", "no match here"),
    ("grep", f"b.py:3:  x = 1\na.py:1:y\nb.py:9:{'z' * 120}\n{LONG}:7:q\nBinary file matches\n", f"4 matches in 3 files:\n[file] b.py (2):\n   3: x = 1\n   9: {'z' * 97}...\n[file] a.py (1):\n   1: y\n[file] src/.../on/file.py (1):\n   7: q"),
    ("grep", "\n".join(f"f.py:{k}:v" for k in range(1, 13)), "12 matches in 1 files:\n[file] f.py (12):\n" + "\n".join(f"   {k}: v" for k in range(1, 11)) + "\n   +2"),
    ("git_diff", DIFF, "  @@ def f():\n   same\n  -old\n  +new\n  +more\nx.py (+2 -1)\n  @@ -9 +9 @@\n  -gone\ny.py (+0 -1)"),
    ("git_diff", "", "No diff."),
    ("git_diff", "diff --git a/x b/x\n@@ -1 +1 @@\n" + "\n".join(["+a"] * 103), "  @@ -1 +1 @@\n" + "\n".join(["  +a"] * 100) + "\nx (+103 -0)"),
    ("git_diff", "\n".join(f"diff --git a/{k} b/{k}\n@@ -1 +1 @@\n" + "\n".join(["-a"] * 99) for k in range(7)), "\n".join("  @@ -1 +1 @@\n" + "\n".join(["  -a"] * 99) + f"\n{k} (+0 -99)" for k in range(5)) + "\n... truncated (500 lines shown)"),
    ("pytest", PYTEST, "Pytest: 5 passed, 2 failed, 1 error\n1. [FAIL] tests/t.py::test_a\n     >       assert 1 == 2\n     E       assert 1 == 2\n     E       more\n2. [FAIL] tests/t.py::T::test_b[x-1]\n     E       ValueError: bad\n3. [FAIL] tests/u.py\n     ImportError: no"),
    ("pytest", "collected 0 items", "Pytest: No tests collected"),
    ("pytest", "\n".join(f"FAILED t.py::t{k}" for k in range(7)) + "\n7 failed, 2 skipped", "Pytest: 7 failed, 2 skipped\n" + "\n".join(f"{k + 1}. [FAIL] t.py::t{k}" for k in range(5)) + "\n... +2 more failures"),
    ("ls", "", "(empty)"),
    ("ls", "total 12\ndrwxr-xr-x 2 u g 4096 Jan  2 03:04 src\ndrwxr-xr-x 2 u g 4096 Jan  2 03:04 node_modules\n-rw-r--r-- 1 u g 1536 Feb 12 2023 b.py\n-rw-r--r-- 1 u g 12 Feb 12 2023 a.py\nlrwxrwxrwx 1 u g 3 Mar  1 00:00 z -> a\n-rw-r--r-- 1 u g 3145728 Feb 12 2023 c.tar.gz\ndrwxr-xr-x 2 u g 4096 Jan  2 03:04 .",
     "src/\n  a.py  12B\n  b.py  1.5K\n  c.tar.gz  3.0M\n  z -> a  3B\nSummary: 4 files, 1 dirs, 2 .py, 1 .gz"),
    ("git_status", "## main...origin/main [ahead 1]\nM  s.py\nMM both.py\n M m.py\n?? n.py\nUU c.py\nAA d.py\nR  old -> new", "* main\n!! Conflicts: 2 files\n   c.py\n   d.py\n+ Staged: 3 files\n   s.py\n   both.py\n   old -> new\n~ Modified: 2 files\n   both.py\n   m.py\n? Untracked: 1 files\n   n.py"),
    ("git_status", "## dev", "* dev\nclean"), ("git_status", "", "clean"),
    ("git_status", "\n".join(f"?? f{k}" for k in range(10)), "? Untracked: 10 files\n" + "\n".join(f"   f{k}" for k in range(8)) + "\n   ... +2 more"),
    ("tsc", "", "tsc: ok"), ("tsc", "some Error elsewhere", "some Error elsewhere"),
    ("tsc", "b.ts(1,2): error TS1: m1\na.ts(3,4): error TS2: m2\nb.ts(5,6): error TS1: m3\nb.ts(7,8): error TS1: m4\nb.ts(9,9): error TS3: m5", "TypeScript: 5 errors in 2 files\nTop codes: TS1 (3x), TS2 (1x), TS3 (1x)\nb.ts (4 errors)\n  L1: [TS1] m1\n  L5: [TS1] m3\n  L7: [TS1] m4\n  ... +1 more\na.ts (1 errors)\n  L3: [TS2] m2"),
    ("mypy", "Success: no issues", "mypy: clean"),
    ("mypy", "a.py:1: error: bad  [arg-type]\na.py:2:5: error: worse\na.py:3: note: see", "mypy: 2 errors in 1 files\nTop codes: arg-type (1x)\na.py (2 errors)\n  L1: [arg-type] bad\n  L2: [?] worse"),
    ("eslint", '[{"errorCount":1,"warningCount":2,"messages":[{"ruleId":"semi"},{"ruleId":null},{"ruleId":"semi"}]},{"errorCount":0,"warningCount":0}]', "ESLint: 1 errors, 2 warnings in 1 files\nTop rules:\n  semi (2x)\n  ? (1x)"),
    ("eslint", "[]", "ESLint: clean"), ("eslint", "not json", "not json"),
    ("wc", "\n".join(f"{k} f{k}" for k in range(22)), "\n".join(f"{k} f{k}" for k in range(15)) + "\n... +7 more\n21 f21"), ("wc", "1 a\n2 total\n", "1 a\n2 total"),
    ("diff", "\n".join(f"< {k}" for k in range(100)), "\n".join(f"< {k}" for k in range(100))), ("diff", "\n".join(f"< {k}" for k in range(101)), "\n".join(f"< {k}" for k in range(80)) + "\n... +21 more"),
    ("aws_s3", "\n".join(map(str, range(31))), "\n".join(map(str, range(20))) + "\n... +11 more"), ("aws_s3", "a\nb", "a\nb"),
    ("terraform_state", "\n".join(map(str, range(53))), "\n".join(map(str, range(50))) + "\n... +3 more"),
    ("tree", ".\n├── node_modules\n├── a\n└── b\n\n2 directories, 3 files", ".\n├── a\n└── b\n\n2 directories, 3 files"),
    ("tree", "\n".join(map(str, range(102))) + "\n1 directory, 102 files", "\n".join(map(str, range(80))) + "\n... +22 more\n1 directory, 102 files"),
]


@pytest.fixture(scope="module")
def cut(spark):
    rows = spark.createDataFrame([(k, name, text) for k, (name, text, _) in enumerate(CASES)], "k int, name string, text string")
    out = F.lit(None).cast("string")
    for name in {c[0] for c in CASES}:
        out = F.when(F.col("name") == name, WAY[name](F.col("text"))).otherwise(out)
    return {r.k: r.out for r in rows.select("k", out.alias("out")).collect()}


@pytest.mark.parametrize("k", range(len(CASES)), ids=lambda k: f"{CASES[k][0]}-{k}")
def test_outputs_by_hand(cut, k):
    assert cut[k] == CASES[k][2]


def test_stderr_is_read(spark):
    rows = [("pytest -q", "x" * 200 + "\n1 passed", "FAILED a::b - boom\n1 failed"), ("tsc", "y" * 99, "a.ts(1,2): error TS1: m")]
    runs = spark.createDataFrame(rows, "command string, stdout string, stderr string")
    got = {r.rule: r.filtered for r in filters.filter_outputs(runs.withColumn("stdout", F.concat("stdout", F.lit("\n"))), ["pytest", "tsc"]).collect()}
    assert got["pytest"] == "Pytest: 1 failed\n1. [FAIL] a::b\n     boom"
    assert got["tsc"].startswith("TypeScript: 1 errors in 1 files")


def test_counted(spark):
    rows = [[], ["a"], ["b", "a", "b"], [str(k % 7) for k in range(100)], ["x", "", "x", ""]]
    got = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v array<string>").select("k", arrays.counted(F.col("v")).alias("c")).collect()
    for r in got:
        assert [(x.v, x.n) for x in r.c] == sorted(collections.Counter(rows[r.k]).items(), key=lambda x: (-x[1], x[0]))


def plain(rule, text):
    """The summaries that the query's lines reach, by loops."""
    lines = text.split("\n")
    body = re.sub(r"\s+\Z", "", text).split("\n")
    limits = {"wc": (20, 15), "diff": (100, 80), "aws_s3": (30, 20), "terraform_state": (52, 50)}
    if rule in limits:
        limit, n = limits[rule]
        return "\n".join([*body[:n], f"... +{len(body) - n} more", *([body[-1]] if rule == "wc" else [])] if len(body) > limit else body)
    if rule in ("tsc", "mypy"):
        groups, each, width = ((1, 2, 3, 4), 3, 70) if rule == "tsc" else ((1, 2, 4, 3), 5, 80)
        found = [[m.group(g) or "" for g in groups] for x in lines if (m := re.match(summaries.TSC if rule == "tsc" else summaries.MYPY, x))]
        if not found:
            return text if rule == "tsc" and "error" in text.lower() else "tsc: ok" if rule == "tsc" else "mypy: clean"
        order = lambda c: sorted(c.items(), key=lambda x: (-x[1], x[0]))
        files, codes = collections.Counter(e[0] for e in found), collections.Counter(e[2] for e in found if e[2])
        out = [f"{'TypeScript' if rule == 'tsc' else rule}: {len(found)} errors in {len(files)} files", "Top codes: " + ", ".join(f"{c} ({n}x)" for c, n in order(codes)[:5])]
        for f, n in order(files)[:10]:
            out += [f"{f} ({n} errors)", *[f"  L{e[1]}: [{e[2] or '?'}] {e[3][:width]}" for e in found if e[0] == f][:each], *([f"  ... +{n - each} more"] if n > each else [])]
        return "\n".join(out)
    if rule == "grep":
        found = [(m.group(1), m.group(2), m.group(3).strip(" ")) for x in lines if (m := re.match(summaries.MATCH, x))]
        files = list(dict.fromkeys(f for f, _, _ in found))
        out, shown, seen = [f"{len(found)} matches in {len(files)} files:"], 0, 0
        for f in files:
            if shown >= 200:
                break
            own = [e for e in found if e[0] == f]
            out += [f"[file] {f} ({len(own)}):", *[f"   {n}: {t}" for _, n, t in own[:10]], *([f"   +{len(own) - 10}"] if len(own) > 10 else [])]
            shown, seen = shown + min(len(own), 10), seen + 1
        return "\n".join([*out, *([f"... +{len(files) - seen} files"] if len(files) > seen else [])]) if found else text
    return None


def test_query_equals_plain_python(spark):
    names = catalog_outputs._summed
    made = {r.event_id: r for r in catalog_outputs._outputs(spark, SMALL, names).collect()}
    runs = spark.createDataFrame(list(made.values()))
    checked = collections.Counter()
    for r in filters.filter_outputs(runs, names).collect():
        want = plain(r.rule, r.stdout)
        if want is not None:
            assert r.filtered == (want if len(want) < len(r.stdout) else r.stdout), r.rule
            checked[r.rule] += 1
    assert len(checked) == 7 and min(checked.values()) > 20
