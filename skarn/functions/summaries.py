"""Summaries of command outputs that keep what their lines say: matches by file, diagnostics, failures, hunks, listings.

Each is one column expression over a row's own output: lines are parsed by patterns, counted by one
sort, and shown in bounded number, so that work stays in proportion to an output's length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import counted, let

# What tells a match, a diagnostic, a failure, a listing's date, and folders that say nothing.
MATCH = r"^(.+?):(\d+):(.*)$"
TSC = r"^(.+?)\((\d+),\d+\):\s+error\s+(TS\d+):\s+(.+)$"
MYPY = r"^(.+?):(\d+):(?:\d+:)?\s+error:\s+(.+?)(?:\s+\[([\w-]+)\])?$"
FAILURE = r"^(?:FAILED|ERROR)\s+(.+?)(?:\s+-\s+(.+))?$"
ERROR_LINE = r"^\s*(?:>|E\s+|assert |raise |Error|Exception|Traceback)"
LISTED = r"\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+(?:\d{4}|\d{2}:\d{2})\s+"
NOISE_DIRS = [
    "node_modules", ".git", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target", "dist", "build", ".next", ".nuxt", ".tox", ".venv", "venv", ".eggs", "*.egg-info",
]


def all_lines(text: Column) -> Column:
    """The lines of a text; none of an empty one, and no empty one after a last line's end."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\r?\n", -1))


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def short_path(path: Column, most: int = 50) -> Column:
    """A long path by its first part and its last two."""
    parts = F.split(path, "/")
    cut = F.concat(F.get(parts, F.lit(0)), F.lit("/.../"), F.try_element_at(parts, F.lit(-2)), F.lit("/"), F.try_element_at(parts, F.lit(-1)))
    return F.when((F.length(path) > most) & (F.size(parts) > 3), cut).otherwise(path)


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def _plus(more: Column, form: str) -> Column:
    """A line that says how many more there are, if any."""
    return F.when(more > 0, F.array(F.format_string(form, more))).otherwise(F.array().cast("array<string>"))


def matches(text: Column, per_file: int = 10, most: int = 200) -> Column:
    """Search matches by file, in the files' order: so many of each file and in all, and how many there are."""

    def parsed(line: Column) -> Column:
        return F.struct(F.regexp_extract(line, MATCH, 1).alias("file"), F.regexp_extract(line, MATCH, 2).alias("at"), F.btrim(F.regexp_extract(line, MATCH, 3)).alias("said"))

    def shown(found: Column) -> Column:
        files = F.array_distinct(F.transform(found, lambda m: m["file"]))
        return let(files, lambda f: listed(found, f))

    def listed(found: Column, files: Column) -> Column:
        start = F.struct(F.lit(0).alias("shown"), F.lit(0).alias("files"), F.array().cast("array<string>").alias("out"))

        def add(state: Column, file: Column) -> Column:
            return let(F.filter(found, lambda m: m["file"] == file), lambda own: grown(state, file, own))

        def grown(state: Column, file: Column, own: Column) -> Column:
            head = F.concat(F.lit("[file] "), short_path(file), F.format_string(" (%d):", F.size(own)))
            lines = F.transform(F.slice(own, 1, per_file), lambda m: F.concat(F.lit("   "), m["at"], F.lit(": "), shortened(m["said"], 100)))
            out = F.concat(state["out"], F.array(head), lines, _plus(F.size(own) - per_file, "   +%d"))
            after = F.struct((state["shown"] + F.least(F.size(own), F.lit(per_file))).alias("shown"), (state["files"] + 1).alias("files"), out.alias("out"))
            return F.when(state["shown"] >= most, state).otherwise(after)

        def whole(state: Column) -> Column:
            head = F.format_string("%d matches in %d files:", F.size(found), F.size(files))
            return _joined(F.concat(F.array(head), state["out"], _plus(F.size(files) - state["files"], "... +%d files")))

        # A file shows a line at least, so no more than `most` are looked at.
        return F.aggregate(F.slice(files, 1, most), start, add, whole)

    def all_found(lines: Column) -> Column:
        found = F.transform(F.filter(lines, lambda x: x.rlike(MATCH)), parsed)
        return let(found, lambda m: F.when(F.size(lines) == 0, F.lit("0 matches")).when(F.size(m) == 0, text).otherwise(shown(m)))

    return let(all_lines(text), all_found)


def diagnostics(tool: str, pattern: str, groups: tuple[int, int, int, int], per_file: int, clean: str, most: int = 10, width: int = 80, unless: str | None = None):  # noqa: ANN201
    """A way to sum up diagnostics: how many in how many files, the five commonest codes, and the files of most, with their first.

    `groups` are the pattern's groups of file, line, code and message; outputs without any are
    `clean`, unless they match `unless`, and then stay.
    """
    file, at, code, said = groups

    def parsed(line: Column) -> Column:
        return F.struct(*[F.regexp_extract(line, pattern, g).alias(n) for g, n in ((file, "file"), (at, "at"), (code, "code"), (said, "said"))])

    def summed(found: Column) -> Column:
        codes = counted(F.filter(F.transform(found, lambda e: e["code"]), lambda c: c != ""))
        files = counted(F.transform(found, lambda e: e["file"]))
        return let(codes, lambda c: let(files, lambda f: listed(found, c, f)))

    def listed(found: Column, codes: Column, files: Column) -> Column:
        head = F.format_string(f"{tool}: %d errors in %d files", F.size(found), F.size(files))
        top = F.array_join(F.transform(F.slice(codes, 1, 5), lambda c: F.format_string("%s (%dx)", c["v"], c["n"])), ", ")

        def of(f: Column) -> Column:
            own = F.slice(F.filter(found, lambda e: e["file"] == f["v"]), 1, per_file)
            lines = F.transform(own, lambda e: F.concat(F.lit("  L"), e["at"], F.lit(": ["), F.when(e["code"] == "", "?").otherwise(e["code"]), F.lit("] "), F.substring(e["said"], 1, width)))
            return F.concat(F.array(F.format_string("%s (%d errors)", f["v"], f["n"])), lines, _plus(f["n"] - per_file, "  ... +%d more"))

        each = F.flatten(F.transform(F.slice(files, 1, most), of))
        tops = F.when(F.size(codes) > 0, F.array(F.concat(F.lit("Top codes: "), top))).otherwise(F.array().cast("array<string>"))
        return _joined(F.concat(F.array(head), tops, each, _plus(F.size(files) - most, "... +%d files")))

    def way(text: Column) -> Column:
        found = F.transform(F.filter(all_lines(text), lambda x: x.rlike(pattern)), parsed)
        none = F.lit(clean) if unless is None else F.when(text.rlike(unless), text).otherwise(clean)
        return let(found, lambda e: F.when(F.size(e) == 0, none).otherwise(summed(e)))

    return way


def failures(text: Column, most: int = 5, lines_each: int = 3) -> Column:
    """A test run: its counts, and the first failures with their reason or the first error lines of their section."""
    kinds = ["passed", "failed", "error", "skipped"]

    def summed(lines: Column) -> Column:
        last = F.try_element_at(F.filter(lines, lambda x: x.rlike(r"\d+\s+(?:passed|failed|error)")), F.lit(-1))
        failed = F.filter(lines, lambda x: x.rlike(r"^(?:FAILED|ERROR)\s"))
        heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, r"^_{3,} (.+?) _{3,}$", 1).alias("name"))), lambda h: h["name"] != "")
        return let(F.coalesce(last, F.lit("")), lambda s: let(failed, lambda f: let(heads, lambda h: told(lines, s, f, h))))

    def told(lines: Column, last: Column, failed: Column, heads: Column) -> Column:
        counts = [F.regexp_extract(last, rf"(\d+)\s+{k}", 1) for k in kinds]
        said = F.array_join(F.filter(F.array(*[F.when(~c.isin("", "0"), F.concat(c, F.lit(f" {k}"))) for c, k in zip(counts, kinds, strict=True)]), lambda x: x.isNotNull()), ", ")

        def one(line: Column, k: Column) -> Column:
            name, reason = F.regexp_extract(line, FAILURE, 1), F.regexp_extract(line, FAILURE, 2)
            bare = F.regexp_replace(F.regexp_replace(name, r"^.*::", ""), r"\[.*$", "")
            start = F.try_element_at(F.filter(heads, lambda h: F.regexp_replace(F.regexp_replace(h["name"], r"^.*\.", ""), r"\[.*$", "") == bare), F.lit(1))["i"]
            stop = F.coalesce(F.array_min(F.filter(F.transform(heads, lambda h: h["i"]), lambda i: i > start)), F.size(lines))
            section = F.filter(F.slice(lines, start + 2, F.greatest(stop - start - 1, F.lit(0))), lambda x: x.rlike(ERROR_LINE))
            own = F.when(start.isNotNull(), F.slice(section, 1, lines_each)).otherwise(F.when(reason != "", F.array(reason)).otherwise(F.array().cast("array<string>")))
            return F.concat(F.array(F.concat(F.format_string("%d. [FAIL] ", k + 1), name)), F.transform(own, lambda x: F.concat(F.lit("     "), F.btrim(x))))

        each = F.flatten(F.transform(F.slice(failed, 1, most), one))
        head = F.when(said == "", "Pytest: No tests collected").otherwise(F.concat(F.lit("Pytest: "), said))
        return _joined(F.concat(F.array(head), each, _plus(F.size(failed) - most, "... +%d more failures")))

    return let(all_lines(text), summed)


def hunks(text: Column, per_hunk: int = 100, most: int = 500) -> Column:
    """A diff by file: its hunks with so many lines each and in all, then the file with the lines that came and went."""
    start = F.struct(
        F.lit("").alias("file"), F.lit(0).alias("plus"), F.lit(0).alias("minus"), F.lit(0).alias("hunk"), F.lit(0).alias("total"), F.array().cast("array<string>").alias("out")
    )

    def closed(s: Column) -> Column:
        changed = (s["file"] != "") & ((s["plus"] > 0) | (s["minus"] > 0))
        return F.when(changed, F.concat(s["out"], F.array(F.format_string("%s (+%d -%d)", s["file"], s["plus"], s["minus"])))).otherwise(s["out"])

    def made(s: Column, **new: Column) -> Column:
        return F.struct(*[new.get(n, s[n]).alias(n) for n in ("file", "plus", "minus", "hunk", "total", "out")])

    def add(s: Column, line: Column) -> Column:
        name = F.regexp_extract(line, r"^diff --git a/(.*) b/", 1)
        where = F.btrim(F.regexp_extract(line, r"^@@\s.*?@@\s*(.*)$", 1))
        shown = s["hunk"] < per_hunk
        one = F.when(shown, 1).otherwise(0)
        out = F.when(shown, F.concat(s["out"], F.array(F.concat(F.lit("  "), line)))).otherwise(s["out"])
        sign = F.substring(line, 1, 1)
        return (
            F.when(s["total"] >= most, s)
            .when(name != "", made(s, file=name, plus=F.lit(0), minus=F.lit(0), hunk=F.lit(0), out=closed(s)))
            .when(line.rlike(r"^(?:index |--- |\+\+\+ )"), s)
            .when(line.rlike(r"^@@\s.*?@@"), made(s, hunk=F.lit(0), total=s["total"] + 1, out=F.concat(s["out"], F.array(F.concat(F.lit("  "), F.when(where != "", F.concat(F.lit("@@ "), where)).otherwise(F.btrim(line)))))))
            .when(sign.isin("+", "-", " "), made(s, hunk=s["hunk"] + 1, total=s["total"] + one, out=out, plus=s["plus"] + F.when(sign == "+", 1).otherwise(0), minus=s["minus"] + F.when(sign == "-", 1).otherwise(0)))
            .otherwise(s)
        )

    def whole(s: Column) -> Column:
        rest = F.when(s["total"] >= most, F.array(F.lit(f"... truncated ({most} lines shown)"))).otherwise(F.array().cast("array<string>"))
        return let(F.concat(closed(s), rest), lambda out: F.when(F.size(out) == 0, "No diff.").otherwise(_joined(out)))

    return F.aggregate(all_lines(text), start, add, whole)


def listing(text: Column) -> Column:
    """A long listing: folders, then files with their sizes, each by name, and how many there are by extension."""

    def size(before: Column) -> Column:
        n = F.try_element_at(F.filter(F.split(before, r"\s+"), lambda x: x.rlike(r"^\d+$")), F.lit(-1)).cast("double")
        return F.when(n.isNull(), "").when(n < 1024, F.format_string("%.0fB", n)).when(n < 1024 * 1024, F.format_string("%.1fK", n / 1024)).otherwise(F.format_string("%.1fM", n / 1048576))

    def parsed(line: Column) -> Column:
        name = F.btrim(F.regexp_replace(line, f"^.*?{LISTED}", ""))
        return F.struct(F.substring(line, 1, 1).alias("kind"), name.alias("name"), size(F.regexp_extract(line, f"^(.*?){LISTED}", 1)).alias("size"))

    def told(entries: Column) -> Column:
        dirs = F.array_sort(F.transform(F.filter(entries, lambda e: e["kind"] == "d"), lambda e: F.concat(e["name"], F.lit("/"))))
        files = F.array_sort(F.transform(F.filter(entries, lambda e: e["kind"] != "d"), lambda e: F.struct(e["name"].alias("name"), e["size"].alias("size"))))
        ends = F.transform(F.filter(entries, lambda e: ~e["kind"].isin("d", "l")), lambda e: F.regexp_extract(e["name"], r"(\.[^.]*)$", 1))
        top = F.transform(F.slice(counted(F.filter(ends, lambda x: (x != "") & (F.length(x) <= 6))), 1, 5), lambda c: F.format_string("%d %s", c["n"], c["v"]))
        shown = F.transform(files, lambda f: F.concat(F.lit("  "), f["name"], F.lit("  "), f["size"]))
        sums = F.concat(F.array(F.format_string("%d files", F.size(files)), F.format_string("%d dirs", F.size(dirs))), top)
        return _joined(F.concat(dirs, shown, F.array(F.concat(F.lit("Summary: "), F.array_join(sums, ", ")))))

    lines = F.filter(all_lines(text), lambda x: ~x.startswith("total ") & x.rlike(LISTED))
    entries = F.filter(F.transform(lines, parsed), lambda e: ~e["name"].isin("", ".", "..") & ~F.substring_index(e["name"], "/", 1).isin(NOISE_DIRS))
    return let(all_lines(text), lambda x: F.when(F.size(x) == 0, "(empty)").otherwise(let(entries, told)))


def status(text: Column, most: int = 10, untracked: int = 8) -> Column:
    """A short-form status: the branch, and conflicts, staged, modified and untracked files by name."""
    lines = F.filter(all_lines(text), lambda x: (F.length(x) >= 4) & ~x.startswith("## "))
    name = lambda x: F.btrim(F.substring(x, 4, 100_000))
    clash = r"^(?:U.|.U|AA|DD)"
    groups = [
        ("!! Conflicts", most, lambda x: x.rlike(clash)), ("+ Staged", most, lambda x: x.rlike(r"^[MADRC]") & ~x.rlike(clash)),
        ("~ Modified", most, lambda x: x.rlike(r"^[ MADRC][MD]") & ~x.rlike(clash)), ("? Untracked", untracked, lambda x: x.startswith("??")),
    ]

    def group(x: Column, title: str, n: int, rule) -> Column:  # noqa: ANN001
        def shown(f: Column) -> Column:
            head = F.array(F.format_string(f"{title}: %d files", F.size(f)))
            return F.when(F.size(f) == 0, F.array().cast("array<string>")).otherwise(F.concat(head, F.slice(f, 1, n), _plus(F.size(f) - n, "   ... +%d more")))

        return let(F.transform(F.filter(x, rule), lambda v: F.concat(F.lit("   "), name(v))), shown)

    def told(x: Column) -> Column:
        return F.concat(*[group(x, *g) for g in groups])

    branch = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^## (.*?)(?:\.\.\..*)?$", 1)
    head = F.when(branch != "", F.array(F.concat(F.lit("* "), branch))).otherwise(F.array().cast("array<string>"))
    return let(told(lines), lambda p: _joined(F.concat(head, F.when(F.size(p) == 0, F.array(F.lit("clean"))).otherwise(p))))


def lint(text: Column) -> Column:
    """A linter's JSON report: errors and warnings in how many files, and the five commonest rules; other outputs stay."""
    kind = "array<struct<errorCount:int,warningCount:int,messages:array<struct<ruleId:string>>>>"
    data = F.from_json(F.when(text.rlike(r"^\s*\["), text), kind)

    def told(d: Column) -> Column:
        n = lambda c: F.aggregate(d, F.lit(0), lambda s, x: s + F.coalesce(x[c], F.lit(0)))
        bad = F.size(F.filter(d, lambda x: F.coalesce(x["errorCount"], F.lit(0)) + F.coalesce(x["warningCount"], F.lit(0)) > 0))
        rules = F.flatten(F.transform(d, lambda x: F.transform(F.coalesce(x["messages"], F.array().cast("array<struct<ruleId:string>>")), lambda m: F.coalesce(m["ruleId"], F.lit("?")))))
        top = F.transform(F.slice(counted(rules), 1, 5), lambda c: F.format_string("  %s (%dx)", c["v"], c["n"]))
        shown = _joined(F.concat(F.array(F.format_string("ESLint: %d errors, %d warnings in %d files", n("errorCount"), n("warningCount"), bad)), F.when(F.size(top) > 0, F.concat(F.array(F.lit("Top rules:")), top)).otherwise(top)))
        return F.when(n("errorCount") + n("warningCount") == 0, "ESLint: clean").otherwise(shown)

    return let(data, lambda d: F.when(d.isNull(), text).otherwise(told(d)))


def above(limit: int, n: int, last: bool = False, without: str | None = None, end: str | None = None):  # noqa: ANN201
    """A way to cut outputs of over `limit` lines to the first n; shorter ones stay.

    With `last`, the last line is kept too; lines that match `without` go first; a last line that
    matches `end` doesn't count and is kept.
    """

    def way(text: Column) -> Column:
        lines = all_lines(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+\z", ""))
        if without:
            lines = F.filter(lines, lambda x: ~x.rlike(without))

        def cut(x: Column) -> Column:
            tail = F.when(F.try_element_at(F.concat(F.array(F.lit("")), x), F.lit(-1)).rlike(end), F.array(F.try_element_at(x, F.lit(-1)))).otherwise(F.array().cast("array<string>")) if end else F.array().cast("array<string>")
            return let(F.slice(x, 1, F.size(x) - F.size(tail)), lambda y: shown(x, y, tail))

        def shown(x: Column, y: Column, tail: Column) -> Column:
            kept = F.concat(F.slice(y, 1, n), _plus(F.size(y) - n, "... +%d more"), F.array(F.try_element_at(x, F.lit(-1))) if last else tail)
            return F.when(F.size(y) > limit, _joined(kept)).otherwise(_joined(x))

        return let(lines, cut)

    return way
