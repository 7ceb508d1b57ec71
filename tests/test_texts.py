"""Queries without SQL against brute force, and texts of every kind on small fixtures."""

import difflib
import json
import re

import pytest
from pyspark.sql import functions as F

from skarn import catalog
from skarn.functions import chunks, filters, text
from skarn.operators import changes, community, resolve, sessions, traverse
from skarn.plans import adapters
from skarn.sources import files

from .conftest import SMALL


def plain_compress(said, level):
    """The rules on one text, with numbered marks for protected spans."""
    kept = []

    def hide(m):
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    for pattern in text.PROTECTED:
        said = re.sub(pattern, hide, said)
    for step in text.replacements(level):
        if isinstance(step, list):
            said = " ".join(w for w in said.split() if w.lower().rstrip(".,;:!?") not in step)
        else:
            said = re.sub(*step, said)
    said = re.sub(" {2,}", " ", said).strip()
    while "\x00" in said:
        said = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], said)
    return said


@pytest.mark.parametrize("level", ["lite", "full", "ultra"])
def test_compressed_texts(spark, level):
    odd = [
        "Run `the database really` at https://x.io/the/configuration/a.py really.", "Sure, the fix:\n```python\nthe  database = 1\n```\nis basically  done because the request  failed.",
        "main.py::Really.just the 42 ms, 3.14 and 7%", "", "   ", "However, in order to win the\n\n\n\ngame, just ./the/path/a and such as that",
    ]
    said = [r[0] for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("text").where("text is not null").collect()] + odd
    got = [r[0] for r in spark.createDataFrame([(t,) for t in said], "t string").coalesce(1).select(text.compress(F.col("t"), level)).collect()]
    assert got == [plain_compress(t, level) for t in said]


def test_compress_fields(spark):
    row = spark.createDataFrame([({"name": "This is basically the name", "kind": "the kind", "path": "the"}, ["just short", "this is really a longer text"])], "m map<string,string>, l array<string>")
    got = row.select(text.compress_fields(F.col("m")), text.compress_list(F.col("l"))).first()
    assert got[0] == {"name": "This is name", "kind": "the kind", "path": "the"} and got[1] == ["just short", "this is longer text"]
    assert spark.createDataFrame([("Sure, the x",)], "t string").select(text.compress(F.col("t"), "off")).first()[0] == "Sure, the x"


def pack(parts, most):
    out = []
    for p in parts:
        if out and len(out[-1]) + len(p) + 2 <= most:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def test_paragraph_chunks(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(-1, "a\n\nb\n \nc" + "\n\n" + "x" * 50 + "\n\n\n\nd\n\n"), (-2, ""), (-3, None), (-4, "\n\n \n\n")], "doc_id long, text string")
    spread = docs.select("doc_id", F.regexp_replace("text", r"\. ", ".\n\n").alias("text")).unionByName(odd)
    for most in (20, 4096):
        got = sorted(map(tuple, catalog.sq.chunk_paragraphs(spread, most).collect()))
        want = []
        for r in spread.collect():
            parts = [p.strip() for p in re.split(r"\n\s*\n", r.text or "") if p.strip()]
            want += [(r.doc_id, k, c) for k, c in enumerate(pack(parts, most))]
        assert got == sorted(want)


def test_chunks_are_whole():
    plain = "\n".join(f"line {i}" for i in range(50))
    assert [t for t, _ in chunks.plain_chunks(plain)] == ["Lines 1", "Lines 2", "Lines 3"]
    assert chunks.plain_chunks(plain)[1][1].split("\n") == [f"line {i}" for i in range(18, 38)]
    long = "\n".join("y" * 100 for _ in range(20))
    assert "".join(c for _, c in chunks.plain_chunks(long, 500)).replace("\n", "")[: 20 * 100] == "y" * 2000
    parts = "\n\n".join(f"p{i} " + "z" * 30 for i in range(9))
    assert [c for _, c in chunks.plain_chunks(parts, 80)] == pack(parts.split("\n\n"), 80)
    marked = "intro\n# One\ntext\n```\n# not a heading\n```\n## Two\n" + "w\n\n" * 40 + "##### five signs are text"
    assert [t for t, _ in chunks.markdown_chunks(marked)] == ["Preamble", "One", "Two"]
    cut = chunks.markdown_chunks(marked, 60)
    assert all(len(c) <= 60 for _, c in cut) and "Two (part 2)" in [t for t, _ in cut]
    assert "".join("".join(c.split()) for _, c in cut) == "".join(marked.split())
    assert chunks.plain_chunks("  ") == chunks.markdown_chunks("\n") == []


def leaves(value):
    if isinstance(value, dict):
        return [x for v in value.values() for x in leaves(v)]
    return [x for v in value for x in leaves(v)] if isinstance(value, list) else [value]


def test_json_chunks():
    value = {"name": "n", "rows": [{"id": i, "v": "x" * (i % 7)} for i in range(30)], "deep": {"a": {"b": list(range(20))}}, "s": "t"}
    assert list(chunks.json_chunks(value, 10_000)) == [(" (n)", json.dumps(value))]
    got = list(chunks.json_chunks(value, 60))
    assert all(len(c) <= 60 + 20 for _, c in got)
    seen = [x for _, c in got for x in (leaves(json.loads(c)) if c[0] in "[{" else [c])]
    assert sorted(map(str, seen)) == sorted(map(str, leaves(value)))
    assert chunks.any_chunks("{bad json", 100) == [("Lines 1", "{bad json")]


@pytest.mark.parametrize("name,how,most", [("plain_chunks", chunks.plain_chunks, chunks.MOST), ("markdown_chunks", chunks.markdown_chunks, 600)])
def test_chunk_queries(spark, name, how, most):
    got = catalog.queries()[name](spark, SMALL).collect()
    from skarn.catalog_sources import _markdown

    docs = _markdown(spark, SMALL) if name == "markdown_chunks" else spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {(r.doc_id, k, *c) for r in docs.collect() for k, c in enumerate(how(r.text or "", most))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_memory_filled(spark):
    got = [(r.id, round(r.score, 6), r.source) for r in catalog.queries()["memory_filled"](spark, SMALL).collect()]
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{SMALL}/part.parquet").collect()}
    both = {k for k, v in names.items() if {"small", "widget"} <= set(v.split())}
    first = [k for k, _, s in got if s == 0]
    assert set(first) <= both and len(first) == min(5, len(both))
    ratio = {k: difflib.SequenceMatcher(None, "small widgets", v.lower()).ratio() for k, v in names.items() if k not in first}
    want = sorted(((k, r) for k, r in ratio.items() if r >= 0.6), key=lambda x: (-x[1], x[0]))[: 40 - len(first)]
    assert [(k, r) for k, r, s in got if s == 1] == [(k, round(r, 6)) for k, r in want]


def test_community_names(spark):
    got = {r.community: r.name for r in catalog.queries()["community_names"](spark, SMALL).collect()}
    members = adapters.nodes(spark, SMALL).where("community_id is not null").select("community_id", "name", "file_path").collect()
    for c in {r.community_id for r in members}:
        folders, words = {}, {}
        for r in (r for r in members if r.community_id == c):
            if "/" in r.file_path:
                f = re.sub("[^a-z0-9]+", "-", r.file_path.split("/")[-2].lower()).strip("-")[:30]
                folders[f] = folders.get(f, 0) + 1
            for w in re.split(r"[_\-.\s]+", re.sub("([a-z])([A-Z])", r"\1_\2", r.name)):
                if len(w) > 2 and w.lower() not in community.COMMON:
                    words[w.lower()] = words.get(w.lower(), 0) + 1
        best = [min(x, key=lambda k: (-x[k], k)) for x in (folders, words) if x]
        assert got[c] == "-".join(best)


def test_binary_files(spark):
    rows = [(b"P\x05\x00rest", True), (b"text P\x50\x05", False), (b"", False), (b"a" * 9000 + b"\x00", False), ("éĀ".encode(), False), (b"\x10\x01", False)]
    got = spark.createDataFrame([(bytearray(b), x) for b, x in rows], "c binary, want boolean").select(files.is_binary(F.col("c")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_long_path_and_betweenness(spark):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(30)], "source string, target string")
    assert traverse.shortest_path(chain, "n00", "n30").count() == 31
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d")], "source string, target string")
    every = spark.createDataFrame([(n,) for n in "abcdx"], "node string")
    assert {r.node: r.score for r in traverse.betweenness(line, every).collect()} == {"b": 1.0, "x": 1.0, "c": 3.0}


def test_breaking_changes_and_slices(spark):
    shape = "path string, symbol string, kind string, params array<string>, n_defaults int, returns string, bases array<string>"
    old = spark.createDataFrame([("p", "f", "function", ["a", "b"], 0, "int", None), ("p", "g", "function", ["a"], 0, None, None), ("p", "C", "class", [], 0, None, ["B"]), ("p", "C.m", "method", ["x"], 0, None, None)], shape)
    new = spark.createDataFrame([("p", "f", "function", ["a", "c"], 1, "str", None), ("p", "g", "function", ["a", "d"], 0, None, None), ("p", "C", "class", [], 0, None, ["B", "D"])], shape)
    got = {(r.symbol, r.change) for r in changes.breaking_changes(old, new).collect()}
    assert got == {("f", "removed_parameter"), ("f", "changed_signature"), ("g", "added_required_param"), ("C", "changed_bases"), ("C.m", "removed_method")}
    rows = spark.createDataFrame([("p", 1, "a", []), ("p", 2, "b", ["a"]), ("p", 3, "c", ["z"]), ("p", 4, "d", ["b", "d"]), ("p", 9, "a", ["c"])], "path string, line int, variable string, used array<string>")
    target = spark.createDataFrame([("p", 5, "d")], "path string, line int, variable string")
    assert sorted(r.line for r in changes.backward_slice(rows, target, traverse.settled).collect()) == [1, 2, 4]


def test_bare_calls_by_imports(spark):
    nodes = spark.createDataFrame([("Function", "f", "a.py::f", "a.py"), ("Function", "f", "b.py::f", "b.py"), ("Class", "g", "c.py::g", "c.py")], "kind string, name string, qualified_name string, file_path string")
    calls = spark.createDataFrame([(1, "m.py", "f"), (2, "n.py", "f"), (3, "m.py", "g"), (4, "m.py", "h")], "call_id int, file_path string, name string")
    imports = spark.createDataFrame([("m.py", "a.py"), ("n.py", "a.py"), ("n.py", "b.py")], "file_path string, imported string")
    assert {(r.call_id, r.target) for r in resolve.resolve_bare_calls(calls, nodes, imports).collect()} == {(1, "a.py::f"), (3, "c.py::g")}


def test_bare_calls_meet_files_and_not_each_node_of_their_name(spark):
    nodes = spark.range(3_000).selectExpr("'Function' as kind", "'f' as name", "concat('a.py::', id) as qualified_name", "'a.py' as file_path").unionByName(
        spark.createDataFrame([("Function", "f", "b.py::f", "b.py")], "kind string, name string, qualified_name string, file_path string")
    )
    calls = spark.range(3_000).selectExpr("id as call_id", "if(id = 7, 'n.py', 'm.py') as file_path", "'f' as name")
    imports = spark.createDataFrame([("m.py", "a.py"), ("n.py", "b.py")], "file_path string, imported string")
    made = resolve.resolve_bare_calls(calls, nodes, imports)
    assert [tuple(r) for r in made.collect()] == [(7, "f", "b.py::f")]
    plan = made._jdf.queryExecution().executedPlan()
    assert max(_rows_out(plan)) < 10_000  # 9,000,000 pairs before


def _rows_out(plan):
    """Rows out of each join of a plan that has run."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        yield from _rows_out(plan.executedPlan())
        return
    if plan.nodeName().endswith("QueryStage"):
        yield from _rows_out(plan.plan())
        return
    if "Join" in plan.nodeName():
        yield plan.metrics().apply("numOutputRows").value()
    for i in range(plan.children().size()):
        yield from _rows_out(plan.children().apply(i))


def test_shell_events(spark):
    rows = [(1, "git commit -m x", "[main abc1234f] fix the bug\n 1 file", "", 0), (2, "cat 'a b.txt'", "", "", 0), (3, "make", "", "boom", 2), (4, "git status", " M a\nA  b\n?? c\n?? d", "", 0)]
    got = sessions.shell_events(spark.createDataFrame(rows, "call_id int, command string, stdout string, stderr string, exit_code int")).collect()
    by = {(r.call_id, r.event_type): r.data for r in got}
    assert by[1, "git_commit"] == {"hash": "abc1234f", "message": "fix the bug", "command": "git commit -m x"}
    assert by[2, "file_read"] == {"file_path": "a b.txt"} and by[3, "error"]["stderr"] == "boom" and by[4, "git_status"]["untracked"] == "2"
    assert len([k for k in by if k[1] == "mcp_tool_use"]) == 4


def test_every_output_rule_is_chosen(spark):
    from skarn.catalog_outputs import COMMANDS

    assert sorted(COMMANDS) == sorted(r.name for r in filters.RULES)
    rows = spark.createDataFrame(list(COMMANDS.items()), "want string, command string")
    got = rows.select("want", filters.match_rule(F.concat(F.lit("X=1 "), "command")).alias("got")).collect()
    other = {r.want: r.got for r in got if r.got != r.want}
    # The first rule that matches counts: kubectl_get's own outputs are those of other kinds.
    assert not other
