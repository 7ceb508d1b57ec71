"""Calls through variables on a source written out by hand, and flows from all entry points."""

from skarn.operators import receivers, traverse

SOURCE = """conn: Conn = make()
other = Thing()
def top(a: Conn, b: "pkg.Sub"):
    a.send()
    b.send()
    b.own()
    a = Thing()
    a.send()
    a.run(b.missing())
    self.run()
    late.run()
    late = Thing()
    conn.send()
    def inner():
        other.run()
        a.run()
        other = 3
    x.y.run()
    unknown = compute()
    unknown.run()
class Thing:
    field = Conn()
    def run(self):
        field.send()
        strange.nothing()
        weird: Alien = 1
        weird.run()
other.run()
async def last(q: Conn = None) -> Thing:
    q.close()
    z = await mod.Thing(q)
    z.run()"""
SCOPES = [
    ("m", "File", 0, 10_000, None), ("m::top", "Function", 3, 20, "m"), ("m::top.inner", "Function", 14, 17, "m::top"), ("m::Thing", "Class", 21, 27, "m"), ("m::Thing.run", "Function", 23, 27, "m::Thing"), ("m::last", "Function", 29, 32, "m"),
]
WANT = {
    (4, "a", "send"): ("m::top", "Conn.send", "new"), (5, "b", "send"): ("m::top", "Conn.send", "new"), (6, "b", "own"): ("m::top", "Sub.own", "known"), (8, "a", "send"): ("m::top", None, "member"),
    (9, "a", "run"): ("m::top", "Thing.run", "new"), (9, "b", "missing"): ("m::top", None, "method"), (11, "late", "run"): ("m::top", None, "receiver"), (13, "conn", "send"): ("m::top", "Conn.send", "new"),
    (15, "other", "run"): ("m::top.inner", None, "receiver"), (16, "a", "run"): ("m::top.inner", "Thing.run", "new"), (20, "unknown", "run"): ("m::top", None, "type"),
    (24, "field", "send"): ("m::Thing.run", None, "receiver"), (25, "strange", "nothing"): ("m::Thing.run", None, "method"), (27, "weird", "run"): ("m::Thing.run", None, "type"),
    (28, "other", "run"): ("m", "Thing.run", "new"), (30, "q", "close"): ("m::last", "Base.close", "new"), (31, "mod", "Thing"): ("m::last", None, "method"), (32, "z", "run"): ("m::last", "Thing.run", "new"),
}


def test_receivers(spark):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    lines = made([("f.py", k, t) for k, t in enumerate(SOURCE.split("\n"), 1)], "file_path string, line int, text string")
    scopes = made([(q, "f.py", k, a, b, p) for q, k, a, b, p in SCOPES], "qualified_name string, file_path string, kind string, line_start int, line_end int, parent string")
    types = made([("f.py", "Conn", "Conn"), ("f.py", "Sub", "Sub"), ("f.py", "Thing", "Thing")], "file_path string, name string, class string")
    bases = made([("Sub", "Conn", 0), ("Conn", "Base", 0), ("Base", "Sub", 0)], "class string, base string, place int")
    methods = made([("Conn", "send", "Conn.send"), ("Base", "send", "Base.send"), ("Sub", "own", "Sub.own"), ("Thing", "run", "Thing.run"), ("Base", "close", "Base.close")], "class string, method string, target string")
    known = made([("m::top", 6)], "source string, line int")
    got = {(r.line, r.receiver, r.method): (r.source, r.target, r.outcome) for r in receivers.resolve_receivers(lines, scopes, types, bases, methods, known).collect()}
    assert got == WANT


def test_flows_start_at_every_entry_point(spark):
    nodes = spark.createDataFrame(
        [("r", "Function", "route", "@app.route('/')"), ("m", "Function", "main", ""), ("h", "Function", "helper", ""), ("u", "Function", "uncalled", "")], "qualified_name string, kind string, name string, decorators string"
    ).selectExpr("*", "'a.py' AS file_path", "false AS is_test")
    edges = spark.createDataFrame([("CALLS", "u", "r"), ("CALLS", "r", "h"), ("CALLS", "h", "m"), ("CALLS", "m", "r")], "kind string, source string, target string")
    entries = {r.entry for r in traverse.flows(nodes, edges).collect()}
    assert entries == {"r", "m", "u"}


def test_methods_are_settled_once_a_class(spark, monkeypatch):
    kept = []
    keep = receivers.Scratch.keep
    monkeypatch.setattr(receivers.Scratch, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    lines = spark.createDataFrame([("a.py", 2, "x = A()"), ("a.py", 3, "x.m(); x.n()"), ("a.py", 4, "x.own()"), ("a.py", 5, "y = Alone()"), ("a.py", 6, "y.m()")], "file_path string, line int, text string")
    scopes = spark.createDataFrame([("a.py", "a.py", "File", 0, 99, None)], "qualified_name string, file_path string, kind string, line_start int, line_end int, parent string")
    types = spark.createDataFrame([("a.py", "A", "A"), ("a.py", "Alone", "Alone")], "file_path string, name string, class string")
    bases = spark.createDataFrame([("A", "B"), ("B", "C")], "class string, base string")
    methods = spark.createDataFrame([("B", "m", "B.m"), ("C", "m", "C.m"), ("C", "n", "C.n"), ("A", "own", "A.own"), ("Alone", "m", "Alone.m")], "class string, method string, target string")
    known = spark.createDataFrame([], "source string, line int")
    out = receivers.resolve_receivers(lines, scopes, types, bases, methods, known).collect()
    assert {(r.line, r.method, r.target, r.outcome) for r in out} == {(3, "m", "B.m", "new"), (3, "n", "C.n", "new"), (4, "own", "A.own", "new"), (6, "m", "Alone.m", "new")}
    assert [df for df in kept if df.columns == ["class", "method", "target"]]
