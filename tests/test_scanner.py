"""Blanked texts and modules against loops over characters."""

import random
import re

from pyspark.sql import functions as F

from skarn.sources import scanner


def plain_blanked(text):
    out, i, n = [], 0, len(text)
    gap = lambda c: "\n" if c == "\n" else " "
    while i < n:
        two = text[i : i + 2]
        if two == "//":
            while i < n and text[i] != "\n":
                out.append(" ")
                i += 1
        elif two == "/*":
            depth, i = 1, i + 2
            out.append("  ")
            while i < n and depth:
                two = text[i : i + 2]
                if two in ("/*", "*/"):
                    depth += 1 if two == "/*" else -1
                    out.append("  ")
                    i += 2
                else:
                    out.append(gap(text[i]))
                    i += 1
        elif text[i] in "\"`":
            sign = text[i]
            out.append(sign)
            i += 1
            while i < n and text[i] != sign:
                # An escape at a line's end keeps the line.
                if sign == '"' and text[i] == "\\" and i + 1 < n and text[i + 1] != "\n":
                    out.append("  ")
                    i += 2
                    continue
                out.append(gap(text[i]))
                i += 1
            if i < n:
                out.append(sign)
                i += 1
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def plain_modules(path, text):
    clean = plain_blanked(text)
    line = lambda at: clean.count("\n", 0, at) + 1
    found = []
    for m in re.finditer(r"(?m)^[ \t]*module\s+(?:type\s+)?([A-Z][\w']*)\s*[:=]", clean):
        if re.match(r"(?m)^[ \t]*module\s+[A-Z][\w']*\s*=\s*[A-Z][\w']*(?:\.[A-Za-z_][\w']*)*\s*$", clean[m.start() :]):
            continue
        at = clean.find("{", m.end())
        if at < 0 or re.search(r"(?:^|\s)(?:let|type|module|external|and)\s", clean[m.end() : at]):
            continue
        depth, j = 1, at + 1
        while j < len(clean) and depth:
            depth += {"{": 1, "}": -1}.get(clean[j], 0)
            j += 1
        found.append((m.group(1), m.start(), j - 1 if not depth else len(clean), line(m.start()), line(j - 1) if not depth else clean.count("\n") + 1))
    out = []
    for name, a, b, first, last in found:
        around = [(x, o) for o, x, y, _, _ in found if x < a and (y > b or y == b == len(clean))]
        out.append((path, name, first, last, max(around)[1] if around else None))
    return out


FIXED = '''module A = {
  // } not this
  let s = "}" /* } /* } */ } */
  module B: {
    type t
  } = {
    let t = `}
}`
    module type C = { let x: int }
  }
}
module Alias = Foo.Bar
let after = { 1 }
module Alias2 = Foo.Bar
module D =
{
  let q = "\\\\"
  let r = "\\"}"
}
module External = Make(X)
let z = {1}
module Open = {
  module Inner = { let a = {1} }
  let b = {
'''


def test_blanked_equals_a_loop(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices('/*"`\\\nab {}', weights=[4, 4, 2, 1, 2, 2, 3, 1, 1, 1, 1], k=rng.randint(0, 80))) for _ in range(600)] + [FIXED, "", "/", "x" * 5000 + "/* " + "y" * 5000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scanner.blanked(F.col("t")).alias("b")).collect()
    assert [(r.t, r.b) for r in got if r.b != plain_blanked(r.t)] == []
    assert all(len(r.b) == len(r.t) and r.b.count("\n") == r.t.count("\n") for r in got)


def nested(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 3)):
        name = rng.choice("ABCDE")
        body = nested(rng, depth + 1) if depth < 4 and rng.random() < 0.6 else f"let v = {{ {rng.randint(1, 9)} }}\n"
        noise = rng.choice(["", "// }\n", '/* { */\n', 'let s = "{"\n', "let t = `}`\n", "module Al = Foo.Bar\n"])
        out.append(f"{noise}module {name} = {{\n{body}}}\n")
    return "".join(out)


def test_modules_equal_a_loop(spark):
    rng = random.Random(4)
    files = [("fixed.res", FIXED), ("empty.res", ""), *[(f"{k}.res", nested(rng)) for k in range(40)]]
    rows = spark.createDataFrame([*files, ("null.res", None)], "file_path string, text string").repartition(4)
    want = sorted((m for path, text in files for m in plain_modules(path, text)), key=str)
    got = sorted(map(tuple, scanner.modules(rows).collect()), key=str)
    assert got == want and len(want) > 150
    assert {(m[1], m[4]) for m in want if m[0] == "fixed.res"} == {("A", None), ("B", "A"), ("C", "A"), ("D", None), ("Open", None), ("Inner", "Open")}
