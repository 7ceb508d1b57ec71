"""Imports, settings and re-exports against loops over a set of files."""

import posixpath
import random

from skarn.sources import imports

FILES = [
    "app/main.py", "app/util.py", "lib/pkg/__init__.py", "lib/pkg/mod.py", "util.py", "web/index.ts", "web/a.ts", "web/b/index.tsx", "web/c.service.ts", "web/c.ts", "web/d.js",
    "web/deep/x/y.vue", "shared/core/one.ts", "shared/core/two/index.js", "shared/ui.button.tsx", "bin/run.sh", "bin/lib.sh", "dart/lib/src/w.dart", "dart/app.dart", "dart/lib/v.dart",
]
IMPORTS = [
    ("app/main.py", "python", "util"), ("app/main.py", "python", "lib.pkg"), ("app/main.py", "python", "lib.pkg.mod"), ("app/main.py", "python", "os.path"), ("lib/pkg/mod.py", "python", "util"),
    ("web/index.ts", "typescript", "./a"), ("web/index.ts", "typescript", "./b"), ("web/index.ts", "typescript", "./c.service"), ("web/index.ts", "typescript", "./d.js"), ("web/index.ts", "typescript", "."),
    ("web/deep/x/y.vue", "vue", "../../a"), ("web/deep/x/y.vue", "vue", "../..//./b"), ("web/deep/x/y.vue", "vue", "./none"), ("web/deep/x/y.vue", "vue", "../../../../../util"),
    ("web/index.ts", "typescript", "@core/one"), ("web/index.ts", "typescript", "@core/two"), ("web/deep/x/y.vue", "vue", "@core/one"), ("web/index.ts", "typescript", "@ui"), ("web/index.ts", "typescript", "ui.button"),
    ("web/index.ts", "typescript", "@core/none"), ("app/main.py", "typescript", "@core/one"), ("bin/run.sh", "bash", "./lib.sh"), ("bin/run.sh", "bash", "lib.sh"), ("bin/run.sh", "bash", "none.sh"),
    ("dart/app.dart", "dart", "./lib/v"), ("dart/app.dart", "dart", "package:mine/src/w.dart"), ("dart/lib/src/w.dart", "dart", "package:mine/v.dart"), ("dart/app.dart", "dart", "package:other/v.dart"), ("dart/app.dart", "dart", "dart:core"),
]
CONFIGS = [
    ("web/tsconfig.json", "./base", None, None),
    ("web/base.json", "../root.json", None, [("@core/*", ["none/*", "core/*"]), ("@c*", ["core/two"]), ("*", ["*"])]),
    ("root.json", "web/tsconfig", "../shared", [("@ui", ["wrong"])]),
    ("web/deep/tsconfig.app.json", None, "../../shared/core", [("@core/*", ["*"])]),
]
ENDS = [".ts", ".tsx", ".js", ".jsx", ".vue"]


def suffix(path, end, append):
    head, ext = posixpath.splitext(path)
    return (path if append and ext else head) + end


def probe(base, append):
    for x in [base, *(suffix(base, e, append) for e in ENDS), *(f"{base}/index{e}" for e in ENDS)]:
        if x in FILES:
            return x
    return None


def chain(path):
    """Own and extended settings, nearest first."""
    by, seen = {c[0]: c for c in CONFIGS}, []
    while path in by and path not in seen:
        seen.append(path)
        ext = by[path][1]
        if not ext or not ext.startswith("."):
            break
        path = posixpath.normpath(posixpath.join(posixpath.dirname(path), ext))
        path = path if posixpath.splitext(path)[1] else path + ".json"
    return [by[x] for x in seen]


def up(here):
    while True:
        yield here
        if not here:
            return
        here = posixpath.dirname(here)


def clean(path):
    out = []
    for x in path.split("/"):
        if x == "..":
            out = out[:-1]
        elif x not in ("", "."):
            out.append(x)
    return "/".join(out)


def meant(path, language, module):
    here = posixpath.dirname(path)
    if language == "python":
        rest = module.replace(".", "/")
        return next((t for d in up(here) for t in (posixpath.join(d, rest + ".py"), posixpath.join(d, rest + "/__init__.py")) if t in FILES), None)
    local = clean(posixpath.join(here, module))
    if language == "bash":
        return local if local in FILES else None
    if language == "dart":
        if module.startswith("package:"):
            name, _, sub = module[8:].partition("/")
            return next((f for f in [f"dart/lib/{sub}"] if name == "mine" and f in FILES and "dart" in up(here)), None)
        return next((x for x in (local, suffix(local, ".dart", False)) if x in FILES), None) if module.startswith(".") else None
    if module.startswith("."):
        return probe(local, False)
    for d in up(here):
        for name in ("tsconfig.json", "tsconfig.app.json"):
            p = posixpath.join(d, name)
            if p in {c[0] for c in CONFIGS}:
                found = chain(p)
                base = next((c[2] for c in found if c[2] is not None), ".")
                paths = next((c[3] for c in found if c[3] is not None), [])
                for pattern, targets in sorted(paths, key=lambda x: -len(x[0].partition("*")[0])):
                    start, star, end = pattern.partition("*")
                    if module.startswith(start) and module.endswith(end) if star else module == pattern:
                        inner = module[len(start) : len(module) - len(end)]
                        for t in targets:
                            hit = probe(clean(posixpath.join(d, base, t.replace("*", inner, 1))), True)
                            if hit:
                                return hit
                return None
    return None


def test_modules(spark):
    files = spark.createDataFrame([(f,) for f in FILES], "file_path string")
    asked = spark.createDataFrame(IMPORTS * 2, "file_path string, language string, module string")
    settings = imports.effective_settings(spark.createDataFrame(CONFIGS, "path string, extends string, base_url string, paths array<struct<pattern:string,targets:array<string>>>"))
    packages = spark.createDataFrame([("dart", "mine"), ("elsewhere", "other")], "folder string, name string")
    got = {(r.file_path, r.module): r.target_file for r in imports.module_files(asked, files, settings, packages).collect()}
    want = {(p, m): t for p, g, m in IMPORTS if (t := meant(p, g, m)) is not None}
    assert got == want and len(want) > 18


def resolved(own, lines, path, name, seen=None):
    """Depth-first, as a reader would follow the exports."""
    seen = set() if seen is None else seen
    if (path, name) in seen:
        return None
    seen.add((path, name))
    if (path, name) in own:
        return path, name
    for _, exported, original, target in sorted(lines.get(path, [])):
        if exported == name:
            return (target and resolved(own, lines, target, original, seen)) or (target or path, original)
        if exported == "*" and target and (hit := resolved(own, lines, target, name, seen)):
            return hit
    return None


def random_exports(rng, rings):
    own = {(f"f{rng.randrange(12)}", rng.choice("abcd")) for _ in range(10)}
    lines = {}
    for f in range(12):
        for place in range(rng.randint(0, 4)):
            target = rng.randrange(12) if rings else rng.randrange(f + 1, 13)
            target = f"f{target}" if target != f and rng.random() < 0.9 else None
            if rng.random() < 0.5:
                lines.setdefault(f"f{f}", []).append((place, "*", None, target))
            else:
                lines.setdefault(f"f{f}", []).append((place, rng.choice("abcd"), rng.choice("abcd"), target))
    return own, lines


def solve(spark, own, lines):
    defs = spark.createDataFrame(sorted(own), "file_path string, name string")
    rows = [(f, p, e, o or e, t) for f, xs in lines.items() for p, e, o, t in xs]
    frame = spark.createDataFrame(rows, "file_path string, place int, exported string, original string, target_file string")
    return {(r.file_path, r.name): (r.target_file, r.target_name) for r in imports.exported_names(defs, frame).collect()}


def test_reexports_equal_a_walk(spark):
    for seed in range(5):
        own, lines = random_exports(random.Random(seed), rings=False)
        want = {(f"f{f}", n): hit for f in range(13) for n in "abcd" if (hit := resolved(own, lines, f"f{f}", n))}
        assert solve(spark, own, lines) == want, seed


def test_rings_end(spark):
    """Names in rings of exports come from outside the ring, or else from where it was entered."""
    own = {("d", "x"), ("far", "y")}
    lines = {
        "a": [(0, "*", None, "b")], "b": [(0, "*", None, "a"), (1, "*", None, "d")], "d": [(0, "*", None, "far")],
        "p": [(0, "z", "z", "q")], "q": [(0, "z", "z", "r")], "r": [(0, "z", "z", "q")], "s": [(0, "w", "w", "s")],
    }
    got = solve(spark, own, lines)
    assert got["a", "x"] == got["b", "x"] == ("d", "x") and got["a", "y"] == ("far", "y")
    assert got["q", "z"] == ("q", "z") and got["r", "z"] == ("r", "z") and got["p", "z"] in {("q", "z"), ("r", "z")}
    assert got["s", "w"] == ("s", "w")
    for seed in range(2):
        own, lines = random_exports(random.Random(100 + seed), rings=True)
        found = solve(spark, own, lines)
        reach = {(f"f{f}", n) for f in range(13) for n in "abcd" if resolved(own, lines, f"f{f}", n)}
        assert set(found) == reach and all(found[x] == x for x in own)


def test_long_chains(spark):
    own, n = {("f40", "x")}, 40
    lines = {f"f{k}": [(0, "*" if k % 2 else "x", "x", f"f{k + 1}")] for k in range(n)}
    assert set(solve(spark, own, lines).values()) == {("f40", "x")}


def test_call_targets(spark):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    calls = made([("m", "own"), ("m", "x"), ("m", "y"), ("m", "z"), ("m", "x")], "file_path string, name string")
    defs = made([("m", "own"), ("d", "x")], "file_path string, name string")
    brought = made([("m", "x", "./i"), ("m", "own", "./i"), ("m", "y", "./i"), ("m", "z", "gone")], "file_path string, name string, module string")
    files = made([("m", "./i", "i")], "file_path string, module string, target_file string")
    names = made([("i", "x", "d", "x")], "file_path string, name string, target_file string, target_name string")
    got = {r.name: (r.target, r.how) for r in imports.call_targets(calls, defs, brought, files, names).collect()}
    assert got == {"own": ("m::own", "own"), "x": ("d::x", "export"), "y": ("i::y", "module"), "z": ("z", "bare")}
