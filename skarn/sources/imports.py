"""Imports to files, and names through chains of re-exports, by equality joins and pointer jumping.

Nothing probes a file system: an import becomes the paths it may mean, in order of preference, and
one join on paths with the files at hand keeps the first that exists.  Re-exports are edges between
(file, name) pairs; what each pair can give is closed from the definitions upwards, so names that no
barrel leads to are never looked for, and each pair then points to the one it takes its name from.
Pointers are doubled until all stand still.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import Scratch
from ..operators.traverse import settled

# Languages of scripts, the extensions tried for them, and the names of their settings, in order.
SCRIPTS = ["javascript", "typescript", "tsx", "vue"]
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".vue"]
SETTINGS = ["tsconfig.json", "tsconfig.app.json"]


def folder(path: Column) -> Column:
    """What a path's last part stands in; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def normal(path: Column) -> Column:
    """A path without '.' and empty parts, in which each '..' takes the part before it away."""

    def step(parts: Column, x: Column) -> Column:
        up = F.when(F.size(parts) > 0, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
        return F.when(x.isin("", "."), parts).when(x == "..", up).otherwise(F.concat(parts, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """A folder and those above it, nearest first, down to the empty one."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(above, F.array(F.lit(""))))


def _under(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest))


def _suffixed(base: Column, end: str, append: bool) -> Column:
    """`base` with the suffix of its last part replaced, or (append) an existing one followed."""
    has = base.rlike(r"[^/.][^/]*\.[^/.]+$")
    changed = F.concat(base, F.lit(end)) if append else F.concat(F.regexp_replace(base, r"\.[^/.]+$", ""), F.lit(end))
    return F.when(has, changed).otherwise(F.concat(base, F.lit(end)))


def _probes(base: Column, append: bool) -> Column:
    """The file itself, with each extension, and as a folder's index."""
    every = lambda b: F.array(b, *[_suffixed(b, e, append) for e in EXTENSIONS], *[F.concat(b, F.lit(f"/index{e}")) for e in EXTENSIONS])
    return F.element_at(F.transform(F.array(base), every), 1)  # the base is made once


def effective_settings(configs: DataFrame) -> DataFrame:
    """(path, base_url, paths): settings with what they take over from those they extend.

    `configs` has (path, extends, base_url, paths): extends is a relative path or null, paths an array
    of (pattern, targets) or null.  The nearest in a chain counts, for each of the two on its own.
    Chains are halved each round; one that runs into itself has been seen whole after as many
    rounds as double the number of settings needs.
    """
    scratch = Scratch(configs.sparkSession)
    named = F.when(F.col("extends").startswith("."), normal(_under(folder(F.col("path")), F.col("extends"))))
    full = F.when(named.rlike(r"\.[^/.]+$"), named).otherwise(F.concat(named, F.lit(".json")))
    now = scratch.keep(configs.select("path", full.alias("next"), "base_url", "paths"))
    reach, n = 1, now.count()
    while reach <= n and not now.where("next is not null").isEmpty():
        over = now.select(F.col("path").alias("next"), F.col("next").alias("then"), F.col("base_url").alias("b"), F.col("paths").alias("p"))
        now = scratch.keep(now.join(over, "next", "left").select("path", F.col("then").alias("next"), F.coalesce("base_url", "b").alias("base_url"), F.coalesce("paths", "p").alias("paths")))
        reach *= 2
    return scratch.result(now.select("path", "base_url", "paths"))


def module_files(imports: DataFrame, files: DataFrame, configs: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """(file_path, module, target_file): the file that each import (file_path, language, module) means, where one exists.

    Python modules are looked for from the importer's folder upwards, as a file and then a package;
    scripts' relative ones from the importer's folder, as they are, with extensions, and as a
    folder's index; their other ones by the path patterns of the nearest settings (`configs`, as
    effective_settings gives them), longest fixed start first; shell ones from the importer's
    folder; `package:` ones in lib of the nearest of `packages` (folder, name) above.
    """
    # Far fewer than there are imports by name: found once, and kept for the ways below.
    wanted = settled(imports.select("file_path", "language", "module").distinct().withColumn("here", folder(F.col("file_path"))))
    local = _under(F.col("here"), F.col("module"))
    relative, script, dart = F.col("module").startswith("."), F.col("language").isin(SCRIPTS), F.col("language") == "dart"
    dotted = F.replace("module", F.lit("."), F.lit("/"))
    python = F.flatten(F.transform(ancestors(F.col("here")), lambda d: F.array(_under(d, F.concat(dotted, F.lit(".py"))), _under(d, F.concat(dotted, F.lit("/__init__.py"))))))
    tries = (
        F.when(F.col("language") == "python", python)
        .when(F.col("language") == "bash", F.array(normal(local)))
        .when(script & relative, _probes(normal(local), False))
        .when(dart & relative, F.array(normal(local), _suffixed(normal(local), ".dart", False)))
    )
    options = wanted.where(tries.isNotNull()).select("file_path", "module", F.posexplode(tries).alias("turn", "target_file"))
    if configs is not None:
        asked = wanted.where(script & ~relative)
        above = asked.select("here").distinct().select("here", F.posexplode(ancestors(F.col("here"))).alias("up", "dir"))
        names = F.create_map(*[F.lit(x) for k, name in enumerate(SETTINGS) for x in (name, k)])
        own = configs.select(folder(F.col("path")).alias("dir"), names[F.regexp_extract("path", "[^/]*$", 0)].alias("which"), "base_url", "paths").where("which is not null")
        # The nearest settings count even if they have no paths.
        nearest = above.join(own, "dir").groupBy("here").agg(F.min(F.struct("up", "which", "dir", "base_url", "paths")).alias("m"))
        rules = nearest.select("here", normal(_under(F.col("m.dir"), F.coalesce("m.base_url", F.lit(".")))).alias("base"), F.posexplode("m.paths").alias("at", "rule"))
        star = F.instr("rule.pattern", "*")
        start = F.when(star > 0, F.substring("rule.pattern", F.lit(1), star - 1)).otherwise(F.col("rule.pattern"))
        end = F.substring("rule.pattern", star + 1, F.length("rule.pattern"))
        met = asked.join(rules.select("here", "base", "at", "rule", star.alias("star"), start.alias("start"), end.alias("end")), "here")
        fits = F.when(F.col("star") == 0, F.col("module") == F.col("start")).otherwise(F.col("module").startswith(F.col("start")) & F.col("module").endswith(F.col("end")))
        inner = F.when(F.col("star") > 0, F.substring("module", F.length("start") + 1, F.length("module") - F.length("start") - F.length("end"))).otherwise("")
        hit = met.where(fits).select("file_path", "module", "base", "start", "at", inner.alias("inner"), F.posexplode("rule.targets").alias("k", "to"))
        put = F.when(F.instr("to", "*") > 0, F.concat(F.substring_index("to", "*", 1), F.col("inner"), F.substring("to", F.instr("to", "*") + 1, F.length("to")))).otherwise(F.col("to"))
        probed = hit.select("file_path", "module", "start", "at", "k", F.posexplode(_probes(normal(_under(F.col("base"), put)), True)).alias("p", "target_file"))
        found = probed.join(files.select(F.col("file_path").alias("target_file")).distinct(), "target_file")
        best = found.groupBy("file_path", "module").agg(F.min(F.struct((-F.length("start")).alias("s"), "at", "k", "p", "target_file")).alias("m"))
        options = options.unionByName(best.select("file_path", "module", F.lit(0).alias("turn"), F.col("m.target_file").alias("target_file")))
    if packages is not None:
        body = F.substring("module", len("package:") + 1, 100_000)
        asked = wanted.where(dart & F.col("module").startswith("package:")).withColumns({"name": F.substring_index(body, "/", 1), "sub": F.regexp_extract(body, "^[^/]*/(.+)$", 1)}).where("sub <> ''")
        above = asked.select("file_path", "module", "name", "sub", F.posexplode(ancestors(F.col("here"))).alias("up", "folder"))
        near = above.join(packages.select("folder", "name").distinct(), ["folder", "name"]).groupBy("file_path", "module", "sub").agg(F.min(F.struct("up", "folder")).alias("m"))
        options = options.unionByName(near.select("file_path", "module", F.lit(0).alias("turn"), normal(_under(F.col("m.folder"), F.concat(F.lit("lib/"), F.col("sub")))).alias("target_file")))
    there = options.join(files.select(F.col("file_path").alias("target_file")).distinct(), "target_file")
    first = there.groupBy("file_path", "module").agg(F.min(F.struct("turn", "target_file")).alias("m"))
    return first.select("file_path", "module", F.col("m.target_file").alias("target_file"))


def exported_names(definitions: DataFrame, exports: DataFrame) -> DataFrame:
    """(file_path, name, target_file, target_name): where each name that a file defines or passes on comes from.

    `definitions` has (file_path, name); `exports` (file_path, place, exported, original,
    target_file) in the order of `place`: exported '*' passes on all names of target_file, another
    one the name `original` of target_file, or the file's own where that is null.  A file's own
    definition counts first; then its exports in order, those of '*' where they lead to the name; a
    passed-on name that is defined nowhere ends at the last file that is named, as does one that a
    file renames without a target.  In a ring of
    exports a name comes from what the ring leads out to, nearest first, or else from where the
    ring was entered.
    """
    scratch = Scratch(definitions.sparkSession)
    keep = scratch.keep
    own = keep(definitions.select("file_path", "name").distinct())
    lines = keep(exports.select("file_path", "place", "exported", "original", "target_file"))
    stars = lines.where("exported = '*' and target_file is not null").select("file_path", "place", "target_file").distinct()
    named = lines.where("exported <> '*'")
    # What each file can give, with the number of '*' on the shortest way.
    frontier = keep(own.unionAll(named.select("file_path", F.col("exported").alias("name"))).distinct().withColumn("rank", F.lit(0)))
    known, rank = frontier, 0
    while not frontier.isEmpty():
        rank += 1
        up = stars.join(frontier.select(F.col("file_path").alias("target_file"), "name"), "target_file").select("file_path", "name").distinct()
        frontier = keep(up.join(known.select("file_path", "name"), ["file_path", "name"], "left_anti").withColumn("rank", F.lit(rank)))
        known = known.unionByName(frontier)
    known = keep(known)
    # Each pair's ways on: through stars to pairs that can give the name, and through its own named exports.
    by_star = stars.join(known.select(F.col("file_path").alias("target_file"), "name", F.col("rank").alias("child_rank")), "target_file")
    by_star = by_star.select("file_path", "name", "place", "target_file", F.col("name").alias("target_name"), "child_rank", F.lit(True).alias("star"), F.lit(False).alias("stop"))
    by_name = named.select("file_path", F.col("exported").alias("name"), "place", F.coalesce("target_file", "file_path").alias("target_file"), F.coalesce("original", "exported").alias("target_name"), F.lit(-1).alias("child_rank"), F.lit(False).alias("star"), F.col("target_file").isNull().alias("stop"))
    ways = by_star.unionByName(by_name).join(own, ["file_path", "name"], "left_anti").join(known, ["file_path", "name"])
    ways = keep(ways)
    pick = F.min(F.struct("place", "target_file", "target_name", "stop")).alias("m")
    to = lambda df: df.groupBy("file_path", "name").agg(pick).select("file_path", "name", "m.target_file", "m.target_name", "m.stop")
    still = own.select("file_path", "name", F.col("file_path").alias("target_file"), F.col("name").alias("target_name"), F.lit(False).alias("stop"))
    steps = keep(to(ways).unionByName(still))
    rings = keep(_ends(steps, keep).where("ring").select(F.col("target_file").alias("file_path"), F.col("target_name").alias("name")).distinct())
    if not rings.isEmpty():
        inside = ways.join(rings, ["file_path", "name"], "left_semi")
        out = inside.where("not star or child_rank < rank").join(rings.select(F.col("file_path").alias("target_file"), F.col("name").alias("target_name"), F.lit(True).alias("back")), ["target_file", "target_name"], "left")
        out = to(out.where("back is null or star"))
        stay = rings.join(out.select("file_path", "name"), ["file_path", "name"], "left_anti")
        stay = stay.select("file_path", "name", F.col("file_path").alias("target_file"), F.col("name").alias("target_name"), F.lit(False).alias("stop"))
        steps = keep(steps.join(rings, ["file_path", "name"], "left_anti").unionByName(out).unionByName(stay))
    return scratch.result(_ends(steps, keep).select("file_path", "name", "target_file", "target_name"))


def _ends(steps: DataFrame, keep) -> DataFrame:
    """Where following (file_path, name) -> (target_file, target_name) ends, and whether that is on a ring.

    Pointers are doubled until none moves or they reach past all pairs: what then is neither a pair
    that points to itself from the start, nor one that points nowhere, is on a ring.
    """
    ids = ["target_file", "target_name"]
    over = lambda df: df.select(F.col("file_path").alias("at_file"), F.col("name").alias("at_name"), F.col("target_file").alias("f"), F.col("target_name").alias("n"), F.col("stop").alias("s"))
    on = ~F.col("stop") & (F.col("target_file") == F.col("at_file")) & (F.col("target_name") == F.col("at_name"))
    now, reach, n = steps, 1, steps.count()
    while reach <= n:
        moved = (F.col("f") != F.col("target_file")) | (F.col("n") != F.col("target_name")) | F.col("s")
        now = keep(
            now.join(over(now), on, "left").select(
                "file_path", "name", F.coalesce("f", "target_file").alias("target_file"), F.coalesce("n", "target_name").alias("target_name"), F.coalesce("s", "stop").alias("stop"), moved.alias("moved")
            )
        )
        if now.where("moved").isEmpty():
            break
        reach *= 2
    going = over(steps).where("s or f <> at_file or n <> at_name").select("at_file", "at_name", F.lit(True).alias("going"))
    return now.join(going, on, "left").select("file_path", "name", *ids, F.coalesce("going", F.lit(False)).alias("ring"))


def call_targets(calls: DataFrame, definitions: DataFrame, imports: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """(file_path, name, target, how): what each call (file_path, name) means.

    A name defined in the file is that; one that an import (file_path, name, module) brings is what
    the module's file (`files`: file_path, module, target_file) takes it from (`names`, as
    exported_names gives them), or else the name in that file; any other stays as it is.
    """
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("string").alias("module_file")
    brought = imports.join(files, ["file_path", "module"]).select("file_path", "name", no.alias("called"), no.alias("own"), F.col("target_file").alias("module_file"))
    own = definitions.select("file_path", "name", no.alias("called"), yes.alias("own"), none)
    # What is known of a name in a file meets in one aggregation; nulls equal nothing.
    known = brought.unionByName(own).where("file_path is not null and name is not null")
    every = calls.select("file_path", "name", yes.alias("called"), no.alias("own"), none).unionByName(known)
    met = every.groupBy("file_path", "name").agg(F.max("called").alias("called"), F.max("own").alias("own"), F.min("module_file").alias("module_file")).where("called")
    given = names.select(F.col("file_path").alias("module_file"), "name", F.concat_ws("::", "target_file", "target_name").alias("given"))
    met = met.join(given, ["module_file", "name"], "left")
    how = F.when(F.col("own"), "own").when(F.col("given").isNotNull(), "export").when(F.col("module_file").isNotNull(), "module").otherwise("bare")
    target = F.when(F.col("own"), F.concat_ws("::", "file_path", "name")).otherwise(F.coalesce("given", F.when(F.col("module_file").isNotNull(), F.concat_ws("::", "module_file", "name")), "name"))
    return met.select("file_path", "name", target.alias("target"), how.alias("how"))
