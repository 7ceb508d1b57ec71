"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Method: bulk-synchronous best-fit.  Documents are cut into pieces, range-sorted by length and
ranked with per-partition counts, so that no length, however common, meets in one task.  Sorted
pieces and sorted gaps are then runs of equal sizes: at most `capacity` runs of pieces, and of
gaps no more than the packing has distinct histories.  Each superstep takes the longest waiting
run, sweeps to its successor gap (the smallest that holds it), settles conflicts by rank (the
lowest ranks win the gap run, the rest sweep on), updates the gaps and repeats.  Every piece finds
its place again from its rank, in parallel.  The runs, not the pieces, are what the driver sees,
and their number depends on the capacity and not on the corpus.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, shuffle_parts, written

CAPACITY, END_ID = 1024, 2
#: The byte-level pattern with possessive repeats: the same words, without backtracking.
POSSESSIVE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(tokenizer_json: str):
    """A function from a text to its ids (a numpy array) for a byte-level BPE tokenizer file.

    Where each merge's id follows the one before it, as in files of this kind, merging by id is
    merging by rank, and the faster ranked encoder gives the same ids; else the file's own
    library encodes.
    """
    from tokenizers import Tokenizer

    spec = json.loads(tokenizer_json)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    first = len(vocab) - len(merges) - sum(x["content"] in vocab for x in spec["added_tokens"])
    level = spec["pre_tokenizer"] or {}
    plain = level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not spec["normalizer"]
    if plain and first == 256 and all(vocab.get(a + b) == first + i for i, (a, b) in enumerate(pairs)):
        import tiktoken

        shown = byte_letters()
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(shown[c] for c in k): v for k, v in vocab.items() if k not in special}
        ranked = tiktoken.Encoding("ranked", pat_str=POSSESSIVE, mergeable_ranks=ranks, special_tokens={})
        return lambda text: ranked.encode_to_numpy(text, disallowed_special=())
    tokenizer = Tokenizer.from_str(tokenizer_json)
    tokenizer.encode_special_tokens = True
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies show each byte: itself if printable, else 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length and crc32 of its ids.

    Null and empty texts are the end id alone.  Documents over the capacity are cut so that all
    pieces but the first are full.  Whole texts are encoded; the tokenizer file is sent once.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(sent.value)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, PIECES)


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces per sequence, offset) of the packing.

    `counts` has the number of pieces by length.  A run's pieces, by rank, fill its sequences in
    turn; it ends where the next run of its length begins.  Supersteps: see the module.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    sizes: list[int] = []
    plan: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def leave(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, waiting = 0, counts[length]
        while waiting:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                gap, first, n = capacity, bins, -(-waiting // (capacity // length))
                bins += n
            else:
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            per = gap // length
            placed = min(waiting, per * n)
            full, rest = divmod(placed, per)
            plan.append((length, rank, first, per, capacity - gap))
            leave(gap - per * length, first, full)
            if rest:
                leave(gap - rest * length, first + full, 1)
            leave(gap, first + full + bool(rest), n - full - bool(rest))
            rank, waiting = rank + placed, waiting - placed
    return plan


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows that have a `length` from 1 to the capacity.

    Handles any number of rows of one length; ties go by the rows' other columns and then by
    place, so repeated rows each get a place of their own.  No rows in, no rows out.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c != "length"]
    ranked = durable(
        pieces.repartitionByRange(shuffle_parts(spark), "length", *names)
        .sortWithinPartitions("length")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ranked.withColumns({"_part": part, "_row": row})
    # At most one row for each range partition and length it holds: partitions + capacity rows.
    found = ranked.groupBy("_part", "length").agg(F.count("*").alias("n"), F.min("_row").alias("first")).collect()
    counts: dict[int, int] = defaultdict(int)
    bases = []
    for r in sorted(found, key=lambda r: (r["_part"], r["length"])):
        bases.append((r["_part"], r["length"], counts[r["length"]] - r["first"]))
        counts[r["length"]] += r["n"]
    runs = defaultdict(list)
    for length, *run in plan_best_fit(counts, capacity):
        runs[length].append(run)
    bases_df = spark.createDataFrame(bases, "_part long, length long, _base long")
    runs_df = spark.createDataFrame(
        list(runs.items()), "length long, _runs array<struct<rank:long,first:long,per:long,offset:long>>"
    )
    placed = (
        ranked.join(F.broadcast(bases_df), ["_part", "length"])
        .join(F.broadcast(runs_df), "length")
        .withColumn("_rank", F.col("_row") + F.col("_base"))
        .withColumn("_run", F.expr("element_at(filter(_runs, r -> r.rank <= _rank), -1)"))
        .withColumn("_in", F.col("_rank") - F.col("_run.rank"))
    )
    return placed.select(
        *pieces.columns,
        (F.col("_run.first") + F.expr("_in div _run.per")).alias("sequence_id"),
        (F.col("_run.offset") + F.col("_in") % F.col("_run.per") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents: pieces with their places.  Extra columns of `docs` are ignored."""
    return best_fit(durable(token_pieces(docs, tokenizer_path, capacity, end_id)), capacity)


# The same packing with pieces and gaps as tables, superstep by superstep.  See the README for why
# `pack_documents` sweeps over runs instead.

EVENTS = "kind int, id long, size long, units long, seq long, place long, part int"


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range partition's sweep from large to small: each piece takes the last gap seen, the smallest that holds it.

    Returns matched pieces (kind 2, seq the gap's), pieces without a gap (kind 1) with their place
    among them, and gaps with units left (kind 0) with the units above them on the stack.
    """
    stack: list[list[int]] = []
    rows: list[tuple] = []
    lone = part = 0
    for batch in batches:
        for kind, id_, size, units, part in zip(batch["kind"], batch["id"], batch["size"], batch["units"], batch["part"], strict=True):
            if kind == 0:
                stack.append([id_, units, size])
            elif stack:
                rows.append((2, id_, size, 1, stack[-1][0], 0, part))
                stack[-1][1] -= 1
                if not stack[-1][1]:
                    stack.pop()
            else:
                rows.append((1, id_, size, 1, -1, lone, part))
                lone += 1
    above = 0
    for id_, units, size in reversed(stack):
        rows.append((0, id_, size, units, id_, above, part))
        above += units
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])


def _settle_conflicts(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(part, from, to, gap part, unit) for lone pieces by rank: the nearest partition before with units left serves first.

    `counts` has (part, lone pieces, units left) in the order of the sweep: a row a partition.
    """
    open_: list[list[int]] = []
    out = []
    for part, lone, units in counts:
        at = 0
        while at < lone and open_:
            of, used, left = open_[-1]
            n = min(lone - at, left)
            out.append((part, at, at + n, of, used))
            open_[-1][1:] = [used + n, left - n]
            if left == n:
                open_.pop()
            at += n
        if units:
            open_.append([part, 0, units])
    return out


def best_fit_supersteps(pieces: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """`best_fit` with every piece and gap a row, and the number of supersteps it took.

    Pieces go by classes of length, the longest first.  A superstep range-sorts the class's waiting
    pieces with the gaps that may hold them, sweeps each range, settles what is left between ranges
    by rank, and updates the gaps; a gap serves as many pieces at once as surely fit.  When no gap
    holds a waiting piece, as many sequences are opened as their lengths need at least.
    """
    spark = pieces.sparkSession
    parts = shuffle_parts(spark)
    names = list(pieces.columns)
    all_ = written(pieces.withColumn("_at", F.monotonically_increasing_id()))
    bounds = [capacity // k for k in range(1, 9) if capacity // k > 0]
    while bounds[-1] > 1:
        bounds.append(bounds[-1] // 2)
    bounds = sorted({*bounds, 0}, reverse=True)
    gaps, placed, opened, steps = None, [], 0, 0
    for hi, lo in zip(bounds, bounds[1:], strict=False):
        waiting = all_.where((F.col("length") > lo) & (F.col("length") <= hi)).select(F.col("_at").alias("id"), F.col("length").cast("long").alias("size"))
        last = None
        while True:
            n, total = waiting.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            if not n:
                break
            steps, stuck, last = steps + 1, n == last, n
            usable = None if gaps is None else gaps.where(F.col("size") > lo)
            if usable is None or stuck or usable.isEmpty():
                fresh = max(-(-total // capacity), -(-n // (capacity // (lo + 1))))
                new = spark.range(opened, opened + fresh).select("id", F.lit(capacity).cast("long").alias("size"))
                gaps = written(new if gaps is None else gaps.unionByName(new))
                opened += fresh
                usable = gaps.where(F.col("size") > lo)
            units = F.greatest(F.lit(1), F.floor(F.col("size") / hi)).cast("long")
            events = usable.select(F.lit(0).alias("kind"), "id", "size", units.alias("units")).unionByName(waiting.select(F.lit(1).alias("kind"), "id", "size", F.lit(1).cast("long").alias("units")))
            order = [F.desc("size"), F.asc("kind"), F.asc("id")]
            dealt = events.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
            swept = written(dealt.mapInPandas(_sweep, EVENTS))
            found = swept.where("kind < 2").groupBy("part").agg(F.count_if(F.col("kind") == 1).alias("lone"), F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("units"))), F.lit(0)).alias("units"))
            served = _settle_conflicts(sorted(map(tuple, found.collect())))  # at most two rows a partition
            runs = spark.createDataFrame(served, "part int, first long, upto long, of int, unit long")
            lone = swept.where("kind = 1").join(F.broadcast(runs), "part").where("place >= first and place < upto")
            lone = lone.select("id", "size", "of", (F.col("place") - F.col("first") + F.col("unit")).alias("unit"))
            most = F.broadcast(runs.groupBy("of").agg(F.max(F.col("unit") + F.col("upto") - F.col("first")).alias("most")))
            left = swept.where("kind = 0").join(most, F.col("part") == F.col("of")).where("place < most")
            left = left.select("of", "seq", F.explode(F.sequence("place", F.least(F.col("place") + F.col("units"), F.col("most")) - 1)).alias("unit"))
            across = lone.join(left, ["of", "unit"]).select("id", "size", "seq")
            matched = written(swept.where("kind = 2").select("id", "size", "seq").unionByName(across))
            filled = matched.groupBy(F.col("seq").alias("id")).agg(F.sum("size").alias("used"))
            gaps = written(gaps.join(filled, "id", "left").select("id", (F.col("size") - F.coalesce("used", F.lit(0))).alias("size")).where("size > 0"))
            waiting = written(waiting.join(matched.select("id"), "id", "left_anti"))
            placed.append(matched.withColumn("step", F.lit(steps)))
    if not placed:
        empty = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
        return empty.where("false"), 0
    every = placed[0]
    for other in placed[1:]:
        every = every.unionByName(other)
    from pyspark.sql import Window

    before = F.sum("size").over(Window.partitionBy("seq").orderBy("step", F.desc("size"), "id").rowsBetween(Window.unboundedPreceding, -1))
    offsets = every.select(F.col("id").alias("_at"), F.col("seq").alias("sequence_id"), F.coalesce(before, F.lit(0)).cast("long").alias("offset"))
    return all_.join(offsets, "_at").select(*names, "sequence_id", "offset"), steps

