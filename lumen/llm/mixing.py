"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, power_of_two, stage

#: Words of one document are taken at most this many times.
MOST = 3
#: Blocks that the smallest target of an uncapped source has at least, so that rounding cannot move it far.
LEAST_BLOCKS = 64
#: Blocks, and rows of a source in a shard, that may be broadcast; more are joined by source and shard.
BROADCAST_BLOCKS = 400_000
PICKED = pa.schema([("o_src", pa.string()), ("o_shard", pa.int32()), ("o_start", pa.int64()), ("o_first", pa.int64()), ("o_times", pa.list_(pa.int32()))])


def targets(sizes: dict, weights: list[float], most: float = MOST) -> dict:
    """Words to take from each source: the total by weight, at most `most` times a source's own size; what exceeds
    that is shared again by weight among the others until none is above."""
    w, got, free = dict(zip(sizes, weights, strict=True)), {}, float(sum(sizes.values()))
    open_ = list(sizes)
    while open_:
        unit = free / sum(w[s] for s in open_)
        over = [s for s in open_ if unit * w[s] > most * sizes[s]]
        if not over:
            return got | {s: unit * w[s] for s in open_}
        for s in over:
            got[s] = float(most * sizes[s])
            free -= got[s]
        open_ = [s for s in open_ if s not in got]
    return got


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 * seats so far + 1), never more than most; ties go to the earlier."""
    total = sum(votes)
    # Rounding adds at most half a seat a party, which bounds the divisor: so many seats are sure, the rest is dealt
    # one by one.
    sure = max(0.0, seats - len(votes) / 2) / total if total else 0.0
    got = [min(m, max(0, int(v * sure - 0.5))) for v, m in zip(votes, most, strict=True)]
    heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most, strict=True)) if v > 0 and g < m]
    heapq.heapify(heap)
    left = seats - sum(got)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def mix_sources(docs: DataFrame, weights=(1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, max_blocks: int = 1 << 16, rows_per_shard: int = 4000) -> DataFrame:
    """How many words of each document a mix takes whose sources have target weights.

    The words of a source, in a seeded order of its documents, are cut into blocks of equal word count; blocks are
    allocated to sources by highest quotient, a source's blocks to its shards likewise, and within a shard a seeded
    draw picks which blocks are taken once more than the others. A document's part is the overlap of its words with
    the blocks taken, repeats counted. Prefix sums run per shard (a hash range of ids) and source, so that a source
    with a third of all rows stays spread.

    Blocks are small enough for LEAST_BLOCKS of them in the smallest uncapped target, so their number grows with that
    of sources. The driver holds one row per (source, shard), at most 1,048,576 or one per source if those are more, and
    arrays of at most max_blocks blocks, or LEAST_BLOCKS for each unit of the sources' weights if that is more. Each
    shard of a source gets its own blocks, as one row: broadcast if they are few, else joined.

    Null text has size 0 and takes 0; a null source is a source of its own, last in order. Repeated ids are separate
    rows; very long texts are cut by blocks as others are. Sources without words have target 0. An empty table gives an empty result. Other columns play no part.

    Returns id, size, source, source_size, target, taken, and copies: how often the block with the document's middle
    word is taken, for mixes of whole documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = stage(rows.withColumn("h", F.xxhash64("id", F.lit(seed))), "sizes")
    n, sources = rows.agg(F.count("*"), F.count_distinct(F.coalesce("src", F.lit("")), F.col("src").isNull())).first()
    shards = power_of_two(n / rows_per_shard, 16, power_of_two((1 << 20) / max(1, sources), 16, 8192))
    rows = rows.withColumn("shard", F.shiftrightunsigned("h", 64 - (shards.bit_length() - 1)).cast("int"))
    parts = [(x["src"], x["shard"], x["n"]) for x in rows.groupBy("src", "shard").agg(F.sum("size").alias("n")).collect()]
    sizes: dict = {}
    for src, _, n in parts:
        sizes[src] = sizes.get(src, 0) + n
    sizes = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))}
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))]) if sizes else {}
    uncapped = [goal[s] for s in sizes if 0 < goal[s] < MOST * sizes[s]]
    block = max(16, -(-sum(sizes.values()) // max_blocks))
    if uncapped:
        block = max(1, min(block, int(min(uncapped) // LEAST_BLOCKS)))
    count = {s: -(-n // block) for s, n in sizes.items()}
    quota = dict(zip(sizes, sainte_lague([goal[s] / block for s in sizes], round(sum(goal.values()) / block), [MOST * count[s] for s in sizes]), strict=True)) if sizes else {}
    for s in sizes:  # a target at the cap is the whole source, its short last block included
        if goal[s] >= MOST * sizes[s]:
            quota[s] = MOST * count[s]
    by_source: dict = {}
    for src, shard, n in sorted(parts, key=lambda x: x[1]):
        by_source.setdefault(src, []).append((shard, n))
    picked, blocks = [], 0
    for s, own in by_source.items():
        start, begin = 0, []
        for _, n in own:
            begin.append(-(-start // block))  # the first block that begins in this shard
            start += n
        own_blocks = [b - a for a, b in zip(begin, [*begin[1:], count[s]], strict=True)]
        times = np.zeros(count[s] + 1, "int32")
        for (shard, _), a, k, q in zip(own, begin, own_blocks, sainte_lague([float(k) for k in own_blocks], quota[s], [MOST * k for k in own_blocks]), strict=True):
            if k:
                times[a : a + k] = q // k
                times[random.Random(f"{seed}/{s!r}/{shard}").sample(range(a, a + k), q % k)] += 1
        start = 0
        for shard, n in own:  # the blocks that the shard's words lie in
            first, last = start // block, (start + n) // block
            picked.append((s, shard, start, first, times[first : last + 1]))
            blocks += last + 1 - first
            start += n
    columns = list(zip(*picked, strict=True)) or [()] * 5
    picked = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PICKED, strict=True)], schema=PICKED))
    if blocks <= BROADCAST_BLOCKS:
        picked = F.broadcast(picked)
    about = F.broadcast(spark.createDataFrame([(s, n, goal[s]) for s, n in sizes.items()], "t_src string, t_source_size long, t_target double"))
    order = Window.partitionBy("shard", "src").orderBy("h", "id", "size")
    out = rows.repartition(shards, "shard").withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(about, F.expr("src <=> t_src")).join(picked, F.expr("src <=> o_src AND shard = o_shard"))
    # words of the source before the document's first, after its last, and before its middle one
    out = out.withColumns({"z": F.expr("o_start + end"), "a": F.expr("o_start + end - size"), "m": F.expr("o_start + end - size + size div 2")})
    block = f"{block}L"
    # whole blocks from the document's first to its last, and what it has of those two
    inside = f"aggregate(slice(o_times, cast(a div {block} - o_first + 1 as int), cast(z div {block} - a div {block} as int)), 0L, (s, x) -> s + x) * {block}"
    part = lambda x: f"({x} % {block}) * get(o_times, cast({x} div {block} - o_first as int))"
    taken = F.expr(f"{inside} + {part('z')} - {part('a')}")
    return out.select(F.col("id").alias(id_col), "size", F.col("src").alias(source_col), F.col("t_source_size").alias("source_size"), F.col("t_target").alias("target"), taken.alias("taken"), F.expr(f"get(o_times, cast(m div {block} - o_first as int))").alias("copies"))


def mixed(docs: DataFrame, weights=(1, 2, 3), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **also) -> DataFrame:
    """docs as the mix takes them: whole rows, each as often as the block that holds its middle word is taken.

    Rows that share an id, null ids among them, share the largest number of copies. Null and empty texts follow the
    block at their place. An empty table gives an empty result. The columns are those of docs, whatever their names.
    """
    marks = {x: next(c for k in range(len(docs.columns) + 1) if (c := f"__{x}{k}") not in docs.columns) for x in ("id", "copies", "copy")}
    found = mix_sources(docs, weights, id_col, text_col, source_col, **also)
    found = found.groupBy(F.col(id_col).alias(marks["id"])).agg(F.max("copies").alias(marks["copies"])).where(F.col(marks["copies"]) > 0)
    out = docs.join(found, F.col(id_col).eqNullSafe(F.col(marks["id"])))
    return out.withColumn(marks["copy"], F.explode(F.sequence(F.lit(1), marks["copies"]))).drop(*marks.values())
