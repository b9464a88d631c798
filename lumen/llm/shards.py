"""Sharding: contiguous shards of near equal bytes, from per-partition byte totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import power_of_two, stage

#: A group of equal texts with more than 1/SPLIT of all bytes may be cut; at most SPLIT groups can be that large.
SPLIT = 400
#: A group with more than 1/LARGE of a shard's bytes is kept away from the cuts.
LARGE = 400


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 2000) -> DataFrame:
    """Put every row into one of `shards` contiguous shards of near equal bytes.

    Rows are ordered by the hash of their text, then by id, so the order needs no sampling pass and equal texts stand
    side by side. Within each of as many stretches of that order as there are shards, large groups of equal texts stand
    in the middle half: cuts fall near the ends of stretches, hence between small ones. The order is cut into hash
    ranges; prefix sums run inside each range, ranges are offset by the totals of the ranges before them, and a row's
    shard is where its middle byte falls among equal targets. A group of equal texts goes by its middle, hence to one
    shard, unless the group has over 1/SPLIT of all bytes; such groups are spread by the hash of the id instead, or of
    the row's place where the id is null.

    size: UTF-8 bytes plus 1 (null text: 1), however long. text_crc32: of the UTF-8 bytes (null: 0). Ids may be null or
    repeat; each row is kept. Ties in hash and id have equal size, so any order among them gives the same table. An
    empty table gives an empty result. Other columns of docs play no part, whatever their names.

    Returns id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0), grown_shard (null).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("k")), "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = power_of_two(n / rows_per_range, 16, 1 << 14)
    bits = ranges.bit_length() - 1
    # at most LARGE * shards groups, the largest first to the stretch with the least of them
    large = rows.groupBy("k").agg(F.sum("size").alias("b"), F.count("*").alias("c")).where(F.col("b") * (LARGE * shards) > total).collect()
    held, found = [0] * shards, []
    for x in sorted(large, key=lambda x: (-x["b"], x["k"])):
        big, stretch = x["b"] * SPLIT > total and x["c"] > 1, held.index(min(held))
        held[stretch] += 0 if big else x["b"]
        found.append((x["k"], big, None if big else stretch))
    large = docs.sparkSession.createDataFrame(found, "k long, big boolean, stretch long")
    place = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    at = rows.withColumn("place", place).join(F.broadcast(large), "k", "left").withColumn("u", F.shiftrightunsigned(F.when(F.col("big"), F.xxhash64("id", "place", F.lit(7))).otherwise(F.col("k")), 2))
    wide = (1 << 62) // shards + 1  # of a stretch
    half = F.expr(f"(u % {wide}L) div 2")
    inside = F.when(F.coalesce(~F.col("big"), F.col("size") * (LARGE * shards) > total), F.lit(wide // 4) + half).otherwise(F.when(half < wide // 4, half).otherwise(half + wide // 2))
    at = at.withColumn("o", F.coalesce("stretch", F.expr(f"u div {wide}L")) * wide + inside).withColumn("r", F.shiftrightunsigned("o", 62 - bits).cast("int")).select("r", "o", "k", "id", "size", "crc")
    at = stage(at, "ranges")
    # one row per range, at most 16,384
    sums, starts, offset, first = at.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("r").collect(), [], 0, 0
    for x in sums:
        starts.append((x["r"], offset, first))
        offset, first = offset + x["b"], first + x["n"]
    spark = docs.sparkSession
    starts = spark.createDataFrame(starts, "r int, byte0 long, row0 long")
    order = Window.partitionBy("r").orderBy("o", "k", "id")
    group = Window.partitionBy("r", "o", "k")
    placed = (
        at.repartition(min(ranges, 4096), "r")
        .withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("pos", F.row_number().over(order))
        .withColumn("middle", (F.min("start").over(group) + F.max(F.col("start") + F.col("size")).over(group)) / 2)
        .join(F.broadcast(starts), "r")
        .select("id", "size", "crc", F.expr(f"cast(least((byte0 + cast(middle as long)) * {shards}L div {max(total, 1)}L, {shards - 1}L) as int)").alias("shard"), (F.col("row0") + F.col("pos") - 1).alias("pos"))
    )
    placed = stage(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("pos").alias("pos0"))
    return placed.join(F.broadcast(firsts), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("pos") - F.col("pos0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
