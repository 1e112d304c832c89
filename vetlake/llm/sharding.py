"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id). A sample drawn with probability in proportion to size gives splitters at
its quantiles, which part the records into ranges of nearly equal bytes; the key's second part splits even one text that a
third of all rows share. Exact sums of the ranges and running sums within each then put every record's first byte at its
place in the whole, and the shard is the eighth (or n-th) of all bytes that this place falls in: ranges that would overfill
a shard are subdivided at the record. Only DataFrame functions are used, and no task holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

#: Ranges for each shard, bytes of a range from which on there are more, and sampled records for each range.
RANGES, RANGE_BYTES, SAMPLED = 32, 256 << 20, 8


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes (null: none) plus 1. Shards hold nearly equal bytes: each boundary is off by less than
    one record. Slots count from 0 without gaps within a shard, in the order of (text's hash, doc_id). Nulls and repeated
    rows are records like others; ties are broken by nothing else, as equal records are alike. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = scratch.write(rows, "rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(shards * RANGES, -(-total // RANGE_BYTES))
    # size-weighted: a record stands in the sample as often as its size makes likely; a hash of the record is the dice
    dice = F.pmod(F.xxhash64("h", "doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sampled = rows.where(dice * max(total, 1) < F.col("size") * ranges * SAMPLED)
    # one string key that sorts as (h, doc_id) would; null ids first
    wide = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.concat(wide(F.col("h")), F.coalesce(wide(F.col("doc_id")), F.lit("")))
    cut = sampled.select(key.alias("key")).withColumn("n", F.ntile(ranges).over(W.orderBy("key")))
    bounds = [r[0] for r in cut.groupBy("n").agg(F.max("key").alias("key")).select("key").distinct().orderBy("key").collect()][:-1]  # at most `ranges`
    table = spark.createDataFrame([(bounds,)], "bounds array<string>")
    keyed = rows.withColumn("key", key).crossJoin(F.broadcast(table))
    # binary search: the number of bounds below the key
    steps = max(1, len(bounds)).bit_length()
    find = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
        lambda a, _: F.when(
            a.getField("lo") < a.getField("hi"),
            F.when(
                F.get(F.col("bounds"), F.floor((a.getField("lo") + a.getField("hi")) / 2).cast("int")) < F.col("key"),
                F.struct((F.floor((a.getField("lo") + a.getField("hi")) / 2).cast("int") + 1).alias("lo"), a.getField("hi").alias("hi")),
            ).otherwise(F.struct(a.getField("lo").alias("lo"), F.floor((a.getField("lo") + a.getField("hi")) / 2).cast("int").alias("hi"))),
        ).otherwise(a),
        lambda a: a.getField("lo"),
    )
    placed = keyed.select("doc_id", "size", "text_crc32", "h", find.alias("range"))
    sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # over the ranges, not the records
    bases = sums.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    within = W.partitionBy("range").orderBy("h", "doc_id")
    done = placed.withColumns({"done": F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"), "nth": F.row_number().over(within) - 1})
    at = done.join(F.broadcast(bases), "range")  # one row for each range
    number = F.least(F.floor((F.col("base") + F.col("done")) * shards / max(total, 1)), F.lit(shards - 1)).cast("int")
    at = at.select("doc_id", "size", "text_crc32", number.alias("shard"), (F.col("first") + F.col("nth")).alias("place"))
    at = scratch.write(at, "placed")
    scratch.drop("rows")
    starts = at.groupBy("shard").agg(F.min("place").alias("start"))  # `shards` rows
    return at.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("start")).cast("long").alias("slot"))
