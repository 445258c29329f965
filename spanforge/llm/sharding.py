"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters the rows uniformly into memory-sized buckets by a seeded hash of the whole row. Pass two puts each
bucket in order of that hash, walks it with a Fisher-Yates shuffle and lays the buckets end to end: a row's place in
that global order decides its shard and slot. Shards are equal cuts of the order, so their row counts differ by one at
most (law "rows"). The draws of a walk are hashes of seed, bucket and position, so the same rows get the same places
whatever partitions they lie in.

A bucket holds about `bucket_bytes` or BUCKET_ROWS rows, whichever is less, whatever the sources, sizes or copies are:
only identical rows hash alike, and of these each further copy enters its number into the hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import settled, shared_dir

SHARDS = 24
SEED = 20240607
BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 1024


def row_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus eight."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _ordered(buckets: DataFrame) -> DataFrame:
    """Rows before each bucket, from a table of one small row a bucket, by blocks of 4,096 buckets."""
    block = F.expr("bucket div 4096")
    sums = buckets.groupBy(block.alias("block")).agg(F.sum("n").alias("n_block"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("block", F.coalesce(F.sum("n_block").over(over), F.lit(0)).alias("before_block"))
    inside = Window.partitionBy(block).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    part = buckets.select("bucket", block.alias("of"), F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("before"))
    return part.join(before, part["of"] == before["block"]).select(F.col("bucket").alias("in_bucket"), (F.col("before") + F.col("before_block")).alias("before"))


def walk(n: Column, bucket: Column, seed: int) -> Column:
    """A Fisher-Yates walk as the array of positions 0 to n - 1 in their new order, from the inside out.

    Step i draws j in 0 to i; position i takes the place j, and what stood there moves to the end.
    """

    def step(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), (i + 1).cast("long")).cast("int")
        swapped = F.concat(F.slice(order, F.lit(1), j), F.array(i), F.slice(order, j + 2, i - j - 1), F.array(F.get(order, j)))
        return F.when(j == i, F.concat(order, F.array(i))).otherwise(swapped)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<int>"), step)


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> DataFrame:
    """All rows of `rows` with their columns in struct `row`, and `shard` (0 to shards - 1) and `slot` (from 0, gapless).

    Row counts of shards differ by one at most. Nulls in any column, empty and very long texts and repeated rows are
    kept as they are; an empty table gives no rows. Columns of any name are safe, as they stay inside `row`. Columns of
    map type don't enter the hash. Identical rows can't be told apart, so it doesn't matter which gets which place.
    """
    fields = [f.name for f in rows.schema if f.dataType.typeName() != "map"]
    packed = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"))
    key = F.xxhash64(F.lit(seed), *[F.col("row").getField(c) for c in fields])
    light = packed.select(key.alias("key"), row_size(F.col("row").getField(text)).alias("size"))
    total = light.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    # A power of two, so that a few more rows seldom change it.
    n, buckets = total["n"], 1 << max(0, -(-(total["bytes"] or 0) // bucket_bytes) - 1, -(-total["n"] // BUCKET_ROWS) - 1).bit_length()
    many = settled(light.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("many")))
    keyed = packed.select(key.alias("key"), "row")
    if many.limit(1).count():  # rows that have copies are counted before they move; further copies get a hash of their own
        marked = keyed.join(many, F.col("key") == F.col("many"), "left")
        copies = marked.where("many IS NOT NULL").groupBy("key", *[F.col("row").getField(c).alias(f"_{i}") for i, c in enumerate(rows.columns)]).agg(F.count(F.lit(1)).alias("_n"))
        made = copies.select("key", F.struct(*[F.col(f"_{i}").alias(c) for i, c in enumerate(rows.columns)]).alias("row"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("copy"))
        made = made.select(F.when(F.col("copy") == 1, F.col("key")).otherwise(F.xxhash64("key", "copy")).alias("key"), "row")
        keyed = marked.where("many IS NULL").select("key", "row").unionByName(made)
    scattered = keyed.select("key", F.pmod(F.xxhash64("key", F.lit("bucket")), F.lit(buckets)).alias("bucket"), "row")
    before = _ordered(settled(scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))))
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    whole = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("key", "row")), by_key).alias("rows"))
    ordered = whole.select("bucket", "rows", walk(F.size("rows"), F.col("bucket"), seed).alias("order"))
    walked = ordered.select("bucket", F.posexplode(F.transform("order", lambda i: F.get("rows", i))).alias("at", "held"))
    placed = walked.join(before, walked["bucket"] == before["in_bucket"]).select((F.col("before") + F.col("at")).alias("place"), F.col("held.row").alias("row"))
    # Shard s takes places from ceil(s n / shards) on, so place p is in shard floor(p shards / n).
    shard = F.expr(f"place * {shards}L div {max(n, 1)}L")
    start = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return placed.select("row", "place", shard.alias("shard")).select("row", F.col("shard").cast("int").alias("shard"), (F.col("place") - start).alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, **more) -> DataFrame:
    """Writes (row, slot) below path, a folder `shard=N` for each shard, in slot order within files; returns them read.

    The rows of a bucket go to one file or two, where they lie: writing moves nothing. An empty table writes no folder.
    """
    out = shuffled(rows, shards=shards, **more)
    out.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return rows.sparkSession.read.schema(out.select("row", "slot", "shard").schema).parquet(path)


def shard_table(rows: DataFrame, shards: int = SHARDS, **more) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, from shards written in the shared folder."""
    out = write_shards(rows, f"{shared_dir(rows.sparkSession)}/shards-{uuid.uuid4().hex}", shards, **more)
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
    return out.select(F.col("row.doc_id").alias("doc_id"), row_size(F.col("row.text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
