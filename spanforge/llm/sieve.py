"""Rows that may hold one of some keys, told without moving the others: a bitmap of the keys goes to every task.

A join of whole texts with a table about few of them would shuffle every text. Here the rows are told apart first: those
that the bitmap passes go to the join, which alone decides; of the others it is certain that their key isn't held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import settled

BITS_A_KEY = 16
#: The bitmap's size is bounded; with more keys than a sixteenth of it more rows pass, and no result changes.
MOST_BITS = 1 << 26
NAME = "_maybe"


def sieved(rows: DataFrame, by: Column, keys: DataFrame, n: int | None = None) -> DataFrame:
    """rows with a boolean column _maybe: true wherever the long `by` is a key, and for about one in 16 of the others.

    keys: one column of hashes, of any type of long; n: how many there are at most, counted if not given. Nulls aren't keys.
    """
    keys = keys.toDF("_key").where("_key IS NOT NULL")
    n = keys.count() if n is None else n
    bits = min(MOST_BITS, 1 << max(10, (BITS_A_KEY * n).bit_length()))
    words = settled(keys.selectExpr(f"_key & {bits - 1}L AS _place").groupBy(F.expr("shiftright(_place, 6)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, CAST(_place & 63 AS INT)))").alias("_bits")))
    held = rows.withColumn("_place", by.bitwiseAND(F.lit(bits - 1).cast("long"))).join(F.broadcast(words), F.expr("shiftright(_place, 6)") == F.col("_word"), "left")
    return held.withColumn(NAME, F.expr("coalesce(getbit(_bits, CAST(_place & 63 AS INT)) = 1, false)")).drop("_place", "_word", "_bits")
