"""The driver tables in the roles of the engine's data model.

A window is an order, a mention one of its line items: type from the return flag and line status (family: the flag),
trigger span from the line number, argument from the part. Predictions and samples are arithmetic perturbations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNSEEN = ["R:F"]
GOLD_SQL = "SELECT l_orderkey AS wnd_id, concat(l_returnflag, ':', l_linestatus) AS event_type, CAST(l_linenumber AS BIGINT) AS s, CAST(l_linenumber + 1 AS BIGINT) AS e, l_partkey % 50 AS a FROM lineitem"


def predicted_sql(m: int = 5) -> str:
    return f"SELECT l_orderkey AS wnd_id, CASE WHEN (l_orderkey + l_linenumber * 3) % 7 = 0 THEN 'A:F' ELSE concat(l_returnflag, ':', l_linestatus) END AS event_type, CAST(l_linenumber + (CASE WHEN (l_partkey + l_linenumber) % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS s, CAST(l_linenumber + 1 + (CASE WHEN (l_partkey + l_linenumber) % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS e, (l_partkey + (CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END)) % 50 AS a FROM lineitem WHERE (l_orderkey * 7 + l_linenumber) % {m} <> 0"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows in as many partitions as a shuffle has: a small file of many rows is else the work of few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("long")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("wnd_id"), F.concat("l_returnflag", F.lit(":"), "l_linestatus").alias("event_type"), n.alias("s"), (n + 1).alias("e"), (F.col("l_partkey") % 50).alias("a"))


def predicted(spark: SparkSession, sf_dir: str, m: int = 5) -> DataFrame:
    n = F.col("l_linenumber").cast("long")
    shift = F.when((F.col("l_partkey") + n) % 11 == 0, 1).otherwise(0)
    kind = F.when((F.col("l_orderkey") + n * 3) % 7 == 0, "A:F").otherwise(F.concat("l_returnflag", F.lit(":"), "l_linestatus"))
    rows = read(spark, sf_dir, "lineitem").where((F.col("l_orderkey") * 7 + n) % m != 0)
    return rows.select(F.col("l_orderkey").alias("wnd_id"), kind.alias("event_type"), (n + shift).alias("s"), (n + 1 + shift).alias("e"), ((F.col("l_partkey") + F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0)) % 50).alias("a"))


def windows(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("wnd_id").agg(F.collect_list(F.struct("event_type", "s", "e", "a")).alias("events"))


def samples(spark: SparkSession, sf_dir: str, moduli: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    out = None
    for m in moduli:
        one = predicted(spark, sf_dir, m).withColumn("k", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def samples_sql(moduli: tuple[int, ...] = (3, 4, 5)) -> str:
    return " UNION ALL ".join(f"SELECT *, {m} AS k FROM ({predicted_sql(m)})" for m in moduli)
