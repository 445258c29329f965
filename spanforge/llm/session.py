"""What all operators of this subpackage need from the session: the shared folder, cut lineage, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share.

    Where it is unset, a local master (tests) gets a folder of its own; on a cluster that is an error, since executors
    couldn't read one another's files.
    """
    sc = spark.sparkContext
    held = sc.getCheckpointDir()
    if held:
        return held
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spanforge-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends inside go with it: its result is in the shared folder then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage: a lost executor rereads the shared files instead of recomputing."""
    shared_dir(df.sparkSession)
    with _freeing(df.sparkSession):
        return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """As cut(), but as a Parquet table, whose size the planner knows: it alone decides whether a join broadcasts."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _freeing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of settled() tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_columns(df: DataFrame, *needed: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash with what an operator adds."""
    return df.select(*[df[c] for c in needed])
