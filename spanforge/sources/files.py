"""Readers and writers of the engine's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PAYLOAD = "events array<struct<event_type:string,trigger:struct<text:string,start:int,end:int>,arguments:array<struct<role:string,text:string,start:int,end:int>>>>"
WINDOW = (
    "doc_id string, wnd_id string, text string, lang string, tokens array<string>, "
    "entity_mentions array<struct<text:string,id:string,start:int,end:int,entity_type:string,mention_type:string,value:string>>, "
    "event_mentions array<struct<id:string,event_main_type:string,event_subtype:string,event_type:string,trigger:struct<text:string,start:int,end:int>,"
    "arguments:array<struct<entity_id:string,role:string,text:string,start:int,end:int>>>>, "
    "relation_mentions array<struct<id:string,relation_type:string,relation_subtype:string,arguments:array<struct<entity_id:string,role:string,text:string,start:int,end:int>>>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One object a line; blank lines are skipped. strict: a bad line fails the read; else it lands in `_corrupt`."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = StructType([*spark.createDataFrame([], schema).schema.fields, StructField("_corrupt", StringType())])
    return spark.read.schema(wide).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_seeds(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """seed-*/predictions.jsonl below root, with `seed` from the folder's name."""
    rows = spark.read.schema(schema).json(f"{root}/seed-*/predictions.jsonl")
    return rows.withColumn("seed", F.regexp_extract(F.input_file_name(), r"/seed-([^/]+)/", 1))


def read_tagged_text(spark: SparkSession, path: str, after: str) -> DataFrame:
    """(path, at, body): the text between the tags of marked-up files, from the closing tag `after` on."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.element_at(F.split("value", after, 2), -1).alias("value"))
    parts = whole.select("path", F.posexplode(F.split("value", r"<[^>]*>")).alias("at", "body"))
    return parts.where(F.trim("body") != "").select("path", "at", F.trim("body").alias("body"))


def read_annotations(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """One row an element `row_tag` of XML files, attributes as columns with an underscore."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, size, sha256) of every file that matches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_digest(files: DataFrame) -> DataFrame:
    """sha256 over the records in order of their path."""
    line = F.concat_ws("\t", "path", F.col("size").cast("string"), "sha256")
    return files.agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"])), 256).alias("digest"))


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): missing, added or changed."""
    b, a = before.select("path", F.col("sha256").alias("old")), after.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "changed")
    return b.join(a, "path", "full").select("path", change.alias("change")).where(F.col("change").isNotNull())


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def register(spark: SparkSession, df: DataFrame, name: str) -> None:
    """Upsert of a named dataset in the catalog."""
    df.write.mode("overwrite").saveAsTable(name)


def read_jsonl_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line, value): the objects of JSON lines with their line numbers from 1 on; blank lines count but give no row.

    A line that isn't such an object has a null value: `bad_lines` says where. A file is one task's, as line numbers
    need all that stands before; files are dealt out.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("lines"))
    each = whole.select("path", F.posexplode("lines").alias("at", "text")).where(F.trim("text") != "")
    broken = F.try_parse_json("text").isNull()
    return each.select("path", (F.col("at") + 1).alias("line"), F.when(~broken, F.from_json("text", schema)).alias("value"))


def bad_lines(rows: DataFrame) -> DataFrame:
    """(place): path:line of each line that held no object."""
    return rows.where("value IS NULL").select(F.concat_ws(":", "path", F.col("line").cast("string")).alias("place"))


def read_many(spark: SparkSession, pattern: str, schema: str, keys: list[str], most_round: int | None = None) -> DataFrame:
    """All files that match; of rows with equal keys the first by path stays. most_round: no row of a later round."""
    rows = spark.read.schema(schema).json(pattern).withColumn("_path", F.input_file_name())
    rows = rows.where(F.col("round") <= most_round) if most_round is not None else rows
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (*keys, "_path")]), F.col("_path")).alias("_row"))
    return kept.select(*keys, "_row.*")


def read_split(spark: SparkSession, docs: DataFrame, path: str, doc_id: str = "doc_id") -> DataFrame:
    """The documents that a list names, one id a line, in order of their ids; a name that is no document is an error."""
    names = spark.read.text(path).select(F.trim("value").alias("_name")).where("_name <> ''").distinct()
    lost = [r["_name"] for r in names.join(docs, names["_name"] == docs[doc_id], "left_anti").limit(5).collect()]
    if lost:
        raise ValueError(f"no such documents: {lost}")
    return docs.join(names, docs[doc_id] == names["_name"], "left_semi").orderBy(doc_id)


def write_summary(row: DataFrame, path: str) -> None:
    """One row as a JSON file in a folder of its own."""
    row.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; over `most` rows is an error, since such a table is a report."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"over {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = [f"| {' | '.join(rows.columns)} |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*head, *(f"| {' | '.join(map(cell, r))} |" for r in got)])


def cached(requests: DataFrame, path: str, answer) -> DataFrame:
    """requests with `response`: what answer(new requests) gave, kept below path by the sha256 of the request's JSON.

    answer takes rows with `key` and the columns of requests and returns (key, response); equal requests ask once.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("key", F.sha2(F.to_json(F.struct(*sorted(requests.columns))), 256))
    schema = "key string, response string"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
    known = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    fresh = keyed.dropDuplicates(["key"]).join(known, "key", "left_anti")
    answer(fresh).select("key", "response").write.mode("append").parquet(path)
    return keyed.join(spark.read.schema(schema).parquet(path).dropDuplicates(["key"]), "key").drop("key")
