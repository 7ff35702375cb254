"""Readers of ledgers and measurement records, with declared schemas, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = (
    "sample_id string, origin string, path string, sha256 string, size_bytes string, format string, label string, serializer string, "
    "container_chain string, Inner_pickle_path string, repo_id string, used_in_RQ string"
)
TRACES = "sample_id string, oracle array<struct<sha:string,chain:string,offset:bigint>>, ps_hit array<string>, ms_hit array<string>, ps_err string, ms_err string"
MEASUREMENTS = (
    "sample_id string, status string, n_streams int, blob_shas array<string>, blob_kinds array<string>, n_hits int, n_unsafe int, n_review int, n_low int, "
    "warn boolean, confirm boolean, or_globals int, callables array<string>"
)
STREAM_TRACE = "streams array<struct<globals:array<struct<module:string,name:string>>>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A CSV ledger; all strings but the size."""
    return spark.read.schema(LEDGER).csv(path, header=True).withColumn("size_bytes", F.col("size_bytes").cast("long"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One record a line; blank lines give no rows. A malformed line is an error, or, unless ``strict``, a row with the line in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that holds one array or object."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_globals(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct callables of trace files, by file."""
    rows = read_document(spark, folder, STREAM_TRACE).select(F.input_file_name().alias("file"), F.explode("streams.globals").alias("g"))
    return rows.select("file", F.explode("g").alias("x")).select("file", "x.module", "x.name").distinct()


def last_row_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Key and the value of its last row: how a hand-kept sheet is read."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Streams as Parquet, by digest prefix, so that no folder grows with the corpus."""
    name = F.concat(F.regexp_replace("logical_name", r"[/\\!]", "__"), F.lit("."), F.substring("sha256", 1, 8), F.lit(".pkl"))
    blobs.withColumn("file_name", name).withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("overwrite").partitionBy("prefix").parquet(path)


#: Calls whose hits share one labelled record.
CALLS_A_RECORD = 256


def write_labelled(found: DataFrame, path: str) -> None:
    """JSON records of each stream, one for every ``CALLS_A_RECORD`` calls that has hits, so that none grows with the stream: part, its worst verdict, its hits in order, and what each was judged by."""
    hit = F.struct("call_seq", "qualname", "canonical", "track", "forced", "reasons", "text", "entropy", "acts", "demotion", "verdict", "slice_start", "slice_end")
    rank = F.when(F.col("verdict") == "Unsafe", 0).when(F.col("verdict") == "Review", 1).otherwise(2)
    parts = found.withColumn("part", F.expr(f"call_seq div {CALLS_A_RECORD}"))
    parts.groupBy("blob_id", "part").agg(F.min_by("verdict", rank).alias("verdict"), F.array_sort(F.collect_list(hit)).alias("hits")).write.mode("overwrite").json(path)
