"""Maintained measurements of a folder of files: a run reads the files that changed since the last one, and rewrites their buckets only.

``store`` holds two tables, both in buckets by the hash of the path: the snapshot (path, length, modified, digest, run) and the measurements (path, run, and what the measuring function
gives). A file whose size and time are as before is not opened; one whose time alone has changed is read for its digest and measured only if that is another. Buckets without any change
aren't read or written. Each rewritten bucket has a row without a path, so that one that has lost all its files is rewritten too. Measurements are written before the snapshot: a run that
ends in between is made again by the next one, with the same result.

Defined cases: a first run measures everything; a run without changes writes nothing; files that are gone lose their rows; a file that goes during the run has no row until it is back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carvelake.scratch import saved
from carvelake.sources.members import read_listing

from .carve import carve, carve_large, container_findings, large_findings, opened
from .integrity import digests
from .verdict import artifact_verdicts, scan_blobs

BUCKETS, MOST_BYTES, BATCH_BYTES = 256, 512 << 20, 64 << 20
SNAPSHOT = "path string, length long, modified timestamp, digest string, run long, bucket int"

#: Rows (path, ...) measured from files (path, length).
Measure = Callable[[DataFrame], DataFrame]


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, ids, data, size = ["artifact_id", "path", "content"], [], [], 0
    paths: list[str] = []
    for batch in batches:
        for artifact, path in zip(*(c.to_pylist() for c in batch.columns)):
            with opened(path) as file:
                data.append(file.read())
            ids.append(artifact), paths.append(path)
            size += len(data[-1])
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(paths), pa.array(data, pa.binary())], names)
                ids, paths, data, size = [], [], [], 0
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(paths), pa.array(data, pa.binary())], names)


def scan_measurements(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The verdict and counts of each file (path, length); tasks open the files, so no others are read."""
    files = files.select(F.sha2("path", 256).alias("artifact_id"), "path", "length")
    small = files.where(F.col("length") <= most_bytes).select("artifact_id", "path").repartition("path").mapInArrow(_contents, "artifact_id string, path string, content binary")
    large = files.where(F.col("length") > most_bytes)
    blobs = saved(carve(small).unionByName(carve_large(large)), "measured-blobs")
    findings = container_findings(small).unionByName(large_findings(large))
    return artifact_verdicts(files, blobs, scan_blobs(blobs), findings).join(files.select("artifact_id", "path"), "artifact_id").drop("artifact_id")


def _table(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException:  # not written yet
        return None


def _rewrite(rows: DataFrame, touched: DataFrame, path: str) -> None:
    none = touched.select(*[F.col("bucket") if f.name == "bucket" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    rows.unionByName(none).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def remeasure(spark: SparkSession, root: str, store: str, measure: Measure = scan_measurements, buckets: int = BUCKETS) -> DataFrame:
    """Brings the tables in ``store`` up to date with the files below ``root`` and returns the measurements."""
    now = saved(read_listing(spark, root).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")), "listing")
    was = _table(spark, f"{store}/snapshot", SNAPSHOT)
    was = spark.createDataFrame([], SNAPSHOT) if was is None else was.where("path is not null")
    run = (was.agg(F.max("run")).first()[0] or 0) + 1
    before = was.select("path", *[F.col(c).alias(f"_{c}") for c in ("length", "modified", "digest", "run")])
    other = now.join(before, "path", "left").where("_length is null or length <> _length or modified <> _modified")
    other = saved(other.join(digests(other.select("path")), "path").where("digest is not null"), "changed")
    fresh = other.where("not _digest <=> digest")
    gone = was.join(now.select("path"), "path", "left_anti")
    touched = saved(other.select("bucket").union(gone.select("bucket")).distinct(), "touched")
    if touched.limit(1).count():
        rows = measure(fresh.select("path", "length")).withColumn("run", F.lit(run).cast("long")).join(fresh.select("path", "bucket"), "path")
        old = _table(spark, f"{store}/measurements")
        if old is not None:
            stays = old.where("path is not null").join(F.broadcast(touched), "bucket", "left_semi").join(gone.select("path").union(fresh.select("path")), "path", "left_anti")
            rows = rows.unionByName(stays)
        _rewrite(saved(rows, "measured"), touched, f"{store}/measurements")
        seen = other.select("path", "length", "modified", "digest", F.when(F.col("_digest") == F.col("digest"), F.col("_run")).otherwise(F.lit(run)).cast("long").alias("run"), "bucket")
        stays = was.join(F.broadcast(touched), "bucket", "left_semi").join(gone.select("path").union(other.select("path")), "path", "left_anti").select(*seen.columns)
        _rewrite(saved(seen.unionByName(stays), "snapshot"), touched, f"{store}/snapshot")
    return spark.read.parquet(f"{store}/measurements").where("path is not null").drop("bucket")
