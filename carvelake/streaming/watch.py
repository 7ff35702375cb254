"""A drop folder as a stream: new contents are carved, scanned and judged by the same functions as a batch.

The stream carries paths, not contents: tasks digest each new file where it lies, piece by piece, and a keyed state per digest lets a content pass once, for ever or until its own expiry, across
restarts. The batch then opens the files that passed, small ones whole and large ones by windows, so no file is too large for the stream. A file that can't be read is a row, not the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from carvelake.operators.integrity import digests, digests_of
from carvelake.operators.remeasure import MOST_BYTES, scan_measurements
from carvelake.scratch import saved

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SeenOnce(StatefulProcessor):
    """Lets the first row of a key pass. ttl_ms: after so long without being seen anew a key counts as new again; None: never."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "path string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        first = None
        for frame in rows:
            own = frame.sort_values("path").head(1)
            if len(own) and (first is None or own["path"].iloc[0] < first["path"].iloc[0]):
                first = own
        if first is not None:
            self.seen.update((first["path"].iloc[0],))
            if not known:
                yield first

    def close(self) -> None:
        pass


def artifact_stream(spark: SparkSession, folder: str, ttl_ms: int | None = None) -> DataFrame:
    """digest, path and length of new files of a folder, each content once; a file without a digest could not be read."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(folder).select("path", "length")
    rows = files.repartition("path").mapInArrow(_with_digest, "path string, length long, digest string").withColumn("digest", F.coalesce("digest", F.concat(F.lit("unread:"), "path")))
    once = rows.groupBy("digest").transformWithStateInPandas(SeenOnce(ttl_ms), "digest string, path string, length long", "Append", "ProcessingTime" if ttl_ms else "None")
    return once.select(F.when(~F.col("digest").startswith("unread:"), F.col("digest")).alias("digest"), "path", "length")


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests_of(batch.column(0).to_pylist()), pa.string())], ["path", "length", "digest"])


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, trigger: dict | None = None, ttl_ms: int | None = None, most_bytes: int = MOST_BYTES) -> StreamingQuery:
    """Appends the verdict of every new content to a Parquet folder; a batch that is retried writes its own folder again."""

    def batch(rows: DataFrame, number: int) -> None:
        files = saved(rows, "new-files")
        there = files.where("digest is not null")
        there = there.join(digests(there.select("path")).where("digest is not null").select("path"), "path")
        verdicts = files.join(scan_measurements(there.select("path", "length"), most_bytes), "path", "left").withColumn("verdict", F.coalesce("verdict", F.lit("Not scanned")))
        verdicts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return artifact_stream(spark, folder, ttl_ms).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
