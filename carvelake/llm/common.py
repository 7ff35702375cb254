"""Shared helpers of the llm operators: table access, shared scratch, row keys."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from carvelake.scratch import scratch_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark touches the path."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path and file system of ``path``."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared scratch folder and reads it back.

    A lost executor costs no more than the tasks it was running, for the files are not its own. The shuffle files
    behind ``df`` are let go.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a row group.
ROW_GROUP = 8 << 20


def saved_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, label: str) -> DataFrame:
    """``saved(df.mapInArrow(run, schema))``, but the workers write the files, so that rows don't travel back through the JVM.

    A task's file gets its name by a rename once it is whole, and attempts of a task use the same name, so retried and
    speculative tasks leave one file. Where Arrow can't open the shared folder, Spark writes the rows.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    try:
        pafs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        return saved(df.mapInArrow(run, schema), label)
    folder, files = _hadoop(spark, path)
    files.mkdirs(folder)
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = pafs.FileSystem.from_uri(path)
        name = f"part-{TaskContext.get().partitionId():06d}.parquet"
        own, whole, rows = f"{inner}/_{uuid.uuid4().hex}", f"{inner}/{name}", 0
        with contextlib.ExitStack() as stack:
            writer, held, size = None, [], 0
            for batch in chain(run(batches), [None]):
                if batch is not None and batch.num_rows:
                    held.append(batch.cast(arrow))
                    size += batch.nbytes
                    rows += batch.num_rows
                if held and (batch is None or size >= ROW_GROUP):
                    writer = writer or stack.enter_context(pq.ParquetWriter(own, arrow, filesystem=store, compression="zstd"))
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
        if rows:
            try:
                store.move(own, whole)
            except OSError:
                if store.get_file_info(whole).type is pafs.FileType.NotFound:
                    raise
                store.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    df.mapInArrow(write, "rows long").agg(F.sum("rows")).collect()
    release_shuffles(spark)
    return spark.read.schema(kind).parquet(path)


def cut_batch(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose values of one text or binary column have about ``size`` bytes together."""
    lengths = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    part = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished rounds now, not at the next driver collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks(spark: SparkSession) -> int:
    """The session's shuffle width, which operators use where they deal out rows themselves."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: The key of documents without an id.
NO_ID = -(2**63)


def place_of(docs: DataFrame, name: str) -> int | None:
    """Which column Spark takes ``name`` for: that of this very name, else one that differs in case only, unless the session tells case; None if there is none."""
    if name in docs.columns:
        return docs.columns.index(name)
    told = docs.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    like = [] if told else [k for k, c in enumerate(docs.columns) if c.lower() == name.lower()]
    return like[0] if like else None


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns renamed _in0, _in1, ... in their order, so that no name clashes."""
    return docs.toDF(*[f"_in{k}" for k in range(len(docs.columns))])


def text_bytes(col: str = "text") -> Column:
    """A text as UTF-8; a null one is empty."""
    return F.encode(F.coalesce(F.col(col), F.lit("")), "UTF-8")


def text_crc(col: str = "text") -> Column:
    return F.crc32(text_bytes(col))
