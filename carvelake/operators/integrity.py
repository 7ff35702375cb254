"""A ledger against the files of a folder, in two phases.

First a full outer join of the ledger with the folder's listing, which reads no contents; then digests of those files only whose size agrees and that the ledger has a digest of. Tasks
read these files a piece at a time where they lie, so a file of any size needs no cell.

Defined cases: a size or digest that the ledger leaves null isn't checked; a path that the ledger lists twice is checked twice; a file that goes between the phases is missing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carvelake.sources.members import read_listing

from .carve import opened

PIECE = 4 << 20


def listing(spark: SparkSession, root: str) -> DataFrame:
    """name (below the root), path and length of all files, without their contents."""
    files = read_listing(spark, root)
    return files.select(F.regexp_replace(F.substring_index("path", root.rstrip("/").rpartition(":")[2].lstrip("/") + "/", -1), "^/+", "").alias("name"), "path", "length")


def compared(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Phase one: sample_id, name, path, sha256 and state (missing, extra, size, or null where the digest decides or nothing is left to check: ok)."""
    both = ledger.select("sample_id", F.col("path").alias("name"), "sha256", "size_bytes").join(files, "name", "full")
    state = (
        F.when(F.col("path").isNull(), "missing").when(F.col("sample_id").isNull() & F.col("size_bytes").isNull() & F.col("sha256").isNull(), "extra")
        .when(F.col("size_bytes") != F.col("length"), "size").when(F.col("sha256").isNull(), "ok")
    )
    return both.select("sample_id", "name", "path", "sha256", state.alias("state"))


def digests_of(paths: list[str]) -> list[str | None]:
    """SHA-256 of each file, read a piece at a time; None for one that can't be read."""
    found: list[str | None] = []
    for path in paths:
        try:
            digest = hashlib.sha256()
            with opened(path) as file:
                while piece := file.read(PIECE):
                    digest.update(piece)
            found.append(digest.hexdigest())
        except OSError:
            found.append(None)
    return found


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests_of(batch.column(0).to_pylist()), pa.string())], ["path", "digest"])


def digests(paths: DataFrame) -> DataFrame:
    """path and digest (SHA-256 in hex; null for a file that can't be read) of each path once; dealt out anew, for reading files is far more work than their rows' sizes tell."""
    return paths.distinct().repartition("path").mapInArrow(_digests, "path string, digest string")


def verified(ledger: DataFrame, files: DataFrame, quick: bool = False) -> DataFrame:
    """sample_id, name and state (ok, missing, extra, size, digest) of each row of the ledger (sample_id, path, sha256, size_bytes) and of each further file."""
    rows = compared(ledger, files)
    if quick:
        return rows.select("sample_id", "name", F.coalesce("state", F.lit("ok")).alias("state"))
    state = F.coalesce("state", F.when(F.col("digest").isNull(), "missing").when(F.col("digest") == F.lower("sha256"), "ok").otherwise("digest"))
    return rows.join(digests(rows.where("state is null").select("path")), "path", "left").select("sample_id", "name", state.alias("state"))
