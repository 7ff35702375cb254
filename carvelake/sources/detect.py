"""File kinds by magic bytes, as ordered Catalyst conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Magic numbers, in hex.
ZIP_LOCAL, ZIP_ANY = "504B0304", ("504B0304", "504B0506", "504B0708")
GZIP, BZIP2, XZ, LZ4, ZSTD, NPY = "1F8B", "425A68", "FD377A585A00", "04224D18", "28B52FFD", "934E554D5059"
LEGACY_LZMA_SIZES = ("00001000", "00008000", "00000001", "00000004")
PICKLE_STARTERS = tuple(f"{ord(c):02X}" for c in "(c}])SVINiltd")


def _head(data: Column, n: int) -> Column:
    return F.hex(F.substring(data, 1, n))


def is_pickle_prefix(data: Column) -> Column:
    """Protocol 2 to 5 header, or an opcode that protocol 0 and 1 streams begin with."""
    return _head(data, 2).isin("8002", "8003", "8004", "8005") | _head(data, 1).isin(*PICKLE_STARTERS)


def _zlib(data: Column) -> Column:
    return (_head(data, 1) == "78") & (F.conv(_head(data, 2), 16, 10).cast("int") % 31 == 0) & (F.length(data) >= 2)


def _legacy_lzma(data: Column) -> Column:
    first = F.conv(_head(data, 1), 16, 10).cast("int")
    return first.between(0x5D, 0xE0) & F.hex(F.substring(data, 2, 4)).isin(*LEGACY_LZMA_SIZES)


def file_kind(data: Column) -> Column:
    """Kind of a whole file by its first 16 bytes; the order decides."""
    h = lambda n: _head(data, n)
    return (
        F.when(h(4) == ZIP_LOCAL, "zip").when(h(2) == GZIP, "gzip").when(h(3) == BZIP2, "bzip2").when(h(6) == XZ, "lzma")
        .when(_legacy_lzma(data), "lzma").when(h(4) == LZ4, "lz4").when(_zlib(data), "zlib").when(is_pickle_prefix(data), "pickle").otherwise("unknown")
    )


def member_kind(data: Column) -> Column:
    """Kind of an archive member by its first 512 bytes."""
    h = lambda n: _head(data, n)
    return (
        F.when(h(4).isin(*ZIP_ANY), "zip").when(h(6) == NPY, "npy").when(h(2) == GZIP, "gzip").when(h(3) == BZIP2, "bzip2").when(h(6) == XZ, "xz")
        .when(h(4) == LZ4, "lz4").when(h(4) == ZSTD, "zstd").when(F.hex(F.substring(data, 258, 5)) == "7573746172", "tar")
        .when(is_pickle_prefix(data), "pickle").otherwise("unknown")
    )


def member_score(name: Column) -> Column:
    """Priority of an archive member by its name."""
    n = F.lower(name)
    ends = lambda *e: F.lit(False) if not e else n.rlike("\\.(" + "|".join(e) + ")$")
    return (
        F.when(n.endswith("/data.pkl"), 100).otherwise(0) + F.when(ends("pkl", "pickle", "joblib", "p"), 40).otherwise(0)
        + F.when(ends("pt", "pth", "bin", "ckpt"), 20).otherwise(0) + F.when(ends("zip", "tar", "gz", "bz2", "xz", "lz4", "npz", "npy", "tgz"), 5).otherwise(0)
        - F.when(n.contains("/data/"), 50).otherwise(0) - F.when(n.rlike("(byteorder|version|serialization_id)$"), 30).otherwise(0)
    )


def unsafe_member(name: Column) -> Column:
    """Whether a member name leaves its folder: a parent segment, an absolute path or a drive."""
    return name.rlike(r"(^|[/\\])\.\.([/\\]|$)") | name.rlike(r"^[/\\]") | name.rlike(r"^[A-Za-z]:")


def read_artifacts(spark: SparkSession, path: str | list[str], recursive: bool = False, most_bytes: int = 512 << 20) -> DataFrame:
    """artifact_id, path, length, content and kind of the files in a folder. The size limit is pushed to the scan.

    Files beyond ``most_bytes`` do not fit a cell; list them with ``large_artifacts`` and carve them with ``carve.carve_large``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).where(F.col("length") <= most_bytes)
    return files.select(F.sha2("path", 256).alias("artifact_id"), "path", "length", "content", file_kind(F.col("content")).alias("kind"))


def large_artifacts(spark: SparkSession, path: str | list[str], recursive: bool = False, most_bytes: int = 512 << 20) -> DataFrame:
    """artifact_id, path and length of the files that ``read_artifacts`` leaves out; their contents are not read here."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(F.col("length") > most_bytes).select(F.sha2("path", 256).alias("artifact_id"), "path", "length")
