"""Files and archive members as a data source, without their contents: ``spark.read.format("artifact_members").load(folder)``.

A row for each member of an archive, and one for each other file: where it lies, how it is stored, its size, the first 512 bytes of what
it holds, and the layout that those bytes tell. Small files are read in groups; a large zip archive is dealt out by byte ranges, and a task lists the
members whose headers begin in its range, so no file is one task's work alone. A compressed file is decoded for its head only. Only the driver lists
the folder, and it opens large files for four bytes each.

Filters on path and length leave files out before any is opened, those on member before a member is (`pushFilters`); Spark applies all others.
"""

from __future__ import annotations

import posixpath
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

from carvelake.operators.carve import Forward, decoder, is_prefix, is_tar, local_streams, opened, score

from .detect import member_kind

HEAD, RANGE, GROUP_BYTES, GROUP_FILES = 512, 256 << 20, 128 << 20, 1000
SCHEMA = "path string, length long, layout string, mode string, member string, method string, offset long, packed long, size long, score int, head binary, error string"
# Names of methods and of what is done with a layout.
METHODS = {0: "stored", 8: "deflated", 12: "bzip2", 14: "lzma"}
MODES = {"zip": "zip_member_extract", "streaming_zip": "streaming_zip_extract", "tar": "tar_member_extract", "pickle": "raw_pickle_file", "unknown": "unsupported"}
_TESTS = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda v, x: x in v,
}


def kept(filters: list[Filter], column: str, value) -> bool:
    """Whether a value of a column passes the pushed filters on it; null passes none."""
    own = [f for f in filters if f.attribute == (column,)]
    return all(value is not None and _TESTS[type(f)](value, f.value) for f in own)


@dataclass
class Files(InputPartition):
    """Whole files, or of one archive the members whose headers begin in a range of bytes."""

    files: list[tuple]
    start: int = 0
    end: int = 1 << 62

    def __post_init__(self):
        super().__init__(None)


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.recursive = str(options.get("recursive", "false")).lower() == "true"
        self.range = int(options.get("rangeBytes", RANGE))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("length",), ("member",)):
                self.filters.append(f)
            else:
                yield f

    def listed(self) -> list[tuple[str, int, datetime]]:
        """Path, length and time of all files that pass the filters, hidden ones left out."""
        store, inner = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        found = store.get_file_info(pafs.FileSelector(inner, recursive=self.recursive))
        prefix = self.path[: len(self.path) - len(inner.lstrip("/"))].rstrip("/") if "://" in self.path else "file://"
        files = sorted((f"{prefix}/{i.path.lstrip('/')}", i.size, i.mtime) for i in found if i.type is pafs.FileType.File and not posixpath.basename(i.path).startswith(("_", ".")))
        return [f for f in files if kept(self.filters, "path", f[0]) and kept(self.filters, "length", f[1])]

    def partitions(self) -> list[Files]:
        out, group, size = [], [], 0
        for path, length, _ in self.listed():
            if length > self.range and _begins(path, b"PK\3\4"):
                out += [Files([(path, length)], at, at + self.range) for at in range(0, length, self.range)]
                continue
            if group and (size + length > GROUP_BYTES or len(group) >= GROUP_FILES):
                out.append(Files(group))
                group, size = [], 0
            group.append((path, length))
            size += length
        return [*out, *([Files(group)] if group else [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, length in partition.files:
            try:
                with opened(path) as file:
                    for row in layout_rows(file, partition.start, partition.end, lambda name: kept(self.filters, "member", name)):
                        yield (path, length, *row)
            except Exception as e:  # noqa: BLE001 a damaged file is a row, not the end of the job
                if partition.start == 0 and kept(self.filters, "member", None):
                    yield (path, length, *_row("unknown", error=f"{type(e).__name__}: {e}"[:200]))


class ListingReader(MemberReader):
    """Paths, lengths and times only: no file is opened."""

    def partitions(self) -> list[Files]:
        files = self.listed()
        return [Files(files[k : k + GROUP_FILES * 10]) for k in range(0, len(files), GROUP_FILES * 10)]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from partition.files


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_listing"

    def schema(self) -> str:
        return "path string, length long, modified timestamp"

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))


class MemberSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MemberReader:
        return MemberReader(dict(self.options))


def _begins(path: str, magic: bytes) -> bool:
    with opened(path) as file:
        return file.read(len(magic)) == magic


def _row(layout: str, member=None, method=None, offset=None, packed=None, size=None, head: bytes = b"", error=None, mode=None) -> tuple:
    return layout, mode or MODES[layout], member, method, offset, packed, size, score(member) if member is not None else 0, bytearray(head), error


def _zip_rows(file, start: int, end: int, wanted) -> Iterator[tuple]:
    with zipfile.ZipFile(file) as z:
        for i in z.infolist():
            if i.is_dir() or not start <= i.header_offset < end or not wanted(i.filename):
                continue
            head, error = b"", None
            try:
                with z.open(i) as f:
                    head = f.read(HEAD)
            except Exception as e:  # noqa: BLE001 one bad member is a row, too
                error = f"{type(e).__name__}: {e}"[:200]
            yield _row("zip", i.filename, METHODS.get(i.compress_type, f"zip_method_{i.compress_type}"), i.header_offset, i.compress_size, i.file_size, head, error)


def layout_rows(file, start: int, end: int, wanted) -> Iterator[tuple]:
    """Rows of one seekable file. wanted: whether a member of this name (None: the file itself) is asked for."""
    head = file.read(1024)
    file.seek(0)
    if head[:4] == b"PK\3\4":
        if zipfile.is_zipfile(file):
            yield from _zip_rows(file, start, end, wanted)
        elif start == 0:  # no directory: one pass over the local headers
            file.seek(0)
            for name, body, offset, method in local_streams(Forward(file.read)):
                data, size = body.read(HEAD), 0
                while chunk := body.read(1 << 20):
                    size += len(chunk)
                if wanted(name):
                    yield _row("streaming_zip", name, METHODS.get(method, f"zip_method_{method}"), offset, None, len(data) + size, data)
    elif is_tar(head + bytes(1024)):
        with tarfile.open(fileobj=file, mode="r:") as t:
            for m in t:
                if m.isfile() and wanted(m.name):
                    yield _row("tar", m.name, "stored", m.offset, m.size, m.size, t.extractfile(m).read(HEAD))
    elif wanted(None):
        layer = decoder(Forward(file.read), head)
        if layer is not None and layer[0] != "npy":
            inner = layer[1].read(HEAD)
            error = layer[1].error
            yield _row(layer[0], method=layer[0], head=inner, mode="wrapper_payload_extract", error=str(error)[:200] if error else None)
        else:
            yield _row("pickle" if is_prefix(head) else "unknown", head=head[:HEAD])


def read_listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length and modified (time) of the files of a folder, empty ones too, which Spark's own file sources leave out."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListingSource)
    return spark.read.format("artifact_listing").option("recursive", str(recursive)).load(path)


def read_members(spark: SparkSession, path: str, **options) -> DataFrame:
    """`MemberSource` over a folder, with kind, what the head of a member or of a compressed file's contents is by its magic."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MemberSource)
    found = spark.read.format("artifact_members").options(**{k: str(v) for k, v in options.items()}).load(path)
    return found.withColumn("kind", member_kind(F.col("head")))
