"""Media columns: byte payloads stored as lossless WebP images in a binary column, read back into pixel arrays.

A payload becomes the samples of a grey image ``WIDTH`` pixels wide (red = green = blue), in one file or, past the
format's height, several after another. Reading decodes the stored bytes in full; features are computed from the pixels.

Defined cases: a null text is an empty one, and its payload one row of spaces; equal texts give equal bytes and features;
repeated rows repeat; a null doc_id stays null; an empty table gives an empty table; other columns are not read. An image of 16
values or fewer is stored with a palette of bundled pixels, any other with subtract-green; both are lossless, and the values alone decide.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp
from .common import table

WIDTH, FILL = 192, 32


def stored(payload: bytes) -> bytes:
    """WebP files of a payload whose length is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(webp.encode_grey(rows[k : k + webp.SIDE]) for k in range(0, len(rows), webp.SIDE))


def pixels(media: bytes) -> np.ndarray:
    """ARGB rows of all the files in ``media``."""
    found, at = [], 0
    while at < len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little") + 8
        found.append(webp.decode(media[at : at + size]))
        at += size
    return np.concatenate(found)


def samples(image: np.ndarray) -> np.ndarray:
    """The grey samples of an image; raises if it isn't grey and opaque."""
    grey = image & np.uint32(255)
    if not (image == grey * np.uint32(0x010101) + np.uint32(0xFF000000)).all():
        raise webp.WebPError("not a grey image")
    return grey.astype(np.uint8)


def feature(grey: np.ndarray) -> str:
    """Size, mean, spread and a histogram of 16 bins, as text."""
    bins = np.bincount(grey.ravel() >> 4, minlength=16)
    n, total = grey.size, int(grey.sum(dtype=np.int64))
    square = int((grey.astype(np.int64) ** 2).sum())
    return f"{grey.shape[1]}x{grey.shape[0]};mean={1000 * total // n};var={(n * square - total * total) // (n * n)};hist={','.join(map(str, bins.tolist()))}"


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + bytes([FILL]) * (-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, size = 0, 0
        rows: list[tuple[int, bytes]] = []
        for k, text in enumerate(batch.column(1)):
            payload, n = payload_of(text.as_py())
            rows.append((n, stored(payload)))
            size += len(payload)
            if size > 8 << 20 or k + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "n_bytes", "media"])
                at, size, rows = at + len(rows), 0, []


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media, the stored form."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        out: list[list] = [[] for _ in kinds]
        for cell in batch.column(2):
            media = cell.as_py()
            grey = samples(pixels(media))
            back = grey.tobytes()
            for o, v in zip(out, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(grey))):
                o.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(o, t) for o, t in zip(out, kinds))], ["doc_id", "n_bytes", *names])


def read_media(rows: DataFrame) -> DataFrame:
    """Digests and features of the payloads read back from (doc_id, n_bytes, media)."""
    return rows.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(store_documents(table(spark, sf_dir, "documents")))
