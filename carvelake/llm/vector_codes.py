"""Vector code compression: product quantisation by whole numbers, fitted with treeAggregate over columnar blocks.

Vectors become integers and are gathered into blocks: one NumPy array of a block's vectors, component by component, of at
most ``BLOCK_BYTES``. Blocks are written once; each round reads them as an RDD, adds up the distances of all vectors to a part's entries one
dimension after the other, picks the nearest entries and adds the vectors to int64 tensors of sums and counts
(``np.add.at``). The tensors, a few kilobytes a task whatever the number of rows, meet in a reduction tree; only the last one reaches the
driver, which sends the next codebooks out with the tasks. Everything is exact: no order of rows, blocks or merges changes a result.

Defined cases: vectors that are null or hold null or non-finite components are dropped; components are clipped to 2**27 on
either side after scaling (an x of 32768), so that squares stay within 64 bits; vectors of each length have codebooks of
their own, and parts of lengths that 8 doesn't divide differ by one component at most (the longer ones first; parts may be empty); more
than ``MOST_LENGTHS`` lengths are an error, for then the tensors would grow with the data; fewer than 16 vectors make fewer entries; null ids
come after all others, and rows of the same id are ordered by their components; repeated rows repeat and count each;
label errors beyond 64 bits are null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import saved_map, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
MOST, MOST_LENGTHS = 1 << 27, 64
BLOCK_BYTES = 1 << 20

#: For each length of vectors: for each part an array (entries, components).
Codebooks = dict[int, list[np.ndarray]]


def usable(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose vector and components are neither null nor non-finite."""
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return rows.where(F.coalesce(finite, F.lit(False)))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch.column(2)
        lengths = np.diff(vectors.offsets.to_numpy())
        values = whole_numbers(vectors.values.to_numpy(zero_copy_only=False))
        starts = vectors.offsets.to_numpy()[:-1]
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            step = max(1, BLOCK_BYTES // (4 * max(1, length)))
            for k in range(0, len(at), step):
                own = at[k : k + step]
                block = values[starts[own][None, :] + np.arange(length)[:, None]].astype("<i4")
                cells = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), c.take(pa.array(own))) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays([pa.array([length], pa.int64()), *cells, pa.array([block.tobytes()], pa.binary())], ["length", "vec_ids", "labels", "block"])


def column_blocks(rows: DataFrame) -> DataFrame:
    """Saved: length, vec_ids, labels and block (little-endian int32, component by component) of rows (vec_id, label, vector)."""
    label = rows.schema["label"].dataType
    kind = StructType([StructField("length", LongType()), StructField("vec_ids", ArrayType(LongType())), StructField("labels", ArrayType(label)), StructField("block", BinaryType())])
    rows = rows.select("vec_id", "label", F.col("vector").cast("array<double>"))
    return saved_map(rows, _blocks, kind, "vector-blocks")


def part_edges(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    own, more = divmod(length, parts)
    ends = [k * own + min(k, more) for k in range(parts + 1)]
    return list(zip(ends, ends[1:]))


def part_blocks(row, parts: int = PARTS) -> list[np.ndarray]:
    """The parts of a block: for each an array (components, vectors)."""
    block = np.frombuffer(row.block, "<i4").reshape(row.length, len(row.vec_ids)).astype(np.int64)
    return [block[a:b] for a, b in part_edges(row.length, parts)]


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of a part (components, vectors) the index of its nearest entry, ties to the lower, and the squared distance."""
    far = np.zeros((len(entries), part.shape[1]), np.int64)
    for column, places in zip(part, entries.T):
        apart = column[None, :] - places[:, None]
        far += apart * apart
    code = far.argmin(axis=0)
    return code, far[code, np.arange(part.shape[1])]


Start = dict[int, list[tuple]]


def _first_of_block(found: Start, row, entries: int) -> Start:
    block = np.frombuffer(row.block, "<i4").reshape(row.length, len(row.vec_ids))
    ids = np.array([2**63 - 1 if x is None else x for x in row.vec_ids], np.int64)
    # ids up to the last that may count, those equal to it included
    last = np.partition(ids, entries - 1)[entries - 1] if len(ids) > entries else 2**63 - 1
    own = [(row.vec_ids[k] is None, row.vec_ids[k] or 0, tuple(block[:, k].tolist())) for k in np.flatnonzero(ids <= last).tolist()]
    return _first_of_both(found, {row.length: own}, entries)


def _first_of_both(a: Start, b: Start, entries: int) -> Start:
    out = {length: sorted(a.get(length, []) + b.get(length, []))[:entries] for length in a.keys() | b.keys()}
    if len(out) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    return out


#: For each length: for each part the sums (components, entries) and the counts (entries).
Tensors = dict[int, list[tuple[np.ndarray, np.ndarray]]]


def _add_block(found: Tensors, row, books: Codebooks) -> Tensors:
    book = books[row.length]
    if row.length not in found:
        found[row.length] = [(np.zeros(e.shape[::-1], np.int64), np.zeros(len(e), np.int64)) for e in book]
    for part, entries, (sums, counts) in zip(part_blocks(row, len(book)), book, found[row.length]):
        code, _ = nearest(part, entries)
        np.add.at(counts, code, 1)
        for own, column in zip(sums, part):
            np.add.at(own, code, column)
    return found


def _add_both(a: Tensors, b: Tensors) -> Tensors:
    for length, parts in b.items():
        if length in a:
            for (sums, counts), (more, n) in zip(a[length], parts):
                sums += more
                counts += n
        else:
            a[length] = parts
    return a


def start_codebooks(blocks: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors with the least ids."""
    found = blocks.rdd.treeAggregate({}, partial(_first_of_block, entries=entries), partial(_first_of_both, entries=entries))
    return {length: [np.array([v[2][a:b] for v in own], np.int64).reshape(len(own), b - a) for a, b in part_edges(length, parts)] for length, own in found.items()}


def refined(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the floor of the mean of the parts nearest to it; entries without any stay."""
    found = blocks.rdd.treeAggregate({}, partial(_add_block, books=books), _add_both)
    out: Codebooks = {}
    for length, parts in found.items():
        out[length] = [np.where(counts[:, None] > 0, sums.T // np.maximum(counts, 1)[:, None], old) for (sums, counts), old in zip(parts, books[length])]
    return out


def fit_codebooks(blocks: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    books = start_codebooks(blocks, parts, entries)
    for _ in range(rounds if books else 0):
        books = refined(blocks, books)
    return books


def codebook_digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for entries in book for x in entries.ravel().tolist()).encode()).hexdigest()


def encode_blocks(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """Saved: vec_id, label, code (two hex digits a part), error and codebooks_sha256 of each vector."""
    label = blocks.schema["labels"].dataType.elementType
    prints = {length: codebook_digest(book) for length, book in books.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                length, ids, labels, block = (c[row] for c in batch.columns)
                book, n = books[length.as_py()], len(ids)
                data = np.frombuffer(block.as_py(), "<i4").reshape(length.as_py(), n).astype(np.int64)
                codes, error = np.zeros((n, len(book)), np.uint8), np.zeros(n, np.int64)
                for k, ((a, b), entries) in enumerate(zip(part_edges(length.as_py(), len(book)), book)):
                    codes[:, k], far = nearest(data[a:b], entries)
                    error += far
                text = codes.tobytes().hex()
                width = 2 * len(book)
                code = pa.array([text[k * width : (k + 1) * width] for k in range(n)], pa.string())
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, code, pa.array(error), pa.array([prints[length.as_py()]] * n, pa.string())], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kind = StructType([StructField("vec_id", LongType()), StructField("label", label), StructField("code", StringType()), StructField("error", LongType()), StructField("codebooks_sha256", StringType())])
    return saved_map(blocks, run, kind, "vector-codes")


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the errors of all rows of an equal label; the sums are made before anything is dealt by label."""
    sums = codes.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def compress_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256 and label_error of the usable rows of (vec_id, label, vector)."""
    kept = usable(rows, vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col(vector).alias("vector"))
    blocks = column_blocks(kept)
    return with_label_error(encode_blocks(blocks, fit_codebooks(blocks)))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compress_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _rounds_sql() -> str:
    """Six rounds, one after the other, over rows (vec_id, part, place, value)."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
far{k} AS MATERIALIZED (SELECT x.vec_id, x.part, b.entry, sum((x.value - b.value) * (x.value - b.value)) AS far FROM x JOIN book{k} b USING (part, place) GROUP BY ALL),
near{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, far * {ENTRIES} + entry) AS entry, min(far) AS far FROM far{k} GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(m.value, b.value) AS value FROM book{k} b LEFT JOIN
  (SELECT part, entry, place, floor(sum(value)::HUGEINT / count(*))::BIGINT AS value FROM x JOIN near{k} USING (vec_id, part) GROUP BY ALL) m USING (part, entry, place))""")
    return ",".join(steps)


OP13_SQL = f"""
WITH kept AS (SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS width FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (SELECT vec_id, (k - 1) // width AS part, (k - 1) % width AS place, floor({SCALE}.0::DOUBLE * v::DOUBLE)::BIGINT AS value FROM (SELECT vec_id, width, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}),
book0 AS MATERIALIZED (SELECT part, entry, place, value FROM x JOIN first USING (vec_id)),{_rounds_sql()},
codes AS (SELECT vec_id, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(value::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{ROUNDS}) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
"""
