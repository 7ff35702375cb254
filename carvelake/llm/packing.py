"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents become pieces in one scan. The pieces are dealt evenly over tasks; each task takes its pieces longest first
and packs them online by bounded-space best fit: bins are kept in stacks by free space, a bitset over the free
spaces finds the tightest bin that still fits in one operation, and when ``open_bins`` bins are open the fullest
closes. Bins that end with more than a quarter free are packed once more, as items, over all tasks; the pieces
follow their bin by a join. Tasks hold at most ``open_bins`` bins and one batch of pieces, and no task sees more than
about ``PER_TASK`` pieces.

Defined cases: a null or empty text is the end token alone; a document longer than a sequence is cut from its end, so
that only its first piece may be shorter than a sequence; equal lengths are ordered by doc_id and piece; repeated
rows are packed as often as they occur; a null doc_id stays null; an empty table gives an empty table. Texts with
white space of ``LONG_SPACE`` characters or more are encoded by the tokenizers library, all others by tiktoken from the
same vocabulary; tests hold both to the same ids.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import saved, saved_map, table

MAX_TOKENS, END_ID, OPEN_BINS, PER_TASK = 2048, 0, 8192, 16_000
#: A vocabulary, as a rank file and as a tokenizers file: VOCABULARY.tiktoken and VOCABULARY.json.
VOCABULARY = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}
#: White space that is as long goes to the tokenizers library: the other one's pattern gives up somewhere beyond half a million.
LONG_SPACE = 20_000
_SPACES = re.compile(r"\s{2,}")


@lru_cache(maxsize=2)
def _ranks(name: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache(maxsize=2)
def _library(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def token_ids(text: str | None, name: str = VOCABULARY) -> np.ndarray:
    """Ids as the tokenizers library gives them without added special tokens: the special token's own string is its id.

    tiktoken gives the same ids, as tests hold, in less than a third of the time.
    """
    text = text or ""
    if len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in _SPACES.finditer(text)):
        return np.array(_library(name).encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(_ranks(name).encode(text, allowed_special="all"), "<u4")


def _pieces(max_tokens: int, end_id: int, name: str, keep_ids: bool):
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = token_ids(text.as_py(), name).tobytes() + end
                n = len(raw) // 4
                edges = [0, *range(n % max_tokens or max_tokens, n + 1, max_tokens)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = raw[4 * a : 4 * b]
                    for o, v in zip(out, (doc, k, a, b - a, zlib.crc32(part), np.frombuffer(part, "<i4") if keep_ids else None)):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names)

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def tokenised_pieces(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, name: str = VOCABULARY) -> DataFrame:
    """All pieces of all documents, with their ids."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(max_tokens, end_id, name, True), PIECES)


class BestFit:
    """Online best fit with a bounded number of open bins."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.limit = size, open_bins
        self.free: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space
        self.bits = 0  # of the free spaces that have bins
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        bin_ = self.free[space].pop()
        if not self.free[space]:
            self.bits ^= 1 << space
        self.open -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset of the next item."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            bin_, space = self.made, self.size
            self.made += 1
        if left := space - length:
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.size - space


def _packed(max_tokens: int, open_bins: int, level: int, carried: list[str]):
    """Adds bin and offset to each row (length, *carried); bins are numbered apart by level and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = level << 62 | TaskContext.get().partitionId() << 36
        pack = BestFit(max_tokens, open_bins)
        for batch in batches:
            at = np.array([pack.put(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), batch.column("length"), pa.array(at[:, 0] + base), pa.array(at[:, 1])], [*carried, "length", "bin", "offset"])

    return run


def _dealt(rows: DataFrame, *ties: str) -> DataFrame:
    n = rows.count()
    return rows.repartition(max(1, -(-n // PER_TASK))).sortWithinPartitions(F.desc("length"), *ties)


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for saved ``pieces``."""
    carried = ["doc_id", "piece", "start", "ids_crc32"]
    schema = "doc_id long, piece int, start long, ids_crc32 long, length long, bin long, offset long"
    first = saved_map(_dealt(pieces.select("length", *carried), "doc_id", "piece", "ids_crc32"), _packed(max_tokens, open_bins, 0, carried), schema, "packing-first")
    used = first.groupBy("bin").agg(F.sum("length").alias("length")).where(F.col("length") <= max_tokens * 3 // 4)
    loose = saved(used.withColumnRenamed("bin", "loose"), "packing-loose")
    second = saved_map(_dealt(loose, "loose"), _packed(max_tokens, open_bins, 1, ["loose"]), "loose long, length long, bin long, offset long", "packing-second")
    moved = second.select("loose", F.col("bin").alias("new_bin"), F.col("offset").alias("shift"))
    joined = first.join(moved, first.bin == moved.loose, "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("new_bin", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, name: str = VOCABULARY, open_bins: int = OPEN_BINS) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return pack(saved_map(texts, _pieces(max_tokens, end_id, name, False), PIECES, "packing-pieces").drop("ids"), max_tokens, open_bins)


def sequences(docs: DataFrame, packed: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, name: str = VOCABULARY) -> DataFrame:
    """sequence_id and the ids of each packed sequence; a group is one sequence, so never longer than ``max_tokens``."""
    keyed = tokenised_pieces(docs, max_tokens, end_id, name).dropDuplicates(["doc_id", "piece", "start", "ids_crc32"]).select("doc_id", "piece", "start", "ids_crc32", "ids")
    rows = packed.join(keyed, ["doc_id", "piece", "start", "ids_crc32"])
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x.ids)).alias("ids"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
