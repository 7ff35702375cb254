"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least 5
positional bytes: the guaranteed minimum that the count filter asks for. Posting lists of single bytes would be as
long as n / 256, so the index posts four positions together: the 14 blocks of `BLOCKS` are such that any 5 of the 8
positions contain one of them, and no pair that could pass the filter is missed. Lists of one entry are dropped by a
pre-aggregated count before anything is compared. Each list is compared in cells of at most about two times
``CELL`` fingerprints (a longer list is split into blocks by hash and each pair of blocks is a cell), where shared
bytes are tallied, pairs under the minimum dropped and the rest verified by their differing bits. A cell reports a
spanning forest of its links, not all its pairs; equal fingerprints have been collapsed before.

Defined cases: a null text is an empty one, its fingerprint zero, and zero links like any other value; fewer words
than a shingle make one shingle; repeated rows share a component; a null doc_id takes part but never names a
component unless no other id does; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, numbered, place_of, saved, saved_map, table, text_bytes, text_crc
from .components import components

WORDS, SEED, BITS_APART = 3, 42, 3
CELL = 512

_PAIRS = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
#: Byte positions posted together. Five positions of eight have four in one half, or three in one and two in the
#: other; the three contain one of the two pairs of any perfect matching of their half.
BLOCKS = [(0, 1, 2, 3), (4, 5, 6, 7), *((*a, *(x + 4 for x in b)) for m in _PAIRS for a in m for b in m)]

_BIT_OF = np.array([[v >> k & 1 for k in range(8)] for v in range(256)], np.int64)
_POSITION = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """64-bit hashes of a text's word shingles, in order."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    return np.fromiter([hashed(line[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64, len(starts))


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    h = shingle_hashes(text, words, seed)
    if not len(h):
        return 0
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _POSITION).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BIT_OF).ravel() * 2 > len(h)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(values.view(np.int64))], ["doc_id", "crc", "hash", "print"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Saved: doc_id, the text's CRC and hash, and its fingerprint, as the signed long of the same 64 bits."""
    rows = docs.select(F.col("doc_id").cast("long"), text_crc().alias("crc"), "text", text_hash().alias("hash"))
    return saved_map(rows, _fingerprints(words, seed), "doc_id long, crc long, hash long, print long", "simhash-prints")


def text_hash(col: str = "text") -> Column:
    """Tells texts apart whose 32-bit CRCs are equal."""
    return F.xxhash64(text_bytes(col))


def _index(prints: DataFrame) -> DataFrame:
    """One posting for each block: (block and the bytes at its positions, fingerprint)."""
    keys = []
    for k, block in enumerate(BLOCKS):
        key = F.lit(k).cast("long")
        for p in block:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("print", 8 * p).bitwiseAND(F.lit(255)))
        keys.append(key)
    return prints.select("print", F.explode(F.array(*keys)).alias("posting"))


def _forest(members: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member to the least one of its component, among the members."""
    x = members[:, None] ^ members[None, :]
    shared = np.zeros(x.shape, np.uint8)
    for k in range(8):
        shared += (x >> np.uint64(8 * k) & np.uint64(255)) == 0
    linked = shared >= 8 - apart
    linked &= np.bitwise_count(x) <= apart
    label = np.arange(len(members))
    while True:
        least = np.where(linked, label[None, :], len(members)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    at = np.flatnonzero(label != np.arange(len(members)))
    return members[at], members[label[at]]


def _links(apart: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compared(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(rows)))
            prints = rows[:, 3].copy().view(np.uint64)
            two = at[size == 2]
            a, b = prints[two], prints[two + 1]
            ok = np.bitwise_count(a ^ b) <= apart
            us, vs = [a[ok]], [b[ok]]
            for k, n in zip(at[size > 2], size[size > 2]):
                u, v = _forest(np.unique(prints[k : k + n]), apart)
                us.append(u), vs.append(v)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.column_stack([c.to_numpy() for c in batch.columns]).astype(np.int64, copy=False))
            last = held[-1]
            change = np.flatnonzero((last[:, :3] != last[-1, :3]).any(axis=1))
            if len(change):
                whole, rest = last[: change[-1] + 1], last[change[-1] + 1 :]
                yield compared(np.concatenate([*held[:-1], whole]))
                held = [rest]
        if held:
            yield compared(np.concatenate(held))

    return run


def links(prints: DataFrame, apart: int = BITS_APART, cell: int = CELL) -> DataFrame:
    """Spanning links (u, v), each from a fingerprint to the least one that its cell connects it to, among distinct fingerprints (column print) at ``apart`` or fewer differing bits (3 at most)."""
    index = _index(prints)
    shared = saved(index.groupBy("posting").count().where("count > 1").selectExpr("posting", "int(ceil(count / %d)) as blocks" % cell), "simhash-lists")
    entries = index.join(shared, "posting").withColumn("mine", F.expr("int(pmod(xxhash64(print), blocks))"))
    entries = entries.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = entries.select("posting", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "print")
    cells = cells.repartition("posting", "i", "j").sortWithinPartitions("posting", "i", "j")
    return cells.mapInArrow(_links(apart), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, apart: int = BITS_APART) -> DataFrame:
    """doc_id, crc, hash, print, root, component_id of each row of ``docs`` (doc_id, text); root is the least fingerprint of a row's group, component_id the least id."""
    rows = fingerprints(docs, words, seed)
    distinct = saved(rows.groupBy("print").agg(F.min("doc_id").alias("least_doc")), "simhash-distinct")
    roots = saved(components(links(distinct.select("print"), apart)), "simhash-roots")
    rooted = distinct.join(roots, distinct.print == roots.node, "left").select("print", "least_doc", F.coalesce("root", "print").alias("root"))
    named = saved(rooted.groupBy("root").agg(F.min("least_doc").alias("component_id")), "simhash-names")
    of_print = saved(rooted.join(named, "root").select("print", "root", "component_id"), "simhash-components")
    return rows.join(of_print, "print").select("doc_id", "crc", "hash", "print", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; of each group of near duplicates the row with the smallest doc_id, once.

    Among rows of that doc_id the text with the smallest CRC stays; a row without doc_id stays only if none of its group has one.
    A group is told by its root: unrelated texts without an id, or under one id, are groups of their own.
    """
    return keep_rows(docs, near_duplicates(docs.select("doc_id", "text")))


def keep_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``keep_one`` for the groups of ``found`` (doc_id, crc, hash, root). Of rows with one id and text but other columns, the one with the smallest hash stays."""
    who = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "crc", "hash")).alias("who")
    kept = saved(found.groupBy("root").agg(who).select(F.coalesce("who.doc_id", F.lit(NO_ID)).alias("_id"), F.col("who.crc").alias("_crc"), F.col("who.hash").alias("_hash")).distinct(), "simhash-kept")
    own = numbered(docs)
    # as text, for maps have no hash; columns take part by place, whatever their names
    whole = F.xxhash64(F.to_json(F.struct(*own.columns), {"ignoreNullFields": "false"}))
    doc_id, text = (f"_in{place_of(docs, c)}" for c in ("doc_id", "text"))
    own = own.select("*", whole.alias("_whole"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"), text_crc(text).alias("_crc"), text_hash(text).alias("_hash"))
    once = own.join(kept, ["_id", "_crc", "_hash"]).withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_crc", "_hash").orderBy("_whole")))
    return once.where("_nth = 1").select(*[F.col(f"_in{k}").alias(c) for k, c in enumerate(docs.columns)])


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, str, int]]:
    """For tests: plain counting of bits and a comparison of all pairs of distinct fingerprints."""
    prints = []
    for _, text in rows:
        parts = [p for p in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if p]
        grams = [" ".join(parts[k : k + 3]) for k in range(max(len(parts) - 2, 1))] if parts else []
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    kinds = sorted(set(prints))
    root = {k: k for k in kinds}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[top(b)] = top(a)
    least: dict[int, int] = {}
    for (doc, _), p in zip(rows, prints):
        least[top(p)] = min(doc, least.get(top(p), doc))
    return [(doc, f"{p:016x}", least[top(p)]) for (doc, _), p in zip(rows, prints)]
