"""Near duplicates by similarity: groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The method is op8's, a byte-position index with count filtering, over other bytes: a 64-bit SimHash does not reach 0.8, for about 9.7
of its bits differ there, so that each of the 8 bytes agrees with a chance of 0.27 only. Here a text has ``BYTES`` bytes, one for each of as many
minimum hashes of its shingles; each agrees with a chance of the similarity (and 1/256 of the rest).

1. Texts with equal sets are collapsed. The index posts ``BANDS`` blocks of ``ROWS`` byte positions; a pair at similarity s shares no list
   with a chance of (1 - s^5)^40, which is 1.3e-7 at 0.8 and less above.
2. In each list, every member is paired with the list's hub, the member that shares most lists with others. A pair is retained if it shares
   ``LEAST`` positional bytes (a pair at 0.8 shares 160 on average; fewer than 128 with a chance below 1e-7), then verified on
   the whole shingle sets (64-bit hashes), so no link is an estimate. The links give components.
3. Lists whose members are still in several components are compared in cells of about ``CELL`` members against as many: the bytes that each pair of
   different components shares are tallied inside the task, at the first list that both share. Members with a partner that reaches ``LEAST`` are
   compared in cells once more, now with their shingle sets, and the task verifies the pairs itself until its components are joined. So no pair leaves a task, only
   a link for each two components that are joined. Members of the commonest component are compared with the others only.

Defined cases: a text without words has the empty set, and all of those are one group; fewer words than a shingle make
one shingle; a null text is an empty one; repeated rows and other texts of an equal set are one group; of a group the row with the least doc_id stays, among those
of that id the text with the smallest CRC and hash, and of rows that agree in both the first in the order of all their other columns; rows
without an id take part, and one stays where none of its group has an id; an empty table gives an empty table; other columns, of any name and type, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_batch, saved, saved_map, text_crc
from .components import components
from .simhash import SEED, keep_rows, shingle_hashes, text_hash

WORDS, BANDS, ROWS = 5, 40, 5
BYTES = BANDS * ROWS
#: A pair is linked where NEAR[1] * shared >= NEAR[0] * union: 0.8.
NEAR = (4, 5)
LEAST, CELL = 128, 1024
#: Hashes of the sets that lie on one side of a cell, about.
SHINGLES = 1 << 20
#: Members that one task verifies against one hub.
AT_ONCE = 512
_PART = 4096
_MIX = np.random.default_rng(SEED).integers(0, 2**63, (2, BYTES, 1), np.uint64) | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    return np.unique(shingle_hashes(text, WORDS, SEED))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A byte for each of BYTES minimum hashes."""
    least = np.full(BYTES, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), _PART):
        least = np.minimum(least, ((shingles[None, k : k + _PART] ^ _MIX[0]) * _MIX[1]).min(axis=1))
    return ((least ^ least >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8)


def bands(own: np.ndarray) -> np.ndarray:
    """Number of each block of byte positions and the bytes there."""
    blocks = own.reshape(BANDS, ROWS).astype(np.int64)
    key = np.arange(BANDS, dtype=np.int64)
    for k in range(ROWS):
        key = key << 8 | blocks[:, k]
    return key


def _print(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in cut_batch(whole, 3)):
        sets = [shingle_set(t.as_py()) for t in batch.column(3)]
        own = [sketch(s) for s in sets]
        ends = np.cumsum([0, *(BANDS if len(s) else 0 for s in sets)])
        found = np.concatenate([np.empty(0, np.int64), *(bands(b) for s, b in zip(sets, own) if len(s))])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], _signed([_print(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), pa.array([b.tobytes() for b in own], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))],
            ["doc_id", "crc", "hash", "print", "size", "sketch", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in cut_batch(whole, 1)):
        sets = [shingle_set(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["print", "shingles"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return NEAR[1] * shared >= NEAR[0] * (len(a) + len(b) - shared)


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v, a, b) whose sketches a and b share LEAST positional bytes."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BYTES) for k in (2, 3))
        ok = pa.array((a == b).sum(axis=1) >= LEAST)
        yield pa.RecordBatch.from_arrays([c.filter(ok) for c in batch.columns[:2]], ["u", "v"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, part, u, shingles), sorted: the hub's own set (u null), then those of its partners."""
    hub, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        us, vs = [], []
        for v, u, cell in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            shingles = np.frombuffer(cell.as_buffer(), np.uint64)
            if u is None:
                hub, own = v, shingles.copy()
            elif v == hub and similar(own, shingles):
                us.append(u), vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _shingle_sets(needed: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Saved: print and shingles, the whole set of hashes, of each of the prints ``needed``."""
    one = rows.join(needed, "print").groupBy("print").agg(F.min(F.struct("crc", "hash")).alias("of")).select("print", "of.crc", "of.hash")
    texts = docs.select(text_crc().alias("crc"), text_hash().alias("hash"), "text").join(one, ["crc", "hash"])
    # texts of one CRC and hash that yet differ would have other prints; of equal ones the least is taken
    texts = texts.groupBy("crc", "hash", "print").agg(F.min("text").alias("text"))
    return saved_map(texts.select("print", "text"), _sets, "print long, shingles binary", "similar-sets")


def _links(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v: prints) whose shingle sets are similar. A hub v with many partners is sent to several tasks."""
    sets = _shingle_sets(pairs.select(F.col("u").alias("print")).union(pairs.select("v")).distinct(), rows, docs)
    parts = saved(pairs.groupBy("v").agg(F.expr(f"int(ceil(count(*) / {AT_ONCE}))").alias("parts")), "similar-hubs")
    partners = pairs.join(parts, "v").withColumn("part", F.expr("int(pmod(xxhash64(u), parts))")).join(sets.withColumnRenamed("print", "u"), "u").select("v", "part", "u", "shingles")
    hubs = parts.join(sets.withColumnRenamed("print", "v"), "v").select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("u"), "shingles")
    dealt = hubs.unionByName(partners).repartition("v", "part").sortWithinPartitions("v", "part", F.asc_nulls_first("u"))
    return saved_map(dealt, _verified, "u long, v long", "similar-links")


def _retained(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Pairs (u, v, n, m: prints and sizes), once each, whose sizes and shared bytes allow the similarity."""
    pairs = pairs.where(f"u <> v and {NEAR[1]} * least(n, m) >= {NEAR[0]} * greatest(n, m)").select("u", "v").distinct()
    own = lambda name, column: distinct.select(F.col("print").alias(name), F.col("sketch").alias(column))
    return saved_map(pairs.join(own("u", "a"), "u").join(own("v", "b"), "v").select("u", "v", "a", "b"), _enough, "u long, v long", "similar-pairs")


class _Cell:
    """Members of a list side by side: all against all (i < 0), or those of the commonest component (side 0) against the others (side 1)."""

    def __init__(self, key: tuple, rows: list[tuple]):
        self.band, self.within = key[0], key[1] < 0
        self.side, self.prints, self.roots, self.sizes = (np.array(x, np.int64) for x in list(zip(*rows))[:4])
        self.bytes = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, BYTES)
        self.sets = [r[5] for r in rows] if len(rows[0]) > 5 else []

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """A member and those others that share LEAST positional bytes with it, lie in other components and meet it here first."""
        right = np.arange(len(self.prints)) if self.within else np.flatnonzero(self.side == 0)
        for k in range(len(self.prints)) if self.within else np.flatnonzero(self.side == 1).tolist():
            ok = (self.roots[right] != self.roots[k]) & (NEAR[1] * np.minimum(self.sizes[right], self.sizes[k]) >= NEAR[0] * np.maximum(self.sizes[right], self.sizes[k]))
            at = right[ok & (self.prints[right] < self.prints[k])] if self.within else right[ok]
            equal = self.bytes[at] == self.bytes[k]
            shared = equal.sum(axis=1)
            enough = np.flatnonzero(shared >= LEAST)
            if len(enough):
                first = equal[enough].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                enough = enough[first == self.band >> 8 * ROWS]
                yield k, at[enough[np.argsort(-shared[enough], kind="stable")]]

    def compared(self) -> np.ndarray:
        """The members that have candidates."""
        seen = np.zeros(len(self.prints), bool)
        for k, at in self.candidates():
            seen[at] = True
            seen[k] |= len(at) > 0
        return self.prints[seen]

    def links(self) -> tuple[list[int], list[int]]:
        """Verified links that join all components that any candidates here join; pairs that are joined by then are not looked at."""
        top = {r: r for r in self.roots.tolist()}

        def of(k: int) -> int:
            r = int(self.roots[k])
            while top[r] != r:
                top[r] = r = top[top[r]]
            return r

        us, vs = [], []
        for k, at in self.candidates():
            for m in at.tolist():
                if of(k) != of(m) and similar(self.sets[k], self.sets[m]):
                    top[of(k)] = of(m)
                    us.append(int(self.prints[k])), vs.append(int(self.prints[m]))
        return us, vs


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[_Cell]:
    """Rows (band, i, j, side, print, root, size, sketch and perhaps shingles), sorted by their cell."""
    key: tuple | None = None
    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(8)]
        if batch.num_columns > 8:
            columns.append([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(8)])
        for band, i, j, *row in zip(*columns):
            if (band, i, j) != key:
                if held:
                    yield _Cell(key, held)
                key, held = (band, i, j), []
            held.append(tuple(row))
    if held:
        yield _Cell(key, held)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell in _each_cell(batches):
        found = cell.compared()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), cell.band)), pa.array(found)], ["band", "print"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cell in _each_cell(batches):
        us, vs = cell.links()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _mixed(members: DataFrame) -> DataFrame:
    """``members`` (band, print, size, root) of lists with several components, with the commonest, main, and in how many blocks its members and the others are dealt."""
    parts = members.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    lists = parts.groupBy("band").agg(F.max(F.struct("n", "root", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(n / CELL), F.ceil(w / SHINGLES)).cast("int")
    lists = lists.select("band", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.w")).alias("b_main"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("b_other"), (F.col("n") - F.col("main.n")).alias("n_other"))
    return members.join(saved(lists, "similar-mixed"), "band")


def _cells(members: DataFrame, more: list[str]) -> DataFrame:
    """``members`` of `_mixed` with sketch and ``more`` columns, once for each cell that they are compared in."""
    rows = members.withColumn("common", F.col("root") == F.col("main"))
    block = "int(pmod(xxhash64(print), {}))"
    rows = rows.selectExpr("*", f"if(common, {block.format('b_main')}, {block.format('b_other')}) as mine")
    upto = lambda n: F.expr(f"sequence(0, {n} - 1)")
    kept = ["print", "root", "size", "sketch", *more]
    common = rows.where("common").withColumn("j", F.explode(upto("b_other"))).select("band", F.col("mine").alias("i"), "j", F.lit(0).alias("side"), *kept)
    others = rows.where("not common")
    against = others.withColumn("i", F.explode(upto("b_main"))).select("band", "i", F.col("mine").alias("j"), F.lit(1).alias("side"), *kept)
    among = others.where("n_other > 1").withColumn("other", F.explode(upto("b_other")))
    among = among.selectExpr("band", "-1 - least(mine, other) as i", "greatest(mine, other) as j", "1 as side", *kept)
    cells = common.unionByName(against).unionByName(among)
    return cells.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")


def _left_links(members: DataFrame, distinct: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between different components of the ``members`` (band, print, size, root) of any list."""
    sketched = _mixed(members).join(distinct.select("print", "sketch"), "print")
    near = saved_map(_cells(sketched, []), _compared, "band long, print long", "similar-near")
    # of what is left, those that any sketch is near to are verified, in cells again, so that no pair travels
    near = saved(members.join(near.distinct(), ["band", "print"]), "similar-left")
    sets = _shingle_sets(near.select("print").distinct(), rows, docs)
    whole = _mixed(near).join(distinct.select("print", "sketch"), "print").join(sets, "print")
    return saved_map(_cells(whole, ["shingles"]), _joined, "u long, v long", "similar-left-links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, crc, hash, root of each row of ``docs`` (doc_id, text); root tells its group."""
    rows = docs.select(F.col("doc_id").cast("long"), text_crc().alias("crc"), text_hash().alias("hash"), "text")
    rows = saved_map(rows, _signatures, "doc_id long, crc long, hash long, print long, size long, sketch binary, bands array<long>", "similar-rows")
    distinct = saved(rows.groupBy("print").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "similar-distinct")
    postings = distinct.select("print", "size", F.explode("bands").alias("band"))
    lists = postings.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    shared = saved(postings.join(lists, "band"), "similar-lists")
    weights = shared.groupBy("print").agg(F.sum("members").alias("weight"))
    hubs = shared.join(weights, "print").groupBy("band").agg(F.max(F.struct("weight", "print", "size")).alias("hub"))
    pairs = shared.join(hubs, "band").selectExpr("print as u", "hub.print as v", "size as n", "hub.size as m")
    tried = _retained(pairs, distinct)
    links = _links(tried, rows, docs)
    roots = saved(components(links), "similar-roots")

    rooted = saved(shared.select("band", "print", "size").join(roots, F.col("print") == roots.node, "left").select("band", "print", "size", F.coalesce("root", "print").alias("root")), "similar-rooted")
    roots = saved(components(links.union(_left_links(rooted, distinct, rows, docs))), "similar-groups")
    return rows.select("doc_id", "crc", "hash", "print").join(roots, F.col("print") == roots.node, "left").select("doc_id", "crc", "hash", F.coalesce("root", "print").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; one row of each group, chosen as ``keep_rows`` says."""
    return keep_rows(docs, near_duplicates(docs.select("doc_id", "text")))
