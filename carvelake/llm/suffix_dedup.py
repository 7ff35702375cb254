"""Exact removal of repeated substrings by a sampled, range-partitioned suffix array.

A byte goes if a string of ``span`` bytes that covers it also starts at another place of the corpus. Sorting a suffix
for every byte of a corpus would move ``span`` times the corpus, so the suffixes to be sorted are sampled by content. All three
rounds are the same operation on suffix records (`_sorted`): Spark samples splitters and range-partitions
the records by their leading tokens; each bucket is sorted locally by multikey quicksort; neighbours in that order are
compared, within a bucket and across bucket boundaries.

1. *Suffixes at sampled places.* Each window of ``span`` bytes is owned by the smallest fingerprint among the
   ``seeds[0]``-byte strings in it (`rolling.owned_runs`); a run of windows with one owner is one suffix record. Its
   tokens are the owner's fingerprint and a 128-bit digest of the bytes that the run covers. Equal windows have equal owners, so a
   record whose neighbours have other owners holds no repeat. Records that agree in all tokens repeat as a whole.
   Where the records of one owner differ, one of each kind stays open.
2. The same for what is open, with the longer ``seeds[1]``.
3. *All suffixes of what is still open.* One record for each window start: the first 8 bytes, big-endian, and the
   fingerprints of three blocks up to ``span`` bytes. Neighbours that agree in all four share ``span`` bytes.

Buckets: their number follows from the number of records, so that each holds about ``PER_BUCKET``. The last key of the
range is a hash of the place, so equal suffixes, however many, are spread over buckets. In rounds 1 and 2 the first and
last owner of a bucket, which may go on in the next one, stay open; in round 3 the first and last suffix of each bucket are
compared with those of all others. Equal suffixes of one batch travel as one record with a packed list of places. No step gathers a group.

Defined cases: a null or empty text has no bytes and loses none; texts shorter than ``span`` lose nothing; a repeated
row counts as another place, so all its windows go; equal doc_ids with different texts are kept apart by the text's
CRC; a null doc_id is an id like any other; an empty table gives an empty table; further columns are kept by
`remove_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from . import rolling
from .common import NO_ID, cut_batch, numbered, place_of, saved, saved_map, table, text_bytes, text_crc

SPAN = 200
SEEDS = (64, 168)
#: Bytes fingerprinted at a time; longer texts are cut into overlapping pieces, which finds the same windows.
CHUNK = 1 << 20
#: Records that one bucket holds and sorts, about.
PER_BUCKET = 250_000
#: Places that one record carries; a string with more of them in a batch is several records, so that records are about equally long.
MOST_PLACES = 32
#: Segments of fewer records are sorted at once.
SMALL = 4096
#: A place: document, text, start of the slice, first and last window start (offsets in the document).
PLACE = np.dtype([("doc_id", "<i8"), ("crc", "<i8"), ("at", "<i4"), ("first", "<i4"), ("last", "<i4")])
PLACES = "doc_id long, crc long, at int, first int, last int"
REPEATED, OPEN, EDGE = range(3)


def _pieces(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Byte strings of at most CHUNK bytes together, with (doc_id, crc, at, offset in the document) of each."""
    parts: list[bytes] = []
    ids: list[tuple[int, int, int, int]] = []
    size = 0
    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        for (doc, crc, at), data in zip(keys, batch.column(3)):
            raw = data.as_buffer() if data.is_valid else b""
            for cut in range(0, max(len(raw) - span + 1, 0), CHUNK):
                part = bytes(raw[cut : cut + CHUNK + span - 1])
                parts.append(part)
                ids.append((doc, crc, at, at + cut))
                size += len(part)
                if size >= CHUNK:
                    yield parts, np.array(ids, np.int64)
                    parts, ids, size = [], [], 0
    if parts:
        yield parts, np.array(ids, np.int64)


def _places(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    out = np.empty(len(first), PLACE)
    for name, value in zip(PLACE.names, (*ids.T[:3], first, last)):
        out[name] = value
    return out


def _packed(tokens: list[np.ndarray], places: np.ndarray) -> pa.RecordBatch:
    """A record for every MOST_PLACES places of each distinct tuple of ``tokens``: the tuple, a hash of the record's first place and its places."""
    joint = tokens[0]
    for c in tokens[1:]:
        joint = rolling.mix(joint * np.uint64(rolling.BASE) + c)
    order = np.argsort(joint, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in tokens])
    begin = np.flatnonzero(new)
    new |= (np.arange(len(order)) - begin[np.cumsum(new) - 1]) % MOST_PLACES == 0
    at = np.flatnonzero(new)
    offsets = (np.append(at, len(order)) * PLACE.itemsize).astype(np.int32)
    places = places[order]
    packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(places)])
    lead = places[at]
    salt = rolling.mix(lead["doc_id"].view(np.uint64) * np.uint64(rolling.BASE) + lead["first"].astype(np.uint64))
    columns = [pa.array(c[order][at].view(np.int64)) for c in tokens]
    return pa.RecordBatch.from_arrays([*columns, pa.array(salt.view(np.int64)), packed], [*(f"t{k}" for k in range(len(tokens))), "salt", "places"])


def _digests(buf: rolling.Buffer, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """128-bit digests of data[first:end], elementwise, as two numbers each."""
    data, digest = memoryview(buf.data), hashlib.blake2b
    joined = b"".join([digest(data[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist())])
    return list(np.frombuffer(joined, np.uint64).reshape(-1, 2).T.copy())


def _runs(span: int, seed: int):
    """Suffix records at sampled places: tokens are the owner and the digest of the run."""

    def run(batches):
        for parts, ids in _pieces(batches, span):
            buf = rolling.Buffer(parts)
            owner, first, last, _ = rolling.owned_runs(buf, span, seed)
            if len(first):
                part = buf.part_of(first)
                shift = ids[part, 3] - buf.starts[part]
                yield _packed([owner, *_digests(buf, first, last + span)], _places(ids[part], first + shift, last + shift))

    return run


def _windows(span: int):
    """Suffix records at all window starts: tokens are the first 8 bytes and the fingerprints of three blocks."""
    edges = [8, *(8 + (span - 8) * k // 3 for k in (1, 2, 3))]

    def run(batches):
        for parts, ids in _pieces(batches, span):
            buf = rolling.Buffer(parts)
            at = buf.inside(span)
            part = buf.part_of(at)
            lead = np.zeros(len(at), np.uint64)
            for k in range(8):
                lead = (lead << np.uint64(8)) | buf.data[at + k].astype(np.uint64)
            lead ^= np.uint64(1 << 63)  # so that signed order is byte order
            second = buf.second_sums()
            blocks = [buf.prints(at + a, at + b, second if k else None) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            start = at - buf.starts[part] + ids[part, 3]
            yield _packed([lead, *blocks], _places(ids[part], start, start))

    return run


def multikey_quicksort(keys: list[np.ndarray], small: int = SMALL) -> np.ndarray:
    """Order of the records by their tokens: each step splits a segment at a pivot of one token into less, equal and greater; the equal part goes on with the next token."""
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        own = order[a:b]
        if b - a <= small:
            order[a:b] = own[np.lexsort([k[own] for k in reversed(keys[depth:])])]
            continue
        token = keys[depth][own]
        sample = np.sort(token[:: max(1, len(token) // 64)])
        pivot = sample[len(sample) // 2]
        less, more = token < pivot, token > pivot
        same = own[~(less | more)]
        less, more = own[less], own[more]
        order[a:b] = np.concatenate([less, same, more])
        todo += [(a, a + len(less), depth), (b - len(more), b, depth)]
        if depth + 1 < len(keys):
            todo.append((a + len(less), b - len(more), depth + 1))
    return order


def _same(columns: list[np.ndarray]) -> np.ndarray:
    """For each record, whether it agrees with the one before in all columns."""
    found = np.zeros(len(columns[0]), bool)
    found[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return found


def _totals(same: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each record, the number of its group of neighbours and the sum of ``n`` over that group."""
    group = np.cumsum(~same) - 1
    return group, np.bincount(group, n).astype(np.int64)[group]


def _bucket(tokens: int, sampled: bool):
    """Sorts a bucket and compares neighbours. Rows out: kind, places, and for edges the tokens and the number of places."""

    def run(batches):
        whole = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
        if whole is None:
            return
        whole = whole.drop_columns(["salt"]).combine_chunks()
        keys = [whole.column(k).to_numpy() for k in range(tokens)]
        order = multikey_quicksort(keys)
        keys = [k[order] for k in keys]
        packed = whole.column(tokens)
        n = pc.binary_length(packed).to_numpy()[order] // PLACE.itemsize
        same = _same(keys)
        group, total = _totals(same, n)
        first = ~same

        def rows(kind: int, at: np.ndarray, lead_only: bool, edge: bool = False):
            for part in np.array_split(at, len(at) // 20_000 + 1):
                if len(part):
                    places = packed.take(pa.array(order[part])).combine_chunks()
                    if lead_only:
                        places = pc.binary_slice(places, 0, PLACE.itemsize)
                    cells = [pa.array(k[part]) if edge else pa.nulls(len(part), pa.int64()) for k in (*keys, total)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), places, *cells], ["kind", "places", *(f"t{k}" for k in range(tokens)), "n"])

        yield from rows(REPEATED, np.flatnonzero(total > 1), False)
        if sampled:
            owners, _ = _totals(_same(keys[:1]), n)
            kinds = np.bincount(owners[first])[owners]
            yield from rows(OPEN, np.flatnonzero(first & ((kinds > 1) | (owners == 0) | (owners == owners[-1]))), True)
        else:
            yield from rows(EDGE, np.flatnonzero(first & ((group == 0) | (group == group[-1]))), True, True)

    return run


def _sorted(records: DataFrame, tokens: int, sampled: bool, count: int, label: str) -> DataFrame:
    """The rows of all sorted buckets (kind, places, t0 .., n), saved. count: records to expect, about."""
    keys = [f"t{k}" for k in range(tokens)]
    buckets = records.repartitionByRange(max(1, -(-count // PER_BUCKET)), *keys, "salt")
    return saved_map(buckets, _bucket(tokens, sampled), f"kind int, places binary, {', '.join(f'{k} long' for k in keys)}, n long", label)


def _record_schema(tokens: int) -> str:
    return f"{', '.join(f't{k} long' for k in range(tokens))}, salt long, places binary"


def _unpacked(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), PLACE)
            yield pa.RecordBatch.from_arrays([pa.array(flat[c]) for c in PLACE.names], list(PLACE.names))

    return rows.select("places").mapInArrow(run, PLACES)


def _across(rows: DataFrame, tokens: int) -> DataFrame:
    """Edge rows of single suffixes whose equals lie in other buckets. There are two edges to a bucket."""
    keys = [f"t{k}" for k in range(tokens)]
    edges = rows.where(F.col("kind") == EDGE)
    shared = edges.groupBy(*keys).agg(F.sum("n").alias("n_all")).where("n_all > 1")
    return edges.where("n = 1").join(shared, keys, "left_semi")


def _squeezed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a text or binary column compressed, for the shuffle that follows."""
    at = rows.columns.index(column)

    def run(batches):
        for batch in (part for b in batches for part in cut_batch(b, at)):
            press = zstandard.ZstdCompressor().compress
            data = [press(bytes(v.as_buffer())) if v.is_valid else None for v in batch.column(at)]
            yield batch.set_column(at, column, pa.array(data, pa.binary()))

    return rows.mapInArrow(run, StructType([StructField(f.name, BinaryType() if f.name == column else f.dataType) for f in rows.schema]))


def _spans_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the rows, and firsts and lasts, of a column of spans. Rows without spans are empty."""
    flat = column.flatten()
    counts = np.array(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    return np.concatenate([[0], np.cumsum(counts)]), flat.field("first").to_numpy(), flat.field("last").to_numpy()


def _slices(span: int, squeezed: bool):
    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in (part for b in batches for part in cut_batch(b, 3)):
            offsets, firsts, lasts = _spans_of(batch.column(4))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            base = batch.column(2).to_numpy()
            data = []
            for k, raw in enumerate(batch.column(3)):
                buf, at = expand(raw.as_py()) if squeezed else raw.as_buffer(), int(base[k])
                data += [bytes(buf[a - at : b - at + span]) for a, b in zip(firsts[offsets[k] : offsets[k + 1]].tolist(), lasts[offsets[k] : offsets[k + 1]].tolist())]
            out = [batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], firsts]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in out), pa.array(data, pa.binary())], ["doc_id", "crc", "at", "data"])

    return run


def _cut_out(texts: DataFrame, places: DataFrame, span: int, squeezed: bool, label: str) -> DataFrame:
    """Saved: the bytes at each of ``places``, out of the row (doc_id, crc, at) that each lies in. squeezed: compress whole texts for the join."""
    spans = places.groupBy("doc_id", "crc", "at").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = (_squeezed(texts, "data") if squeezed else texts).join(spans, ["doc_id", "crc", "at"]).select("doc_id", "crc", "at", "data", "spans")
    return saved_map(joined, _slices(span, squeezed), "doc_id long, crc long, at int, data binary", label)


def _keyed(docs: DataFrame) -> DataFrame:
    data = text_bytes()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.crc32(data).alias("crc"), F.lit(0).alias("at"), data.alias("data"))


def repeated_places(docs: DataFrame, span: int = SPAN, seeds: tuple[int, int] = SEEDS) -> DataFrame:
    """doc_id, crc, at, first, last: strings of ``span`` bytes that start at first .. last occur elsewhere too."""
    texts = _keyed(docs)
    found = []
    windows = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    for k, seed in enumerate(seeds):
        records = texts.mapInArrow(_runs(span, seed), _record_schema(3))
        rows = _sorted(records, 3, True, windows * 2 // (span - seed + 2), f"suffix-{k}")
        found.append(rows.where(F.col("kind") == REPEATED))
        still = _unpacked(rows.where(F.col("kind") == OPEN))
        texts = _cut_out(texts, still, span, k == 0, f"suffix-slices-{k}")
        windows = texts.agg(F.sum(F.octet_length("data") - F.lit(span - 1))).first()[0] or 0
    rows = _sorted(texts.mapInArrow(_windows(span), _record_schema(4)), 4, False, windows, "suffix-all")
    found += [rows.where(F.col("kind") == REPEATED), _across(rows, 4)]
    return _unpacked(reduce(DataFrame.unionByName, [f.select("places") for f in found]))


def _merge(first: np.ndarray, last: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the windows."""
    if not len(first):
        return []
    order = np.argsort(first)
    first, end = first[order], np.maximum.accumulate(last[order] + span)
    cut = np.flatnonzero(first[1:] > end[:-1]) + 1
    return list(zip(first[np.append(0, cut)].tolist(), end[np.append(cut - 1, len(end) - 1)].tolist()))


def _cut(raw: bytes, ranges: list[tuple[int, int]], whole_chars: bool) -> bytes:
    kept, at = [], 0
    for a, b in ranges:
        if whole_chars:
            while a > at and raw[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(raw) and raw[b] & 0xC0 == 0x80:
                b += 1
        kept.append(raw[at:a])
        at = max(at, b)
    return b"".join([*kept, raw[at:]])


def _removed(span: int, text_at: int):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in (part for b in batches for part in cut_batch(b, text_at, 1 << 20)):
            out: list[list] = [[], [], [], [], [], []]
            texts = []
            offsets, first, last = _spans_of(batch.column("_spans"))
            for k, cell in enumerate(batch.column(text_at)):
                raw = expand(cell.as_py()) if cell.is_valid else b""
                texts.append(raw if cell.is_valid else None)
                ranges = _merge(first[offsets[k] : offsets[k + 1]], last[offsets[k] : offsets[k + 1]], span)
                kept = _cut(raw, ranges, False)
                row = (len(raw), len(raw) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), _cut(raw, ranges, True).decode(), [{"start": a, "end": b} for a, b in ranges])
                for o, v in zip(out, row):
                    o.append(v)
            rest = batch.set_column(text_at, batch.schema.names[text_at], pa.array(texts, pa.binary()).cast(pa.string()))
            names = [n for n in batch.schema.names if n != "_spans"]
            yield pa.RecordBatch.from_arrays([*(rest.column(n) for n in names), *(pa.array(o, t) for o, t in zip(out, kinds))], [*names, *REPORT])

    return run


_RANGES = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
_REPORT = {"_n_bytes": LongType(), "_n_removed": LongType(), "_n_spans": LongType(), "_kept_sha256": StringType(), "_kept_text": StringType(), "_ranges": _RANGES}
REPORT = list(_REPORT)


def remove_repeats(docs: DataFrame, span: int = SPAN, seeds: tuple[int, int] = SEEDS) -> DataFrame:
    """All columns of ``docs`` (renamed _in0, _in1, ... in their order, so that no name clashes) and the REPORT columns.

    _kept_text drops whole characters: one goes if any of its bytes goes.
    """
    places = repeated_places(docs, span, seeds)
    # saved, so that the records' shuffle files are gone before the texts are dealt out
    spans = saved(places.groupBy("doc_id", "crc").agg(F.collect_set(F.struct("first", "last")).alias("_spans")), "suffix-spans")
    at, doc_id = place_of(docs, "text"), f"_in{place_of(docs, 'doc_id')}"
    left = numbered(docs).select("*", text_crc(f"_in{at}").alias("_crc"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"))
    left = _squeezed(left, f"_in{at}")
    joined = left.join(spans, (F.col("_id") == spans.doc_id) & (F.col("_crc") == spans.crc), "left").drop("doc_id", "crc", "_crc", "_id")
    kept = [StructField(f"_in{k}", f.dataType) for k, f in enumerate(docs.schema.fields)]
    return joined.mapInArrow(_removed(span, at), StructType(kept + [StructField(c, kind) for c, kind in _REPORT.items()]))


def cut_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The columns of ``docs``, with the texts that hold repeats cut, and their n_chars, where there is one, counted anew."""
    columns = []
    text, n_chars = (place_of(docs, c) for c in ("text", "n_chars"))
    for k, c in enumerate(docs.columns):
        value = F.col(f"_in{k}")
        if k == text:
            value = F.when(F.col("_n_removed") > 0, F.col("_kept_text")).otherwise(value)
        elif k == n_chars:
            value = F.when(F.col("_n_removed") > 0, F.length("_kept_text").cast(docs.schema.fields[k].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return remove_repeats(docs, span).select(*columns)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(F.col("_in0").alias("doc_id"), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))


def brute_force(texts: list[str | None], span: int = SPAN) -> list[tuple[int, int, int, str]]:
    """For tests: n_bytes, n_removed, n_spans and kept_sha256 by counting every string of ``span`` bytes."""
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raws:
        for k in range(len(r) - span + 1):
            seen[r[k : k + span]] = seen.get(r[k : k + span], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - span + 1):
            if seen[r[k : k + span]] > 1:
                gone[k : k + span] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def crc_of(text: str | None) -> int:
    return zlib.crc32((text or "").encode())
