"""Byte-level BPE by merge replay over the distinct pieces of a batch, and decoding.

Each Arrow batch is a small corpus: its texts are split into pieces, the distinct pieces are laid end to end, and an
inverted index from merge rank to positions says where each mergeable pair stands. Ranks are taken from a heap in
order; all positions of a rank are merged together and only the touched neighbours get new pairs. Texts whose white
space is all single characters are first cut at spaces, which no piece crosses, so that the pattern runs over
distinct chunks only; Arrow cuts and numbers them, and puts ids, their decimals and the bytes they stand for together again
from columns of distinct values. The worker remembers two generations of ``CACHE`` chunks: those seen again live on, so memory is bounded.

Merging all places of one rank together equals the reference order (lowest rank first, leftmost first, piece by
piece) unless a merge makes a pair of a lower rank; pieces where that happens are done again one merge at a time.

Defined cases: a null text is an empty one and has no ids; special tokens are ordinary text; a document's ids decode to
exactly its UTF-8 bytes; repeated rows repeat their result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_batch, table

CACHE = 150_000
#: Bytes of text whose pieces are replayed together.
TOGETHER = 4 << 20
#: What the pattern's \s stands for, and texts that can't be cut at spaces, for Arrow's expressions.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DOUBLE_SPACE = f"{SPACE}{{2}}|^{SPACE}|{SPACE}$"


class Vocabulary:
    """Ranks of a tiktoken file, and every pair of tokens that merges to a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.token = [b""] * self.size
        for word, rank in self.ranks.items():
            self.token[rank] = word
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for word, rank in self.ranks.items():
            for k in range(1, len(word)):
                a, b = self.ranks.get(word[:k]), self.ranks.get(word[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def one_by_one(self, piece: bytes) -> list[int]:
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[k] + parts[k + 1], self.size), k) for k in range(len(parts) - 1)), default=None)
            if best[0] == self.size:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as 32-bit numbers; all words together."""
        lens = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if not n:
            return [b""] * len(words)
        tok = self.byte[data]
        ends = np.cumsum(lens)
        after = np.arange(1, n + 1)
        after[ends[lens > 0] - 1] = -1
        before = np.arange(-1, n - 1)
        before[(ends - lens)[lens > 0]] = -1
        pair = np.full(n, -1, np.int64)  # the rank of the pair that starts here
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: list[np.ndarray] = []

        def post(rank: np.ndarray, pos: np.ndarray) -> None:
            order = np.argsort(rank, kind="stable")
            rank, pos = rank[order], pos[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            edges = [0, *cut.tolist(), len(rank)]
            for a, b, r in zip(edges, edges[1:], rank[edges[:-1]].tolist()):
                if r in index:
                    index[r].append(pos[a:b])
                else:
                    index[r] = [pos[a:b]]
                    heapq.heappush(heap, r)

        first = np.flatnonzero(after >= 0)
        rank = self.merged(tok[first], tok[first + 1])
        pair[first] = rank
        if (rank >= 0).any():
            post(rank[rank >= 0], first[rank >= 0])
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            pos = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            pos = pos[pair[pos] == r]
            if not len(pos):
                continue
            if len(pos) > 1:
                clash = np.zeros(len(pos), bool)
                clash[1:] = after[pos[:-1]] == pos[1:]
                if clash.any():  # of pairs that overlap in a row, every other one from the left
                    place = np.arange(len(pos))
                    start = np.maximum.accumulate(np.where(clash, 0, place))
                    pos = pos[(place - start) % 2 == 0]
            gone = after[pos]
            then = after[gone]
            tok[pos] = r
            after[pos] = then
            alive[gone] = False
            pair[gone] = -1
            more = then >= 0
            before[then[more]] = pos[more]
            pair[pos] = -1
            left = pos[more]
            prior = before[pos]
            left = np.concatenate([left, prior[prior >= 0]])
            if not len(left):
                continue
            rank = self.merged(tok[left], tok[after[left]])
            pair[left] = rank
            some = rank >= 0
            if some.any():
                if (low := some & (rank < r)).any():
                    odd.append(left[low])
                post(rank[some], left[some])
        ids = tok[alive].astype(np.int32).tobytes()
        edges = (4 * np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])]).tolist()
        out = [ids[a:b] for a, b in zip(edges, edges[1:])]
        for w in set(np.searchsorted(ends, np.concatenate(odd), side="right").tolist()) if odd else ():
            out[w] = np.array(self.one_by_one(words[w]), np.int32).tobytes()
        return out


class Encoder:
    """Encodes batches of texts; keeps the ids of chunks seen before.

    Texts are split, numbered by distinct chunks and put together again as Arrow columns, so Python handles distinct chunks only.
    """

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.token = pa.array(self.vocabulary.token, pa.large_binary())
        self.written = pa.array([b"%d " % k for k in range(self.vocabulary.size)], pa.large_binary())

    def numbers(self, chunks: list[str], words: list[str]) -> list[bytes]:
        """Ids, as 32-bit numbers, of each chunk, and of each word with the space before it."""
        spaced = [" " + w for w in words]
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new, more = ([c for c in dict.fromkeys(part) if c not in known] for part in (chunks, spaced))
        if older:
            known.update((c, older[c]) for c in chain(new, more) if c in older)
            new, more = ([c for c in part if c not in known] for part in (new, more))
        pieces = [self.find(c) for c in new]
        # words have no space inside, so of all their pieces those that begin with one begin a word
        run = self.find("".join(more))
        starts = [k for k, p in enumerate(run) if p[0] == " "]
        kinds = [p for p in dict.fromkeys(chain(chain.from_iterable(pieces), run)) if p not in known]
        known.update(zip(kinds, self.vocabulary.replay([p.encode() for p in kinds])))
        known.update((c, b"".join([known[p] for p in parts])) for c, parts in zip(new, pieces))
        known.update((c, b"".join([known[p] for p in run[a:b]])) for c, a, b in zip(more, starts, [*starts[1:], len(run)]) if b - a > 1)
        return [known[c] for c in chain(chunks, spaced)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and the last one's end."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, DOUBLE_SPACE)
        parts = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        ends = np.asarray(parts.offsets, np.int64)
        chunks = parts.flatten().dictionary_encode()
        words = chunks.dictionary.to_pylist()
        at = np.array(chunks.indices, np.int64)
        first = at[ends[:-1]]  # the first chunk of a text has no space before it
        heads, place = np.unique(first, return_inverse=True)
        own = [words[k] for k in heads.tolist()]
        rest = np.delete(at, ends[:-1])
        used, again = np.unique(rest, return_inverse=True)
        whole = {k: self.find(texts[k].as_py()) for k in np.flatnonzero(np.asarray(odd)).tolist()}
        extra = dict.fromkeys(chain.from_iterable(whole.values()))
        single = [*own, *extra]
        table = pa.array(self.numbers(single, [words[k] for k in used.tolist()]), pa.large_binary())
        order = np.empty(len(at), np.int64)
        inner = np.ones(len(at), bool)
        inner[ends[:-1]] = False
        order[ends[:-1]] = place
        order[inner] = again + len(single)
        if whole:  # in place of their empty first chunk
            number = {c: len(own) + k for k, c in enumerate(extra)}
            count = np.ones(len(at), np.int64)
            count[ends[list(whole)]] = [len(w) for w in whole.values()]
            fill = np.repeat(np.isin(np.arange(len(at)), ends[list(whole)]), count)
            order = np.repeat(order, count)
            order[fill] = [number[c] for w in whole.values() for c in w]
            ends = np.concatenate([[0], np.cumsum(count)])[ends]
        found = table.take(pa.array(order))
        return _values(found).view(np.int32), _edges(found)[ends] // 4

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, ids))


def _edges(column: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)


def _values(column: pa.LargeBinaryArray) -> np.ndarray:
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[: _edges(column)[-1]] if data is not None else np.empty(0, np.uint8)


def _digests(column: pa.LargeBinaryArray, edges: np.ndarray, less: int = 0) -> list[str]:
    """SHA-256 of the values from each edge to the next, put together, without the last ``less`` bytes."""
    data, at = memoryview(_values(column)), _edges(column)[edges].tolist()
    return [hashlib.sha256(data[a : max(b - less, a)]).hexdigest() for a, b in zip(at, at[1:])]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _encoded(name: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(public_tokenizers.path(name), public_tokenizers.PATTERN)
        for batch in batches:
            for part in cut_batch(batch, 1, TOGETHER):
                ids, edges = coder.encode(part.column(1))
                kept = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids)) if keep_ids else pa.nulls(part.num_rows, pa.list_(pa.int32()))
                back, written = coder.token.take(pa.array(ids)), coder.written.take(pa.array(ids))
                columns = (pa.array(np.diff(edges)), pa.array(_digests(written, edges, 1), pa.string()), pa.array(_digests(back, edges), pa.string()), kept)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return run


def encode_documents(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded bytes, and the ids (null without ``keep_ids``). One scan, no shuffle."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encoded(name, keep_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def decode_documents(encoded: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and the bytes that its ids stand for; null ids give no bytes."""

    def run(batches):
        coder = encoder(public_tokenizers.path(name), public_tokenizers.PATTERN)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
