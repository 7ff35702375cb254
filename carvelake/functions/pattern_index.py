"""A required-substring index: which patterns a text can match at all, by the q-grams that it holds.

From each pattern, the strings that any match has to contain are derived: a list of variants (alternatives), each a set of strings that all occur.
Their q-grams (three bytes, fewer for shorter strings) are the vocabulary. One pass over a text's bytes tells which grams of the vocabulary it holds;
a pattern is a candidate if all grams of one of its variants are there. The rest can't match, so its expression isn't run. Patterns
without a required string are not indexed (`Index.free`) and always run.

Texts and patterns are compared in lower case, with the four letters that Unicode folds to ASCII ones, so that a pattern that ignores case loses no match.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from re import _constants as sre
from re import _parser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import fixed_values as V

Q = 3
#: Strings that a part of a pattern may stand for, and variants of a pattern; a part or pattern with more requires less.
MOST_STRINGS, MOST_VARIANTS = 64, 512
#: Bytes, and texts, that are looked at together.
SLICE, TOGETHER = 1 << 20, 512
# Letters that fold to an ASCII letter.
FOLDED = {"K": "k", "ſ": "s", "İ": "i", "ı": "i"}
_FOLDED = str.maketrans(FOLDED)

Strings = set[str]
Variants = list[frozenset[str]]


def folded(text: str) -> bytes:
    return (text if text.isascii() else text.translate(_FOLDED)).encode("utf-8", "surrogatepass").lower()


def _members(of: list) -> Strings | None:
    """The characters of a small class, or None."""
    out: Strings = set()
    for op, value in of:
        if op is not sre.LITERAL:
            return None
        out.add(folded(chr(value)).decode())
    return out if len(out) <= 8 else None


def _node(op, value) -> tuple[Strings | None, Variants]:
    """All strings that a part of a pattern stands for, if they are few, and otherwise what each of its matches contains."""
    if op is sre.LITERAL:
        return {folded(chr(value)).decode()}, []
    if op is sre.IN:
        return _members(value), []
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, []
    if op is sre.SUBPATTERN:
        return _sequence(value[-1])
    if op is sre.ATOMIC_GROUP:
        return _sequence(value)
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and len(every := set().union(*(s for s, _ in parts))) <= MOST_STRINGS:
            return every, []
        found = [_variants(*p) for p in parts]
        return None, sum(found, []) if all(found) else []
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, needed = _sequence(inner)
        if least == 0:
            return (strings | {""} if strings is not None and most == 1 else None), []
        return (strings, needed) if most == 1 else (None, _variants(strings, needed))
    return None, []


def _variants(strings: Strings | None, needed: Variants) -> Variants:
    """What each match contains: the empty list if nothing is required."""
    if strings is None:
        return needed
    return [frozenset([s]) for s in strings] if strings and "" not in strings else []


def _sequence(items) -> tuple[Strings | None, Variants]:
    factors: list[Variants] = []
    run: Strings = {""}
    whole = True
    for op, value in items:
        strings, needed = _node(op, value)
        joined = {a + b for a, b in product(run, strings)} if strings is not None and len(run) * len(strings) <= MOST_STRINGS else None
        if joined is not None:
            run = joined
            continue
        whole = False
        factors += [_variants(run, []), _variants(strings, needed)]
        run = {""}
    if whole:
        return run, []
    factors.append(_variants(run, []))
    # the factors that tell most come first, and others as long as there are few variants
    factors = sorted((f for f in factors if f), key=lambda f: -min(sum(map(len, v)) for v in f))
    out: Variants = []
    for f in factors:
        if not out:
            out = f if len(f) <= MOST_VARIANTS else []
        elif len(out) * len(f) <= MOST_VARIANTS:
            out = [a | b for a, b in product(out, f)]
    return None, out


def required(pattern: str) -> Variants:
    """Sets of strings, all of which occur in a match of one of the variants; empty if the pattern requires nothing."""
    return _variants(*_sequence(_parser.parse(pattern)))


def grams_of(text: str) -> set[bytes]:
    data = folded(text)
    return {data[k : k + Q] for k in range(len(data) - Q + 1)} if len(data) > Q else {data}


class Index:
    """names: the indexed patterns, by number; free: those that require nothing."""

    def __init__(self, patterns: dict[str, str]):
        self.variants = {name: [frozenset().union(*map(grams_of, v)) for v in required(p)] for name, p in patterns.items()}
        self.names = [n for n, v in self.variants.items() if v]
        self.free = [n for n, v in self.variants.items() if not v]
        self.number = {n: k for k, n in enumerate(self.names)}
        self.grams = sorted({g for n in self.names for v in self.variants[n] for g in v}, key=lambda g: (len(g), g))
        number = {g: k for k, g in enumerate(self.grams)}
        each = [v for n in self.names for v in self.variants[n]]
        self.flat = np.array([number[g] for v in each for g in sorted(v)], np.int64)
        # of each gram, the variants that require it; of each variant, how many grams it requires, and its pattern
        variant = np.repeat(np.arange(len(each)), [len(v) for v in each])
        order = np.argsort(self.flat, kind="stable")
        self.of_gram, self.first = variant[order], np.searchsorted(self.flat[order], np.arange(len(self.grams) + 1))
        self.needed = np.array([len(v) for v in each], np.int64)
        self.owner = np.repeat(np.arange(len(self.names)), [len(self.variants[n]) for n in self.names])
        none = len(self.grams)
        self.tables = []  # for each length below Q: the number of the gram, or none
        for q in (1, 2):
            table = np.full(256**q, none, np.int32)
            for g, k in number.items():
                if len(g) == q:
                    table[int.from_bytes(g)] = k
            self.tables.append(table)
        self.long = np.array([int.from_bytes(g) for g in self.grams if len(g) == Q], np.uint32)
        self.first_long = none - len(self.long)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self._slot(self.long)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint32(0x9E3779B1)) >> np.uint32(16)

    def _slices(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The texts' bytes, joined by a byte that no text has, in slices; where each piece of a text begins, and the text's place. Pieces of one text overlap."""
        pieces: list[bytes] = []
        rows: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            whole = folded(text or "")
            for at in range(0, len(whole), SLICE):
                pieces.append(whole[at : at + SLICE + Q - 1])
                rows.append(k)
                size += len(pieces[-1]) + 1
                if size >= SLICE:
                    yield _joined(pieces, rows)
                    pieces, rows, size = [], [], 0
        if pieces:
            yield _joined(pieces, rows)

    def pairs(self, texts: list[str | None]) -> np.ndarray:
        """Sorted, text * grams + gram: each gram of the vocabulary that each text holds, once."""
        none = len(self.grams)
        found = [np.empty(0, np.int64)]
        for data, starts, rows in self._slices(texts):
            two = data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]
            three = two[:-1] << np.uint32(8) | data[2:]
            for grams, table in ((data, self.tables[0]), (two, self.tables[1])):
                at = np.flatnonzero(table[grams] != none)
                found.append(np.unique(rows[np.searchsorted(starts, at, "right") - 1] * none + table[grams[at]]))
            at = np.flatnonzero(self.sieve[self._slot(three)])
            place = np.minimum(np.searchsorted(self.long, three[at]), max(len(self.long) - 1, 0))
            at, place = (x[self.long[place] == three[at]] for x in (at, place))
            found.append(np.unique(rows[np.searchsorted(starts, at, "right") - 1] * none + self.first_long + place))
        return np.unique(np.concatenate(found))

    def held(self, texts: list[str | None]) -> np.ndarray:
        """For each text, whether it holds each gram of the vocabulary."""
        found = np.zeros(len(texts) * len(self.grams), bool)
        found[self.pairs(texts)] = True
        return found.reshape(len(texts), len(self.grams))

    def matches(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of texts and numbers of the patterns that may match them, sorted."""
        text, gram = np.divmod(self.pairs(texts), max(len(self.grams), 1))
        many = self.first[gram + 1] - self.first[gram]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        seen = np.repeat(text, many) * len(self.needed) + self.of_gram[np.repeat(self.first[gram], many) + inside]
        kinds, count = np.unique(seen, return_counts=True)
        text, variant = np.divmod(kinds, max(len(self.needed), 1))
        whole = count == self.needed[variant]
        return np.divmod(np.unique(text[whole] * len(self.names) + self.owner[variant[whole]]), max(len(self.names), 1))

    def lists(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the patterns that may match each text, one text after another, and where each one's begin and end."""
        numbers, sizes = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for k in range(0, len(texts), TOGETHER):
            part = texts[k : k + TOGETHER]
            text, pattern = self.matches(part)
            numbers.append(pattern.astype(np.int32))
            sizes.append(np.bincount(text, minlength=len(part)))
        return np.concatenate(numbers), np.cumsum(np.concatenate(sizes))

    def candidates(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the numbers of the patterns that may match it."""
        numbers, ends = self.lists(texts)
        return [numbers[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _joined(pieces: list[bytes], rows: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(p) + 1 for p in pieces)])[:-1]
    return np.frombuffer(b"\xff".join([*pieces, b"\xff\xff"]), np.uint8), starts, np.array(rows)


# Signals outside the pattern vocabulary.
NATIVE_LIB = r"(?i)[^\s/\\]{0,200}\.(?:so|dll|dylib)(?:\.[0-9]+)?\b"
URL = r"(?i)(?:https?|ftp|ftps|sftp|file|ssh|telnet|ldap|smb|nfs)://\S"
PATH = r"""(?:(?:^|(?<=[\s"'`,;({[]))/[a-zA-Z0-9_.~@%-][a-zA-Z0-9_.~@%/+-]*|[A-Za-z]:[/\\]\S|\\\\[a-zA-Z0-9._-]+[/\\])"""


@lru_cache(maxsize=None)
def index(kind: str) -> Index:
    """signals: the patterns of text tags and scores; behaviours: the strings of the rules, as rule.name."""
    if kind == "signals":
        rows = V.STRUCTURAL_SIGNALS + V.SHELL_PATTERNS + V.SHELL_ALLOWLIST + V.SHELL_SHORTCUTS + V.PYTHON_PATTERNS + V.PYTHON_SHORTCUTS
        return Index({r[0]: r[4] for r in rows} | {"NATIVE_LIB": NATIVE_LIB, "URL": URL, "PATH": PATH})
    return Index({f"{rule}.{name}": p for rule, body in V.BEHAVIOURS.items() for name, (p, _) in body[-1].items()})


def candidates(text: Column, kind: str) -> Column:
    """Numbers of the indexed patterns that may match a text, as an array; empty for null."""

    def run(texts: pa.Array) -> pa.Array:
        numbers, ends = index(kind).lists(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int32()))

    return F.arrow_udf(run, ArrayType(IntegerType()))(text)


def may_match(may: Column | None, kind: str, name: str, then: Column) -> Column:
    """``then``, looked at only where ``may`` (of `candidates`) has the pattern; without ``may`` or for patterns that require nothing always."""
    number = index(kind).number.get(name)
    return then if may is None or number is None else F.array_contains(may, F.lit(number)) & then


def postings(rows: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """The index as a relation: key, gram (text) of each gram of the vocabulary that a text holds."""

    def run(texts: pd.Series) -> pd.Series:
        own, every = index(kind), texts.tolist()
        found = (row for k in range(0, len(every), TOGETHER) for row in own.held(every[k : k + TOGETHER]))
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in found], dtype=object)

    grams = F.array(*[F.lit(g.decode("latin-1")) for g in index(kind).grams])
    held = rows.select(key, F.explode(F.pandas_udf(run, ArrayType(IntegerType()))(F.col(text))).alias("_gram"))
    return held.select(key, F.get(grams, F.col("_gram")).alias("gram"))
