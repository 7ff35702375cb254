"""Rolling fingerprints and minimiser sampling over byte buffers, vectorised with numpy.

A window of ``span`` bytes is owned by the smallest fingerprint among the ``seed``-byte strings inside it. Equal
windows have equal owners wherever they stand, so grouping by owner brings every two equal windows together while
only one position in about ``(span - seed) / 2`` is ever shipped. Fingerprints are polynomial (modulo 2**64, an odd
base, random letters), mixed afterwards; they choose and group, and are 64 bits of evidence each.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LETTER2 = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Buffer:
    """Several byte strings laid end to end, with prefix sums from which any substring's fingerprint follows."""

    def __init__(self, parts: list[bytes]):
        self.lens = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        n = len(self.data)
        self.up, self.down = _powers(n + 1)
        self.sums = self._sums(LETTER)

    def _sums(self, letters: np.ndarray) -> np.ndarray:
        s = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(letters[self.data] * self.up[:-1], out=s[1:])
        return s

    def prints(self, first: np.ndarray, last: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        """Fingerprints of data[first:last], elementwise."""
        s = self.sums if sums is None else sums
        return mix((s[last] - s[first]) * self.down[first] + (last - first).astype(np.uint64))

    def second_sums(self) -> np.ndarray:
        return self._sums(LETTER2)

    def all_prints(self, width: int) -> np.ndarray:
        """Fingerprints of every substring of ``width`` bytes, those across parts included."""
        n = len(self.data) - width + 1
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def inside(self, width: int) -> np.ndarray:
        """Starts of the substrings of ``width`` bytes that lie within one part."""
        room = np.maximum(self.lens - width + 1, 0)
        total = int(room.sum())
        if not total:
            return np.zeros(0, np.int64)
        base = np.repeat(self.starts - (np.cumsum(room) - room), room)
        return np.arange(total, dtype=np.int64) + base

    def part_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, pos, side="right")


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of a[i:i+width] for each i."""
    n, p, cur = len(a) - width + 1, 1, a
    if n <= 0:
        return a[:0]
    while 2 * p <= width:
        cur = np.minimum(cur[:-p], cur[p:])
        p *= 2
    return np.minimum(cur[:n], cur[width - p : width - p + n]) if p < width else cur[:n]


def owned_runs(buf: Buffer, span: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one owner at one place (the leftmost of equals): owner fingerprint, first start, last start, fingerprint of all bytes that the run covers.

    Runs never leave a part. Equal windows always have equal owner fingerprints.
    """
    starts = buf.inside(span)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z.astype(np.uint64)
    prints = buf.all_prints(seed)
    owner = sliding_min(prints, span - seed + 1)[starts]
    new = np.ones(len(starts), bool)
    # the owner's place changes with its value, or where it is the byte string that the next window no longer holds
    new[1:] = (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1) | (owner == prints[starts])[:-1]
    at = np.flatnonzero(new)
    first, last = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    return owner[at], first, last, buf.prints(first, last + span)
