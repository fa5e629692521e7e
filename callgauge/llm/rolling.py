"""Rabin-Karp fingerprints of word runs, by prefix polynomials over numpy arrays.

All arithmetic is modulo 2^64. The base is odd, so its powers have inverses, and the
fingerprint of any run is a difference of two prefix sums times one inverse power: the same
wherever the run stands. Words get theirs from their bytes, runs of words from their words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Words that are compared byte by byte at a time.
TOGETHER = 1 << 16
#: A random odd number for every byte value.
VALUES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)


class _Powers:
    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def reach(cls, n: int) -> None:
        """Powers 0 to n. Tables twice the largest slice of a worker at most."""
        if len(cls.up) <= n:
            size = max(n + 1, 1 << 16)
            for name, step in (("up", BASE), ("down", INVERSE)):
                table = np.full(size, step, U)
                table[0] = 1
                setattr(cls, name, np.multiply.accumulate(table))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of x over all bits of the result; one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial: entry i is the sum of values[j] * BASE^j over j < i."""
    _Powers.reach(len(values))
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _Powers.up[: len(values)], out=out[1:])
    return out


def runs(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Fingerprint of the values from starts to stops."""
    return (sums[stops] - sums[starts]) * _Powers.down[starts]


def windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of every `size` consecutive values."""
    count = max(0, len(sums) - size)
    return (sums[size : size + count] - sums[:count]) * _Powers.down[:count]


def lowered(values: np.ndarray = VALUES) -> np.ndarray:
    """Byte values that take A-Z for a-z."""
    values = values.copy()
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@dataclass
class Words:
    """Words of a slice of texts, in order: where they stand, whose they are, what they are."""

    raw: np.ndarray  # bytes of all texts
    starts: np.ndarray  # first byte of each word
    stops: np.ndarray
    text: np.ndarray  # number of the text
    first: np.ndarray  # by text: its first word; one more entry at the end
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def _alike(self, plain: np.ndarray, theirs: np.ndarray, at: int) -> bool:
        """Whether TOGETHER words from one on have the bytes of others of the same sizes."""
        starts, other = self.starts[at : at + TOGETHER], self.starts[theirs[at : at + TOGETHER]]
        sizes = self.stops[at : at + TOGETHER] - starts
        ahead = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.array_equal(plain[ahead + np.repeat(starts, sizes)], plain[ahead + np.repeat(other, sizes)])

    def identities(self, translation: bytes | None = None) -> np.ndarray:
        """A number for each word, the same for the same (translated) bytes and for no others.

        Words of one hash are compared byte by byte; should two differ, all are told apart
        by their bytes.
        """
        data = self.raw.tobytes()
        if translation:
            data = data.translate(translation)
        plain = np.frombuffer(data, np.uint8)
        _, rep, number = np.unique(self.hashes, return_index=True, return_inverse=True)
        sizes = self.stops - self.starts
        theirs = rep[number]
        if np.array_equal(sizes, sizes[theirs]) and all(self._alike(plain, theirs, at) for at in range(0, len(self), TOGETHER)):
            return number
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(data[a:b], len(seen)) for a, b in zip(self.starts.tolist(), self.stops.tolist())])


def words_of(column: pa.Array, inside: np.ndarray, values: np.ndarray = VALUES) -> Words:
    """Words of a text column: runs of bytes for which the table `inside` holds."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    bounds = offsets - low
    word = np.zeros(len(raw) + 1, bool)
    word[:-1] = inside[raw]
    begins = word[:-1].copy()
    begins[1:] &= ~word[:-2]
    edges = bounds[:-1][bounds[:-1] < len(raw)]
    begins[edges] = word[edges]
    ends = word[:-1] & ~word[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    ends[last] = word[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(starts, bounds)
    text = np.repeat(np.arange(len(column)), np.diff(first)) if len(column) else np.zeros(0, np.int64)
    hashes = mix(runs(prefix(values[raw]), starts, stops)) if len(starts) else np.zeros(0, U)
    return Words(raw, starts, stops, text, first, hashes)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return x.view(np.int64)
