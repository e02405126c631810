"""Word shingles of whole texts as sorted arrays of 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BATCH_BYTES = 1 << 20
KNOWN_PLACES = 1 << 12


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _places(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A random value per byte; A-Z have those of a-z, white space counts nothing.
VALUE = mix(np.arange(1, 257, dtype=U64) + U64(1 << 40))
VALUE[65:91] = VALUE[97:123]
VALUE[BLANK] = U64(0)
PLACE = _places(KNOWN_PLACES)


def word_hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``data`` (bytes); texts begin at ``first``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A hash is a sum of byte values times place
    values, all random, so equal words and only they (but for chance) are equal.
    """
    blank = BLANK[data]
    before = np.empty(len(data), bool)
    before[0:1] = True
    before[1:] = blank[:-1]
    before[first[first < len(data)]] = True
    begins = before & ~blank
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, U64), starts
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    place[blank] = 0
    longest = int(place.max())
    table = PLACE if longest < KNOWN_PLACES else _places(longest + 1)
    return mix(np.add.reduceat(VALUE[data] * table[place], starts)), starts


def _cuts(data: np.ndarray) -> list[np.ndarray]:
    """A long text in parts that end at white space."""
    parts, at = [], 0
    while len(data) - at > 2 * BATCH_BYTES:
        blanks = np.flatnonzero(BLANK[data[at + BATCH_BYTES :]])
        if not len(blanks):
            break
        end = at + BATCH_BYTES + int(blanks[0])
        parts.append(data[at:end])
        at = end
    return [*parts, data[at:]]


def _distinct(sorted_: np.ndarray) -> np.ndarray:
    keep = np.ones(len(sorted_), bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=keep[1:])
    return sorted_[keep]


class Shingler:
    """Sets of shingles of ``words`` words; fewer words make one shingle, none make none."""

    def __init__(self, words: int):
        self.words = words
        self.weights = mix(np.arange(1, words + 1, dtype=U64)) | U64(1)

    def _shingles(self, h: np.ndarray) -> np.ndarray:
        n = len(h) - self.words + 1
        total = h[:n] * self.weights[0]
        for j in range(1, self.words):
            total += h[j : j + n] * self.weights[j]
        return mix(total)

    def _short(self, h: np.ndarray) -> np.ndarray:
        whole = np.full(1, len(h), U64)
        for x in h:
            whole = mix(whole * U64(0x9E3779B97F4A7C15) + x)
        return whole

    def _sets(self, data: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        hashes, starts = word_hashes(data, first)
        bounds = np.append(np.searchsorted(starts, first), len(starts))
        whole = self._shingles(hashes) if len(hashes) >= self.words else hashes[:0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= self.words:
                yield _distinct(np.sort(whole[a : b - self.words + 1]))
            else:
                yield self._short(hashes[a:b]) if b > a else hashes[:0]

    def of_long(self, data: np.ndarray) -> np.ndarray:
        hashes = np.concatenate([word_hashes(p, np.zeros(1, int))[0] for p in _cuts(data)])
        if len(hashes) >= self.words:
            return _distinct(np.sort(self._shingles(hashes)))
        return self._short(hashes) if len(hashes) else hashes

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The set of each text of an Arrow string array (null: empty), in order."""
        run: list[np.ndarray] = []
        size = 0
        for cell in texts.cast(pa.large_binary()):
            data = np.frombuffer(cell.as_py() or b"", np.uint8)
            if run and size + len(data) > BATCH_BYTES:
                yield from self._run(run)
                run, size = [], 0
            if len(data) > BATCH_BYTES:
                yield self.of_long(data)
            else:
                run.append(data)
                size += len(data)
        yield from self._run(run)

    def _run(self, run: list[np.ndarray]) -> Iterator[np.ndarray]:
        if run:
            first = np.cumsum([0] + [len(r) for r in run[:-1]])
            yield from self._sets(np.concatenate(run), first)


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())
