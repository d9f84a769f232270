"""Hashed word shingles of whole texts, their min-hashes and parity bitmaps, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

WORDS_PER_SHINGLE = 5
#: Words a worker remembers the hash of; the memory is emptied beyond it (no result depends on it).
REMEMBERED_WORDS = 150_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes from which on ``hashed_words`` hashes a word by itself.
LONG_WORD = 64
#: Masks of the first 0 to 8 bytes of a little-endian number.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: A-Z lower-cased, split on space and the control characters 9 to 13."""
    return text.lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes_of(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of every word."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (see ``words_of``) of the texts, one after another, and the number of words of each text.

    The words are hashed side by side, eight bytes at a time, and no word is remembered: texts of ever new words cost no more
    than others. The hashes are not those of ``hashes_of``.
    """
    body = b"\n".join([b"", *texts, b"\n" * 8]).lower()
    raw = np.frombuffer(body, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, first))
    eight = np.ndarray(len(raw) - 7, "<u8", body, strides=(1,))
    out = _mixed((eight[starts] & _LOW_BYTES[np.minimum(sizes, 8)]) + _mixed(sizes.astype(np.uint64) * _MULTIPLIER))
    rows = np.flatnonzero((sizes > 8) & (sizes <= LONG_WORD))
    for at in range(8, LONG_WORD, 8):
        part = eight[starts[rows] + at] & _LOW_BYTES[np.minimum(sizes[rows] - at, 8)]
        out[rows] = _mixed(out[rows] * _MULTIPLIER + part)
        rows = rows[sizes[rows] > at + 8]
    for k in np.flatnonzero(sizes > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(body[starts[k] : starts[k] + sizes[k]])
    return out, counts


def shingle_set(words: list[bytes], size: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles; fewer words make one shingle, none make an empty set."""
    return shingle_set_of(hashes_of(words), size)


def shingle_set_of(hashes: np.ndarray, size: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """``shingle_set`` of words whose hashes are known."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    if len(hashes) < size:
        total = np.array([len(hashes)], np.uint64)
        for h in hashes:
            total = total * _MULTIPLIER + h
        return _mixed(total)
    return np.unique(rolling_of(hashes, size))


def rolling(words: list[bytes], size: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """The hash of every ``size`` words in a row, as ``shingle_set`` has it, in order and with repetitions."""
    return rolling_of(hashes_of(words), size)


def rolling_of(hashes: np.ndarray, size: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """``rolling`` of words whose hashes are known."""
    n = len(hashes) - size + 1
    total = hashes[:n].copy()
    for k in range(1, size):
        total *= _MULTIPLIER
        total += hashes[k : n + k]
    return _mixed(total)


def set_key(values: np.ndarray) -> bytes:
    """128 bits that name the set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


class Banding:
    """Min-hash bands: ``bands`` keys of ``rows`` min-hashes each."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        random = np.random.default_rng(20240229)
        self.factors = random.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = random.integers(0, 2**63, bands * rows, dtype=np.uint64)

    @classmethod
    def tuned(cls, threshold: float, recall: float, rows: int = 3) -> Banding:
        """The fewest bands by which a pair just at ``threshold`` meets with probability ``recall`` at least."""
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        return cls(bands, rows)

    def keys(self, values: np.ndarray) -> np.ndarray:
        """One 64-bit key a band, of a set that is not empty."""
        least = np.full(len(self.factors), np.uint64(2**64 - 1), np.uint64)
        for at in range(0, len(values), 4096):
            part = values[at : at + 4096, None] * self.factors + self.shifts
            np.minimum(least, part.min(axis=0), out=least)
        return self._banded(least[None])[0]

    def many_keys(self, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The keys of many sets that stand one after another from ``starts`` on, a row each; repeated elements change nothing."""
        least = np.empty((len(starts), len(self.factors)), np.uint64)
        for k, (factor, shift) in enumerate(zip(self.factors, self.shifts, strict=True)):
            least[:, k] = np.minimum.reduceat(values * factor + shift, starts)
        return self._banded(least)

    def _banded(self, least: np.ndarray) -> np.ndarray:
        least = least.reshape(-1, self.bands, self.rows)
        total = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), least.shape[:2])
        for k in range(self.rows):
            total = _mixed(total * _MULTIPLIER + least[:, :, k])
        return total.view(np.int64)


def bitmap_words(n: int) -> int:
    """64-bit words of the bitmap of a set of ``n``: about two bits an element, a power of two."""
    words = 1
    while words * 32 < n and words < 512:
        words *= 2
    return words


def parity_bitmap(values: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the elements hashed to i, so differing bits of two bitmaps never outnumber differing elements."""
    words = bitmap_words(len(values))
    bits = np.bincount((values & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap as one of fewer words would be."""
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
