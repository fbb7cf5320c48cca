"""Words of many texts at once as 64-bit hashes, computed with numpy over the joined bytes.

A word's hash is the sum of a random value for each of its bytes (A-Z lower-cased) and that byte's place in the word,
taken from prefix sums and mixed at the end, so neither the number of words nor their lengths cost Python steps. Values of
different places have nothing in common, so no regular words share a hash, as they do under a polynomial modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_A = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(16)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Places of a word that have random values of their own in a table; those of the places behind them are mixed from these.
PLACES = 64


def _table(separators: range | list[int]) -> tuple[np.ndarray, np.ndarray]:
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    value = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * _P).reshape(PLACES, 256)
    value[:, 65:91] = value[:, 97:123]
    return inside, value.ravel()


#: Words are runs of anything but ASCII white space.
SPACED = _table([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


@dataclass
class Words:
    """hash, row (index of the text), and where each word begins and ends in the joined bytes."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each text, and the total at the end
    _sums: np.ndarray  # of the values of all words' bytes, one word behind the other

    def prefixes(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word, or of the whole word if it is shorter."""
        return self._hashed(np.minimum(self.end - self.start, n), np.uint64(n))

    def _hashed(self, n: np.ndarray, salt: np.uint64) -> np.ndarray:
        length = self.end - self.start
        at = np.cumsum(length) - length
        with np.errstate(over="ignore"):
            return mix(self._sums[at + n] - self._sums[at] + n.astype(np.uint64) * _A[1] + salt)


def _values(letters: np.ndarray, length: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Value of each byte at its place, of words that stand one behind the other."""
    place = np.arange(len(letters)) - np.repeat(np.cumsum(length) - length, length)
    out = value[(place % PLACES) * 256 + letters]
    far = np.flatnonzero(place >= PLACES)
    with np.errstate(over="ignore"):
        out[far] = mix(out[far] + (place[far] // PLACES).astype(np.uint64) * _A[1])
    return out


def words_of(texts: list[bytes], kind: tuple[np.ndarray, np.ndarray] = SPACED) -> Words:
    inside, value = kind
    buf = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    in_word = inside[buf]
    edge = np.flatnonzero(in_word[1:] != in_word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    letters = buf[in_word]
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(_values(letters, end - start, value), dtype=np.uint64, out=sums[1:])
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    w = Words(np.empty(0, np.uint64), row, start, end, first, sums)
    w.hash = w._hashed(end - start, np.uint64(0))
    return w


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (over the ends of texts too; the caller drops those)."""
    m = max(0, len(hashes) - n + 1)
    with np.errstate(over="ignore"):
        total = np.full(m, np.uint64(n))
        for k in range(n):
            total += hashes[k : k + m] * _A[k + 2]
    return mix(total)


def blocks(texts: list[bytes], size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes each, to bound what numpy holds."""
    a = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield a, i
            a, total = i, 0
        total += len(t) + 1
    if a < len(texts):
        yield a, len(texts)
