"""Words and shingles of whole texts as 64-bit hashes, computed on Arrow batches without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

# Bytes of text that one step holds as arrays.
STEP_BYTES = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (a bijection)."""
    x = x + _SPREAD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unmixed(x: np.ndarray) -> np.ndarray:
    """What ``mixed`` made ``x`` of."""
    for shift, back in ((31, pow(int(_M2), -1, 1 << 64)), (27, pow(int(_M1), -1, 1 << 64))):
        x = x ^ (x >> np.uint64(shift)) ^ (x >> np.uint64(2 * shift))
        x = x * np.uint64(back)
    return (x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))) - _SPREAD


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower case; white space; what is no ASCII letter and no part of a longer character; value of a byte."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    white = np.zeros(256, dtype=bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    other = np.zeros(256, dtype=bool)
    other[:128] = True
    other[[*range(65, 91), *range(97, 123)]] = False
    return lower, white, other, mixed(np.arange(256, dtype=np.uint64)) | np.uint64(1)


BASE = 0xD1342543DE82EF95
BACK = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """Powers 0 .. n of an odd number, modulo 2 to the 64."""
    p = np.full(n + 1, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Words:
    """Words of a list of texts: ``hashes`` with the text and place (bytes within the joined text) of each.

    Words lie between white space, or are runs of letters where ``letters`` is set; A-Z count as a-z.
    """

    def __init__(self, texts: list[bytes], letters: bool = False):
        lower, white, other, value = _tables()
        joined = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_end = np.cumsum(lengths)
        self.text_start = self.text_end - lengths
        self.joined = lower[joined]
        inside = ~(other if letters else white)[joined]
        change = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.start, self.end = change[::2], change[1::2]
        power, self._back = powers(BASE, len(joined)), powers(BACK, len(joined))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[self.joined] * power[:len(joined)], dtype=np.uint64)])
        self._total = total
        # the sum over a word, divided by the power at its start: words of equal bytes are equal wherever they stand
        raw = (total[self.end] - total[self.start]) * self._back[self.start]
        self.hashes = mixed(raw ^ mixed((self.end - self.start).astype(np.uint64)))
        self.first = np.searchsorted(self.start, self.text_start)
        self.last = np.searchsorted(self.start, self.text_end)

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges [start, end), equal for equal bytes."""
        return mixed((self._total[end] - self._total[start]) * self._back[start])

    def counts(self) -> np.ndarray:
        return self.last - self.first


def shingles(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within [start, end) pieces of ``words``, and the piece of each.

    A piece of fewer words, but at least one, has its whole sequence as its only shingle.
    """
    counts = ends - starts
    many = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    piece = np.repeat(np.arange(len(starts)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + starts[piece]
    length = np.minimum(counts[piece], size)
    out = mixed(length.astype(np.uint64))
    for k in range(size):
        live = length > k
        if live.all():
            out = mixed(out ^ words[at + k])
        else:
            out[live] = mixed(out[live] ^ words[at[live] + k])
    return out, piece


def distinct_in_pieces(hashes: np.ndarray, piece: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's distinct hashes in ascending order, joined, and the n + 1 places where pieces begin and end."""
    order = np.lexsort((hashes, piece))
    h, p = hashes[order], piece[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    h, p = h[new], p[new]
    return h, np.searchsorted(p, np.arange(n + 1))


def steps(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with about STEP_BYTES of text, and their texts as bytes (null: empty)."""
    column = batch.column(text).cast(pa.binary())
    sizes = np.asarray(pa.compute.binary_length(column).fill_null(0), dtype=np.int64)
    at = np.cumsum(sizes) // STEP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a), [x or b"" for x in column.slice(a, b - a).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
