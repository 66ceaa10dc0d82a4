"""Words of whole Arrow batches and their hashes, with numpy.

A word is a run of bytes other than space and 0x09-0x0D. Bytes of other
characters in UTF-8 are 0x80 or more, so cutting bytes cuts characters right.
"""

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
SUMMED_BYTES = 32
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_tables(lower: bool, letters: bool) -> tuple[np.ndarray, np.ndarray]:
    """Value of each byte in a hash, and whether it parts words."""
    codes = np.arange(256)
    if lower:
        codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    if letters:
        space = ~(((codes >= 97) & (codes <= 122)) | ((codes >= 65) & (codes <= 90)) | ((codes >= 48) & (codes <= 57)) | (codes >= 128))
    with np.errstate(over="ignore"):
        return mix((codes.astype(np.uint64) + np.uint64(1)) * STEP), space


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse; grown as needed and kept."""
    if len(_POWERS[0]) < n:
        base = 0x5851F42D4C957F2D
        for i, b in enumerate((base, pow(base, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK_BYTES + 1), b, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offset of each; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    starts: np.ndarray  # byte where it begins
    ends: np.ndarray  # byte after it
    first: np.ndarray  # index of each text's first word, and the number of words
    bounds: np.ndarray  # byte where each text begins, and where the last one ends


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool, letters: bool = False) -> Words:
    """Words of texts that lie between neighbouring offsets of ``data``.

    ``lower`` takes A-Z as a-z; with ``letters`` all ASCII but letters and digits parts words.
    """
    begin, data = offsets[0], data[offsets[0] : offsets[-1]]
    values, spaces = _byte_tables(lower, letters)
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~spaces[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets - begin] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    # Sums modulo a power of two meet on long words of a regular build, so those are hashed byte by byte.
    for k in np.flatnonzero(ends - starts > SUMMED_BYTES):
        word = data[starts[k] : ends[k]].tobytes()
        hashes[k] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return Words(hashes, starts + begin, ends + begin, np.searchsorted(starts, offsets - begin), offsets)


def word_hash(word: str) -> int:
    """Hash of one word without blanks, in lower case."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words_of(data, np.array([0, len(data)]), True).hashes[0])


def in_chunks(column: pa.Array, lower: bool, letters: bool = False) -> Iterator[tuple[int, np.ndarray, Words]]:
    """(index of the first text, bytes, words) of runs of texts of about ``CHUNK_BYTES`` together."""
    data, offsets = bytes_of(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, data, words_of(data, offsets[at : end + 1], lower, letters)
        at = end


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on, where so many follow."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    count = len(hashes) - n + 1
    x = mix(hashes[:count] + STEP)
    for j in range(1, n):
        x = mix(x * STEP + hashes[j : j + count])
    return x


def grams_at(hashes: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
    """Those of ``grams`` that begin at ``starts``; where most are wanted, all are worked out in place of gathering."""
    if 2 * len(starts) > len(hashes):
        return grams(hashes, n)[starts]
    x = mix(hashes[starts] + STEP)
    for j in range(1, n):
        x = mix(x * STEP + hashes[starts + j])
    return x
