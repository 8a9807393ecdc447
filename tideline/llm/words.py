"""Words and word windows of many texts at once, as numpy arrays.

Texts come as one UTF-8 byte buffer with offsets, straight from an Arrow column.
All separators are ASCII, so words can be cut on bytes.  A word is hashed to 64
bits by a polynomial over its bytes; no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts handled at once; a longer text is a chunk of its own

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = np.uint64(0xD6E8FEB86659FD93)
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def white_words(data: np.ndarray) -> np.ndarray:
    """Bytes of words that white space (0x20, 0x09 to 0x0D) separates."""
    return (data != 0x20) & ((data - np.uint8(9)) > 4)


def alnum_words(data: np.ndarray) -> np.ndarray:
    """Bytes of words of digits, a-z and everything above ASCII."""
    return ((data - np.uint8(0x30)) < 10) | ((data - np.uint8(0x61)) < 26) | (data >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a run of texts: hashes, byte places in ``data``, and where each text's words begin."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # text i has words first[i]:first[i + 1]

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(self.texts), np.diff(self.first))


def _hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, read in blocks of eight bytes."""
    padded = np.empty(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    padded[len(data) :] = 0
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, 0, (1,))
    length = ends - starts
    hashes = length.astype(np.uint64) * _STEP
    hashes += mix(eight[starts] & _FIRST_BYTES[np.minimum(length, 8)])
    longer = np.flatnonzero(length > 8)
    done = 8
    while len(longer):
        left = length[longer] - done
        block = eight[starts[longer] + done] & _FIRST_BYTES[np.minimum(left, 8)]
        hashes[longer] = hashes[longer] * _BLOCK + mix(block)
        longer = longer[left > 8]
        done += 8
    return mix(hashes)


def cut(data: np.ndarray, offsets: np.ndarray, inside: Callable[[np.ndarray], np.ndarray] = white_words, lower: bool = False) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; ``inside`` marks the bytes of words."""
    offsets = np.asarray(offsets, np.int64)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(data, np.empty(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    if lower:
        data = data + (((data - np.uint8(65)) < 26).view(np.uint8) << 5)
    word = inside(data)
    borders = offsets[(offsets > 0) & (offsets < n)]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    opens[borders] = word[borders]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    closes[borders - 1] = word[borders - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, _hash_ranges(data, starts, ends), starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, width: int, factor: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words, over text borders too."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # Doubling: runs of 1, 2, 4, ... words; the bits of the width say which to chain.
    total, have = None, 0
    runs, length, power = hashes, 1, np.uint64(factor)
    with np.errstate(over="ignore"):
        while True:
            if width & length:
                part = runs[have : have + n]
                total = part.copy() if total is None else total * power + part
                have += length
            if have == width:
                return mix(total)
            runs = runs[:-length] * power + runs[length:]
            power = power * power
            length *= 2


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words.

    A text with fewer words has one shingle, all its words; one without words none.
    """
    runs = windows(words.hashes, width)
    for lo, hi in zip(words.first[:-1], words.first[1:]):
        n = hi - lo
        if n >= width:
            yield np.unique(runs[lo : hi - width + 1])
        elif n:
            yield windows(words.hashes[lo:hi], int(n)) ^ np.uint64(n)
        else:
            yield np.empty(0, np.uint64)


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to, bytes, offsets) of a string or binary column with about ``size`` bytes."""
    array = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    held = array.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    row = 0
    while row < len(array):
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(len(array), max(end, row + 1))
        yield row, end, data, offsets[row : end + 1]
        row = end


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
