"""Columns of texts as flat byte arrays, and vectorised words, hashes and shingles over them."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15
#: Spans of more bytes are hashed one by one.
LONG = 512
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: The separators of words: \x20 and \x09-\x0D; all other bytes belong to words.
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: The same with ASCII punctuation as separators too.
IN_PLAIN_WORD = IN_WORD.copy()
IN_PLAIN_WORD[[b for b in range(128) if not chr(b).isalnum()]] = False
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets into them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows with about ``most`` bytes of text each, which bounds what numpy needs at once."""
    for batch in batches:
        size = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)]))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def give_back() -> None:
    """Return this process's freed memory to the system: a Python worker outlives its task, and the next one's comes on top of what it holds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many words stand before each text (n+1 numbers). Words never cross texts.
    ``inside``: which bytes belong to words."""
    word = np.concatenate([[False], inside[data], [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits after which all bits depend on all others (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def stretches(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts as they are; a single text of more than ``most`` bytes in stretches that end after a separator, so no word is cut."""
    if len(offsets) != 2 or len(data) <= most:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        while end < len(data) and IN_WORD[data[end - 1]]:
            ahead = np.flatnonzero(~IN_WORD[data[end : end + most]])
            end = min(len(data), end + (int(ahead[0]) + 1 if len(ahead) else most))
        yield data[at:end], np.array([0, end - at])
        at = end


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; equal bytes have equal hashes wherever they stand.

    Eight bytes at a time are mixed into the hash by a bijection, so, unlike for a polynomial modulo 2^64, no texts of regular
    structure are known that collide; spans above LONG bytes go through BLAKE2.
    """
    size = ends - starts
    h = mixed(size.astype(np.uint64) + np.uint64(_P))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    live, at = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(live):
        left = size[live] - at
        chunk = eight[starts[live] + at] & _FIRST[np.minimum(left, 8)]
        h[live] = mixed(h[live] ^ chunk) + np.uint64(_P)
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].data, digest_size=8).digest(), "little")
    return mixed(h)


def shingles(words: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and how many stand before each text. A text with fewer words, but at least one, has
    one shingle of all its words. ``before``: words before each text, as from spans()."""
    n = np.diff(before)
    many = np.where(n == 0, 0, np.maximum(1, n - width + 1))
    offsets = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(n)), many)
    first = before[:-1][text] + np.arange(offsets[-1]) - offsets[:-1][text]
    last = before[1:][text]
    h = np.full(len(first), 0x5851F42D4C957F2D, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = first + k < last
            w = words[np.minimum(first + k, max(0, len(words) - 1))] if len(words) else np.zeros(0, np.uint64)
            h = np.where(inside, (h ^ w) * np.uint64(_P) + np.uint64(k + 1), h)
    return mixed(h), offsets
