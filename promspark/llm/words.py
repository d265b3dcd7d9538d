"""Vectorised word tokens of Arrow string columns.

Every operator that works on word sequences (shingles, k-mer seeds, spaced
seeds, piece lattices) reads its words here: the UTF-8 buffer of a batch is
split with numpy, and each word gets a 64-bit hash, so no Python object is
made per word.  Batches are cut into chunks of bounded size, which bounds
the memory of a task whatever the batch or document count; only a single
document larger than the bound is a chunk of its own.

Five alphabets:

* ``SPACE_WORDS``: maximal runs of anything but 0x20 and 0x09-0x0D, A-Z
  lower-cased (the word rule of the n-gram join);
* ``LETTER_WORDS``: maximal runs of ASCII letters, digits and non-ASCII
  characters, lower-cased for A-Z and Latin-1 capitals, so punctuation, case
  and white space do not tell two passages apart;
* ``ALPHA_WORDS``: the same without digits;
* ``TERM_WORDS``: as ``LETTER_WORDS``, but only A-Z is lower-cased;
* ``UNIT_WORDS``: as ``SPACE_WORDS``, cut too where an ASCII letter is followed
  by another ASCII character (but ``|``).  A chunk that holds ``<|``, which
  begins the special tokens of public vocabularies, keeps its words whole and
  their case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SPACE_WORDS, LETTER_WORDS, UNIT_WORDS, ALPHA_WORDS, TERM_WORDS = "space", "letter", "unit", "alpha", "term"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: a bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _tables(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, value of a byte) per byte value."""
    b = np.arange(256)
    if kind in (LETTER_WORDS, ALPHA_WORDS, TERM_WORDS):
        inside = (b >= 128) | ((b >= 48) & (b <= 57) & (kind != ALPHA_WORDS)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
    else:
        inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    low = np.where((b >= 65) & (b <= 90), b + 32, b)
    return inside, np.where(inside, _BYTE[low], np.uint64(0))


_LETTER = np.isin(np.arange(256) | 0x20, np.arange(97, 123)) & (np.arange(256) < 128)
_CUTS = ~_LETTER & (np.arange(256) < 128) & (np.arange(256) != ord("|"))
_SALT = np.uint64(0xA0761D6478BD642F)
_TABLES = {k: _tables(k) for k in (SPACE_WORDS, LETTER_WORDS, UNIT_WORDS, ALPHA_WORDS, TERM_WORDS)}


@dataclass
class Words:
    """Words of the rows [first, first + n) of a batch, one after another."""

    first: int
    hashes: np.ndarray  # uint64, one per word
    starts: np.ndarray  # byte offsets in ``data``
    ends: np.ndarray
    offsets: np.ndarray  # n + 1 word offsets, one range per row
    data: np.ndarray  # the chunk's bytes
    rows: np.ndarray  # n + 1 byte offsets of the rows

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets n + 1, bytes) of a string array; a null counts as empty."""
    if pa.types.is_null(column.type):
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1] if off is not None else np.zeros(1)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets.astype(np.int64), data


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on after a task, and what they keep counts
    against their executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A function from batches to batches that gives its memory back when it ends: its worker waits for
    the next task with what it keeps."""
    def to_the_end(batches):
        yield from run(batches)
        give_back()
    return to_the_end


def chunks(column: pa.Array, kind: str, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a string column in chunks of about ``limit`` bytes; every row is in one chunk."""
    give_back()
    offsets, data = string_buffers(column)
    n, i = len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield split_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], kind, i)
        i = j


def split_words(data: np.ndarray, rows: np.ndarray, kind: str, first: int = 0) -> Words:
    inside, value = _TABLES[kind]
    size = len(data)
    if not size:
        return Words(first, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64),
                     np.zeros(len(rows), np.int64), data, rows)
    cut = np.zeros(size + 1, bool)  # a row begins here
    cut[rows[:-1]] = True
    cut[size] = True
    word = inside[data]
    special = kind == UNIT_WORDS and b"<|" in data.tobytes()
    if kind == UNIT_WORDS and not special:
        cut[1:-1] |= _LETTER[data[:-1]] & _CUTS[data[1:]]
    left = np.empty(size, bool)
    left[0] = True
    left[1:] = ~word[:-1]
    starts = np.flatnonzero(word & (left | cut[:-1]))
    right = np.empty(size, bool)
    right[-1] = True
    right[:-1] = ~word[1:]
    ends = np.flatnonzero(word & (right | cut[1:])) + 1
    if kind in (LETTER_WORDS, ALPHA_WORDS):  # Latin-1 capitals: C3 80-9E but 97, to C3 A0-BE
        high = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        if len(high):
            data_low = data.copy()
            data_low[high] += 0x20
            val = value[data_low]
        else:
            val = value[data]
    else:
        val = np.where(word, _BYTE[data], np.uint64(0)) if special else value[data]
    if len(starts):
        at = np.repeat(starts, np.diff(np.append(starts, size)))
        at = np.arange(starts[0], size) - at  # place within the word (or behind it, where val is 0)
        v = val[starts[0]:] * _POWERS[at & 0xFFFF]
        if len(at) > 65536 and at.max() > 65535:
            v *= (at >> 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        hashes = mix(np.add.reduceat(v, starts - starts[0]) + (ends - starts).astype(np.uint64))
        hashes = hashes ^ _SALT if special else hashes
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(first, hashes, starts, ends, np.searchsorted(starts, rows), data, rows)


_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def ngrams(words: Words, n: int, mask: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index of the first word) of every run of ``n`` words inside a row.

    ``mask`` names the places of the run that count (all by default)."""
    h, total = words.hashes, len(words.hashes)
    count = total - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(count, np.uint64)
    for k in (range(n) if mask is None else mask):
        out += h[k:k + count] * _ODD[k]
    ok = np.ones(count, bool)
    for k in range(1, n):  # runs that would cross into the next row
        edge = words.offsets[1:-1] - k
        edge = edge[(edge >= 0) & (edge < count)]
        ok[edge] = False
    at = np.flatnonzero(ok)
    return mix(out[at]), at
