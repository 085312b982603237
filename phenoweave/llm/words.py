"""Vectorised word and shingle hashing over Arrow string columns.

A word is a run of bytes that are ASCII digits, ASCII letters or above 0x7F;
A-Z count as a-z. On UTF-8 this equals matching ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
on the text with A-Z lower-cased. Nulls have no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes hashed at once; longer words are hashed one by one


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its len + 1 offsets into them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    size = 8 if wide else 4
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * size).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values (new array)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class WordHasher:
    """64-bit hashes of the words in a byte buffer, the same in every process."""

    def __init__(self) -> None:
        code = np.arange(256)
        letter = ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
        self.is_word = letter | ((code >= 48) & (code <= 57)) | (code >= 128)
        lower = np.where((code >= 65) & (code <= 90), code + 32, code)
        self.table = mix(lower.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        base = np.full(2 * CHUNK + 1, 0x5851F42D4C957F2D, np.uint64)
        base[0] = 1
        self.powers = np.multiply.accumulate(base)

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of the words, and each row's first word (len + 1); words end at row ends."""
        mask = self.is_word[raw]
        start = mask.copy()
        start[1:] &= ~mask[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(raw)]
        start[firsts] = mask[firsts]
        end = mask.copy()
        end[:-1] &= ~mask[1:]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        end[lasts] = mask[lasts]
        starts = np.flatnonzero(start)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)

    def hashes(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            if ends[i] - starts[i] > CHUNK:
                word = bytes(raw[starts[i] : ends[i]]).lower()
                out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
                i += 1
                continue
            j = int(np.searchsorted(ends, starts[i] + CHUNK, "right"))
            lo, hi = starts[i], ends[j - 1]
            sums = np.empty(hi - lo + 1, np.uint64)
            sums[0] = 0
            np.cumsum(self.table[raw[lo:hi]] * self.powers[: hi - lo], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * self.powers[CHUNK - s]
            i = j
        return mix(out)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive values (len - length + 1 of them)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, length):
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += words[k : k + n]
    return mix(out)


def windows_of_rows(words: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and row of each window that stays within one row."""
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[rows] if len(rows) else np.zeros(0, np.int64)
    return window_hashes(words, length)[first], first, rows


def rows_to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
