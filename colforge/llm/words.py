"""Words of whole texts as 64-bit hashes, for a batch of texts at once on the bytes of its Arrow buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from colforge.llm.common import mix

_SPACES = [9, 10, 11, 12, 13, 32]
_LOWER = [b + 32 if 65 <= b <= 90 else b for b in range(256)]

# What a byte becomes; 0 ends a word. `BY_SPACE`: words lie between ASCII white space. `ALPHANUMERIC`: between ASCII
# characters that are neither letters nor digits; characters beyond ASCII belong to words. A-Z count as a-z in both.
BY_SPACE = np.array([0 if b in _SPACES else _LOWER[b] + 1 for b in range(256)], np.uint16)
ALPHANUMERIC = np.array([_LOWER[b] + 1 if b > 127 or chr(b).isalnum() else 0 for b in range(256)], np.uint16)

_DEPTH = 64
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, (_DEPTH, 257), np.uint64)  # one random number per place and byte


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (one entry more than texts)."""
    code = kind[data]
    inside = code > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    number = np.cumsum(first) - 1  # of the word that a byte belongs to
    place = np.arange(len(data)) - starts[np.maximum(number, 0)]
    value = _TABLE[place % _DEPTH, code]
    if int(place[inside].max()) >= _DEPTH:  # very long words: every further stretch weighs its bytes anew
        value = np.where(place >= _DEPTH, mix(value + (place // _DEPTH).astype(np.uint64)), value)
    value = np.where(inside, value, np.uint64(0))
    hashes = mix(np.add.reduceat(value, starts))
    return hashes, np.searchsorted(starts, offsets)


def column_words(column: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hash_words(*text_bytes(column), kind)


def small_batches(batch: pa.RecordBatch, text: int, limit: int = 4 << 20):
    """Slices of a batch with about `limit` bytes of text each, so that temporary arrays stay small."""
    sizes = np.diff(text_bytes(batch.column(text))[1])
    start = 0
    while start < batch.num_rows:
        total = np.cumsum(sizes[start:])
        n = max(1, int(np.searchsorted(total, limit, "right")))
        yield batch.slice(start, n)
        start += n
