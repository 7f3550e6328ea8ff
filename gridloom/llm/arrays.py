"""Texts as arrays of 64-bit word hashes, for operators that work on blocks of documents in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

#: The finaliser of the public SplitMix64 generator.
_MIX = ((30, np.uint64(0xBF58476D1CE4E5B9)), (27, np.uint64(0x94D049BB133111EB)))
CHUNK_BYTES = 1_500_000


def mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in _MIX:
        x = (x ^ (x >> np.uint64(shift))) * factor
    return x ^ (x >> np.uint64(31))


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and all else as it is."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_codes(words: list[list[bytes]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of all documents as codes, the distinct words, and where each document begins (one more at the end)."""
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    flat = np.empty(ends[-1], dtype=object)
    flat[:] = list(chain.from_iterable(words))
    if not len(flat):
        return np.zeros(0, np.int64), [], ends
    codes, distinct = pd.factorize(flat)
    return codes, list(distinct), ends


def hash_bytes(values: list[bytes]) -> np.ndarray:
    own = np.empty(len(values), dtype=object)
    own[:] = values
    return pd.util.hash_array(own, categorize=False) if values else np.zeros(0, np.uint64)


def hash_words(words: list[list[bytes]], *prefixes: int) -> tuple[np.ndarray, ...]:
    """The words of all documents as hashes, where each document begins (one more at the end), and
    for each asked length the hashes of the words' first so many bytes."""
    codes, distinct, ends = word_codes(words)
    return (hash_bytes(distinct)[codes], ends, *(hash_bytes([x[:p] for x in distinct])[codes] for p in prefixes))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with about so many characters of text (a longer text is a slice of its own)."""
    for batch in batches:
        lengths = np.array([len(x) if x else 0 for x in batch.column(text).to_pylist()])
        a = 0
        while a < batch.num_rows:
            b = a + max(1, int(np.searchsorted(np.cumsum(lengths[a:]), size, "right")))
            part = batch.slice(a, b - a)
            yield part, part.column(text).to_pylist()
            a = b


def rolling(h: np.ndarray, ends: np.ndarray, width: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words within documents, and each one's document."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, salt, np.uint64)
    for k in range(width):
        out = mix(out ^ h[k : k + n]) + np.uint64(0x9E3779B97F4A7C15)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    whole = doc[:n] == doc[width - 1 :]
    return out[whole], doc[:n][whole]
