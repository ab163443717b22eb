"""Byte-level text helpers shared by the Python-side operators.

A word is a maximal run of bytes outside space and 0x09-0x0D, after A-Z became a-z, which is
what ``bytes.translate(LOWER).split()`` yields. UTF-8 never uses those bytes inside a
multi-byte character, so splitting bytes and splitting characters agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CHUNK_BYTES = 2 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """A word -> 64-bit hash memo; ``trim`` keeps it bounded between chunks."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def trim(self, most: int = 100_000) -> None:
        if len(self) > most:
            self.clear()


def free_name(df, name: str) -> str:
    """``name``, or that with underscores in front, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over whole arrays."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches that hold about CHUNK_BYTES of text each, with that text as bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for row, size in enumerate(sizes):
            if row > start and total + size > CHUNK_BYTES:
                yield batch.slice(start, row - start), column.slice(start, row - start).to_pylist()
                start, total = row, 0
            total += int(size)
        if len(column) > start:
            yield batch.slice(start), column.slice(start).to_pylist()


def word_hashes(texts: list[bytes | None], memo: WordHashes, table: bytes = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and where each text's words begin (one more at the end)."""
    memo.trim()
    parts, starts = [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words = text.translate(table).split() if text else []
        parts.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
        starts[i + 1] = starts[i] + len(words)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), starts


def shingles(words: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's set of ``width``-word shingles as sorted distinct hashes.

    A text with fewer words has its whole sequence as the one shingle; one without words, none.
    """
    rolled = _roll(words, width)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(_roll(words[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _roll(words: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(words) - width + 1)
    h = np.full(n, width, np.uint64) * _GOLDEN
    for k in range(width):
        h = mix(h + words[k : k + n] * np.uint64(0x9FB21C651E98DF25))
    return h
