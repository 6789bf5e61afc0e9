"""What several operators of this folder share: registration, text chunks, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Characters that separate words: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None):
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` would also change other letters."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that other columns cannot clash with computed ones."""
    return df.select(*columns)


def packed(df: DataFrame) -> DataFrame:
    """All columns in one struct ``doc``, beside which any name can be used."""
    return df.select(F.struct("*").alias("doc"))


def unpacked(names: list[str], **changed: Column) -> list[Column]:
    """The columns of a packed row again, some of them changed; of changed ones only those named."""
    return [
        (changed[c] if c in changed else F.col("doc")[c]).alias(c) for c in names
    ]


# ---- text columns inside tasks ----

CHUNK_BYTES = 2 << 20


def text_chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most ``limit`` bytes of text (or one row), whole texts always.

    Yields the slice, its UTF-8 bytes and the n + 1 offsets of its texts; null is empty.
    """
    for batch in batches:
        column = pc.fill_null(batch.column(text), "").cast(pa.large_string())
        n, buffers = len(column), column.buffers()
        if not n:
            continue
        offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + n + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(n, max(last, first + 1))
            part = offsets[first:last + 1]
            yield batch.slice(first, last - first), data[part[0]:part[-1]], part - part[0]
            first = last


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.ones(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 1024), 0xD6E8FEB86659FD93, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit hashes, so that all bits depend on all bits."""
    v = values.astype(np.uint64)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and the word offsets by text."""
    word = _SPACE[data]
    starts_here = word.copy()
    starts_here[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    starts_here[inner] = word[inner]  # a word does not run on from one text into the next
    starts = np.flatnonzero(starts_here)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = (_LOWER[data[starts[0]:]] + np.uint64(1)) * word[starts[0]:]
    values *= _powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(values, starts - starts[0]))
    return hashes, np.searchsorted(starts, offsets)
