"""Joining many texts into one, without those that the text so far contains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SEPARATOR = " | "
MANY = 200  # texts of a row from which on they are looked up in an index

_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def merge_column(ordered: Column) -> Column:
    """Join distinct texts by the separator, leaving out one that the text so far contains."""
    return F.aggregate(
        ordered,
        F.lit(""),
        lambda text, more: F.when((more == "") | F.contains(text, more), text)
        .when(text == "", more)
        .otherwise(F.concat(text, F.lit(SEPARATOR), more)),
    )


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def contained_earlier(texts: list[str]) -> np.ndarray:
    """For each text without ``|``: whether a text before it contains it. False for the others.

    A table of the hashes of all windows that are as long as a text tells where it can stand
    first: one pass over all characters for each length that occurs, however many texts there
    are. Places are compared with the text, so that the answer does not rest on hashes.
    """
    joined = "|".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _powers(_BASE, len(codes)), out=sums[1:])
    inverse = _powers(_INVERSE, len(codes) + 1)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    whole = np.array(["|" not in t and t != "" for t in texts], bool)
    out = np.zeros(len(texts), bool)
    for n in np.unique(lengths[whole]).tolist():
        which = np.flatnonzero(whole & (lengths == n))
        windows = (sums[n:] - sums[:len(sums) - n]) * inverse[:len(sums) - n]
        wanted, group = np.unique(windows[starts[which]], return_inverse=True)
        near = np.zeros(1 << 16, bool)
        near[(wanted >> np.uint64(48)).astype(np.int64)] = True
        places = np.flatnonzero(near[(windows >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(wanted, windows[places]), len(wanted) - 1)
        there = wanted[at] == windows[places]
        first = np.full(len(wanted), len(codes))
        np.minimum.at(first, at[there], places[there])
        for k, place in zip(which.tolist(), first[group].tolist()):
            if place < starts[k]:
                out[k] = joined.startswith(texts[k], place) or joined.find(texts[k], 0, int(starts[k])) >= 0
    return out


def merge_texts(texts: list[str]) -> str:
    """What ``merge_column`` gives, in time that grows with the texts and not with their square.

    A text that has no ``|`` and no blank at its ends stands in the joined text only if it stands
    within one text before it. A text left out stands in the joined text itself, so it does not
    matter whether that one was kept. The few other texts may lie across separators; they are
    looked for in the joined text as it is then.
    """
    texts = [t for t in texts if t]
    inside = contained_earlier(texts) if texts else []
    kept: list[str] = []
    for text, contained in zip(texts, inside):
        if not contained and ("|" in text or text[0] == " " or text[-1] == " "):
            kept = [SEPARATOR.join(kept)] if kept else kept
            contained = bool(kept) and text in kept[0]
        if not contained:
            kept.append(text)
    return SEPARATOR.join(kept)


def merge_rows(df: DataFrame, texts: str, out: str) -> DataFrame:
    """``df`` (a key column and the ordered array ``texts``) with the joined text ``out`` in the
    array's place. Rows of few texts are joined by the JVM; only the others go to Python."""
    key = next(c for c in df.columns if c != texts)
    schema = f"{key} string, {out} string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, row in zip(batch[key].to_pylist(), batch[texts]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name], pa.string()), pa.array([merge_texts(row.as_py())], pa.string())], [key, out])

    few = df.where(F.size(texts) <= MANY).select(key, merge_column(F.col(texts)).alias(out))
    return few.unionByName(df.where(F.size(texts) > MANY).select(key, texts).mapInArrow(join, schema))
