"""Embedding of texts and cosine top-k over vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomwright.operators.topk import rank_documents, rank_in_blocks
from loomwright.storage import spread

# Cosines are ranked on this many decimals: the last bits depend on the order of
# summation, and equal vectors must tie.
SCORE_DECIMALS = 9
_BATCH_CELLS = 4_000_000
# All vectors travel once for each block of queries, so these are large.
QUERY_BLOCK = 8192

Embedder = Callable[[Sequence[str]], np.ndarray]


def hashing_embedder(dimension: int = 64) -> Embedder:
    """A model-free embedder: word counts hashed into unit vectors.

    Expects words separated by single spaces.
    """

    def slot(word: str) -> int:
        return int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16) % dimension

    def embed(texts: Sequence[str]) -> np.ndarray:
        words = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = pc.dictionary_encode(words.flatten())
        slots = np.array([slot(w) if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
        place = slots[coded.indices.to_numpy(zero_copy_only=False)]
        row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
        kept = place >= 0
        cells = row[kept].astype(np.int64) * dimension + place[kept]
        vectors = np.bincount(cells, minlength=len(texts) * dimension).astype(np.float64)
        vectors = vectors.reshape(len(texts), dimension)
        norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return np.divide(vectors, norms, out=vectors, where=norms > 0)

    return embed


def embed_texts(
    df: DataFrame,
    text_col: str,
    make_embedder: Callable[[], Embedder],
    out: str = "embedding",
    batch_size: int = 1000,
    prepare: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """Add an embedding column. ``make_embedder`` runs once per task, so that a model
    is loaded on the workers and never shipped; it is given the prepared texts."""
    schema = T.StructType(
        [*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType(), False))]
    )
    prepared = spread(df).withColumn("_prepared", prepare(F.col(text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = None
        for big in batches:
            embed = embed or make_embedder()
            for start in range(0, big.num_rows, batch_size):
                batch = big.slice(start, batch_size)
                texts = ["" if t is None else t for t in batch.column("_prepared").to_pylist()]
                vectors = np.asarray(embed(texts), dtype=np.float32)
                column = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(texts) + 1) * vectors.shape[1], pa.int32()),
                    pa.array(vectors.ravel()),
                )
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], column], names=[*batch.schema.names[:-1], out]
                )

    return prepared.mapInArrow(run, schema)


def plain_words(text: Column) -> Column:
    """Text reduced to lower-case words with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def unit_rows(column) -> np.ndarray:
    """A column of vectors as a matrix of unit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / norms  # a zero vector has no direction: nan, never a match


class CosineScorer:
    """Cosine of vectors of one length."""

    query_columns = ("embedding",)
    doc_columns = ("embedding",)

    def row_bytes(self) -> Column:
        return F.size("embedding") * 8

    def prepare(self, queries: pa.Table) -> np.ndarray:
        return unit_rows(queries.column("embedding"))

    def score(self, state: np.ndarray, docs: pa.RecordBatch):
        vectors = unit_rows(docs.column("embedding"))
        step = max(1, _BATCH_CELLS // max(1, len(state)))
        for start in range(0, len(vectors), step):
            part = vectors[start : start + step]
            yield np.arange(start, start + len(part)), np.round(part @ state.T, SCORE_DECIMALS)


def cosine_topk(
    queries: DataFrame, docs: DataFrame, k: int = 3, where: Column | None = None, **limits
) -> DataFrame:
    """The k documents nearest to each query vector.

    The metadata filter is applied before ranking, where it can reach the scan.
    """
    docs = docs if where is None else docs.where(where)
    present = "embedding is not null and size(embedding) > 0"
    limits.setdefault("in_blocks", partial(rank_in_blocks, query_block=QUERY_BLOCK))
    return rank_documents(
        queries.where(present), spread(docs.where(present)), CosineScorer(), k, **limits
    )


def project_matches(matches: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Join ranked ids back to document content; only the few matches travel."""
    return matches.join(docs.select(F.col("id").alias("doc_id"), *columns), "doc_id")
