"""Best k per query, without ever emitting all (query, document) pairs.

Each task scores its documents against a block of queries and keeps the k best per
query; only these meet in the final ranking. A scorer is an object with

``query_columns`` / ``doc_columns``
    names of the columns it reads besides the id;
``row_bytes() -> Column``
    about how many bytes a row of either side takes;
``prepare(queries: pyarrow.Table) -> state``
    once per block of queries;
``score(state, docs: pyarrow.RecordBatch) -> iterator of (rows, scores)``
    ``rows`` are positions in the batch, ``scores`` a (rows x queries) array in which
    ``nan`` marks a document that is no match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A query side up to this many rows and bytes goes to every task; a larger one is
# cut into blocks that are shuffled together with blocks of documents.
MAX_SHARED_QUERIES = 16_384
MAX_SHARED_BYTES = 64 << 20
QUERY_BLOCK = 2048
DOC_BLOCK = 100_000
LEAST_DOC_BLOCK = 1000
BLOCK_BYTES = 128 << 20


class _Best:
    """Running k best (score descending, id ascending) for each query of a block."""

    def __init__(self, n_queries: int, k: int):
        self._k = k
        self._scores = [np.empty(0)] * n_queries
        self._ids = [None] * n_queries
        self._least = np.full(n_queries, -np.inf)  # score of the k-th best so far

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        # In id order the first of equal scores are the ones to keep.
        order = np.argsort(ids, kind="stable")
        ids, scores = ids[order], scores[order]
        scores[np.isnan(scores)] = -np.inf
        k, n = self._k, len(ids)
        top = scores.max(axis=0)
        cuts = np.partition(scores, n - k, axis=0)[n - k] if n > k else None
        for q in np.flatnonzero((top > -np.inf) & (top >= self._least)):
            column = scores[:, q]
            if cuts is None:
                chosen = np.flatnonzero(column > -np.inf)
            else:
                above = np.flatnonzero(column > cuts[q])
                level = np.flatnonzero((column == cuts[q]) & (column > -np.inf))
                chosen = np.concatenate([above, level[: k - len(above)]])
            found, found_ids = column[chosen], ids[chosen]
            if self._ids[q] is not None:
                found = np.concatenate([self._scores[q], found])
                found_ids = np.concatenate([self._ids[q], found_ids])
            best = np.lexsort((found_ids, -found))[:k]
            self._scores[q], self._ids[q] = found[best], found_ids[best]
            if len(best) == k:
                self._least[q] = found[best[-1]]

    def table(self, query_ids: pa.Array, doc_type: pa.DataType) -> pa.Table:
        filled = [q for q, ids in enumerate(self._ids) if ids is not None]
        if not filled:
            return pa.table(
                {
                    "query_id": query_ids.slice(0, 0),
                    "doc_id": pa.array([], doc_type),
                    "score": pa.array([], pa.float64()),
                }
            )
        counts = [len(self._ids[q]) for q in filled]
        return pa.table(
            {
                "query_id": query_ids.take(pa.array(np.repeat(filled, counts))),
                "doc_id": pa.array(np.concatenate([self._ids[q] for q in filled]), doc_type),
                "score": pa.array(np.concatenate([self._scores[q] for q in filled])),
            }
        )


def _combined(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _rank_block(scorer, queries: pa.Table, batches: Iterator[pa.RecordBatch], k: int) -> pa.Table | None:
    best, state, doc_type = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if best is None:
            best, state = _Best(queries.num_rows, k), scorer.prepare(queries)
            doc_type = batch.column("doc_id").type
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for rows, scores in scorer.score(state, batch):
            best.add(ids[rows], scores)
    if best is None:
        return None
    return best.table(_combined(queries.column("query_id")), doc_type)


def best_k(candidates: DataFrame, k: int) -> DataFrame:
    """Rank (query_id, doc_id, score) rows per query from 1 and keep the first k."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(
    queries: DataFrame,
    docs: DataFrame,
    scorer,
    k: int,
    max_shared: int = MAX_SHARED_QUERIES,
    max_shared_bytes: int = MAX_SHARED_BYTES,
    in_blocks: Callable | None = None,
) -> DataFrame:
    """Exact k best documents per query: (query_id, doc_id, score, rank).

    ``queries`` has ``query_id`` and the scorer's query columns; ``docs`` has
    ``doc_id`` and the scorer's document columns. A query side within the bounds is shared with
    all tasks; beyond them ``in_blocks`` (``rank_in_blocks`` by default) gives the same result.
    """
    queries = queries.select("query_id", *scorer.query_columns)
    docs = docs.select("doc_id", *scorer.doc_columns)
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    # The size is measured before anything is read back to be shared.
    rows, size = (
        queries.limit(max_shared + 1).agg(F.count("*"), F.sum(scorer.row_bytes())).first()
    )
    if rows > max_shared or (size or 0) > max_shared_bytes:
        return best_k((in_blocks or rank_in_blocks)(queries, docs, scorer, k, schema), k)
    handle = queries.sparkSession.sparkContext.broadcast(queries.toArrow())

    def run(batches):
        table = _rank_block(scorer, handle.value, batches, k)
        if table is not None:
            yield from table.to_batches()

    return best_k(docs.mapInArrow(run, schema), k)


def block_count(scorer, rows: int | Column, block_bytes: int = BLOCK_BYTES) -> Column:
    """How many blocks of bounded rows and bytes a side needs."""
    return F.greatest(
        F.lit(1),
        F.ceil(F.count("*") / rows),
        F.ceil(F.coalesce(F.sum(scorer.row_bytes()), F.lit(0)) / block_bytes),
    ).cast("int")


def rank_in_blocks(
    queries: DataFrame,
    docs: DataFrame,
    scorer,
    k: int,
    schema: T.StructType,
    bucket: str | None = None,
    query_block: int = QUERY_BLOCK,
    doc_block: int = DOC_BLOCK,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """k best per query within each pair of blocks, for a query side of any size.

    Both sides are hashed into blocks of bounded size, so no task ever holds more
    than one block of each, and a block pair emits at most k rows per query. With a
    ``bucket`` column only rows of the same bucket meet, and a bucket gets as many
    blocks as its own size needs.
    """

    def blocks(rows: int | Column) -> Column:
        return block_count(scorer, rows, block_bytes)

    q_blocks = blocks(query_block)
    if bucket is None:
        n_q_blocks = queries.select(q_blocks).first()[0]
        # Small document sides are cut finer, so that every core gets a pair of blocks.
        cores = docs.sparkSession.sparkContext.defaultParallelism
        per_core = F.ceil(F.count("*") * n_q_blocks / cores)
        rows = F.least(F.lit(doc_block), F.greatest(F.lit(LEAST_DOC_BLOCK), per_core))
        n_d_blocks = docs.select(blocks(rows)).first()[0]
        counts = {"_q_blocks": F.lit(n_q_blocks), "_d_blocks": F.lit(n_d_blocks)}
        queries, docs = (
            side.withColumns({"_bucket": F.lit(0), **counts}) for side in (queries, docs)
        )
    else:
        queries = queries.withColumnRenamed(bucket, "_bucket")
        docs = docs.withColumnRenamed(bucket, "_bucket")
        sizes = (
            queries.groupBy("_bucket")
            .agg(q_blocks.alias("_q_blocks"))
            .join(docs.groupBy("_bucket").agg(blocks(doc_block).alias("_d_blocks")), "_bucket")
        )
        queries, docs = (side.join(sizes, "_bucket") for side in (queries, docs))

    def block_of(column: str, blocks: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))

    left = (
        queries.withColumn("_q", block_of("query_id", "_q_blocks"))
        .withColumn("_d", every("_d_blocks"))
        .drop("_q_blocks", "_d_blocks")
    )
    right = (
        docs.withColumn("_d", block_of("doc_id", "_d_blocks"))
        .withColumn("_q", every("_q_blocks"))
        .drop("_q_blocks", "_d_blocks")
    )
    empty = to_arrow_schema(schema).empty_table()

    def run(query_table: pa.Table, doc_table: pa.Table) -> pa.Table:
        if not query_table.num_rows or not doc_table.num_rows:
            return empty
        return _rank_block(scorer, query_table, iter(doc_table.to_batches()), k)

    keys = ("_bucket", "_q", "_d")
    # Both sides may come from one frame: fresh columns keep them apart.
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)

