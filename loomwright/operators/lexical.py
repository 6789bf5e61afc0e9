"""Cosine top-k over word counts: text search that needs no model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomwright.functions.text import words
from loomwright.operators.topk import QUERY_BLOCK, block_count, rank_documents, rank_in_blocks
from loomwright.storage import spread, stage

_BATCH_CELLS = 4_000_000


def _counts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row, word code, count) of a list column, its vocabulary, and the row norms²."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = pc.dictionary_encode(column.flatten())
    rows = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary = coded.dictionary
    size = max(1, len(vocabulary))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cells, counts = np.unique(rows * size + codes, return_counts=True)
    row, code = cells // size, cells % size
    counts = counts.astype(np.float64)
    squares = np.bincount(row, weights=counts * counts, minlength=len(column))
    return row, code, counts, vocabulary, squares


class WordScorer:
    """Cosine of word counts. All sums are of whole numbers, hence exact."""

    query_columns = ("words",)
    doc_columns = ("words",)

    def row_bytes(self) -> Column:
        return F.octet_length(F.array_join("words", " ")) + 4 * F.size("words")

    def prepare(self, queries: pa.Table):
        """Postings (the queries that have a word, and how often) for rare words, and a
        dense row of counts for the words that many queries share."""
        row, code, counts, vocabulary, squares = _counts(queries.column("words"))
        n_queries = queries.num_rows
        lengths = np.bincount(code, minlength=len(vocabulary))
        common = np.flatnonzero(lengths > n_queries / 8)
        common = common[np.argsort(-lengths[common])][: _BATCH_CELLS // max(1, n_queries)]
        dense_row = np.full(len(vocabulary), -1)
        dense_row[common] = np.arange(len(common))
        dense = np.zeros((len(common), n_queries))
        is_common = dense_row[code] >= 0
        dense[dense_row[code[is_common]], row[is_common]] = counts[is_common]

        row, code, counts = row[~is_common], code[~is_common], counts[~is_common]
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(vocabulary)))
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        postings = starts, ends, row[order], counts[order]
        return vocabulary, dense_row, dense, postings, np.sqrt(squares)

    def cells(self, docs: pa.RecordBatch):
        return _counts(docs.column("words"))

    def score(self, state, docs: pa.RecordBatch):
        known, dense_row, dense, postings, query_norms = state
        row, code, counts, vocabulary, squares = self.cells(docs)
        if not len(known) or not len(vocabulary):
            return
        place = pc.fill_null(pc.index_in(vocabulary, value_set=known), -1)
        code = place.to_numpy(zero_copy_only=False).astype(np.int64)[code]
        hit = code >= 0
        row, code, counts = row[hit], code[hit], counts[hit]
        doc_norms = np.sqrt(squares)
        n_queries = len(query_norms)
        step = max(1, _BATCH_CELLS // max(1, n_queries, len(dense)))
        for first in range(0, docs.num_rows, step):
            rows = np.arange(first, min(first + step, docs.num_rows))
            lo, hi = np.searchsorted(row, [first, first + len(rows)])
            at, word, count = row[lo:hi] - first, code[lo:hi], counts[lo:hi]
            common = dense_row[word] >= 0
            shared = np.zeros((len(rows), len(dense)))
            shared[at[common], dense_row[word[common]]] = count[common]
            rare = ~common
            dots = shared @ dense + self._meet(
                at[rare], word[rare], count[rare], postings, (len(rows), n_queries)
            )
            norms = doc_norms[rows][:, None] * query_norms[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                yield rows, np.where(dots > 0, dots / norms, np.nan)

    @staticmethod
    def _meet(row, code, counts, postings, shape: tuple[int, int]) -> np.ndarray:
        """Dot products over postings, in pieces, so that long documents stay in memory."""
        starts, ends, posted, posted_counts = postings
        dots = np.zeros(shape[0] * shape[1])
        lengths = (ends - starts)[code]
        reach = np.cumsum(lengths)
        at = 0
        while at < len(code):
            done = reach[at - 1] if at else 0
            to = int(np.searchsorted(reach, done + _BATCH_CELLS, side="right"))
            to = max(to, at + 1)
            length = lengths[at:to]
            offset = np.repeat(starts[code[at:to]] - np.r_[0, np.cumsum(length)[:-1]], length)
            posting = offset + np.arange(length.sum())
            cell = np.repeat(row[at:to] * shape[1], length) + posted[posting]
            product = np.repeat(counts[at:to], length) * posted_counts[posting]
            dots += np.bincount(cell, weights=product, minlength=len(dots))
            at = to
        return dots.reshape(shape)


class CountedWordScorer(WordScorer):
    """The same for documents whose words are counted already and cut to those asked for."""

    doc_columns = ("words", "counts", "squares")

    def row_bytes(self) -> Column:
        return F.octet_length(F.array_join("words", " ")) + 12 * F.size("words")

    def cells(self, docs: pa.RecordBatch):
        words_ = docs.column("words")
        coded = pc.dictionary_encode(words_.flatten())
        row = pc.list_parent_indices(words_).to_numpy(zero_copy_only=False).astype(np.int64)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = docs.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return row, code, counts, coded.dictionary, docs.column("squares").to_numpy()


def _word_cells(docs: DataFrame) -> DataFrame:
    """(doc_id, word, n, squares): each distinct word of a document with its count, and the sum of
    the squares of all its counts."""
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("word", T.StringType()),
        T.StructField("n", T.DoubleType()), T.StructField("squares", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, code, counts, vocabulary, squares = _counts(batch.column("words"))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), vocabulary.take(pa.array(code)),
                 pa.array(counts), pa.array(squares[row])],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def route_by_words(queries: DataFrame, docs: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the ``block`` of the queries. A document goes to the blocks that ask
    for a word it has, with these words alone, and to no other."""
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = queries.select("block", F.explode("words").alias("word")).distinct()
    routed = _word_cells(docs).join(asked, "word").groupBy("doc_id", "block").agg(
        F.collect_list(F.struct("word", "n")).alias("cells"), F.first("squares").alias("squares")
    )
    return queries, routed.select(
        "doc_id", "block", F.col("cells.word").alias("words"), F.col("cells.n").alias("counts"), "squares")


def lexical_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 3,
    query_text: str = "text",
    doc_text: str = "text",
    where: Column | None = None,
    **limits,
) -> DataFrame:
    """The k documents whose word counts are nearest to each query text; documents
    that share no word with the query are no matches."""
    docs = spread(docs if where is None else docs.where(where))
    return rank_documents(
        queries.select("query_id", words(F.col(query_text)).alias("words")),
        docs.select("doc_id", words(F.col(doc_text)).alias("words")),
        WordScorer(),
        k,
        in_blocks=_rank_routed,
        **limits,
    )


def _rank_routed(queries: DataFrame, docs: DataFrame, scorer: WordScorer, k: int, schema) -> DataFrame:
    queries = stage(queries, "lexical-queries")  # sized, listed by word, and ranked
    blocks = queries.select(block_count(scorer, QUERY_BLOCK)).first()[0]
    queries, routed = route_by_words(queries, docs, blocks)
    routed = stage(routed, "lexical-routed")
    return rank_in_blocks(queries, routed, CountedWordScorer(), k, schema, bucket="block")
