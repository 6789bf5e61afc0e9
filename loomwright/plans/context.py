"""Context of requests: what the indexes of catalog columns and approved specs say to each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomwright.operators.context import CATALOG_HITS, TASK_HITS, assemble_context, indented
from loomwright.operators.vectors import Embedder
from loomwright.sources.index_store import DocumentIndex


def request_context(
    requests: DataFrame,
    catalog: DocumentIndex,
    tasks: DocumentIndex,
    embedder: Embedder,
    catalog_hits: int = CATALOG_HITS,
    task_hits: int = TASK_HITS,
) -> DataFrame:
    """(query_id, context) of requests (query_id, text), by the nearest documents of both indexes.

    An index without a document gives none; a request that neither answers gets the
    sentence that says so. Metadata fields are listed by name.
    """

    def hits(index: DocumentIndex, k: int) -> DataFrame:
        if index.read() is None:
            return requests.sparkSession.createDataFrame(
                [], "query_id string, rank int, page_content string, metadata string"
            ).withColumn("query_id", F.col("query_id").cast(requests.schema["query_id"].dataType))
        return index.search(requests, k, embedder).select(
            "query_id", "rank", F.col("text_content").alias("page_content"),
            indented(F.col("metadata")).alias("metadata"),
        )

    return assemble_context(requests, hits(catalog, catalog_hits), hits(tasks, task_hits))
