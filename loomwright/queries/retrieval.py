"""Document index, vector search, lexical search and context texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomwright.operators.context import assemble_context
from loomwright.operators.inverted_file import InvertedFile
from loomwright.operators.lexical import lexical_topk
from loomwright.operators.vectors import (
    cosine_topk, embed_texts, hashing_embedder, plain_words, project_matches,
)
from loomwright.queries.base import query, stable, stable_sql, table
from loomwright.sources.index_store import (
    DocumentIndex, as_documents, metadata_equals, with_variant_metadata,
)
from loomwright.storage import scratch_path, stage

# ---- index ----


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _document_batch(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_variant_metadata(
        as_documents(docs, F.col("text"), F.struct("source", "lang"), _id("doc-", "doc_id"))
    )


def _changes(spark, sf_dir) -> DataFrame:
    """New texts for the labelled documents, and each conversation's messages in turn."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    relabelled = labelled.select(
        _id("doc-", "doc_id").alias("id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(": "), "text").alias(
            "text_content"
        ),
        F.struct(F.lit("labelled").alias("source"), F.col("lang").alias("lang")).alias("metadata"),
        F.lit(0).cast("bigint").alias("position"),
    )
    messages = table(spark, sf_dir, "conversations").select(
        _id("conv-", "conv_id").alias("id"),
        F.col("text").alias("text_content"),
        F.struct(F.lit("conversation").alias("source"), F.lit("").alias("lang")).alias("metadata"),
        F.col("turn").alias("position"),
    )
    return with_variant_metadata(relabelled.unionByName(messages))


@query(
    "index_upsert",
    """
    WITH last AS (
      SELECT conv_id, text FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
        FROM conversations) WHERE rn = 1)
    SELECT 'doc-' || d.doc_id AS id,
           CASE WHEN l.doc_id IS NULL THEN d.text
                ELSE 'quality ' || l.quality || ': ' || d.text END AS text_content,
           CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'labelled' END AS source
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL SELECT 'conv-' || conv_id, text, 'conversation' FROM last
    """,
)
def index_upsert(spark, sf_dir):
    index = DocumentIndex(spark, scratch_path(spark, "index"))
    index.upsert(_document_batch(spark, sf_dir))
    index.upsert(_changes(spark, sf_dir), position="position")
    return index.read().select(
        "id", "text_content", F.try_variant_get("metadata", "$.source", "string").alias("source")
    )


@query(
    "index_delete",
    """
    SELECT 'doc-' || doc_id AS id, source FROM documents WHERE source <> 'src3'
    UNION ALL SELECT 'page-' || page_id, NULL FROM pages
    """,
)
def index_delete(spark, sf_dir):
    index = DocumentIndex(spark, scratch_path(spark, "index"))
    pages = table(spark, sf_dir, "pages")
    unsourced = as_documents(pages, F.col("html"), F.struct("url"), _id("page-", "page_id"))
    index.upsert(_document_batch(spark, sf_dir).unionByName(with_variant_metadata(unsourced)))
    index.delete(metadata_equals("source", "src3"))
    return index.read().select(
        "id", F.try_variant_get("metadata", "$.source", "string").alias("source")
    )


# ---- vectors ----


def _centroids(spark, sf_dir) -> DataFrame:
    """The mean vector of each label: a query side that does not grow with the rows."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding"))
    means = cells.groupBy("label", "pos").agg(F.avg("col").alias("v"))
    return means.groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("cells")
    ).select(F.col("label").alias("query_id"), F.col("cells.v").alias("embedding"))


_VECTOR_SQL = """
    WITH cells AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos
                   FROM embeddings),
    means AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS a FROM cells GROUP BY 1, 2),
    q AS (SELECT label, list(a ORDER BY pos) AS qv FROM means GROUP BY 1),
    scored AS (
      SELECT q.label AS query_id, e.vec_id AS doc_id, e.label AS doc_label,
             floor(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])) * 1e9 + 0.5) / 1e9 AS score
      FROM q, embeddings e WHERE {where}),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)
                              AS INTEGER) AS rank FROM scored)
    SELECT {columns} FROM ranked WHERE rank <= {k}
"""


@query("vector_topk", _VECTOR_SQL.format(where="true", columns="query_id, doc_id, score, rank", k=5))
def vector_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return cosine_topk(_centroids(spark, sf_dir), docs, k=5)


@query(
    "vector_topk_filtered",
    _VECTOR_SQL.format(
        where="e.label = 3", columns="query_id, doc_id, score, rank, doc_label AS label", k=3
    ),
)
def vector_topk_filtered(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    docs = vectors.select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    hits = cosine_topk(_centroids(spark, sf_dir), docs, k=3, where=F.col("label") == 3)
    return project_matches(hits, vectors.withColumnRenamed("vec_id", "id"), "label")


RECALL = 0.9  # what the approximate search states and its query measures


@query(
    "vector_topk_approx",
    "SELECT vec_id AS query_id, CAST(3 AS BIGINT) AS n_found, true AS recall_reached, true AS few_compared FROM embeddings",
)
def vector_topk_approx(spark, sf_dir):
    """How many neighbours each vector finds, whether those of every twentieth are the exact
    ones often enough, and whether it was compared with less than a tenth of all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.selectExpr("vec_id query_id", "embedding")
    docs = vectors.selectExpr("vec_id doc_id", "embedding")
    index = InvertedFile(docs, k=3)
    found = stage(index.search(asked), "approximate")
    exact = cosine_topk(asked.where("query_id % 20 = 0"), docs, k=3)
    share = exact.join(
        found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left"
    ).agg((F.count("hit") / F.count("*") >= RECALL).alias("reached"))
    return found.groupBy("query_id").agg(
        F.count("*").alias("n_found"), (F.max("compared") * 10 < F.lit(index.size)).alias("few_compared")
    ).withColumn("recall_reached", share.scalar())


_WORDS_SQL = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}]+'), lambda w: w <> '')"


_SEARCHED = "src3"


@query(
    "index_search",
    f"""
    WITH texts AS (
      SELECT 'doc-' || doc_id AS id, NULL AS query_id, text FROM documents WHERE source = '{_SEARCHED}'
      UNION ALL SELECT NULL, item_id, text FROM benchmark),
    w AS (SELECT id, query_id, unnest({_WORDS_SQL.format("text")}) AS word FROM texts),
    n AS (SELECT id, query_id, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 64 AS slot,
                 CAST(count(*) AS DOUBLE) AS c FROM w GROUP BY ALL),
    s AS (SELECT *, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id, query_id)) AS FLOAT) AS DOUBLE) AS f FROM n),
    norms AS (SELECT id, query_id, sqrt(sum(f * f)) AS norm FROM s GROUP BY ALL),
    scored AS (
      SELECT q.query_id, d.id, round(sum(q.f * d.f) / any_value(nq.norm) / any_value(nd.norm), 9) AS score
      FROM s q JOIN s d ON q.slot = d.slot AND q.query_id IS NOT NULL AND d.id IS NOT NULL
      JOIN norms nq ON nq.query_id = q.query_id JOIN norms nd ON nd.id = d.id GROUP BY ALL),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
               FROM scored)
    SELECT r.query_id, r.id, rank, {stable_sql("score", 6)} AS score, t.text AS text_content, '{_SEARCHED}' AS source
    FROM ranked r JOIN texts t ON t.id = r.id WHERE rank <= 3
    """,
)
def index_search(spark, sf_dir):
    index = DocumentIndex(spark, scratch_path(spark, "index"), dimension=64)
    index.upsert(_document_batch(spark, sf_dir), embedder=hashing_embedder(64))
    queries = table(spark, sf_dir, "benchmark").selectExpr("item_id query_id", "text")
    found = index.search(queries, 3, hashing_embedder(64), source=_SEARCHED)
    return found.select(
        "query_id", "id", "rank", stable("score", 6).alias("score"), "text_content",
        F.try_variant_get("metadata", "$.source", "string").alias("source"),
    )


@query(
    "embed_text",
    f"""
    WITH w AS (SELECT doc_id, unnest({_WORDS_SQL.format("text")}) AS word FROM documents),
    n AS (SELECT doc_id, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 64 AS slot,
                 CAST(count(*) AS DOUBLE) AS c FROM w GROUP BY 1, 2),
    s AS (SELECT *, sum(c * c) OVER (PARTITION BY doc_id) AS total FROM n)
    SELECT doc_id, CAST(slot AS INTEGER) AS slot,
           {stable_sql("CAST(CAST(c / sqrt(total) AS FLOAT) AS DOUBLE)", 6)} AS weight
    FROM s
    """,
)
def embed_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    embedded = embed_texts(docs, "text", lambda: hashing_embedder(64), prepare=plain_words)
    cells = embedded.select("doc_id", F.posexplode("embedding").alias("slot", "weight"))
    return cells.where("weight > 0").withColumn("weight", stable(F.col("weight").cast("double"), 6))


# ---- words ----


def lexical_sql(queries: str, docs: str, k: int, name: str) -> str:
    """CTEs that rank ``docs`` (doc_id, text) for ``queries`` (query_id, text) by word cosine."""
    return f"""
    {name}_qw AS (SELECT query_id, unnest({_WORDS_SQL.format("text")}) AS w FROM {queries}),
    {name}_dw AS (SELECT doc_id, unnest({_WORDS_SQL.format("text")}) AS w FROM {docs}),
    {name}_qt AS (SELECT query_id, w, count(*) AS c FROM {name}_qw GROUP BY 1, 2),
    {name}_dt AS (SELECT doc_id, w, count(*) AS c FROM {name}_dw GROUP BY 1, 2),
    {name}_qn AS (SELECT query_id, CAST(sum(c * c) AS DOUBLE) AS s FROM {name}_qt GROUP BY 1),
    {name}_dn AS (SELECT doc_id, CAST(sum(c * c) AS DOUBLE) AS s FROM {name}_dt GROUP BY 1),
    {name}_dot AS (SELECT query_id, doc_id, CAST(sum(q.c * d.c) AS DOUBLE) AS dot
                   FROM {name}_qt q JOIN {name}_dt d ON q.w = d.w GROUP BY 1, 2),
    {name}_ranked AS (
      SELECT query_id, doc_id, score, CAST(row_number() OVER (
               PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
      FROM (SELECT query_id, doc_id, dot / (sqrt(d.s) * sqrt(q.s)) AS score
            FROM {name}_dot JOIN {name}_qn q USING (query_id) JOIN {name}_dn d USING (doc_id))),
    {name} AS (SELECT * FROM {name}_ranked WHERE rank <= {k})"""


def embedded_sql(queries: str, docs: str, k: int, name: str) -> str:
    """CTEs that rank ``docs`` (doc_id, text) for ``queries`` (query_id, text) by the cosine
    of hashed word counts."""

    def side(source: str, key: str, at: str) -> str:
        return f"""
    {at}_w AS (SELECT {key}, unnest({_WORDS_SQL.format("text")}) AS word FROM {source}),
    {at}_n AS (SELECT {key}, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 64 AS slot,
                      CAST(count(*) AS DOUBLE) AS c FROM {at}_w GROUP BY ALL),
    {at}_s AS (SELECT *, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS f FROM {at}_n),
    {at} AS (SELECT *, sqrt(sum(f * f) OVER (PARTITION BY {key})) AS norm FROM {at}_s),"""

    return side(queries, "query_id", f"{name}_q") + side(docs, "doc_id", f"{name}_d") + f"""
    {name}_scored AS (
      SELECT query_id, doc_id, round(sum(q.f * d.f) / any_value(q.norm) / any_value(d.norm), 9) AS score
      FROM {name}_q q JOIN {name}_d d USING (slot) GROUP BY ALL),
    {name}_ranked AS (SELECT *, CAST(row_number() OVER (
        PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {name}_scored),
    {name} AS (SELECT * FROM {name}_ranked WHERE rank <= {k})"""


_REQUESTS = "(SELECT item_id AS query_id, text FROM benchmark)"


@query(
    "lexical_topk",
    f"WITH {lexical_sql(_REQUESTS, 'documents', 3, 'hits')} SELECT * FROM hits",
)
def lexical_topk_query(spark, sf_dir):
    return lexical_topk(
        table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"),
        table(spark, sf_dir, "documents"),
        k=3,
    )


def _block_sql(hits: str, source: str, label: str) -> str:
    return f"""(SELECT query_id, string_agg('  - Document ' || rank || ' ({label}): ''' || content
        || ''' '[1:1] || chr(10) || '    Metadata: ' || meta || chr(10), '' ORDER BY rank) AS block
      FROM {hits} JOIN {source} USING (doc_id) GROUP BY 1)"""


_PAGES = "(SELECT page_id AS doc_id, html AS text FROM pages)"


@query(
    "context_assembly",
    f"""
    WITH {lexical_sql(_REQUESTS, "documents", 5, "a")},
    {lexical_sql(_REQUESTS, _PAGES, 3, "b")},
    asrc AS (SELECT doc_id, text AS content, '{{"source":"' || source || '"}}' AS meta FROM documents),
    bsrc AS (SELECT page_id AS doc_id, html AS content, '{{"page_id":' || page_id || '}}' AS meta FROM pages)
    SELECT item_id AS query_id,
      CASE WHEN x.block IS NULL AND y.block IS NULL
           THEN 'No highly relevant context found in any vector database.'
           ELSE coalesce('Relevant Dataset Metadata:' || chr(10) || x.block, '')
             || coalesce(chr(10) || 'Relevant Approved ETL Tasks (Past Examples):' || chr(10) || y.block, '')
      END AS context
    FROM benchmark LEFT JOIN {_block_sql("a", "asrc", "Dataset")} x ON item_id = x.query_id
    LEFT JOIN {_block_sql("b", "bsrc", "Approved Task")} y ON item_id = y.query_id
    """,
)
def context_assembly(spark, sf_dir):
    requests = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    docs = table(spark, sf_dir, "documents")
    pages = table(spark, sf_dir, "pages")
    first = lexical_topk(requests, docs, k=5)
    second = lexical_topk(requests, pages.withColumnRenamed("page_id", "doc_id"), k=3, doc_text="html")
    doc_content = docs.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("page_content"),
        F.to_json(F.struct("source")).alias("metadata"),
    )
    page_content = pages.select(
        F.col("page_id").alias("id"),
        F.col("html").alias("page_content"),
        F.to_json(F.struct("page_id")).alias("metadata"),
    )
    return assemble_context(
        requests,
        project_matches(first, doc_content, "page_content", "metadata"),
        project_matches(second, page_content, "page_content", "metadata"),
    )
