"""Context of requests over the indexes of merged columns and approved specs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators.vectors import hashing_embedder
from loomwright.plans.catalog import global_documents
from loomwright.plans.context import request_context
from loomwright.plans.tasks import index_tasks
from loomwright.queries.base import query, table
from loomwright.queries.catalog import GLOBAL_SQL, merged_catalog
from loomwright.queries.jobs import ACCEPTED_SQL, RENDERED_SQL, approved_specs
from loomwright.queries.retrieval import embedded_sql
from loomwright.sources.index_store import DocumentIndex
from loomwright.storage import scratch_path


def _object_sql(**fields: str) -> str:
    """Indented JSON of fields, whose values are SQL of JSON texts."""
    lines = [f"'  \"{name}\": ' || {value}" for name, value in sorted(fields.items())]
    return "'{' || chr(10) || " + " || ',' || chr(10) || ".join(lines) + " || chr(10) || '}'"


def _quoted(sql: str) -> str:
    return f"coalesce('\"' || {sql} || '\"', 'null')"


def _listed(sql: str) -> str:
    """A list from its text, in which ', ' separates the items."""
    items = f"""replace({sql}, ', ', '",' || chr(10) || '    "')"""
    return f"""'[' || chr(10) || '    "' || {items} || '"' || chr(10) || '  ]'"""


_COLUMN_META = _object_sql(
    source=_quoted("source"), normalized_column_name=_quoted("normalized_column_name"),
    column_name=_quoted("column_name"), data_type=_listed("data_types"), description=_quoted("description"),
    is_target="CAST(is_target AS VARCHAR)", is_id="CAST(is_id AS VARCHAR)", tables_present_in=_listed("tables"),
)
_HAS_MODEL = "CASE WHEN o_orderstatus <> 'P' THEN {0} END"
_TASK_META = _object_sql(
    source=_quoted("'approved_etl_task'"), pipeline_name=_quoted("'job ' || k"),
    main_goal=_quoted("'goal ' || o_orderstatus"), initial_tables=_listed("'application_train, bureau'"),
    join_operations_summary=_listed("'application_train JOIN bureau ON SK_ID_CURR'"),
    data_cleaning_types=_listed("'imputation'"), scoring_model_name=_quoted(_HAS_MODEL.format("'m' || k")),
    target_column=_quoted(_HAS_MODEL.format("'TARGET'")), original_request_text=_quoted("'request ' || k"),
)


def _block_sql(hits: str, docs: str, label: str) -> str:
    return f"""(SELECT query_id, string_agg('  - Document ' || rank || ' ({label}): ' || chr(39) || text || chr(39)
        || chr(10) || '    Metadata: ' || meta || chr(10), '' ORDER BY rank) AS block
      FROM {hits} JOIN {docs} USING (doc_id) GROUP BY 1)"""


@query(
    "request_context",
    f"""
    WITH {GLOBAL_SQL}, {ACCEPTED_SQL},
    requests AS (SELECT item_id AS query_id, text FROM benchmark),
    column_docs AS (SELECT id AS doc_id, entry_text AS text, {_COLUMN_META} AS meta FROM global_columns),
    task_docs AS (SELECT 'task-' || spec_id AS doc_id, {RENDERED_SQL} AS text, {_TASK_META} AS meta FROM approved),
    {embedded_sql("requests", "column_docs", 5, "a")},
    {embedded_sql("requests", "task_docs", 3, "b")}
    SELECT query_id,
      CASE WHEN x.block IS NULL AND y.block IS NULL
           THEN 'No highly relevant context found in any vector database.'
           ELSE coalesce('Relevant Dataset Metadata:' || chr(10) || x.block, '')
             || coalesce(chr(10) || 'Relevant Approved ETL Tasks (Past Examples):' || chr(10) || y.block, '')
      END AS context
    FROM requests LEFT JOIN {_block_sql("a", "column_docs", "Dataset")} x USING (query_id)
    LEFT JOIN {_block_sql("b", "task_docs", "Approved Task")} y USING (query_id)
    """,
)
def request_context_query(spark, sf_dir):
    """Every request against all merged columns and all approved specs, by their vectors."""
    embedder = hashing_embedder(64)
    columns = DocumentIndex(spark, scratch_path(spark, "column-index"), dimension=64)
    columns.upsert(global_documents(merged_catalog(spark, sf_dir)), embedder=embedder)
    tasks = DocumentIndex(spark, scratch_path(spark, "spec-index"), dimension=64)
    specs = approved_specs(spark, sf_dir).withColumn("id", F.concat(F.lit("task-"), F.col("spec_id").cast("string")))
    index_tasks(tasks, specs, embedder, id_col="id")
    requests = table(spark, sf_dir, "benchmark").selectExpr("item_id query_id", "text")
    return request_context(requests, columns, tasks, embedder)
