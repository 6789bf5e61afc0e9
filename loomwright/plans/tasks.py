"""Approved specs as searchable documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwright.operators.vectors import Embedder
from loomwright.sources.index_store import DocumentIndex, as_documents, with_variant_metadata

# Text forms and defaults of a rendered spec.
TASK_SOURCE = "approved_etl_task"
UNNAMED = "Unnamed Pipeline"
UNSPECIFIED = "Not specified"
GENERIC = "Generic"


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def render_task(spec: Column) -> Column:
    """The search text of a spec."""

    def value(path: Column, default: str) -> Column:
        return F.coalesce(path, F.lit(default))

    scoring = spec["scoring_model"]
    features = scoring["features"]
    head = _text(
        "Approved ETL Pipeline: ", value(spec["pipeline_name"], UNNAMED), ". ",
        "Main Goal: ", value(spec["main_goal"], UNSPECIFIED), ". ",
        "Initial Tables: ", F.coalesce(F.array_join(spec["initial_tables"], ", "), F.lit("")), ". ",
    )
    model = F.when(
        scoring.isNotNull(),
        _text(
            "Scoring Model: ", value(scoring["name"], GENERIC), ", ",
            "Objective: ", value(scoring["objective"], UNSPECIFIED), ", ",
            "Target: ", value(scoring["target_column"], UNSPECIFIED), ". ",
        ),
    )
    listed = F.when(
        F.size(features) > 0, _text("Features: ", F.array_join(features, ", "), ".")
    )
    return F.concat(head, F.coalesce(model, F.lit("")), F.coalesce(listed, F.lit("")))


def join_summaries(spec: Column) -> Column:
    return F.transform(
        spec["join_operations"],
        lambda j: _text(
            F.coalesce(j["left_table"], F.lit("")), " JOIN ", F.coalesce(j["right_table"], F.lit("")),
            " ON ", F.coalesce(F.array_join(j["on_columns"], ","), F.lit("")),
        ),
    )


def task_metadata(spec: Column, request: Column, feedback: Column | None = None) -> Column:
    """The flat record stored with a spec; null-safe for specs without a model."""
    fields = [
        F.lit(TASK_SOURCE).alias("source"),
        spec["pipeline_name"].alias("pipeline_name"),
        spec["main_goal"].alias("main_goal"),
        spec["initial_tables"].alias("initial_tables"),
        join_summaries(spec).alias("join_operations_summary"),
        F.transform(spec["data_cleaning_steps"], lambda s: F.coalesce(s["type"], F.lit(""))).alias(
            "data_cleaning_types"
        ),
        spec["scoring_model"]["name"].alias("scoring_model_name"),
        spec["scoring_model"]["target_column"].alias("target_column"),
        request.alias("original_request_text"),
    ]
    if feedback is not None:
        fields.append(feedback.alias("modification_feedback_history"))
    return F.struct(*fields)


def task_id(spec: Column, request: Column) -> Column:
    """Content id of a spec and the request it answers: indexing the pair again replaces it,
    while another request with an equal spec keeps a document of its own."""
    return F.sha2(F.to_json(F.struct(spec.alias("spec"), request.alias("request"))), 256)


def task_documents(
    df: DataFrame, spec_col: str = "spec", request_col: str = "request",
    feedback_col: str | None = None, id_col: str | None = None,
) -> DataFrame:
    """Specs as documents, with the caller's ids or those of their content."""
    spec = F.col(spec_col)
    feedback = F.col(feedback_col) if feedback_col else None
    docs = as_documents(
        df,
        render_task(spec),
        task_metadata(spec, F.col(request_col), feedback),
        F.col(id_col) if id_col else task_id(spec, F.col(request_col)),
    )
    return docs


def index_tasks(index: DocumentIndex, df: DataFrame, embedder: Embedder | None = None, **columns) -> None:
    """Approved specs as documents of the index; with an embedder they can be searched."""
    index.upsert(with_variant_metadata(task_documents(df, **columns)), embedder=embedder)
