"""Jobs over tables of responses, specs and reviews, all made row by row from the given
tables: the shape of a row follows the flags it already has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomwright.functions.names import safe_output_name, table_name_from_path
from loomwright.functions.text import unwrap_script, with_payload, without_fences
from loomwright.plans.reviews import classify_reviews, last_message, run_outcomes
from loomwright.plans.spec import accepted, parse_specs, repair_wrapped
from loomwright.plans.tasks import index_tasks, render_task, task_documents
from loomwright.plans.validate import apply_suggestions, validate_specs, validation_report
from loomwright.queries.base import query, table
from loomwright.queries.catalog import BRAND_TABLE as _TABLE
from loomwright.sources.index_store import DocumentIndex
from loomwright.storage import scratch_path, stage

_ID = "CAST(o_orderkey AS STRING)"

# ---- payloads of response texts ----

_OBJECT = f"""'{{"id": ' || {_ID} || ', "s": "' || o_orderstatus || '"}}'"""
_BODY = f"""CASE o_orderstatus WHEN 'F' THEN {_OBJECT}
      WHEN 'O' THEN {_OBJECT} || ' and {{"more": 1}}' ELSE '  ' || {_OBJECT} || chr(10) END"""
_RESPONSE = f"""CASE o_orderpriority
      WHEN '1-URGENT' THEN 'Here it is:' || chr(10) || '```json  ' || chr(10) || {_BODY} || chr(10) || '```' || chr(10) || 'Done.'
      WHEN '2-HIGH' THEN '```' || chr(10) || {_BODY} || '``` then ```' || chr(10) || 'x```'
      WHEN '3-MEDIUM' THEN 'The spec is ' || {_BODY} || ' as asked'
      WHEN '4-NOT SPECIFIED' THEN chr(9) || 'broken {{"id": ' || {_ID} || ' and }} no' || chr(10)
      ELSE '  nothing in order ' || {_ID} || '  ' END"""
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(
    "spec_extract",
    f"""
    WITH r AS (SELECT o_orderkey AS response_id, {_STRIP.format(_RESPONSE)} AS t FROM orders),
    f AS (SELECT *,
        CASE WHEN regexp_matches(t, '(?s)```json\\s*\\n(.*?)```')
             THEN regexp_extract(t, '(?s)```json\\s*\\n(.*?)```', 1)
             WHEN regexp_matches(t, '(?s)```\\s*\\n(.*?)```')
             THEN regexp_extract(t, '(?s)```\\s*\\n(.*?)```', 1) END AS fenced,
        regexp_extract(t, '(?s)[{{].*[}}]') AS braced FROM r)
    SELECT response_id,
           CASE WHEN fenced IS NOT NULL THEN {_STRIP.format("fenced")}
                WHEN braced <> '' AND json_valid(braced) THEN braced ELSE t END AS payload
    FROM f
    """,
)
def spec_extract(spark, sf_dir):
    responses = table(spark, sf_dir, "orders").selectExpr("o_orderkey response_id", f"{_RESPONSE} text")
    return with_payload(responses, "text").select("response_id", "payload")


# ---- parsing and checking of specs ----

_SPEC = f"""'{{"pipeline_name": "job ' || {_ID} || '", ' || CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN ''
        ELSE '"main_goal": "goal ' || o_orderstatus || '", ' END
    || '"initial_tables": ["application_train", "bureau"], "owner": "x", '
    || '"join_operations": [{{"left_table": "application_train", "right_table": "bureau"'
    || CASE o_orderpriority WHEN '1-URGENT' THEN ', "join_type": "inner"'
         WHEN '4-NOT SPECIFIED' THEN ', "join_type": "cross"' ELSE '' END
    || CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN ''
         ELSE ', "on_columns": ["SK_ID_CURR"]' END || '}}], '
    || '"data_cleaning_steps": [{{"type": "imputation", "details": {{"strategy": "median", "columns": ["A", "B"]}}}}]'
    || CASE o_orderstatus WHEN 'P' THEN ', "scoring_model": null'
         ELSE ', "scoring_model": {{"name": "m' || {_ID} || '", "objective": "o", "target_column": "TARGET", "features": ["A", "C"]}}, "output_format": "parquet"' END
    || '}}' || CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN ' trailing' ELSE '' END"""


# Some specs name themselves twice, where the last name stands, and some have a number that JSON lacks.
_TWICE = "o_custkey % 7 = 0"
_NO_NUMBER = "o_custkey % 11 = 0"
_ODD_SPEC = f"""replace(CASE WHEN {_TWICE} THEN replace({_SPEC}, '{{"pipeline_name"', '{{"pipeline_name": "first", "pipeline_name"')
      ELSE {_SPEC} END, '"owner": "x"', CASE WHEN {_NO_NUMBER} THEN '"owner": NaN' ELSE '"owner": "x"' END)"""


@query(
    "spec_parse",
    f"""
    WITH s AS (SELECT o_orderkey AS spec_id, {_SPEC} AS payload, {_NO_NUMBER} AS no_number FROM orders),
    j AS (SELECT *, json_valid(payload) AND NOT no_number AS valid,
                 CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS d FROM s),
    e AS (SELECT *, CASE WHEN no_number THEN 'payload: NaN or infinite number'
        WHEN NOT valid THEN 'payload: not valid JSON' ELSE
        concat_ws('; ',
          CASE WHEN json_extract_string(d, '$.main_goal') IS NULL THEN 'main_goal: expected string, found missing' END,
          CASE WHEN json_extract_string(d, '$.join_operations[0].join_type') NOT IN ('inner','left','right','outer')
               THEN 'join_operations[0].join_type: not a join type' END,
          CASE WHEN json_extract(d, '$.join_operations[0].on_columns') IS NULL
               THEN 'join_operations[0].on_columns: expected array, found missing' END) END AS errors
      FROM j)
    SELECT spec_id, errors,
      CASE WHEN NOT valid THEN 'invalid_json' WHEN errors <> '' THEN 'schema' END AS error_class,
      CASE WHEN errors = '' THEN d->>'pipeline_name' END AS pipeline_name,
      CASE WHEN errors = '' THEN coalesce(d->>'$.join_operations[0].join_type', 'left') END AS join_type,
      CASE WHEN errors = '' THEN array_to_string(CAST(d->'initial_tables' AS VARCHAR[]), ',') END AS tables,
      CASE WHEN errors = '' THEN d->>'$.data_cleaning_steps[0].details.columns[1]' END AS second_column,
      CASE WHEN errors = '' THEN d->>'$.scoring_model.name' END AS model,
      CASE WHEN errors = '' THEN coalesce(d->>'output_format', 'dataframe') END AS output_format
    FROM e
    """,
)
def spec_parse(spark, sf_dir):
    specs = table(spark, sf_dir, "orders").selectExpr("o_orderkey spec_id", f"{_ODD_SPEC} payload")
    return parse_specs(specs).select(
        "spec_id",
        F.array_join("errors", "; ").alias("errors"),
        "error_class",
        "spec.pipeline_name",
        F.col("spec.join_operations")[0]["join_type"].alias("join_type"),
        F.array_join("spec.initial_tables", ",").alias("tables"),
        F.try_variant_get(
            F.col("spec.data_cleaning_steps")[0]["details"], "$.columns[1]", "string"
        ).alias("second_column"),
        F.col("spec.scoring_model.name").alias("model"),
        "spec.output_format",
    )


# ---- repair: each order wraps four loose items, picked by its own numbers ----


def _item(pick: str, mark: str) -> str:
    """JSON text of one loose item; ``pick`` chooses its kind, ``mark`` goes into it."""
    mark = f"CAST({mark} AS STRING)"
    return f"""CASE {pick}
      WHEN 0 THEN '{{"left_table": "a' || {mark} || '", "right_table": "b", "join_type": "'
           || CASE WHEN o_orderstatus = 'P' THEN 'cross' ELSE 'inner' END || '", "on_columns": ["k"]}}'
      WHEN 1 THEN '{{"type": "Imputation' || {mark} || '", "details": {{"columns": ["x"]}}, "table_name": "t' || {mark} || '"}}'
      WHEN 2 THEN '{{"type": "one_hot_encoding", "details": {{"p": ' || {mark} || '}}}}'
      WHEN 3 THEN '{{"name": "m' || {mark} || '", "objective": "o", "target_column": "TARGET"}}'
      WHEN 4 THEN '{{"type": "date_features", "details": {{}}, "table_name": "base"}}'
      ELSE '{{"type": "outlier aggregation", "details": {{"n": ' || {mark} || '}}, "target_column": "t"}}' END"""


_ITEMS = (
    _item("o_orderkey % 6", "o_orderkey % 3"),
    _item("o_custkey % 6", "o_custkey % 3"),
    _item("(o_orderkey + o_custkey) % 6", "o_orderkey % 4"),
    _item("length(o_orderpriority) % 6", "o_custkey"),
)
_WRAPPED = "'{\"etl_tasks\": [' || " + " || ', ' || ".join(_ITEMS) + " || ', 5]}'"
_INITIAL = f"""'{{"pipeline_name": "order ' || {_ID} || '", "initial_tables": ["base"], "output_location": "out"}}'"""


def _repair_sql(feature_test: str) -> str:
    return f"""
    WITH w AS (SELECT o_orderkey AS spec_id, unnest([{", ".join(_ITEMS)}]) AS txt,
                      unnest([0, 1, 2, 3]) AS pos FROM orders),
    i AS (SELECT spec_id, pos, CAST(txt AS JSON) AS x FROM w),
    c AS (SELECT *, CASE
        WHEN json_exists(x, '$.join_type') AND json_exists(x, '$.on_columns') THEN 'join'
        WHEN regexp_matches(lower(x->>'type'), 'imputation|cleaning|outlier|deduplication|conversion') THEN 'cleaning'
        WHEN regexp_matches(lower(x->>'type'), '{feature_test}') THEN 'feature'
        WHEN json_exists(x, '$.target_column') THEN 'scoring' END AS class FROM i),
    n AS (SELECT spec_id, x->>'table_name' AS t, min(pos) AS p FROM c
          WHERE x->>'table_name' IS NOT NULL AND x->>'table_name' <> 'base' GROUP BY 1, 2),
    tabs AS (SELECT spec_id, string_agg(t, ',' ORDER BY p) AS tables FROM n GROUP BY 1)
    SELECT spec_id, 'order ' || spec_id AS pipeline_name, 'Reconstructed Goal' AS main_goal,
      concat_ws(',', 'base', any_value(tables)) AS tables,
      coalesce(string_agg((x->>'left_table') || '-' || (x->>'join_type'), ',' ORDER BY pos)
        FILTER (WHERE class = 'join' AND x->>'join_type' <> 'cross'), '') AS joins,
      coalesce(string_agg(x->>'type', ',' ORDER BY pos) FILTER (WHERE class = 'cleaning'), '') AS cleaning,
      coalesce(string_agg(x->>'type', ',' ORDER BY pos) FILTER (WHERE class = 'feature'), '') AS features,
      arg_max(x->>'name', pos) FILTER (WHERE class = 'scoring') AS model,
      'dataframe' AS output_format, 'out' AS output_location
    FROM c LEFT JOIN tabs USING (spec_id) GROUP BY spec_id
    """


def _repaired(spark, sf_dir, literal: bool) -> DataFrame:
    wrapped = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey spec_id", f"{_WRAPPED} wrapped", f"{_INITIAL} initial"
    )
    repaired = repair_wrapped(wrapped, "wrapped", "initial", literal)

    def types(steps: str):
        return F.array_join(F.transform(steps, lambda s: s["type"]), ",")

    return repaired.select(
        "spec_id",
        "spec.pipeline_name",
        "spec.main_goal",
        F.array_join("spec.initial_tables", ",").alias("tables"),
        F.array_join(
            F.transform(
                "spec.join_operations",
                lambda j: F.concat(j["left_table"], F.lit("-"), j["join_type"]),
            ),
            ",",
        ).alias("joins"),
        types("spec.data_cleaning_steps").alias("cleaning"),
        types("spec.feature_engineering_steps").alias("features"),
        F.col("spec.scoring_model.name").alias("model"),
        "spec.output_format",
        "spec.output_location",
    )


@query(
    "spec_repair",
    _repair_sql("feature_engineering|aggregation|encoding|scaling|polynomial_features|date_features"),
)
def spec_repair(spark, sf_dir):
    return _repaired(spark, sf_dir, literal=False)


@query("spec_repair_literal", _repair_sql("feature_engineering|aggregation|encoding|scaling"))
def spec_repair_literal(spark, sf_dir):
    return _repaired(spark, sf_dir, literal=True)


# ---- validation against a catalog: every brand is a table, every part name a column ----

_CATALOG = [
    f"{_TABLE} table_name",
    "replace(p_name, ' ', '_') column_name",
    """CASE WHEN p_name LIKE '%ring' AND p_size < 25 THEN 'StringType()'
            WHEN p_name LIKE '%ring' THEN 'IntegerType()' ELSE 'DoubleType()' END data_type""",
    "p_size >= 46 is_target",
]
_LEFT = """CASE WHEN o_orderstatus = 'P' AND o_custkey % 50 = 0 THEN 'brand' WHEN o_custkey % 50 = 1 THEN 'unknown'
      ELSE 'brand_' || CAST(o_custkey % 28 AS STRING) END"""
_RIGHT = "'brand_' || CAST(o_orderkey % 25 + 1 AS STRING)"
_KEY = """CASE o_orderpriority WHEN '1-URGENT' THEN 'small_ring' WHEN '2-HIGH' THEN 'red_ring'
      WHEN '3-MEDIUM' THEN 'blue_bolt' WHEN '4-NOT SPECIFIED' THEN 'no_such' ELSE 'hot_gear' END"""
_TARGET = "CASE o_orderstatus WHEN 'F' THEN 'old_anvil' WHEN 'O' THEN 'nowhere' END"
_STEP_COLUMN = "CASE o_orderstatus WHEN 'F' THEN 'red_bolt' ELSE 'absent' END"
# One column, named as a text, as the key of a type list, or as a list and an order.
_STEP = f"""CASE o_orderstatus
      WHEN 'F' THEN '"data_cleaning_steps": [{{"type": "imputation", "details": {{"columns": "' || {_STEP_COLUMN} || '"}}'
      WHEN 'O' THEN '"data_cleaning_steps": [{{"type": "conversion", "details": {{"types": {{"' || {_STEP_COLUMN} || '": "int"}}}}'
      ELSE '"feature_engineering_steps": [{{"type": "aggregation", "details": {{"group_by": "' || {_STEP_COLUMN}
        || '", "columns": ["' || {_STEP_COLUMN} || '"]}}' END"""
_CHECKED = f"""'{{"pipeline_name": "n", "main_goal": "g", "initial_tables": ["' || {_LEFT}
    || '"], "join_operations": [{{"left_table": "' || {_LEFT} || '", "right_table": "' || {_RIGHT}
    || '", "on_columns": ["' || {_KEY} || '"]}}], ' || {_STEP} || '}}]' || coalesce(', "scoring_model": {{"name": "m", "objective": "o", "target_column": "' || {_TARGET} || '"}}', '') || '}}'"""


def _specs_and_catalog(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    payloads = table(spark, sf_dir, "orders").selectExpr("o_orderkey spec_id", f"{_CHECKED} payload")
    specs = accepted(stage(parse_specs(payloads), "specs")).select("spec_id", "spec")
    catalog = table(spark, sf_dir, "part").selectExpr(*_CATALOG)
    # One type per column: the least family of its parts, as text sorts after numbers.
    return specs, catalog.groupBy("table_name", "column_name").agg(
        F.min("data_type").alias("data_type"), F.bool_or("is_target").alias("is_target")
    )


_HINTS = f"""
    WITH cat AS (
      SELECT {_TABLE} AS t, replace(p_name, ' ', '_') AS c, bool_or(p_size >= 46) AS flagged,
             min(CASE WHEN p_name LIKE '%ring' AND p_size < 25 THEN 'text' ELSE 'number' END) AS family
      FROM part GROUP BY 1, 2),
    tabs AS (SELECT t, bool_or(flagged) AS has_target FROM cat GROUP BY 1),
    s AS (SELECT o_orderkey AS spec_id, {_LEFT} AS l, {_RIGHT} AS r, {_KEY} AS k, {_TARGET} AS tg,
                 {_STEP_COLUMN} AS sc FROM orders),
    lost AS (SELECT DISTINCT n FROM (SELECT l AS n FROM s UNION ALL SELECT r FROM s)
             WHERE n NOT IN (SELECT t FROM tabs)),
    hints AS (
      SELECT n, coalesce(
        (SELECT arg_min(t, (NOT has_target, t)) FROM tabs WHERE starts_with(t, n)),
        (SELECT arg_min(t, (NOT has_target, t)) FROM tabs WHERE levenshtein(t, n) = 1)) AS hint
      FROM lost)"""


@query(
    "spec_validate",
    f"""
    {_HINTS},
    findings AS (
      SELECT DISTINCT spec_id, 'missing_table' AS rule, n AS subject, hint AS detail
        FROM (SELECT spec_id, l AS n FROM s UNION ALL SELECT spec_id, r FROM s) JOIN hints USING (n)
      UNION ALL SELECT spec_id, 'missing_join_key', l || '.' || k, 'left' FROM s
        WHERE NOT EXISTS (SELECT 1 FROM cat WHERE t = l AND c = k)
      UNION ALL SELECT spec_id, 'missing_join_key', r || '.' || k, 'right' FROM s
        WHERE NOT EXISTS (SELECT 1 FROM cat WHERE t = r AND c = k)
      UNION ALL SELECT spec_id, 'incompatible_key_types', k, x.family || '/' || y.family
        FROM s JOIN cat x ON x.t = l AND x.c = k JOIN cat y ON y.t = r AND y.c = k
        WHERE x.family <> y.family
      UNION ALL SELECT spec_id, 'missing_target', tg, NULL FROM s WHERE tg IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM cat WHERE t = l AND c = tg)
      UNION ALL SELECT spec_id, 'target_not_flagged', tg, NULL FROM s JOIN cat ON t = l AND c = tg
        WHERE NOT flagged
      UNION ALL SELECT spec_id, 'missing_column', sc, NULL FROM s
        WHERE NOT EXISTS (SELECT 1 FROM cat WHERE t IN (l, r) AND c = sc))
    SELECT s.spec_id, count(f.rule) = 0 AS ok, count(f.rule) AS n,
           coalesce(string_agg(rule || ':' || subject || coalesce(':' || detail, ''), '; '
                    ORDER BY rule, subject, detail), '') AS findings
    FROM s LEFT JOIN findings f ON s.spec_id = f.spec_id GROUP BY s.spec_id
    """,
)
def spec_validate(spark, sf_dir):
    specs, catalog = _specs_and_catalog(spark, sf_dir)
    report = validation_report(specs, validate_specs(specs, catalog))
    return report.select(
        "spec_id",
        "ok",
        F.size("findings").cast("bigint").alias("n"),
        F.array_join(
            F.transform(
                "findings", lambda f: F.concat_ws(":", f["rule"], f["subject"], f["detail"])
            ),
            "; ",
        ).alias("findings"),
    )


@query(
    "spec_correct",
    f"""
    {_HINTS}
    SELECT spec_id, coalesce(a.hint, l) AS tables, coalesce(a.hint, l) AS left_table,
           coalesce(b.hint, r) AS right_table
    FROM s LEFT JOIN hints a ON a.n = l LEFT JOIN hints b ON b.n = r
    """,
)
def spec_correct(spark, sf_dir):
    specs, catalog = _specs_and_catalog(spark, sf_dir)
    corrected = apply_suggestions(specs, validate_specs(specs, catalog))
    join = F.col("spec.join_operations")[0]
    return corrected.select(
        "spec_id", F.array_join("spec.initial_tables", ",").alias("tables"),
        join["left_table"].alias("left_table"), join["right_table"].alias("right_table"),
    )


# ---- approved specs as documents ----


def approved_specs(spark, sf_dir, payload: str = _SPEC) -> DataFrame:
    specs = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey spec_id", f"{payload} payload", f"'request ' || {_ID} request",
        "CASE WHEN o_custkey % 2 = 0 THEN array(o_orderpriority, o_orderstatus) END feedback",
    )
    return accepted(stage(parse_specs(specs), "specs")).select("spec_id", "spec", "request", "feedback")


ACCEPTED_SQL = f"""
    approved AS (SELECT o_orderkey AS spec_id, {_ID} AS k, * FROM orders WHERE NOT (
      (o_orderpriority = '5-LOW' AND o_orderstatus = 'F') OR o_orderpriority = '4-NOT SPECIFIED'
      OR (o_orderpriority IN ('3-MEDIUM', '2-HIGH') AND o_orderstatus = 'O')))"""
RENDERED_SQL = """'Approved ETL Pipeline: job ' || k || '. Main Goal: goal ' || o_orderstatus
    || '. Initial Tables: application_train, bureau. '
    || CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'Scoring Model: m' || k
       || ', Objective: o, Target: TARGET. Features: A, C.' END"""


@query("task_render", f"WITH {ACCEPTED_SQL} SELECT spec_id, {RENDERED_SQL} AS text FROM approved")
def task_render(spark, sf_dir):
    return approved_specs(spark, sf_dir).select("spec_id", render_task(F.col("spec")).alias("text"))


@query(
    "task_metadata",
    f"""
    WITH {ACCEPTED_SQL}
    SELECT {RENDERED_SQL} AS text, 'approved_etl_task' AS source, 'job ' || k AS pipeline_name,
           'goal ' || o_orderstatus AS main_goal, 'application_train,bureau' AS initial_tables,
           'application_train JOIN bureau ON SK_ID_CURR' AS joins, 'imputation' AS cleaning,
           CASE WHEN o_orderstatus <> 'P' THEN 'm' || k END AS scoring_model_name,
           CASE WHEN o_orderstatus <> 'P' THEN 'TARGET' END AS target_column,
           'request ' || k AS original_request_text,
           CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority || ',' || o_orderstatus END AS feedback
    FROM approved
    """,
)
def task_metadata(spark, sf_dir):
    docs = task_documents(approved_specs(spark, sf_dir), feedback_col="feedback")
    return docs.select(
        F.col("text_content").alias("text"),
        "metadata.source",
        "metadata.pipeline_name",
        "metadata.main_goal",
        F.array_join("metadata.initial_tables", ",").alias("initial_tables"),
        F.array_join("metadata.join_operations_summary", ";").alias("joins"),
        F.array_join("metadata.data_cleaning_types", ";").alias("cleaning"),
        "metadata.scoring_model_name",
        "metadata.target_column",
        "metadata.original_request_text",
        F.array_join("metadata.modification_feedback_history", ",").alias("feedback"),
    )


# Fifty names for all orders: many requests are answered by equal specs.
_SHARED_ID = "CAST(o_orderkey % 50 AS STRING)"


@query(
    "task_index",
    f"""
    WITH {ACCEPTED_SQL.replace(_ID + " AS k", _SHARED_ID + " AS k")}
    SELECT {RENDERED_SQL} AS text, 'approved_etl_task' AS source, 'request ' || spec_id AS request FROM approved
    """,
)
def task_index(spark, sf_dir):
    index = DocumentIndex(spark, scratch_path(spark, "tasks"))
    approved = approved_specs(spark, sf_dir, _SPEC.replace(_ID, _SHARED_ID))
    for _ in range(2):  # content ids: indexing the same specs again adds nothing
        index_tasks(index, approved)
    return index.read().select(
        F.col("text_content").alias("text"),
        F.try_variant_get("metadata", "$.source", "string").alias("source"),
        F.try_variant_get("metadata", "$.original_request_text", "string").alias("request"),
    )


# ---- reviews ----


@query(
    "review_last_message",
    """
    SELECT conv_id AS review_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS content
    FROM conversations GROUP BY 1
    """,
)
def review_last_message(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id review_id", "turn", "role name", "text content"
    )
    return last_message(messages, keys=["review_id"], speaker="user")


# The last line of a message decides; which one it has follows from the message's length.
_VERDICT = """CASE length(text) % 12
      WHEN 0 THEN ' approve' WHEN 1 THEN ' Approved.' WHEN 2 THEN ' NOT APPROVED' WHEN 3 THEN 'deny'
      WHEN 4 THEN 'Quit now' WHEN 5 THEN 'no modifications needed'
      WHEN 6 THEN chr(10) || '```json' || chr(10) || '{"Turn": ' || CAST(turn AS STRING) || '}' || chr(10) || '```'
      WHEN 7 THEN chr(10) || '```json' || chr(10) || '{"Turn": }' || chr(10) || '```'
      WHEN 8 THEN chr(10) || '```python' || chr(10) || 'df = Spark' || chr(10) || '```'
      WHEN 9 THEN '```python df```' WHEN 10 THEN ' denied' ELSE '' END"""
_REVIEW = """CASE WHEN conv_id % 2 = 0 THEN 'task_definition_review' ELSE 'script_execution_review' END"""
_NAME = "CASE role WHEN 'user' THEN 'Human_Reviewer' ELSE 'AI_Reviewer' END"


def _review_sql(literal: bool) -> str:
    json_edit = """CASE WHEN review_type = 'task_definition_review' AND json_valid(
        regexp_extract(content, '(?s)```json\\n(.*?)\\n```', 1))
        THEN regexp_extract(content, '(?s)```json\\n(.*?)\\n```', 1) END"""
    code_edit = """CASE WHEN review_type = 'script_execution_review'
        AND regexp_matches(content, '(?s)```python\\n(.*?)\\n```')
        THEN regexp_extract(content, '(?s)```python\\n(.*?)\\n```', 1) END"""
    if literal:
        json_edit = code_edit = "CAST(NULL AS VARCHAR)"
    return f"""
    WITH m AS (SELECT conv_id AS review_id, {_REVIEW} AS review_type,
                 arg_max(text || {_VERDICT}, turn) FILTER (WHERE role = 'user') AS content
               FROM conversations GROUP BY 1, 2),
    u AS (SELECT *, upper(coalesce(content, '')) AS up, {json_edit} AS je, {code_edit} AS ce FROM m),
    s AS (SELECT *, CASE WHEN contains(up, 'APPROVE') THEN 'approved'
        WHEN contains(up, 'DENIED') OR contains(up, 'DENY') THEN 'denied'
        WHEN contains(up, 'QUIT') THEN 'quit'
        WHEN contains(up, 'NO MODIFICATIONS NEEDED') THEN 'approved'
        WHEN je IS NOT NULL THEN 'modified_json' WHEN ce IS NOT NULL THEN 'modified_code'
        ELSE 'error' END AS status FROM u)
    SELECT review_id, review_type, content, status,
           CASE status WHEN 'modified_json' THEN je WHEN 'modified_code' THEN ce END AS modified_content,
           review_type = 'script_execution_review' AND contains(up, 'APPROVE') AS execute_approved,
           status = 'quit' AS quit_session
    FROM s
    """


def _reviews(spark, sf_dir) -> DataFrame:
    return last_message(
        table(spark, sf_dir, "conversations").selectExpr(
            "conv_id review_id", f"{_REVIEW} review_type", "turn", f"{_NAME} name",
            f"text || {_VERDICT} content",
        )
    )


@query("review_classify", _review_sql(literal=False))
def review_classify(spark, sf_dir):
    return classify_reviews(_reviews(spark, sf_dir))


@query("review_classify_literal", _review_sql(literal=True))
def review_classify_literal(spark, sf_dir):
    return classify_reviews(_reviews(spark, sf_dir), literal=True)


# ---- outcomes: an order is a request, its lines are review decisions, large ones runs ----

_STATUS = """CASE WHEN l_quantity < 30 THEN 'approved' WHEN l_quantity < 35 THEN 'denied'
      WHEN l_quantity < 38 THEN 'quit' WHEN l_quantity < 44 THEN {0} ELSE 'error' END"""
_DECISIONS = {
    "request_id": "l_orderkey",
    "review_type": """CASE l_linestatus WHEN 'F' THEN 'task_definition_review'
                      ELSE 'script_execution_review' END""",
    "round": "l_linenumber",
}


@query(
    "run_outcome",
    f"""
    WITH lines AS (SELECT l_orderkey, l_linestatus, l_linenumber, min(l_quantity) AS l_quantity,
                          min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2, 3),
    task AS (SELECT l_orderkey, arg_max({_STATUS.format("'modified_json'")}, l_linenumber) AS t
             FROM lines WHERE l_linestatus = 'F' GROUP BY 1),
    script AS (SELECT l_orderkey, arg_max({_STATUS.format("'modified_code'")}, l_linenumber) AS s,
                      arg_max(l_partkey % 3 > 0, l_linenumber) AS x
               FROM lines WHERE l_linestatus = 'O' GROUP BY 1),
    runs AS (SELECT l_orderkey, arg_max(l_partkey % 5 > 0, l_linenumber) AS done
             FROM lines WHERE l_linestatus = 'O' AND l_quantity < 30 GROUP BY 1)
    SELECT o_orderkey AS request_id, CASE
      WHEN o_custkey % 20 IN (0, 1) THEN 'error'
      WHEN t IS NULL THEN 'in_review' WHEN t = 'quit' THEN 'quit_session' WHEN t = 'denied' THEN 'denied'
      WHEN t = 'modified_json' THEN 'in_review' WHEN t = 'error' THEN 'error'
      WHEN o_custkey % 20 = 2 THEN 'error'
      WHEN s IS NULL THEN 'in_review' WHEN s = 'quit' THEN 'quit_session' WHEN s = 'denied' THEN 'denied'
      WHEN s = 'modified_code' THEN 'in_review' WHEN s = 'error' THEN 'error'
      WHEN NOT x THEN 'approved_no_execution' WHEN done THEN 'approved' ELSE 'in_review' END AS outcome
    FROM orders LEFT JOIN task ON o_orderkey = task.l_orderkey
    LEFT JOIN script ON o_orderkey = script.l_orderkey LEFT JOIN runs ON o_orderkey = runs.l_orderkey
    """,
)
def run_outcome(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey request_id", "o_custkey % 20 <> 0 parse_ok", "o_custkey % 20 <> 1 plan_ok",
        "o_custkey % 20 <> 2 script_ok",
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus", "l_linenumber").agg(
        F.min("l_quantity").alias("l_quantity"), F.min("l_partkey").alias("l_partkey")
    )
    modified = "CASE l_linestatus WHEN 'F' THEN 'modified_json' ELSE 'modified_code' END"
    decisions = lines.selectExpr(
        *[f"{sql} {name}" for name, sql in _DECISIONS.items()],
        f"{_STATUS.format(modified)} status",
        "l_partkey % 3 > 0 execute_approved",
        "l_quantity >= 35 AND l_quantity < 38 quit_session",
    )
    runs = lines.where("l_linestatus = 'O' AND l_quantity < 30").selectExpr(
        "l_orderkey request_id", "l_linenumber round", "l_partkey % 5 > 0 succeeded"
    )
    return run_outcomes(requests, decisions, runs)


# ---- names and fences ----

_LABEL = "p_name || ' (' || p_brand || ') v' || CAST(p_size AS STRING) || '.0_é!  '"
_PATH = "'/data/' || p_type || '/' || replace(p_name, ' ', '.') || '.CSV'"
_SCRIPT = """CASE p_type WHEN 'PROMO' THEN '```python' || chr(10) || p_name || chr(10) || '```'
      WHEN 'LARGE' THEN '```python' || chr(10) || p_name ELSE p_name END"""


@query(
    "safe_name",
    f"""
    SELECT p_partkey,
      replace(rtrim(regexp_replace({_LABEL}, '[^\\p{{L}}\\p{{N}} ._]', '', 'g')), ' ', '_') AS safe,
      lower(replace(p_name, ' ', '.')) AS table_name,
      CASE WHEN p_type = 'LARGE' THEN '```python' || chr(10) || p_name ELSE p_name END AS script,
      p_name AS shown
    FROM part
    """,
)
def safe_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        safe_output_name(F.expr(_LABEL)).alias("safe"),
        table_name_from_path(F.expr(_PATH)).alias("table_name"),
        unwrap_script(F.expr(_SCRIPT)).alias("script"),
        without_fences(F.expr(_SCRIPT)).alias("shown"),
    )
