import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions.jsonio import NOT_A_NUMBER, jvm_accepts, with_normalized_json, with_strict_json
from loomwright.functions.merging import MANY, merge_texts
from loomwright.functions.names import (
    file_stem, normalize_column_name, safe_output_name, strip_blank, table_name_from_path,
)
from loomwright.functions.text import unwrap_script, with_payload, without_fences
from loomwright.operators.context import NO_CONTEXT
from loomwright.operators.vectors import hashing_embedder
from loomwright.plans.catalog import (
    build_catalog, dictionary_entries, enrich_columns, global_columns, ingest_catalog,
    nested_catalog,
)
from loomwright.plans.context import request_context
from loomwright.plans.reviews import classify_reviews, last_message, run_outcomes
from loomwright.plans.spec import accepted, parse_specs, quarantined, repair_wrapped
from loomwright.plans.tasks import index_tasks, render_task, task_documents
from loomwright.plans.validate import suggest_tables, validate_specs, validation_report
from loomwright.sources.index_store import DocumentIndex, with_variant_metadata
from loomwright.storage import scratch_path


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_names(spark):
    assert apply(spark, normalize_column_name, ["_ sk_id_ ", "\t_A", "a b", None]) == [
        "SK_ID", "_A", "A B", None,
    ]
    assert apply(spark, safe_output_name, ["My é-job! v1.0_x  ", "a/b"]) == ["My_éjob_v1.0_x", "ab"]
    assert apply(spark, table_name_from_path, ["/d/Loans.v2.CSV", "x", "/d/t.csv/"]) == [
        "loans.v2", "x", "t",
    ]
    assert apply(spark, file_stem, ["/a/.csv"]) == [".csv"]
    assert apply(spark, strip_blank, [" \n x \x1f"]) == ["x"]


def test_payloads(spark):
    cases = {
        "say\n```json\n{\"a\": 1}\n``` bye": '{"a": 1}',
        "```json  \n\n[1]```": "[1]",
        "```\n x \n``` ```json\n{}\n```": "{}",
        "```\n x \n```": "x",
        'it is {"a": {"b": 2}} ok': '{"a": {"b": 2}}',
        'it is {"a": 1} x {"b": 2}': 'it is {"a": 1} x {"b": 2}',
        "{broken": "{broken",
        "} {": "} {",
        '{"a": NaN}': '{"a": NaN}',
        "```json```": "```json```",
        "  plain \n": "plain",
        "```json\n```": "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [r.payload for r in with_payload(df, "t").orderBy("i").collect()]
    assert got == list(cases.values())


def test_scripts(spark):
    assert apply(spark, unwrap_script, ["```python\nx\n```", "```python\nx", "x", "```python\n```"]) == [
        "x", "```python\nx", "x", "",
    ]
    assert apply(spark, without_fences, ["```python\nx\n``` y"]) == ["x\n y"]


GOLDEN = {
    "pipeline_name": "Loan Default Prediction ETL",
    "main_goal": "join applicants and bureau",
    "initial_tables": ["application_train", "bureau"],
    "join_operations": [
        {"left_table": "application_train", "right_table": "bureau", "join_type": "left",
         "on_columns": ["SK_ID_CURR"]}
    ],
    "data_cleaning_steps": [
        {"type": "imputation", "details": {"strategy": "median", "columns": ["AMT_INCOME_TOTAL"]}}
    ],
    "scoring_model": {"name": "P", "objective": "binary", "target_column": "TARGET",
                      "features": ["AMT_INCOME_TOTAL"]},
    "output_format": "parquet",
    "output_location": "s3://x/y",
}
MINIMAL = {"pipeline_name": "n", "main_goal": "g"}


def parse(spark, payloads):
    df = spark.createDataFrame(
        [(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)],
        "spec_id int, payload string",
    )
    return parse_specs(df)


HARD_JSON = [
    "{}", " [1] ", "1", '"x"', "null", "", "  ", "1,2", "1],[2", '1},{"v":2', '1,"v":2', '{"a":1} tail', '{"a":1}{"b":2}',
    '{"a":', "[1,]", "{'a':1}", "nul", "01", "1.", '"a\nb"', '"\\u00e9"', '{"a":1,"a":2}', '{"a":{"b":1,"b":[2]}}', "NaN",
    '{"a": -Infinity}', "[" * 60 + "]" * 60, '{"v":1}', "]", "}", '"', "\ufeff{}", "{}\u00a0", "{}\n", "1e400",
]


def test_one_json_value_and_nothing_else(spark):
    """The JVM decides most texts; together with Python it agrees with the strict parser."""
    def strict(text):
        try:
            return json.loads(text)
        except ValueError:
            return None

    df = spark.createDataFrame(list(enumerate(HARD_JSON)), "i int, t string")
    got = with_normalized_json(with_strict_json(df, F.col("t"), "ok"), F.col("t"), "n").withColumn(
        "jvm", jvm_accepts(F.col("t"))).orderBy("i")
    for r in got.collect():
        valid = r.t.strip() == "null" or strict(r.t) is not None
        assert r.ok == valid, r
        assert valid or not r.jvm, r
        if r.n == NOT_A_NUMBER:
            assert "N" in r.t or "I" in r.t
        elif r.n is not None:
            assert json.loads(r.n) == strict(r.t), r


def test_repeated_keys_and_numbers_that_json_lacks(spark):
    rows = parse(spark, ['{"pipeline_name": "a", "pipeline_name": "b", "main_goal": "g"}',
                         '{"pipeline_name": "a", "main_goal": "g", "x": NaN}']).orderBy("spec_id").collect()
    assert rows[0].spec.pipeline_name == "b" and rows[0].error_class is None
    assert rows[1].errors == ["payload: NaN or infinite number"] and rows[1].error_class == "invalid_json"


def test_equal_specs_of_two_requests_are_two_documents(spark):
    specs = accepted(parse(spark, [MINIMAL, MINIMAL])).withColumn("request", F.concat(F.lit("r"), "spec_id"))
    index = DocumentIndex(spark, scratch_path(spark, "test-tasks"))
    for _ in range(2):
        index_tasks(index, specs)
    found = index.read().select(F.try_variant_get("metadata", "$.original_request_text", "string")).collect()
    assert sorted(r[0] for r in found) == ["r0", "r1"]


def test_every_key_with_columns_is_validated(spark):
    steps = [
        {"type": "imputation", "details": {"columns": "nope1"}}, {"type": "conversion", "details": {"types": {"nope2": "int"}}},
        {"type": "deduplication", "details": {"columns": ["a"], "order_by": "nope3"}},
    ]
    build = [{"type": "aggregation", "details": {"group_by": ["nope4"], "status": {"nope5": ["x"]}}},
             {"type": "encoding", "details": {"columns": ["a"], "values": {"nope6": [1]}}}]
    spec = {**MINIMAL, "initial_tables": ["t"], "data_cleaning_steps": steps, "feature_engineering_steps": build}
    catalog = spark.createDataFrame([("t", "a", "IntegerType()", False)],
                                    "table_name string, column_name string, data_type string, is_target boolean")
    specs = accepted(parse(spark, [spec])).select("spec_id", "spec")
    found = validate_specs(specs, catalog).collect()
    assert sorted(r.subject for r in found if r.rule == "missing_column") == [f"nope{i}" for i in range(1, 7)]


def test_a_column_listed_twice_is_one_entry(spark):
    columns = spark.createDataFrame([("a", "x", "IntegerType()"), ("a", "x", "StringType()"), ("a", "y", "IntegerType()")],
                                    "table_name string, column_name string, data_type string")
    tables = spark.createDataFrame([("a",), ("b",)], "table_name string")
    got = {r.table_name: r.columns for r in nested_catalog(columns, tables).collect()}
    assert sorted(got["a"]) == ["x", "y"] and got["a"]["x"].data_type == "IntegerType()" and got["b"] == {}


def test_valid_specs_and_defaults(spark):
    parsed = parse(spark, [GOLDEN, MINIMAL, {**MINIMAL, "extra": [1], "output_format": None}])
    rows = [r.spec for r in accepted(parsed).orderBy("spec_id").collect()]
    assert len(rows) == 3 and quarantined(parsed).count() == 0
    assert rows[0].join_operations[0].on_columns == ["SK_ID_CURR"]
    assert rows[0].data_cleaning_steps[0].details.toPython()["columns"] == ["AMT_INCOME_TOTAL"]
    assert rows[0].scoring_model.features == ["AMT_INCOME_TOTAL"]
    assert (rows[1].initial_tables, rows[1].join_operations, rows[1].scoring_model) == ([], [], None)
    assert (rows[1].output_format, rows[2].output_format) == ("dataframe", None)


@pytest.mark.parametrize(
    "payload, errors",
    [
        ('{"pipeline_name": "n"} tail', ["payload: not valid JSON"]),
        ("[1]", ["spec: expected object"]),
        ({"pipeline_name": "n"}, ["main_goal: expected string, found missing"]),
        ({**MINIMAL, "main_goal": None}, ["main_goal: expected string, found void"]),
        ({**MINIMAL, "pipeline_name": 5}, ["pipeline_name: expected string, found bigint"]),
        ({**MINIMAL, "initial_tables": "x"}, ["initial_tables: expected array, found string"]),
        ({**MINIMAL, "initial_tables": ["x", 1]}, ["initial_tables: expected a list of strings"]),
        ({**MINIMAL, "initial_tables": ["x", None]}, ["initial_tables: expected a list of strings"]),
        ({**MINIMAL, "join_operations": "x"}, ["join_operations: expected array, found string"]),
        ({**MINIMAL, "join_operations": None}, ["join_operations: expected array, found void"]),
        ({**MINIMAL, "join_operations": [1]}, ["join_operations: expected a list of objects"]),
        ({**MINIMAL, "join_operations": [{"left_table": "a", "right_table": "b", "join_type": "cross"}]},
         ["join_operations[0].join_type: not a join type",
          "join_operations[0].on_columns: expected array, found missing"]),
        ({**MINIMAL, "data_cleaning_steps": [{"type": "x"}]},
         ["data_cleaning_steps[0].details: expected object, found missing"]),
        ({**MINIMAL, "feature_engineering_steps": [{"type": "x"}, {"details": [1]}]},
         ["feature_engineering_steps[1].type: expected string, found missing",
          "feature_engineering_steps[1].details: expected object, found array"]),
        ({**MINIMAL, "scoring_model": "m"}, ["scoring_model: expected object, found string"]),
        ({**MINIMAL, "scoring_model": {"name": "m", "objective": "o", "features": [2]}},
         ["scoring_model.target_column: expected string, found missing",
          "scoring_model.features: expected a list of strings"]),
        ({**MINIMAL, "output_location": 1}, ["output_location: expected string, found bigint"]),
    ],
)
def test_invalid_specs(spark, payload, errors):
    row = parse(spark, [payload]).first()
    assert row.errors == errors and row.spec is None
    assert row.error_class == ("invalid_json" if "payload" in errors[0] else "schema")


def repair(spark, items, initial, literal=False):
    df = spark.createDataFrame(
        [(items if isinstance(items, str) else json.dumps({"etl_tasks": items}), json.dumps(initial))],
        "w string, i string",
    )
    return repair_wrapped(df, "w", "i", literal).first()


def test_repair(spark):
    join = {"left_table": "a", "right_table": "b", "join_type": "inner", "on_columns": ["k"]}
    items = [
        {"type": "imputation and encoding", "details": {"columns": ["x"]}, "table_name": "t2"},
        join, {**join, "join_type": "cross"}, "text", 5,
        {"type": "date_features", "details": {}, "table_name": "t1"},
        {"type": "Scaling", "details": {"m": 1}, "table_name": "t2"},
        {"type": "scaling", "details": 1, "target_column": "never"},
        {"name": "m1", "objective": "o", "target_column": "T"},
        {"name": "m2", "objective": "o", "target_column": "T"},
        {"name": "bad", "target_column": "T"},
    ]
    row = repair(spark, items, {"pipeline_name": "p", "initial_tables": ["t1", "t1"]})
    assert row.repaired and row.spec.pipeline_name == "p" and row.spec.main_goal == "Reconstructed Goal"
    assert row.spec.initial_tables == ["t1", "t1", "t2"]
    assert [j.join_type for j in row.spec.join_operations] == ["inner"]
    assert [s.type for s in row.spec.data_cleaning_steps] == ["imputation and encoding"]
    assert [s.type for s in row.spec.feature_engineering_steps] == ["date_features", "Scaling"]
    assert row.spec.scoring_model.name == "m2" and row.spec.output_format == "dataframe"
    literal = repair(spark, items, {}, literal=True)
    assert literal.spec.pipeline_name == "Reconstructed Pipeline"
    assert [s.type for s in literal.spec.feature_engineering_steps] == ["Scaling"]


def test_repair_refuses(spark):
    assert not repair(spark, '{"other": 1}', {}).repaired
    assert repair(spark, [], {"pipeline_name": None}).errors == ["pipeline_name: expected string"]


CATALOG = [
    ("application_train", "SK_ID_CURR", "IntegerType()", False),
    ("application_train", "TARGET", "IntegerType()", True),
    ("application_train", "AMT_INCOME_TOTAL", "DoubleType()", False),
    ("application_test", "SK_ID_CURR", "IntegerType()", False),
    ("bureau", "SK_ID_CURR", "LongType()", False),
    ("bureau", "DAY", "DateType()", False),
    ("codes", "SK_ID_CURR", "StringType()", False),
]


def catalog(spark):
    return spark.createDataFrame(
        CATALOG, "table_name string, column_name string, data_type string, is_target boolean"
    )


def check(spark, *specs):
    typed = accepted(parse(spark, specs))
    findings = validate_specs(typed, catalog(spark))
    return {
        r.spec_id: (r.ok, [tuple(f) for f in r.findings])
        for r in validation_report(typed, findings).collect()
    }


def test_validation(spark):
    def joined(left, right, key, **more):
        return {**MINIMAL, "initial_tables": [left],
                "join_operations": [{"left_table": left, "right_table": right, "on_columns": [key]}], **more}

    target = {"name": "m", "objective": "o"}
    out = check(
        spark,
        GOLDEN,
        joined("application", "bureau", "SK_ID_CURR"),
        joined("application_train", "bureau", "DAY"),
        joined("application_train", "codes", "SK_ID_CURR"),
        {**MINIMAL, "initial_tables": ["bureau"], "scoring_model": {**target, "target_column": "TARGET"}},
        {**MINIMAL, "initial_tables": ["bureau"], "scoring_model": {**target, "target_column": "DAY"}},
        {**MINIMAL, "initial_tables": ["bureau"],
         "data_cleaning_steps": [{"type": "imputation", "details": {"columns": ["DAY", "NIGHT"]}}]},
        MINIMAL,
    )
    assert out == {
        0: (True, []),
        1: (False, [("missing_join_key", "application.SK_ID_CURR", "left"),
                    ("missing_table", "application", "application_train")]),
        2: (False, [("missing_join_key", "application_train.DAY", "left")]),
        3: (False, [("incompatible_key_types", "SK_ID_CURR", "number/text")]),
        4: (False, [("missing_target", "TARGET", None)]),
        5: (False, [("target_not_flagged", "DAY", None)]),
        6: (False, [("missing_column", "NIGHT", None)]),
        7: (True, []),
    }


def test_suggestions(spark):
    names = spark.createDataFrame(
        [("bureau", False), ("bureaus_x", False), ("loans", False), ("loanz", True), ("orders", False)],
        "table_name string, has_target boolean",
    )
    asked = ["burea", "bureaux", "loan", "loany", "ordesr", "oders", "orderss", "xyz", "beaurau", ""]
    missing = spark.createDataFrame([(a,) for a in asked], "table_name string")
    got = {r.table_name: r.suggestion for r in suggest_tables(missing, names).collect()}
    assert got == {
        "burea": "bureau", "bureaux": "bureau", "loan": "loanz", "loany": "loanz", "ordesr": None,
        "oders": "orders", "orderss": "orders", "xyz": None, "beaurau": None, "": None,
    }


def test_tasks(spark):
    typed = accepted(parse(spark, [GOLDEN, MINIMAL])).withColumn("request", F.lit("r"))
    texts = [r[0] for r in typed.orderBy("spec_id").select(render_task(F.col("spec"))).collect()]
    assert texts == [
        "Approved ETL Pipeline: Loan Default Prediction ETL. Main Goal: join applicants and bureau. "
        "Initial Tables: application_train, bureau. Scoring Model: P, Objective: binary, "
        "Target: TARGET. Features: AMT_INCOME_TOTAL.",
        "Approved ETL Pipeline: n. Main Goal: g. Initial Tables: . ",
    ]
    docs = task_documents(typed).collect()
    assert len({d.id for d in docs}) == 2
    meta = next(d.metadata for d in docs if d.metadata.pipeline_name != "n")
    assert meta.join_operations_summary == ["application_train JOIN bureau ON SK_ID_CURR"]
    assert meta.data_cleaning_types == ["imputation"] and meta.original_request_text == "r"


TASK, SCRIPT = "task_definition_review", "script_execution_review"


@pytest.mark.parametrize(
    "text, task, script",
    [
        ("approve", "approved", "approved"),
        ("  APPROVED. ", "approved", "approved"),
        ("not approved", "approved", "approved"),
        ("I deny", "denied", "denied"),
        ("denied, quit", "denied", "denied"),
        ("Quitting", "quit", "quit"),
        ("no modifications needed", "approved", "approved"),
        ('```json\n{"a": "Z"}\n```', "modified_json", "error"),
        ('```json\n{"a": }\n```', "error", "error"),
        ("```python\nX = 1\n```", "error", "modified_code"),
        ("hm", "error", "error"),
        (None, "error", "error"),
    ],
)
def test_reviews(spark, text, task, script):
    rows = []
    for i, kind in enumerate((TASK, SCRIPT)):
        rows += [(i, kind, 0, "AI_Reviewer", "approve or deny?"), (i, kind, 1, "Human_Reviewer", "quit"),
                 (i, kind, 2, "Human_Reviewer", text), (i, kind, 3, "AI_Reviewer", "DENIED")]
    if text is None:
        rows = [r for r in rows if r[3] == "AI_Reviewer"]
    messages = spark.createDataFrame(
        rows, "review_id int, review_type string, turn int, name string, content string"
    )
    last = last_message(messages)
    got = {r.review_type: r for r in classify_reviews(last).collect()}
    assert (got[TASK].status, got[SCRIPT].status) == (task, script)
    assert not got[TASK].execute_approved
    assert got[SCRIPT].execute_approved == ("approve" in (text or "").lower())
    assert got[TASK].quit_session == (task == "quit")
    if task == "modified_json":
        assert got[TASK].modified_content == '{"a": "Z"}'
    if script == "modified_code":
        assert got[SCRIPT].modified_content == "X = 1"
    literal = {r.review_type: r.status for r in classify_reviews(last, literal=True).collect()}
    assert literal[TASK] == (task if not task.startswith("modified") else "error")
    if text == "not approved":
        assert {r.status for r in classify_reviews(last, whole_words=True).collect()} == {"error"}


def test_outcomes(spark):
    requests = spark.createDataFrame(
        [(i, i != 0, i != 1, i != 2) for i in range(12)],
        "request_id int, parse_ok boolean, plan_ok boolean, script_ok boolean",
    )
    ok = ("approved", False, False)
    run = ("approved", True, False)
    rows = [(2, TASK, 1, *ok), (3, TASK, 1, "quit", False, True), (4, TASK, 1, "denied", False, False),
            (5, TASK, 1, *ok), (5, TASK, 2, "modified_json", False, False)]
    for i in range(6, 12):
        rows.append((i, TASK, 1, *ok))
    rows += [(6, SCRIPT, 1, *run), (7, SCRIPT, 1, *run), (8, SCRIPT, 1, *ok),
             (9, SCRIPT, 1, *run), (9, SCRIPT, 2, "quit", False, True),
             (10, SCRIPT, 1, "error", False, False)]
    decisions = spark.createDataFrame(
        rows, "request_id int, review_type string, round int, status string, "
        "execute_approved boolean, quit_session boolean",
    )
    runs = spark.createDataFrame(
        [(6, 1, False), (6, 2, True), (7, 1, False), (9, 1, False)],
        "request_id int, round int, succeeded boolean",
    )
    got = {r.request_id: r.outcome for r in run_outcomes(requests, decisions, runs).collect()}
    assert got == {
        0: "error", 1: "error", 2: "error", 3: "quit_session", 4: "denied", 5: "in_review",
        6: "approved", 7: "in_review", 8: "approved_no_execution", 9: "quit_session", 10: "error",
        11: "in_review",
    }


# ---- catalog ----

DICTIONARY = [
    ("application_{train|test}.csv", "TARGET", "the target"),
    (" BUREAU.CSV ", " _sk_id_curr_ ", "id in bureau"),
    ("bureau.csv", "SK_BUREAU_ID", None),
    ("bureau.csv", "AMT", "amount"),
    ("bureau.csv", "AMT", "amount of credit"),
    ("  ", "X", "no table"),
    ("bureau.csv", None, "no column"),
    (".csv", "X", "empty table"),
    ("gone.csv", "LOST", "nowhere"),
]


def entries(spark):
    return dictionary_entries(
        spark.createDataFrame(DICTIONARY, "Table string, Row string, Description string")
    )


def test_dictionary_entries(spark):
    got = {(r.original_table_name, r.original_column_name, r.description_text): r for r in entries(spark).collect()}
    assert len(got) == 7
    assert got["application_train", "TARGET", "the target"].is_target
    assert not got["application_test", "TARGET", "the target"].is_target
    assert got["bureau", "_sk_id_curr_", "id in bureau"].normalized_column_name == "SK_ID_CURR"
    assert got["bureau", "_sk_id_curr_", "id in bureau"].is_id
    assert got["bureau", "SK_BUREAU_ID", ""].is_id
    assert got["bureau", "AMT", "amount"].entry_text == "Description for table 'bureau', column 'AMT': amount"


def columns(spark, rows):
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def test_enrichment_prefers_exact_matches(spark):
    cols = columns(spark, [("bureau", "AMT", "D"), ("application_train", "target", "I"),
                           ("other", "TARGET", "I"), ("bureau", "SK_BUREAU_ID", "I")])
    got = {(r.table_name, r.column_name): r for r in enrich_columns(cols, entries(spark)).collect()}
    assert got["bureau", "AMT"].description == "amount" and got["bureau", "AMT"].matched == "exact"
    assert got["application_train", "target"].is_target
    fuzzy = got["other", "TARGET"]
    assert fuzzy.matched == "similar" and fuzzy.description == "the target" and not fuzzy.is_target
    strict = {
        (r.table_name, r.column_name): r for r in enrich_columns(cols, entries(spark), strict=True).collect()
    }
    assert strict["bureau", "SK_BUREAU_ID"].matched == "exact"
    assert strict["other", "TARGET"].matched == "similar"
    none = enrich_columns(cols, entries(spark).limit(0)).collect()
    assert {(r.description, r.is_target, r.matched) for r in none} == {("", False, None)}


def test_enrichment_by_vectors(spark):
    cols = columns(spark, [("bureau", "AMT", "D"), ("other", "TARGET", "I")])

    def embed(texts):  # a word more than "target" turns the vector away
        return np.array([[("target" in t.split()), 0.1 * ("amt" in t.split()), 0.01] for t in texts])

    for strict in (False, True):
        rows = enrich_columns(cols, entries(spark), strict, embed).collect()
        got = {r.column_name: (r.description, r.matched) for r in rows}
        amount = "amount of credit" if strict else "amount"  # equal vectors go by id
        assert got == {"AMT": (amount, "exact"), "TARGET": ("the target", "similar")}
    none = enrich_columns(cols, entries(spark).limit(0), embedder=embed).collect()
    assert {(r.description, r.is_target, r.matched) for r in none} == {("", False, None)}


def test_context_of_requests_over_both_indexes(spark, tmp_path):
    embed = hashing_embedder(64)
    requests = spark.createDataFrame(
        [(1, "sum the amount"), (2, "predict the default")], "query_id long, text string")
    columns_index = DocumentIndex(spark, f"{tmp_path}/columns")
    tasks = DocumentIndex(spark, f"{tmp_path}/tasks")
    empty = request_context(requests, columns_index, tasks, embed).collect()
    assert {r.query_id: r.context for r in empty} == {1: NO_CONTEXT, 2: NO_CONTEXT}
    docs = spark.sql("""SELECT * FROM VALUES
        ('a', 'amount', named_struct('source', 's', 'tables', array('t "1"', 'u'), 'none', CAST(array() AS array<string>), 'is_id', false)),
        ('b', 'default', named_struct('source', null, 'tables', CAST(array() AS array<string>), 'none', CAST(null AS array<string>), 'is_id', true))
        AS t(id, text_content, metadata)""")
    columns_index.upsert(with_variant_metadata(docs), embedder=embed)
    got = {r.query_id: r.context for r in request_context(
        requests, columns_index, tasks, embed, catalog_hits=1).collect()}
    first = {"is_id": False, "none": [], "source": "s", "tables": ['t "1"', "u"]}
    second = {"is_id": True, "none": None, "source": None, "tables": []}
    for number, text, meta in ((1, "amount", first), (2, "default", second)):
        assert got[number] == (
            f"Relevant Dataset Metadata:\n  - Document 1 (Dataset): '{text}'\n"
            f"    Metadata: {json.dumps(meta, indent=2)}\n")


def test_global_merge(spark):
    rows = [
        ("t2", "id", "ID", "I", "a key", False, True), ("t1", "ID", "ID", "L", "the key", False, False),
        ("t3", "id", "ID", "I", "key", True, False), ("t3", "x", "X", "I", "", False, False),
    ]
    df = spark.createDataFrame(
        rows, "table_name string, column_name string, normalized_column_name string, "
        "data_type string, description string, is_target boolean, is_id boolean",
    )
    got = {r.normalized_column_name: r for r in global_columns(df).collect()}
    merged = got["ID"]
    assert (merged.column_name, merged.data_type, merged.tables_present_in) == ("ID", ["I", "L"], ["t1", "t2", "t3"])
    assert merged.description == "the key | a key" and merged.is_target and merged.is_id
    assert merged.entry_text == (
        "Column: ID, Data Type(s): I, L, Description: the key | a key. Present in tables: t1, t2, t3."
    )
    assert got["X"].description == ""


def merged_one_by_one(texts):
    out = ""
    for text in texts:
        if text and text not in out:
            out = f"{out} | {text}" if out else text
    return out


def test_merged_texts_are_those_of_the_rule():
    """Texts within others, across separators, equal, empty, with blanks at their ends."""
    draw = random.Random(1)
    for _ in range(3000):
        texts = ["".join(draw.choices("ab |é", [5, 5, 2, 1, 1], k=draw.randint(0, 6))) for _ in range(draw.randint(0, 12))]
        assert merge_texts(texts) == merged_one_by_one(texts)
    assert merge_texts([]) == "" and merge_texts(["", ""]) == ""
    # Equal windows everywhere, and a text that is as long as all others together.
    runs = ["a" * draw.randint(1, 300) for _ in range(200)]
    assert merge_texts(runs) == merged_one_by_one(runs)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(2000)]
    assert merge_texts([*texts, "".join(texts)]) == merged_one_by_one([*texts, "".join(texts)])


def test_many_descriptions_of_one_name(spark):
    """Beside names of few descriptions, one of 100,000: only the latter goes to Python."""
    words = F.transform(F.sequence(F.lit(1), (F.col("id") % 3 + 1).cast("int")), lambda i: F.concat(
        F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(3000)).cast("string")))
    many = spark.range(100_000).select(
        F.concat(F.lit("t"), F.lpad("id", 6, "0")).alias("table_name"), F.lit("c").alias("column_name"),
        F.when(F.col("id") % 100 < 99, "MANY").otherwise(F.concat(F.lit("N"), (F.col("id") % 700).cast("string")))
        .alias("normalized_column_name"), F.lit("I").alias("data_type"),
        F.array_join(words, " ").alias("description"), F.lit(False).alias("is_target"), F.lit(False).alias("is_id"))
    texts = {}
    for r in many.select("normalized_column_name", "table_name", "description").orderBy("table_name").collect():
        texts.setdefault(r.normalized_column_name, []).append(r.description)
    got = {r.normalized_column_name: r.description for r in global_columns(many).collect()}
    assert set(got) == set(texts) and len(texts["MANY"]) == 99_000
    for name, ordered in texts.items():
        few = list(dict.fromkeys(ordered))
        assert (len(few) > MANY) == (name == "MANY")
        if name != "MANY":
            assert got[name] == merged_one_by_one(few)
    whole, kept = f" | {got['MANY']} | ", set(got["MANY"].split(" | "))
    assert all(t in whole for t in set(texts["MANY"])) and kept <= set(texts["MANY"])
    first = list(dict.fromkeys(texts["MANY"]))[:3000]
    assert got["MANY"].startswith(merged_one_by_one(first))


def test_ingest_of_a_folder(spark, tmp_path):
    (tmp_path / "application_train.csv").write_text("SK_ID_CURR,TARGET\n1,0\n")
    (tmp_path / "bureau.csv").write_text("SK_ID_CURR,AMT\n1,2.5\n")
    (tmp_path / "empty.csv").mkdir()
    described = "Table,Row,Description\n" + "\n".join(
        f"{t},{c},{d}" for t, c, d in [
            ("application_{train|test}.csv", "TARGET", "target"), ("bureau.csv", "AMT", "café"),
            ("bureau.csv", "GONE", "NA"),
        ]
    )
    (tmp_path / "columns.csv").write_bytes(described.encode("latin-1"))
    index = DocumentIndex(spark, scratch_path(spark, "catalog-index"))
    built, report = ingest_catalog(spark, str(tmp_path), str(tmp_path / "columns.csv"), index)
    assert report == {"columns": 4, "documents": 3, "described_but_not_found": 1}
    assert [r[0] for r in built.missing.collect()] == ["GONE"]
    texts = [r.text_content for r in index.read().collect()]
    assert "Column: AMT, Data Type(s): DoubleType(), Description: café. Present in tables: bureau." in texts
    nested = {r.table_name: r.columns for r in nested_catalog(built.catalog, built.tables).collect()}
    assert nested["empty"] == {} and nested["bureau"]["AMT"].data_type == "DoubleType()"
    assert nested["application_train"]["TARGET"].is_target
    again, _ = ingest_catalog(spark, str(tmp_path), str(tmp_path / "columns.csv"), index)
    assert index.read().count() == 3
    assert build_catalog(spark, str(tmp_path), str(tmp_path / "columns.csv"), strict=True).catalog.count() == 4


def test_accepted_texts_stay_on_the_jvm(spark):
    """Python stands above a filter for refused texts, in one branch of two, and nowhere else."""
    df = spark.createDataFrame([("{}",), ("{",), (None,)], "t string")
    out = with_normalized_json(df, F.col("t"), "n")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Union") == 1
    above = plan.split("ArrowEvalPython")[1]
    assert "Filter" in above.splitlines()[1] + above.splitlines()[2]
    assert sorted((r.t, r.n) for r in out.where("t IS NOT NULL").collect()) == [("{", None), ("{}", "{}")]
    assert out.count() == 3


def test_payloads_are_made_and_tested_once(spark):
    """Both branches of the parser read a written verdict; a verdict takes one look at a text."""
    df = spark.range(20).selectExpr("id spec_id", "concat('{\"pipeline_name\": \"p', id, '\", \"main_goal\": \"made here\"}') payload")
    out = parse_specs(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "made here" not in plan and "Range" not in plan
    assert sorted(r[0] for r in out.select("spec.pipeline_name").collect()) == sorted(f"p{i}" for i in range(20))
    tested = df.where(jvm_accepts(F.col("payload")))
    assert tested._jdf.queryExecution().analyzed().toString().count("concat([") == 2  # the mark's two readings


def test_texts_with_the_mark_of_the_test(spark):
    from loomwright.functions import jsonio

    mark = getattr(jsonio, "_MARK", "1")
    texts = [f"1,{mark}", f"1,{mark}] x", f"1,{mark}.0] x", f'1,"{mark}"] x', f"1,{mark}e0] x", f"[{mark}]", mark, f"1],{mark}", '"a', "1,"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.jvm, r.ok) for r in with_strict_json(df, F.col("t"), "ok").withColumn("jvm", jvm_accepts(F.col("t"))).collect()}
    assert {t for t, (_, ok) in got.items() if ok} == {f"[{mark}]", mark}
    assert not any(jvm for jvm, _ in got.values())


def test_only_join_keys_are_judged_by_sorting(spark):
    from loomwright.plans import validate

    rows = [(1, "missing_table", -1, "", "t", "", None, None, None), (1, "missing_table", -1, "", "u", "", True, False, None),
            (1, "missing_join_key", 0, "left", "t", "k", None, None, None), (1, "missing_join_key", 0, "right", "u", "k", True, None, "text"),
            (1, "missing_target", -1, "", "t", "y", None, None, None), (1, "missing_target", -1, "", "u", "y", True, True, "text"),
            (None, "missing_column", -1, "", "u", "z", None, None, None)]
    looked_up = spark.createDataFrame(rows, "spec_id int, rule string, pos int, side string, table_name string, column_name string, "
                                            "known boolean, is_target boolean, family string")
    judged = validate._judged(looked_up)
    sides = judged._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" in sides and "HashAggregate" in sides
    got = {(r.spec_id, r.rule, r.column_name, r.asked_table): (r.any_found, r.any_flagged, r.no_left, r.no_right, r.left_family, r.right_family)
           for r in judged.collect()}
    assert got == {
        (1, "missing_table", "", "t"): (False, False, None, None, None, None), (1, "missing_table", "", "u"): (True, False, None, None, None, None),
        (1, "missing_join_key", "k", None): (True, False, "t", None, None, "text"),
        (1, "missing_target", "y", None): (True, True, None, None, None, None),
        (None, "missing_column", "z", None): (False, False, None, None, None, None)}
