"""Job specs: schema, parsing with defaults, checks, repair of wrapped specs.

All of it is done within each row; nothing is shuffled. A JSON object is first opened
into a struct of variants, one per known key, so that each value is looked at once:
its type decides whether it is missing, null or wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwright.functions.jsonio import (
    NOT_A_NUMBER, list_of_members, members, readable, shape, text_of, texts_of, with_normalized_json,
)
from loomwright.operators.joins import JOIN_TYPES
from loomwright.storage import spread, stage

JOIN_TYPE = (
    "struct<left_table:string,right_table:string,join_type:string,"
    "on_columns:array<string>,description:string>"
)
STEP_TYPE = "struct<type:string,details:variant>"
SCORING_TYPE = "struct<name:string,objective:string,target_column:string,features:array<string>>"
SPEC_TYPE = (
    "struct<pipeline_name:string,main_goal:string,initial_tables:array<string>,"
    f"join_operations:array<{JOIN_TYPE}>,data_cleaning_steps:array<{STEP_TYPE}>,"
    f"feature_engineering_steps:array<{STEP_TYPE}>,scoring_model:{SCORING_TYPE},"
    "output_format:string,output_location:string>"
)

# Defaults of a spec and the words that classify its steps.
DEFAULT_JOIN_TYPE = "left"
DEFAULT_FORMAT = "dataframe"
DEFAULT_NAME = "Reconstructed Pipeline"
DEFAULT_GOAL = "Reconstructed Goal"
CLEANING_WORDS = ("imputation", "cleaning", "outlier", "deduplication", "conversion")
FEATURE_WORDS = ("feature_engineering", "aggregation", "encoding", "scaling")
MORE_FEATURE_WORDS = ("polynomial_features", "date_features")

INVALID_JSON = "invalid_json"
BAD_SCHEMA = "schema"


JOIN_KEYS = ("left_table", "right_table", "join_type", "on_columns", "description")
STEP_KEYS = ("type", "details")
SCORING_KEYS = ("name", "objective", "target_column", "features")
SPEC_KEYS = (
    "pipeline_name", "main_goal", "initial_tables", "join_operations", "data_cleaning_steps",
    "feature_engineering_steps", "scoring_model", "output_format", "output_location",
)
ITEM_KEYS = tuple(dict.fromkeys([*JOIN_KEYS, *STEP_KEYS, *SCORING_KEYS, "table_name"]))

_NO_TEXTS = "array<string>"


def _at(path: Column, name: str) -> Column:
    return F.concat(path, F.lit(f".{name}"))


def _problem(
    value: Column, path: Column, expected: str, required: bool = True, nullable: bool = False
) -> Column:
    """An error text for one value, null when it is fine."""
    allowed = [expected] + ([] if required else ["MISSING"]) + (["VOID"] if nullable else [])
    found = F.substring_index(shape(value), "<", 1)
    return F.when(
        ~found.isin(allowed),
        F.concat(path, F.lit(f": expected {expected.lower()}, found "), F.lower(found)),
    )


def _texts_problem(
    value: Column, path: Column, required: bool = True, nullable: bool = False
) -> Column:
    # An empty array and one of nulls share a type, so the elements are looked at, too.
    all_texts = shape(value).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(
        texts_of(value), lambda t: t.isNotNull()
    )
    return F.coalesce(
        _problem(value, path, "ARRAY", required, nullable),
        F.when(
            shape(value).startswith("ARRAY") & ~F.coalesce(all_texts, F.lit(False)),
            F.concat(path, F.lit(": expected a list of strings")),
        ),
    )


def _found(*problems: Column) -> Column:
    return F.array_compact(F.array(*problems))


def _join_problems(join: Column, path: Column) -> Column:
    join_type = join["join_type"]
    return _found(
        _problem(join["left_table"], _at(path, "left_table"), "STRING"),
        _problem(join["right_table"], _at(path, "right_table"), "STRING"),
        F.coalesce(
            _problem(join_type, _at(path, "join_type"), "STRING", required=False),
            F.when(
                ~text_of(join_type).isin(*JOIN_TYPES),
                F.concat(_at(path, "join_type"), F.lit(": not a join type")),
            ),
        ),
        _texts_problem(join["on_columns"], _at(path, "on_columns")),
        _problem(join["description"], _at(path, "description"), "STRING", False, True),
    )


def _cleaning_problems(step: Column, path: Column, details_required: bool = True) -> Column:
    return _found(
        _problem(step["type"], _at(path, "type"), "STRING"),
        F.when(
            members(step["details"], ("_",)).isNull(),
            _problem(step["details"], _at(path, "details"), "OBJECT", details_required),
        ),
    )


def _feature_problems(step: Column, path: Column) -> Column:
    return _cleaning_problems(step, path, details_required=False)


def _scoring_problems(scoring: Column, path: Column) -> Column:
    return _found(
        *[_problem(scoring[n], _at(path, n), "STRING") for n in SCORING_KEYS[:3]],
        _texts_problem(scoring["features"], _at(path, "features"), False, True),
    )


def _list_problems(value: Column, opened: Column, name: str, problems) -> Column:
    # A list that opened needs no look at its type, which would cover all it holds.
    closed = F.coalesce(
        _problem(value, F.lit(name), "ARRAY", required=False),
        F.when(value.isNotNull(), F.lit(f"{name}: expected a list of objects")),
    )
    own = _found(
        F.when(opened.isNull(), closed).when(
            F.exists(opened, lambda item: item.isNull()),
            F.lit(f"{name}: expected a list of objects"),
        )
    )
    of_items = F.flatten(
        F.transform(
            F.filter(opened, lambda item: item.isNotNull()),
            lambda item, i: problems(
                item, F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
            ),
        )
    )
    return F.concat(own, F.coalesce(of_items, F.array().cast(_NO_TEXTS)))


def _as_join(join: Column) -> Column:
    return F.struct(
        text_of(join["left_table"]).alias("left_table"),
        text_of(join["right_table"]).alias("right_table"),
        F.coalesce(text_of(join["join_type"]), F.lit(DEFAULT_JOIN_TYPE)).alias("join_type"),
        texts_of(join["on_columns"]).alias("on_columns"),
        text_of(join["description"]).alias("description"),
    )


def _as_step(step: Column) -> Column:
    details = F.coalesce(step["details"], F.parse_json(F.lit("{}")))
    return F.struct(text_of(step["type"]).alias("type"), details.alias("details"))


def _as_scoring(scoring: Column) -> Column:
    return F.when(
        scoring.isNotNull(),
        F.struct(
            *[text_of(scoring[n]).alias(n) for n in SCORING_KEYS[:3]],
            texts_of(scoring["features"]).alias("features"),
        ),
    )


def _or_default(value: Column, default: str) -> Column:
    return F.when(value.isNull(), F.lit(default)).otherwise(text_of(value))


def _listed(opened: Column, as_item, item_type: str) -> Column:
    return F.coalesce(F.transform(opened, as_item), F.array().cast(f"array<{item_type}>"))


def parse_specs(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Add ``spec`` (null unless valid), ``error_class`` and ``errors`` to payload rows.

    Write the result before taking it apart (``storage.stage``): a filter on the errors
    of an unwritten frame is pushed down and finds them a second time.

    The payloads are written first, with the parser's verdict on each: the rows it accepts and
    the others then read what was found, and neither makes nor tests a payload again.
    """
    top = {n: F.col(f"_top.{n}") for n in SPEC_KEYS}
    joins, cleaning, building, scoring = (
        F.col(c) for c in ("_joins", "_cleaning", "_building", "_scoring")
    )
    tested = stage(spread(df).withColumn("_fine", readable(F.col(payload_col))), "payloads")
    opened = (
        with_normalized_json(tested, F.col(payload_col), "_strict", "_fine")
        .withColumn("_json", F.try_parse_json("_strict"))
        .withColumn("_top", members(F.col("_json"), SPEC_KEYS))
        .withColumns(
            {
                "_joins": list_of_members(top["join_operations"], JOIN_KEYS),
                "_cleaning": list_of_members(top["data_cleaning_steps"], STEP_KEYS),
                "_building": list_of_members(top["feature_engineering_steps"], STEP_KEYS),
                "_scoring": members(top["scoring_model"], SCORING_KEYS),
            }
        )
    )
    problems = F.concat(
        _found(
            _problem(top["pipeline_name"], F.lit("pipeline_name"), "STRING"),
            _problem(top["main_goal"], F.lit("main_goal"), "STRING"),
            _texts_problem(top["initial_tables"], F.lit("initial_tables"), required=False),
        ),
        _list_problems(top["join_operations"], joins, "join_operations", _join_problems),
        _list_problems(
            top["data_cleaning_steps"], cleaning, "data_cleaning_steps", _cleaning_problems
        ),
        _list_problems(
            top["feature_engineering_steps"], building, "feature_engineering_steps",
            _feature_problems,
        ),
        _found(
            F.when(
                scoring.isNull(),
                _problem(top["scoring_model"], F.lit("scoring_model"), "OBJECT", False, True),
            )
        ),
        F.when(scoring.isNotNull(), _scoring_problems(scoring, F.lit("scoring_model"))).otherwise(
            F.array().cast(_NO_TEXTS)
        ),
        _found(
            _problem(top["output_format"], F.lit("output_format"), "STRING", False, True),
            _problem(top["output_location"], F.lit("output_location"), "STRING", False, True),
        ),
    )
    checked = opened.withColumn(
        "errors",
        F.when(F.col("_strict") == NOT_A_NUMBER, F.array(F.lit("payload: NaN or infinite number")))
        .when(F.col("_json").isNull(), F.array(F.lit("payload: not valid JSON")))
        .when(F.col("_top").isNull(), F.array(F.lit("spec: expected object")))
        .otherwise(problems),
    )
    spec = F.struct(
        text_of(top["pipeline_name"]).alias("pipeline_name"),
        text_of(top["main_goal"]).alias("main_goal"),
        F.coalesce(texts_of(top["initial_tables"]), F.array().cast(_NO_TEXTS)).alias(
            "initial_tables"
        ),
        _listed(joins, _as_join, JOIN_TYPE).alias("join_operations"),
        _listed(cleaning, _as_step, STEP_TYPE).alias("data_cleaning_steps"),
        _listed(building, _as_step, STEP_TYPE).alias("feature_engineering_steps"),
        _as_scoring(scoring).alias("scoring_model"),
        _or_default(top["output_format"], DEFAULT_FORMAT).alias("output_format"),
        text_of(top["output_location"]).alias("output_location"),
    )
    return checked.withColumns(
        {
            "error_class": F.when(F.col("_json").isNull(), INVALID_JSON).when(
                F.size("errors") > 0, BAD_SCHEMA
            ),
            "spec": F.when(F.size("errors") == 0, spec),
        }
    ).drop("_fine", "_strict", "_json", "_top", "_joins", "_cleaning", "_building", "_scoring")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("error_class is null").drop("error_class", "errors")


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.where("error_class is not null").drop("spec")


def item_class(item: Column, literal: bool = False) -> Column:
    """What a loose item is: the first of join, cleaning, feature, scoring that it looks
    like, and null when it is not a valid one of these.

    The literal rule knows no polynomial and date features.
    """
    path = F.lit("")
    feature_words = FEATURE_WORDS if literal else FEATURE_WORDS + MORE_FEATURE_WORDS

    def mentions(words: tuple[str, ...]) -> Column:
        return text_of(item["type"]).rlike("(?i)" + "|".join(words))

    def valid(problems, name: str) -> Column:
        return F.when(F.size(problems(item, path)) == 0, name)

    is_step = item["type"].isNotNull() & item["details"].isNotNull()
    return (
        F.when(
            item["join_type"].isNotNull() & item["on_columns"].isNotNull(),
            valid(_join_problems, "join"),
        )
        .when(is_step & mentions(CLEANING_WORDS), valid(_cleaning_problems, "cleaning"))
        .when(is_step & mentions(feature_words), valid(_feature_problems, "feature"))
        .when(item["target_column"].isNotNull(), valid(_scoring_problems, "scoring"))
    )


def repair_wrapped(
    df: DataFrame, wrapped_col: str, initial_col: str, literal: bool = False
) -> DataFrame:
    """Rebuild specs whose content came as one list of loose items.

    ``wrapped_col`` and ``initial_col`` hold JSON texts. Adds ``spec``, ``repaired``
    and ``errors``: items are gathered by class in their order, invalid ones dropped,
    the last scoring item wins, and the head of the spec is taken from the initial one.
    """
    head = {n: F.col(f"_initial.{n}") for n in SPEC_KEYS}
    opened = (
        spread(df)
        .withColumns(
            {
                "_loose": F.try_variant_get(
                    F.try_parse_json(wrapped_col), "$.etl_tasks", "array<variant>"
                ),
                "_initial": members(F.try_parse_json(initial_col), SPEC_KEYS),
            }
        )
        .withColumn(
            "_items",
            F.filter(
                F.transform("_loose", lambda x: members(x, ITEM_KEYS)), lambda x: x.isNotNull()
            ),
        )
        .withColumns(
            {
                "_classes": F.transform("_items", lambda x: item_class(x, literal)),
                "_tables": F.coalesce(texts_of(head["initial_tables"]), F.array().cast(_NO_TEXTS)),
                "_named": F.array_distinct(
                    F.array_compact(F.transform("_items", lambda x: text_of(x["table_name"])))
                ),
            }
        )
    )

    def of_class(name: str, as_item) -> Column:
        chosen = F.filter("_items", lambda x, i: F.get("_classes", i) == name)
        return F.transform(chosen, as_item)

    last_scoring = F.try_element_at(of_class("scoring", _as_scoring), F.lit(-1))
    built = F.struct(
        _or_default(head["pipeline_name"], DEFAULT_NAME).alias("pipeline_name"),
        _or_default(head["main_goal"], DEFAULT_GOAL).alias("main_goal"),
        F.concat(
            "_tables", F.filter("_named", lambda t: ~F.array_contains("_tables", t))
        ).alias("initial_tables"),
        of_class("join", _as_join).alias("join_operations"),
        of_class("cleaning", _as_step).alias("data_cleaning_steps"),
        of_class("feature", _as_step).alias("feature_engineering_steps"),
        last_scoring.alias("scoring_model"),
        _or_default(head["output_format"], DEFAULT_FORMAT).alias("output_format"),
        text_of(head["output_location"]).alias("output_location"),
    )
    nameable = ("MISSING", "STRING")
    errors = F.when(F.col("_items").isNull(), F.array(F.lit("etl_tasks: expected a list"))).otherwise(
        _found(
            *[
                F.when(~shape(head[n]).isin(*nameable), F.lit(f"{n}: expected string"))
                for n in ("pipeline_name", "main_goal")
            ]
        )
    )
    return (
        opened.withColumn("errors", errors)
        .withColumns(
            {"repaired": F.size("errors") == 0, "spec": F.when(F.size("errors") == 0, built)}
        )
        .drop("_loose", "_initial", "_items", "_classes", "_tables", "_named")
    )
