import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomwright.operators import aggregates, cleaning, features
from loomwright.operators.joins import JOIN_TYPES, join_tables
from loomwright.plans.runner import StepError, run_and_save, run_spec, run_specs
from loomwright.sources.sinks import save, verify_written
from loomwright.sources.tables import (
    TableSource, columns_of, discover_csv_tables, infer_columns, preview, read_csv_table,
    read_dictionary,
)
from loomwright.storage import list_folder, stage


@pytest.fixture(scope="module")
def skewed(spark):
    """Both sides share one hot key, each has keys of its own and null keys."""
    left = spark.range(300).selectExpr(
        "CASE WHEN id < 100 THEN 7 WHEN id % 11 = 0 THEN NULL ELSE id END k", "id a", "id same"
    )
    right = spark.range(0, 400, 3).selectExpr(
        "CASE WHEN id < 30 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id END k", "id b", "-id same"
    )
    return left, right


@pytest.mark.parametrize("how", JOIN_TYPES)
def test_joins_equal_the_native_ones(skewed, how):
    left, right = skewed
    got = join_tables(left, right, ["k"], how, "r")
    native = left.join(right.withColumnRenamed("same", "same_r"), ["k"], how)
    assert got.columns == native.columns == ["k", "a", "same", "b", "same_r"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, native.collect()))


def test_joining_a_table_again_keeps_all_columns_apart(skewed):
    left, right = skewed
    right = right.withColumnRenamed("same", "SAME")
    once = join_tables(left, right, ["k"], "left", "r")
    twice = join_tables(once, right, ["k"], "left", "r")
    assert twice.columns == ["k", "a", "same", "b", "SAME_r", "b_r", "SAME_r_r"]
    assert twice.limit(1).count() == 1


def test_join_checks(skewed):
    left, right = skewed
    with pytest.raises(ValueError, match="join type"):
        join_tables(left, right, ["k"], "cross")
    with pytest.raises(ValueError, match="right table"):
        join_tables(left, right, ["a"])
    with pytest.raises(ValueError, match="key column"):
        join_tables(left, right, [])


def test_left_join_keeps_the_row_count_when_the_right_key_is_unique(skewed):
    left, right = skewed
    rolled = aggregates.roll_up(right, ["k"], ["b"])
    assert join_tables(left, rolled, ["k"]).count() == left.count()


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_medians_are_exact_in_joint_passes(spark, monkeypatch, accuracy):
    """A coarse sketch leaves many values between its ends, so it takes several passes."""
    monkeypatch.setattr(aggregates, "_SKETCH_ACCURACY", accuracy)
    made = [
        [1.0], [1.0, 2.0], [5.0] * 400 + [float(i) for i in range(-300, 300)],
        [1.0] * 50 + [9.0] * 50, [random.Random(3).gauss(0, 1) for _ in range(999)], [],
    ]
    rows = [tuple(v[i] if i < len(v) else None for v in made) for i in range(1001)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(len(made)))).repartition(4)
    got = aggregates.medians(df, df.columns).first()
    assert list(got) == [statistics.median(v) if v else None for v in made]


def test_median_jobs_do_not_grow_with_the_columns(spark):
    def jobs(columns):
        df = spark.range(1000).selectExpr(*[f"CAST(id * {i + 1} AS double) c{i}" for i in range(columns)])
        group = f"medians-{columns}"
        spark.sparkContext.setJobGroup(group, "")
        aggregates.medians(df, df.columns)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(12) == jobs(1)


def test_modes_keep_types_and_skip_what_is_named_only(spark):
    df = spark.createDataFrame(
        [(1, [1, 2], b"a", {"k": 1}), (None, None, None, None), (1, [1, 2], b"a", None), (2, [3], b"b", None)],
        "n int, a array<int>, b binary, m map<string,int>",
    )
    found = aggregates.modes(df, ["n", "a", "b"]).first()
    assert (found.n, found.a, bytes(found.b)) == (1, [1, 2], b"a")
    filled = cleaning.impute(df)
    assert filled.where("n IS NULL OR b IS NULL").count() == 0
    assert filled.where("a IS NULL").count() == 1
    assert cleaning.impute(df, "mode", ["a"]).where("a IS NULL").count() == 0


def test_names_are_found_without_regard_to_case(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0)], "id int, age double")
    assert cleaning.impute(df, "mean", ["AGE"]).where("age IS NULL").count() == 0
    assert cleaning.impute(df, "mean", ["AGE"]).columns == ["id", "age"]
    assert join_tables(df, df.select("ID"), ["Id"]).count() == 2
    with pytest.raises(ValueError, match="no such columns"):
        cleaning.impute(df, "mean", ["years"])


@pytest.mark.parametrize("how", ["right", "outer"])
def test_outer_joins_read_the_right_side_once(spark, how):
    left = spark.createDataFrame([(1, "a")] * 50 + [(2, "b"), (None, "n")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n")], "k int, r string")
    rolled = right.groupBy("k").agg(F.max("r").alias("r"))
    got = join_tables(left, rolled, ["k"], how)
    native = left.join(rolled, ["k"], how)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, native.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0  # the derived side stands written


def test_mode_takes_the_smallest_value_on_ties(spark):
    df = spark.createDataFrame(
        [(10, "b", True), (9, "a", None), (10, "a", None), (9, "b", None), (None, None, None)],
        "n int, s string, t boolean",
    )
    assert tuple(aggregates.modes(df, ["n", "s", "t"]).first()) == (9, "a", True)


def test_imputation_leaves_no_nulls(spark):
    df = spark.createDataFrame(
        [(1, 4.0, "x", 1), (2, None, None, 2), (3, 8.0, "y", 3), (4, None, "y", 4)],
        "id int, v double, s string, full int",
    )
    out = {r.id: r for r in cleaning.impute(df).collect()}
    assert out[2].v == 6.0 and out[2].s == "y" and out[4].v == 6.0
    assert cleaning.impute(df, "median", ["v"], accuracy=100).where("v is null").count() == 0
    assert {r.v for r in cleaning.impute(df, "mode", ["v"]).collect()} == {4.0, 8.0}
    with pytest.raises(ValueError, match="strategy"):
        cleaning.impute(df, "guess")
    with pytest.raises(ValueError, match="no such columns"):
        cleaning.impute(df, "mean", ["nope"])


def test_outliers(spark):
    df = spark.createDataFrame(
        [(float(i % 3), 1.0) for i in range(60)] + [(100.0, 1.0), (None, 1.0)], "v double, c double"
    )
    kept = cleaning.drop_outliers(df, ["v", "c"])
    assert kept.count() == 61 and kept.where("v is null").count() == 1
    capped = cleaning.cap_outliers(df, ["v", "c"])
    mean, sd = df.agg(F.avg("v"), F.stddev_samp("v")).first()
    assert capped.agg(F.max("v")).first()[0] == pytest.approx(mean + 3 * sd)
    assert capped.where("v is null").count() == 1
    assert capped.where("c <> 1").count() == 0


def test_deduplication_keeps_the_first_by_order(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "k string, n int")
    assert sorted(tuple(r) for r in cleaning.deduplicate(df, ["k"], ["n"]).collect()) == [
        ("a", 1), ("b", 3),
    ]
    assert cleaning.deduplicate(df.union(df)).count() == 3


def test_strings_and_types(spark):
    df = spark.createDataFrame([(" x\t",), ("  ",), ("",), (None,), ("7",)], "s string")
    assert [r.s for r in cleaning.clean_strings(df).collect()] == ["x", None, None, None, "7"]
    assert [r.s for r in cleaning.convert_types(df, {"s": "int"}).collect()][-1] == 7


def test_features(spark):
    df = spark.createDataFrame(
        [(1, 2.0, 0.0, "a b"), (2, 2.0, 4.0, "c"), (3, 2.0, None, None)],
        "id int, x double, y double, s string",
    )
    hot = features.one_hot(df, "s")
    assert hot.columns[-2:] == ["s_a_b", "s_c"]
    assert [tuple(r)[-2:] for r in hot.orderBy("id").collect()] == [(1, 0), (0, 1), (0, 0)]
    assert [r.x_scaled for r in features.scale(df, ["x"], "minmax").collect()] == [None] * 3
    assert [r.x_scaled for r in features.scale(df, ["x"]).collect()] == [None] * 3
    assert [r.x_y_ratio for r in features.ratio(df, "x", "y").orderBy("id").collect()] == [
        None, 0.5, None,
    ]
    poly = features.polynomial(df, ["x", "y"]).orderBy("id").collect()[1]
    assert (poly.x_squared, poly.y_squared, poly.x_x_y) == (4.0, 16.0, 8.0)
    assert features.select_features(df, ["x", "id", "x"], "id").columns == ["x", "id"]
    assert features.select_features(df, None, "id").columns == df.columns


def test_equal_names_of_values_stay_apart(spark):
    df = spark.createDataFrame([("A-B",), ("A_B",), ("C",), ("a b",), (None,)], "c string")
    hot = features.one_hot(df, "c")
    assert hot.columns == ["c", "c_A_B", "c_A_B_2", "c_C", "c_a_b_3"]
    assert all(sum(r[1:]) == (r.c is not None) for r in hot.collect())
    many = spark.range(1500).selectExpr("CAST(id AS string) v")
    assert len(features.one_hot(many, "v").columns) == 1501
    rolled = aggregates.roll_up(df.selectExpr("1 k", "c"), ["k"], [], status={"c": ["A-B", "A_B"]})
    assert tuple(rolled.first()) == (1, 1, 1) and len(set(rolled.columns)) == 3


def test_products_and_dates_of_awkward_values(spark):
    df = spark.createDataFrame([(100_000, "2024-03-01"), (1, "not a date"), (None, None)], "n int, d string")
    assert features.polynomial(df, ["n"]).first().n_squared == 1e10
    assert [r.d_month for r in features.date_parts(df, ["d"], ["month"]).collect()] == [3, None, None]


# ---- running specs ----


def loan_source(spark):
    frames = {
        "application_train": spark.createDataFrame(
            [(1, 1, 100.0), (2, 0, None), (3, 0, 300.0)],
            "SK_ID_CURR int, TARGET int, AMT_INCOME_TOTAL double",
        ),
        "bureau": spark.createDataFrame(
            [(1, 10, 5.0), (1, 11, 7.0), (2, 12, 9.0)],
            "SK_ID_CURR int, SK_ID_BUREAU int, AMT double",
        ),
        "bureau_balance": spark.createDataFrame(
            [(10, -1, "C"), (10, -2, "0"), (11, -1, "X"), (99, -1, "C")],
            "SK_ID_BUREAU int, MONTHS_BALANCE int, STATUS string",
        ),
    }
    return TableSource(spark, frames=frames)


def loan_spec(**more):
    return {
        "pipeline_name": "loans",
        "main_goal": "default likelihood",
        "initial_tables": ["application_train", "bureau", "bureau_balance"],
        "join_operations": [
            {"left_table": "bureau", "right_table": "bureau_balance", "on_columns": ["SK_ID_BUREAU"]},
            {"left_table": "application_train", "right_table": "bureau", "on_columns": ["SK_ID_CURR"]},
        ],
        "data_cleaning_steps": [
            {"type": "imputation", "details": {"strategy": "median", "columns": ["AMT_INCOME_TOTAL"]}}
        ],
        "feature_engineering_steps": [
            {"type": "aggregation",
             "details": {"table": "bureau_balance", "group_by": ["SK_ID_BUREAU"],
                         "columns": ["MONTHS_BALANCE"], "prefix": "bb_",
                         "status": {"STATUS": ["X", "C", "0", "1", "2", "3", "4", "5"]}}},
            {"type": "aggregation",
             "details": {"table": "bureau", "group_by": ["SK_ID_CURR"], "prefix": "b_",
                         "columns": ["AMT", "bb_STATUS_C_count"], "functions": ["sum"]}},
        ],
        "scoring_model": {
            "name": "m", "objective": "o", "target_column": "TARGET",
            "features": ["AMT_INCOME_TOTAL", "b_AMT_sum", "b_bb_STATUS_C_count_sum"],
        },
        **more,
    }


def test_one_name_as_text_and_general_steps(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, 4.0, "b"), (3, 8.0, None)], "id int, age double, s string")
    spec = {
        "initial_tables": ["t"],
        "data_cleaning_steps": [
            {"type": "imputation", "details": {"columns": "AGE"}},
            {"type": "cleaning", "details": {"columns": "s"}},
            {"type": "deduplication", "details": {"columns": "id", "order_by": "age"}},
        ],
        "feature_engineering_steps": [
            {"type": "one_hot_encoding", "details": {"columns": "s", "values": {"s": "a"}}},
            {"type": "feature_engineering",
             "details": {"operation": "ratio", "columns": ["age", "id"], "name": "per_id"}},
            {"type": "feature_engineering", "details": {"operation": "minmax", "method": "minmax", "columns": "age"}},
            {"type": "aggregation", "details": {"group_by": "id", "columns": "age", "functions": "max"}},
        ],
    }
    out = run_spec(spec, TableSource(spark, frames={"t": frame}))
    assert out.columns == ["id", "age", "s", "s_a", "per_id", "age_scaled", "age_max"]
    assert sorted(r.age for r in out.collect()) == [4.0, 6.0, 8.0]
    spec["feature_engineering_steps"] = [{"type": "feature_engineering", "details": {}}]
    with pytest.raises(StepError, match="names its 'operation'"):
        run_spec(spec, TableSource(spark, frames={"t": frame}))


def test_interval_columns_survive_staging(spark):
    frames = {
        "a": spark.sql("SELECT 1 k, make_interval(0, 1) i, CAST(NULL AS double) v"),
        "b": spark.sql("SELECT 1 k, 2.0D w"),
    }
    spec = {
        "initial_tables": ["a"], "join_operations": [{"left_table": "a", "right_table": "b", "on_columns": "k"}],
        "data_cleaning_steps": [{"type": "imputation", "details": {"columns": ["v", "w"]}}],
    }
    assert run_spec(spec, TableSource(spark, frames=frames)).select("w").first().w == 2.0


def test_two_level_roll_up_run(spark):
    out = run_spec(loan_spec(), loan_source(spark))
    assert out.columns == ["AMT_INCOME_TOTAL", "b_AMT_sum", "b_bb_STATUS_C_count_sum", "TARGET"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(
        map(repr, [(100.0, 12.0, 1, 1), (200.0, 9.0, None, 0), (300.0, None, None, 0)])
    )


@pytest.mark.parametrize("fmt", ["parquet", "csv", "Parquet"])
def test_run_and_save(spark, tmp_path, fmt):
    spec = loan_spec(output_format=fmt, output_location=str(tmp_path / "out"))
    for _ in range(2):  # overwrites
        result = run_and_save(spark, spec, loan_source(spark))
    assert result.location == str(tmp_path / "out") and result.output_format == fmt.lower()
    back = spark.read.format(fmt.lower()).option("header", True).load(result.location)
    assert back.count() == 3
    assert run_and_save(spark, loan_spec(), loan_source(spark)).location is None


def test_bad_formats_fail_before_any_work(spark):
    with pytest.raises(ValueError, match="unknown output format"):
        run_and_save(spark, loan_spec(output_format="orc"), loan_source(spark))
    with pytest.raises(ValueError, match="no provider for 'delta'"):
        save(spark.range(1), "/tmp/never", "delta")
    with pytest.raises(ValueError, match="output location"):
        save(spark.range(1), None, "parquet")
    with pytest.raises(FileNotFoundError):
        verify_written(spark, "/tmp/loomwright-nothing-here", "parquet")


@pytest.mark.parametrize(
    "change, message",
    [
        ({"data_cleaning_steps": [{"type": "wash", "details": {}}]}, "cleaning wash.*unknown"),
        ({"feature_engineering_steps": [{"type": "magic"}]}, "feature magic.*unknown"),
        ({"scoring_model": {"features": ["nope"], "target_column": "TARGET"}}, "selection.*nope"),
        ({"join_operations": [{"left_table": "bureau", "right_table": "gone", "on_columns": ["x"]}]},
         "extract gone"),
    ],
)
def test_errors_name_the_step(spark, change, message):
    with pytest.raises(StepError, match=message):
        run_spec(loan_spec(**change), loan_source(spark))


def test_steps_of_every_type_run(spark):
    spec = {
        "initial_tables": ["bureau_balance"],
        "data_cleaning_steps": [
            {"type": "String cleaning", "details": {}},
            {"type": "type_conversion", "details": {"types": {"MONTHS_BALANCE": "double"}}},
            {"type": "outlier_removal", "details": {"columns": ["MONTHS_BALANCE"], "method": "cap"}},
            {"type": "deduplication", "details": {"columns": ["SK_ID_BUREAU"], "order_by": ["MONTHS_BALANCE"]}},
        ],
        "feature_engineering_steps": [
            {"type": "one_hot_encoding", "details": {"columns": "STATUS"}},
            {"type": "scaling", "details": {"columns": ["MONTHS_BALANCE"]}},
            {"type": "polynomial_features", "details": {"columns": ["MONTHS_BALANCE"]}},
            {"type": "other", "details": {"columns": ["MONTHS_BALANCE", "SK_ID_BUREAU"], "operation": "ratio"}},
            {"type": "other", "details": {"name": "twice", "expression": "2 * MONTHS_BALANCE"}},
            {"type": "aggregation", "details": {"group_by": ["STATUS"], "columns": ["MONTHS_BALANCE"],
                                                "functions": ["max"], "prefix": "s_"}},
        ],
    }
    out = run_spec(spec, loan_source(spark))
    assert out.count() == 3
    assert {"STATUS_0", "STATUS_X", "MONTHS_BALANCE_scaled", "MONTHS_BALANCE_squared",
            "MONTHS_BALANCE_SK_ID_BUREAU_ratio", "twice", "s_MONTHS_BALANCE_max"} <= set(out.columns)


# ---- sources ----


def test_csv_folder(spark, tmp_path):
    (tmp_path / "Loans.csv").write_text("id,amount,day\n1,2.5,2024-01-01\n2,3,2024-01-02\n")
    (tmp_path / "SKIP.CSV").write_text("a\n1\n")
    (tmp_path / "dict.csv").write_text("Table,Row\n")
    (tmp_path / "bad.csv").mkdir()
    found = discover_csv_tables(spark, str(tmp_path), str(tmp_path / "dict.csv"))
    assert sorted(name for name, _ in found) == ["bad", "loans"]
    types = {(r.table_name, r.column_name): r.data_type for r in infer_columns(spark, found).collect()}
    assert types == {
        ("loans", "id"): "IntegerType()", ("loans", "amount"): "DoubleType()",
        ("loans", "day"): "DateType()",
    }
    source = TableSource(spark, str(tmp_path), schemas={"Loans": "id int, amount double, day string"})
    assert source.table("Loans").schema["day"].dataType.simpleString() == "string"
    assert len(list_folder(spark, str(tmp_path))) == 4


def test_dropping_malformed_rows_does_not_depend_on_the_columns_read(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("a,b\n1,2\n3,4,5\n6,7\n")
    df = read_csv_table(spark, str(path), drop_malformed=True)
    assert df.count() == 2 == len(df.collect()) == df.select("a").count()


def test_dictionary_file(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_bytes('" Table ",Row , Description\nx.csv,A,"café, ""q"""\ny.csv,NA,\n'.encode("latin-1"))
    rows = [tuple(r) for r in read_dictionary(spark, str(path)).collect()]
    assert rows == [("x.csv", "A", 'café, "q"'), ("y.csv", None, None)]
    assert read_dictionary(spark, str(tmp_path / "none.csv")).count() == 0


def test_listing_preview_and_stage(spark):
    df = spark.range(20).withColumn("s", F.lit("x"))
    assert [r.column_name for r in columns_of(df, "t").orderBy("position").collect()] == ["id", "s"]
    assert [r.id for r in preview(df, "id").collect()] == [0, 1, 2, 3, 4]
    assert stage(df, "t").count() == 20


def test_join_queries_have_rows_of_one_side_alone(spark):
    """Counted on whole tables: left and outer joins keep rows of the left side, right and outer of the right."""
    from loomwright.queries.relational import join_sides

    def only(how, kind):
        left, right, key, _ = join_sides(spark, "/root/testdata/sf0.01", how)
        sides = (left, right) if kind == "left" else (right, left)
        return sides[0].join(sides[1].select(key), key, "left_anti").count()

    assert only("inner", "left") > 10_000 and only("left", "left") == only("inner", "left")
    assert only("right", "right") > 100 and only("outer", "right") > 100 and only("outer", "left") > 100


def test_sparse_one_hot(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_FLAGS", 1000)
    df = spark.createDataFrame([(i, None if i % 50 == 0 else f"v{(i * 7) % 3000:05d}") for i in range(5000)], "rank int, v string")
    out = features.one_hot_sparse(df, "v").collect()
    values = sorted({r.v for r in out if r.v is not None})
    assert len(out) == 5000 and len(values) > features.MAX_FLAGS
    for r in out:
        at = [] if r.v is None else [values.index(r.v)]
        assert (r.v_vector.size, r.v_vector.indices, r.v_vector["values"]) == (len(values), at, [1.0] * len(at))
    with pytest.raises(ValueError, match="sparse"):
        features.one_hot(df, "v")
    assert features.one_hot_sparse(df.limit(0), "v").count() == 0


def jobs_of(spark, run):
    """How many Spark jobs ``run`` starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{id(run)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_inference_is_one_pass_over_all_files(spark, tmp_path):
    from loomwright.sources.tables import profile_tables

    cells = {
        "i": ["1", "-2", ""], "l": ["1", "3000000000", ""], "w": ["1", "123456789012345678901", ""], "d": ["1", "2.5e3", "NaN"],
        "day": ["2020-01-02", "1999-12-31", ""], "at": ["2020-01-02", "2020-01-02T03:04:05.678", ""], "b": ["true", "FALSE", ""],
        "s": ["1", "x", ""], "none": ["", "", ""], "big": ["1" * 39, "2", ""], "mixed": ["1", "2020-01-02", "true"], "ü x": ["a,b", 'q "z"', ""],
    }
    import csv as writer

    def write(path, names):
        with open(path, "w", newline="", encoding="utf-8") as file:
            out = writer.writer(file)
            out.writerow(names)
            out.writerows([[cells[c][k] for c in names] for k in range(3)])

    for k, name in enumerate(("one", "Two")):
        write(tmp_path / f"{name}.csv", list(cells)[k:])
    (tmp_path / "parts 1.csv").mkdir()
    for k in range(3):
        write(tmp_path / "parts 1.csv" / f"part-{k}.csv", ["i", "s", "none"])
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bare.csv").write_text("a,,a\n")
    found = discover_csv_tables(spark, str(tmp_path))
    profile = profile_tables(spark, found).collect()
    got = {(r.table_name, r.column_name): r.data_type for r in profile}
    kinds = {"i": "IntegerType()", "l": "LongType()", "w": "DecimalType(21,0)", "d": "DoubleType()", "day": "DateType()",
             "at": "TimestampType()", "b": "BooleanType()", "s": "StringType()", "none": "StringType()",
             "big": "DoubleType()", "mixed": "StringType()", "ü x": "StringType()"}
    for name, path in found:
        if name in ("one", "two"):
            for c in list(cells)[name == "two":]:
                assert got[name, c] == kinds[c], c
            native = read_csv_table(spark, path, None, True).schema
            same = {f.name: str(f.dataType) for f in native.fields}
            assert {c: t for (n, c), t in got.items() if n == name} == same
    assert {n: r for n, r in ((r.table_name, r.n_rows) for r in profile)} == {"one": 3, "two": 3, "parts 1": 9, "bare": 0}
    assert [r.column_name for r in profile if r.table_name == "bare"] == ["a0", "_c1", "a2"]
    few = jobs_of(spark, lambda: profile_tables(spark, found[:1]).collect())
    assert jobs_of(spark, lambda: profile_tables(spark, found).collect()) <= few


def test_quarantine_keeps_each_row_once(spark, tmp_path):
    from loomwright.sources.tables import read_with_quarantine

    (tmp_path / "a.csv").write_text('k,v,_own\n1,2.5,x\n2,no,y\n3,1\n4,1,z,more\n,,\n"5",6,"q,r"\n')
    rows, bad = read_with_quarantine(spark, str(tmp_path / "a.csv"), "k int, v double, _own string")
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted([(1, 2.5, "x"), (5, 6.0, "q,r"), (None, None, None)], key=repr)
    assert sorted(tuple(r) for r in bad.collect()) == [("2,no,y", "a.csv"), ("3,1", "a.csv"), ("4,1,z,more", "a.csv")]


def test_columns_of_any_name_survive(spark):
    df = spark.createDataFrame([(1, 2, 3, "a"), (1, 1, 4, "b")], "k int, o int, _own int, _rn string")
    assert [tuple(r) for r in cleaning.deduplicate(df, ["k"], ["o"]).collect()] == [(1, 1, 4, "b")]
    right = spark.createDataFrame([(1, 9), (2, 8)], "k int, _in_left int")
    got = join_tables(df, right, ["k"], "outer", "r").collect()
    assert len(got) == 3 and {r["_in_left"] for r in got} == {9, 8}


def test_specs_share_what_they_make_alike(spark, monkeypatch):
    from loomwright.plans import runner

    written = []
    monkeypatch.setattr(runner, "stage", lambda df, name: written.append(name) or df)
    frames = {
        "a": spark.createDataFrame([(1, 5.0), (2, None)], "k int, w double"),
        "b": spark.createDataFrame([(3, 7.0)], "k int, w double"),
        "child": spark.createDataFrame([(1, 1.0), (1, 3.0), (3, 4.0)], "k int, v double"),
    }
    source = TableSource(spark, frames=frames)

    def spec(table, functions=("mean",), how="left", **more):
        return {
            "initial_tables": [table],
            "join_operations": [{"left_table": table, "right_table": "child", "join_type": how, "on_columns": ["k"]}],
            "feature_engineering_steps": [{"type": "aggregation", "details": {
                "table": "child", "group_by": ["k"], "columns": ["v"], "functions": list(functions), "prefix": ""}}],
            **more,
        }

    def results(specs):
        written.clear()
        together = run_specs(specs, source)
        count = written.count("shared")
        for name, one in specs.items():
            assert sorted(map(repr, together[name].collect())) == sorted(map(repr, run_spec(one, source).collect()))
        return count

    filled = [{"type": "imputation", "details": {"strategy": "mean", "columns": ["w"]}}]
    assert results({"one": spec("a")}) == 0
    assert results({"a": spec("a"), "b": spec("b")}) == 1  # the roll-up of the child
    assert results({"a": spec("a"), "b": spec("b", functions=("max",))}) == 0  # tables are read, not written
    # Equal joins: the join is written, and not the roll-up that only it reads.
    assert results({"a": spec("a"), "again": spec("a", data_cleaning_steps=filled)}) == 1
    assert results({"a": spec("a"), "again": spec("a"), "b": spec("b", how="inner")}) == 2
    with pytest.raises(StepError, match="bad: join 1"):
        run_specs({"a": spec("a"), "bad": spec("b", how="sideways")}, source)


def test_segment_specs_scan_lines_once(spark, monkeypatch):
    from pathlib import Path

    from loomwright.plans import runner
    from loomwright.queries.relational import segment_source, segment_specs

    sf_dir = "/root/testdata/sf0.001"
    if not Path(sf_dir).exists():
        pytest.skip("no test tables here")
    scans, kept = [], runner.stage

    def counted(df, name):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey"))
        return kept(df, name)

    monkeypatch.setattr(runner, "stage", counted)
    parts = run_specs(segment_specs(), segment_source(spark, sf_dir))
    rest = [df._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey") for df in parts.values()]
    assert len(parts) == 5 and sum(n > 0 for n in scans) == 1 and not any(rest)


def test_rows_of_a_table_are_not_sent_to_one_task_for_inference(spark, tmp_path):
    from loomwright.sources.tables import profile_tables

    (tmp_path / "a.csv").write_text("x,y\n+12,true\n-3,\nx,y\n12345678901234567890,FALSE\n")
    (tmp_path / "b.csv").write_text("z\n2020-01-02\n")
    profile = profile_tables(spark, discover_csv_tables(spark, str(tmp_path)))
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    by_file = [line for line in plan.splitlines() if "Join Inner" in line and "entry" in line]
    assert len(by_file) == 1 and "strategy=broadcast" in by_file[0]
    got = {(r.table_name, r.column_name): (r.data_type, r.n_rows) for r in profile.collect()}
    assert got == {("a", "x"): ("DecimalType(20,0)", 3), ("a", "y"): ("BooleanType()", 3), ("b", "z"): ("DateType()", 1)}
