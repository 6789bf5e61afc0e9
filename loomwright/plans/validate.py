"""Checks of many specs against the column catalog.

All references of a spec are listed in one pass, looked up in the catalog by one
equi-join, and judged by spec. The catalog is metadata: Spark broadcasts it when its
measured size allows, and otherwise splits hot table names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomwright.storage import stage

# Names of the findings.
MISSING_TABLE = "missing_table"
MISSING_KEY = "missing_join_key"
MISSING_TARGET = "missing_target"
UNFLAGGED_TARGET = "target_not_flagged"
TYPE_CLASH = "incompatible_key_types"
MISSING_COLUMN = "missing_column"

_TABLE_ITSELF = ""


def type_family(data_type: Column) -> Column:
    """Types that compare with each other share a family."""
    name = F.lower(F.regexp_extract(data_type, r"\A[A-Za-z]+", 0))
    return (
        F.when(name.rlike("^(byte|short|int|integer|long|bigint|float|double|decimal)"), "number")
        .when(name.rlike("^(date|timestamp)"), "time")
        .when(name.rlike("^bool"), "boolean")
        .otherwise("text")
    )


def _references(specs: DataFrame) -> DataFrame:
    """(spec_id, rule, pos, side, table_name, column_name), one row per lookup."""
    joins = F.col("spec.join_operations")
    tables = F.array_distinct(
        F.concat(
            "spec.initial_tables",
            F.flatten(F.transform(joins, lambda j: F.array(j["left_table"], j["right_table"]))),
        )
    )

    def ref(rule: str, pos: Column, side: str, table: Column, column: Column) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"),
            pos.cast("int").alias("pos"),
            F.lit(side).alias("side"),
            table.alias("table_name"),
            column.alias("column_name"),
        )

    none = F.lit(-1)
    of_tables = F.transform(
        tables, lambda t: ref(MISSING_TABLE, none, "", t, F.lit(_TABLE_ITSELF))
    )
    of_keys = F.flatten(
        F.transform(
            joins,
            lambda j, i: F.flatten(
                F.transform(
                    j["on_columns"],
                    lambda c: F.array(
                        ref(MISSING_KEY, i, "left", j["left_table"], c),
                        ref(MISSING_KEY, i, "right", j["right_table"], c),
                    ),
                )
            ),
        )
    )
    target = F.col("spec.scoring_model.target_column")
    of_target = F.when(
        target.isNotNull(),
        F.transform("spec.initial_tables", lambda t: ref(MISSING_TARGET, none, "", t, target)),
    )
    details = F.concat(
        F.transform("spec.data_cleaning_steps", lambda s: s["details"]),
        F.transform("spec.feature_engineering_steps", lambda s: s["details"]),
    )
    step_columns = F.array_distinct(F.flatten(F.transform(details, columns_read)))
    of_steps = F.flatten(
        F.transform(
            step_columns,
            lambda c: F.transform(tables, lambda t: ref(MISSING_COLUMN, none, "", t, c)),
        )
    )
    no_refs = F.array().cast(
        "array<struct<rule:string,pos:int,side:string,table_name:string,column_name:string>>"
    )
    every = F.concat(of_tables, of_keys, F.coalesce(of_target, no_refs), of_steps)
    return specs.select("spec_id", F.explode(every).alias("r")).select("spec_id", "r.*")


def columns_read(details: Column) -> Column:
    """All columns that a step reads by its details: lists of names or one name as text, and
    the columns that type, value and status lists are given for."""
    def named(key: str) -> Column:
        one = F.try_variant_get(details, f"$.{key}", "string")
        return F.coalesce(
            F.try_variant_get(details, f"$.{key}", "array<string>"),
            F.when(one.isNotNull(), F.array(one)),
            F.array().cast("array<string>"),
        )

    def given(key: str) -> Column:
        members = F.try_variant_get(details, f"$.{key}", "map<string,variant>")
        return F.coalesce(F.map_keys(members), F.array().cast("array<string>"))

    lists = [named(k) for k in ("columns", "group_by", "order_by")]
    return F.concat(*lists, *(given(k) for k in ("types", "values", "status")))


def suggest_tables(missing: DataFrame, catalog_tables: DataFrame) -> DataFrame:
    """(table_name, suggestion) for names with an obvious alternative.

    Obvious is a catalog name that extends the missing one, else one that is a single
    edit away; on ties a table that holds a target goes first, then the alphabet
    decides. Both are equi-joins: on the prefixes of the catalog names, and on
    (position, rest) after leaving out one letter, which two names share exactly when
    one edit turns one into the other. Each join key keeps only its first name, so no
    name list is ever paired with another.

    ``catalog_tables`` has (table_name, has_target).
    """
    names = catalog_tables.groupBy("table_name").agg(F.bool_or("has_target").alias("has_target"))
    missing = missing.select("table_name").distinct()
    preference = F.struct((~F.col("has_target")).alias("later"), F.col("table_name").alias("name"))

    cut = F.transform(
        F.sequence(F.lit(1), F.length("table_name")),
        lambda i: F.struct(
            i.alias("at"),
            F.concat(
                F.substr("table_name", F.lit(1), i - 1), F.substr("table_name", i + 1)
            ).alias("rest"),
        ),
    )
    whole = F.struct(F.lit(0).alias("at"), F.col("table_name").alias("rest"))

    def keyed(df: DataFrame, *columns) -> DataFrame:
        """Substitutions meet on (position, rest); an inserted or omitted letter makes the
        rest of one name equal to the whole of the other."""
        omitted = F.transform(
            cut, lambda k: F.struct(F.lit(-1).alias("at"), k["rest"].alias("rest"))
        )
        return (
            df.where("table_name <> ''")
            .select(*columns, F.explode(F.concat(cut, omitted, F.array(whole))).alias("key"))
            .select("key.at", "key.rest", "*")
            .drop("key")
        )

    left = keyed(missing, "table_name")
    right = (
        keyed(names, preference.alias("first"))
        .groupBy("at", "rest")
        .agg(F.min("first").alias("first"))
    )
    # Omitted letters (-1) meet whole names (0) and the other way round.
    opposite = F.when(F.col("at") == 0, -1).when(F.col("at") == -1, 0).otherwise(F.col("at"))
    near = (
        left.withColumn("at", opposite)
        .join(right, ["at", "rest"])
        .groupBy("table_name")
        .agg(F.min("first").alias("near"))
    )
    prefixes = (
        names.select(
            preference.alias("first"),
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length("table_name") - 1, F.lit(1))),
                    lambda n: F.substr("table_name", F.lit(1), n),
                )
            ).alias("table_name"),
        )
        .groupBy("table_name")
        .agg(F.min("first").alias("extended"))
    )
    return (
        missing.join(prefixes, "table_name", "left")
        .join(near, "table_name", "left")
        .select("table_name", F.coalesce("extended.name", "near.name").alias("suggestion"))
    )


def _judged(looked_up: DataFrame) -> DataFrame:
    """What the lookups of a spec say together, by rule, place and column.

    Only join keys need the least name and family of a side, which Spark can find by sorting alone.
    All other rules ask whether anything was found, which a hash aggregate tells without
    a sort, and most lookups are theirs.
    """
    found = F.coalesce("known", F.lit(False))
    flagged = F.coalesce("is_target", F.lit(False))
    keys = ("spec_id", "rule", "pos", "column_name")
    asked = F.when(F.col("rule") == MISSING_TABLE, F.col("table_name")).alias("asked_table")
    whole = [F.bool_or(found).alias("any_found"), F.bool_or(flagged).alias("any_flagged")]
    sides = {
        "no_left": F.when((F.col("side") == "left") & ~found, F.col("table_name")),
        "no_right": F.when((F.col("side") == "right") & ~found, F.col("table_name")),
        "left_family": F.when(F.col("side") == "left", F.col("family")),
        "right_family": F.when(F.col("side") == "right", F.col("family")),
    }
    of_keys = looked_up.where(F.col("rule") == MISSING_KEY).groupBy(*keys, asked).agg(
        *whole, *(F.min(v).alias(name) for name, v in sides.items())
    )
    of_others = looked_up.where(F.col("rule") != MISSING_KEY).groupBy(*keys, asked).agg(
        *whole
    ).withColumns({name: F.lit(None).cast("string") for name in sides})
    return of_keys.unionByName(of_others)


def validate_specs(specs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(spec_id, rule, subject, detail) findings.

    ``specs`` has (spec_id, spec); ``catalog`` has (table_name, column_name, data_type,
    is_target).
    """
    tables = catalog.groupBy("table_name").agg(
        F.bool_or(F.coalesce("is_target", F.lit(False))).alias("has_target")
    )
    known = catalog.select(
        "table_name",
        "column_name",
        type_family(F.col("data_type")).alias("family"),
        F.coalesce("is_target", F.lit(False)).alias("is_target"),
    ).unionByName(
        tables.select(
            "table_name",
            F.lit(_TABLE_ITSELF).alias("column_name"),
            F.lit(None).cast("string").alias("family"),
            F.lit(False).alias("is_target"),
        )
    ).groupBy("table_name", "column_name").agg(
        F.min("family").alias("family"), F.bool_or("is_target").alias("is_target")
    ).withColumn("known", F.lit(True))

    # Read twice, for the suggestions and for the findings.
    looked_up = stage(
        _references(specs).join(known, ["table_name", "column_name"], "left"), "spec-references"
    )
    unknown_tables = looked_up.where((F.col("rule") == MISSING_TABLE) & F.col("known").isNull())
    suggestions = suggest_tables(unknown_tables, tables)

    judged = _judged(looked_up)
    column, key = F.col("column_name"), F.col("rule") == MISSING_KEY

    def finding(when: Column, rule: str, subject: Column, detail: Column) -> Column:
        return F.when(
            when,
            F.struct(F.lit(rule).alias("rule"), subject.alias("subject"), detail.alias("detail")),
        )

    no_text = F.lit(None).cast("string")
    is_target = F.col("rule") == MISSING_TARGET
    findings = F.array_compact(
        F.array(
            finding(
                (F.col("rule") == MISSING_TABLE) & ~F.col("any_found"),
                MISSING_TABLE, F.col("asked_table"), no_text,
            ),
            finding(
                key & F.col("no_left").isNotNull(), MISSING_KEY,
                F.concat(F.col("no_left"), F.lit("."), column), F.lit("left"),
            ),
            finding(
                key & F.col("no_right").isNotNull(), MISSING_KEY,
                F.concat(F.col("no_right"), F.lit("."), column), F.lit("right"),
            ),
            finding(
                key & (F.col("left_family") != F.col("right_family")), TYPE_CLASH,
                column, F.concat(F.col("left_family"), F.lit("/"), F.col("right_family")),
            ),
            finding(is_target & ~F.col("any_found"), MISSING_TARGET, column, no_text),
            finding(
                is_target & F.col("any_found") & ~F.col("any_flagged"),
                UNFLAGGED_TARGET, column, no_text,
            ),
            finding(
                (F.col("rule") == MISSING_COLUMN) & ~F.col("any_found"),
                MISSING_COLUMN, column, no_text,
            ),
        )
    )
    rows = judged.select("spec_id", F.explode(findings).alias("f")).select("spec_id", "f.*")
    return (
        rows.join(
            suggestions.select(
                F.lit(MISSING_TABLE).alias("rule"),
                F.col("table_name").alias("subject"),
                F.col("suggestion"),
            ),
            ["rule", "subject"],
            "left",
        )
        .select("spec_id", "rule", "subject", F.coalesce("detail", "suggestion").alias("detail"))
        .distinct()
    )


def validation_report(specs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per spec: its findings in a fixed order, and whether there are none."""
    listed = findings.groupBy("spec_id").agg(
        F.array_sort(F.collect_list(F.struct("rule", "subject", "detail"))).alias("findings")
    )
    return (
        specs.select("spec_id")
        .join(listed, "spec_id", "left")
        .select(
            "spec_id",
            F.col("findings").isNull().alias("ok"),
            F.coalesce(
                "findings",
                F.array().cast("array<struct<rule:string,subject:string,detail:string>>"),
            ).alias("findings"),
        )
    )


def apply_suggestions(specs: DataFrame, findings: DataFrame) -> DataFrame:
    """The specs with each missing table replaced by its obvious alternative, where it has one.

    A repeated table of the result stands once; other findings are left to the reader.
    """
    known = (F.col("rule") == MISSING_TABLE) & F.col("detail").isNotNull()
    fixes = findings.where(known).groupBy("spec_id").agg(
        F.map_from_entries(F.collect_set(F.struct("subject", "detail"))).alias("_fixes")
    )

    def fixed(table: Column) -> Column:
        return F.coalesce(F.col("_fixes")[table], table)

    spec = F.col("spec")
    joins = F.transform(
        spec["join_operations"],
        lambda j: j.withField("left_table", fixed(j["left_table"])).withField(
            "right_table", fixed(j["right_table"])
        ),
    )
    tables = F.array_distinct(F.transform(spec["initial_tables"], fixed))
    return (
        specs.join(fixes, "spec_id", "left")
        .withColumn("spec", spec.withField("initial_tables", tables).withField("join_operations", joins))
        .drop("_fixes")
    )
