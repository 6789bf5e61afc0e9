"""Scans, joins, roll-ups, cleaning, features, runs and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwright.operators import aggregates, cleaning, features
from loomwright.operators.joins import JOIN_TYPES, join_tables
from loomwright.plans.runner import run_and_save, run_spec, run_specs
from loomwright.queries.base import query, stable, stable_sql, table
from loomwright.sources.sinks import save, verify_written
from loomwright.sources.tables import TableSource, preview, read_csv_table, read_with_quarantine
from loomwright.storage import scratch_path

# ---- the flagship: a two-level roll-up to the customer, run from a spec ----

FLAGSHIP = {
    "pipeline_name": "customer value",
    "main_goal": "describe customers by their orders, lines and events",
    "initial_tables": ["customer", "orders", "lineitem", "events"],
    "join_operations": [
        {"left_table": "orders", "right_table": "lineitem", "join_type": "left",
         "on_columns": ["orderkey"]},
        {"left_table": "customer", "right_table": "orders", "join_type": "left",
         "on_columns": ["custkey"]},
        {"left_table": "customer", "right_table": "events", "join_type": "left",
         "on_columns": ["custkey"]},
    ],
    "feature_engineering_steps": [
        {"type": "aggregation",
         "details": {"table": "lineitem", "group_by": ["orderkey"],
                     "columns": ["quantity", "extendedprice"],
                     "functions": ["mean", "sum", "count", "min", "max"],
                     "status": {"returnflag": ["A", "N", "R"]}, "prefix": "line_"}},
        {"type": "aggregation",
         "details": {"table": "orders", "group_by": ["custkey"],
                     "columns": ["totalprice", "line_quantity_sum", "line_extendedprice_mean",
                                 "line_returnflag_R_count"],
                     "functions": ["mean", "max", "count"], "prefix": ""}},
        {"type": "aggregation",
         "details": {"table": "events", "group_by": ["custkey"], "columns": ["event"],
                     "functions": ["mean", "max", "count"], "prefix": ""}},
    ],
    "data_cleaning_steps": [
        {"type": "imputation",
         "details": {"strategy": "median",
                     "columns": ["totalprice_mean", "totalprice_max", "line_quantity_sum_mean",
                                 "line_extendedprice_mean_mean", "event_mean", "event_max"]}},
    ],
    "scoring_model": {
        "name": "value model", "objective": "regression", "target_column": "acctbal",
        "features": ["custkey", "totalprice_mean", "totalprice_max", "totalprice_count",
                     "line_quantity_sum_mean", "line_extendedprice_mean_mean",
                     "line_returnflag_R_count_max", "event_mean", "event_max"],
    },
    "output_format": "dataframe",
}


def flagship_source(spark: SparkSession, sf_dir: str) -> TableSource:
    customer = table(spark, sf_dir, "customer").selectExpr("c_custkey custkey", "c_acctbal acctbal")
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey orderkey", "o_custkey custkey", "o_totalprice totalprice")
    # Most customers have no events: their means and maxima are imputed.
    events = table(spark, sf_dir, "events").selectExpr("user_id custkey", "value event")
    lineitem = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey orderkey", "l_quantity quantity", "l_extendedprice extendedprice",
        "l_returnflag returnflag",
    )
    return TableSource(
        spark, frames={"customer": customer, "orders": orders, "lineitem": lineitem, "events": events}
    )


_FLAGSHIP_ROUNDED = (
    "totalprice_mean", "totalprice_max", "line_quantity_sum_mean", "line_extendedprice_mean_mean",
    "event_mean", "event_max",
)


@query(
    "flagship_rollup",
    f"""
    WITH lines AS (
      SELECT l_orderkey AS orderkey, sum(l_quantity) AS qsum, avg(l_extendedprice) AS pmean,
             count(*) FILTER (WHERE l_returnflag = 'R') AS r
      FROM lineitem GROUP BY 1),
    big AS (
      SELECT o_custkey AS custkey, o_totalprice AS p, qsum, pmean, r
      FROM orders LEFT JOIN lines ON o_orderkey = orderkey),
    rolled AS (
      SELECT custkey, avg(p) AS pm, max(p) AS px, count(p) AS pc, avg(qsum) AS qm,
             avg(pmean) AS em, max(r) AS rx
      FROM big GROUP BY 1),
    seen AS (SELECT user_id, avg(value) AS vm, max(value) AS vx FROM events GROUP BY 1),
    joined AS (
      SELECT c_custkey AS custkey, c_acctbal AS acctbal, pm, px, pc, qm, em, rx, vm, vx
      FROM customer LEFT JOIN rolled ON c_custkey = custkey LEFT JOIN seen ON c_custkey = user_id),
    mid AS (SELECT median(pm) AS pm, median(px) AS px, median(qm) AS qm, median(em) AS em,
                   median(vm) AS vm, median(vx) AS vx FROM joined)
    SELECT j.custkey,
           {stable_sql("coalesce(j.pm, mid.pm)")} AS totalprice_mean,
           {stable_sql("coalesce(j.px, mid.px)")} AS totalprice_max,
           pc AS totalprice_count,
           {stable_sql("coalesce(j.qm, mid.qm)")} AS line_quantity_sum_mean,
           {stable_sql("coalesce(j.em, mid.em)")} AS line_extendedprice_mean_mean,
           {stable_sql("coalesce(j.vm, mid.vm)")} AS event_mean, {stable_sql("coalesce(j.vx, mid.vx)")} AS event_max,
           rx AS line_returnflag_R_count_max, acctbal
    FROM joined j, mid
    """,
)
def flagship_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_spec(FLAGSHIP, flagship_source(spark, sf_dir))
    return out.withColumns({c: stable(c) for c in _FLAGSHIP_ROUNDED})


# The market segments of the customers.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def segment_specs() -> dict[str, dict]:
    """The flagship spec for the customers of each segment, with its own medians."""

    def of(segment: str) -> dict:
        table_name = f"customer_{segment.lower()}"
        joins = [
            {**join, "left_table": table_name if join["left_table"] == "customer" else join["left_table"]}
            for join in FLAGSHIP["join_operations"]
        ]
        return {**FLAGSHIP, "initial_tables": [table_name, "orders", "lineitem", "events"], "join_operations": joins}

    return {segment: of(segment) for segment in SEGMENTS}


def segment_source(spark: SparkSession, sf_dir: str) -> TableSource:
    whole = flagship_source(spark, sf_dir)
    frames = {name: whole.table(name) for name in ("orders", "lineitem", "events")}
    for segment in SEGMENTS:
        frames[f"customer_{segment.lower()}"] = (
            table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == segment)
            .selectExpr("c_custkey custkey", "c_acctbal acctbal"))
    return TableSource(spark, frames=frames)


@query(
    "specs_by_segment",
    f"""
    WITH lines AS (
      SELECT l_orderkey AS orderkey, sum(l_quantity) AS qsum, avg(l_extendedprice) AS pmean,
             count(*) FILTER (WHERE l_returnflag = 'R') AS r
      FROM lineitem GROUP BY 1),
    rolled AS (
      SELECT o_custkey AS custkey, avg(o_totalprice) AS pm, max(o_totalprice) AS px, count(o_totalprice) AS pc,
             avg(qsum) AS qm, avg(pmean) AS em, max(r) AS rx
      FROM orders LEFT JOIN lines ON o_orderkey = orderkey GROUP BY 1),
    seen AS (SELECT user_id, avg(value) AS vm, max(value) AS vx FROM events GROUP BY 1),
    joined AS (
      SELECT c_mktsegment AS segment, c_custkey AS custkey, c_acctbal AS acctbal, pm, px, pc, qm, em, rx, vm, vx
      FROM customer LEFT JOIN rolled ON c_custkey = custkey LEFT JOIN seen ON c_custkey = user_id),
    mid AS (SELECT segment, median(pm) AS pm, median(px) AS px, median(qm) AS qm, median(em) AS em,
                   median(vm) AS vm, median(vx) AS vx FROM joined GROUP BY 1)
    SELECT j.segment, j.custkey,
           {stable_sql("coalesce(j.pm, mid.pm)")} AS totalprice_mean,
           {stable_sql("coalesce(j.px, mid.px)")} AS totalprice_max,
           pc AS totalprice_count,
           {stable_sql("coalesce(j.qm, mid.qm)")} AS line_quantity_sum_mean,
           {stable_sql("coalesce(j.em, mid.em)")} AS line_extendedprice_mean_mean,
           {stable_sql("coalesce(j.vm, mid.vm)")} AS event_mean, {stable_sql("coalesce(j.vx, mid.vx)")} AS event_max,
           rx AS line_returnflag_R_count_max, acctbal
    FROM joined j JOIN mid ON j.segment = mid.segment
    """,
)
def specs_by_segment(spark, sf_dir):
    """One spec a segment: all of them read one roll-up of orders and lines, and one of events."""
    parts = run_specs(segment_specs(), segment_source(spark, sf_dir))
    first, *others = [df.withColumn("segment", F.lit(segment)) for segment, df in parts.items()]
    for df in others:
        first = first.unionByName(df)
    return first.withColumns({c: stable(c) for c in _FLAGSHIP_ROUNDED})


# ---- scans ----


@query("scan_preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def scan_preview(spark, sf_dir):
    return preview(table(spark, sf_dir, "customer"), "c_custkey")


# Every 97th order has a cell too many, every 89th a price that is none.
_LINE = """o_orderkey || ',' || o_custkey || ',' || CASE WHEN o_orderkey % 89 = 3 THEN 'price' ELSE CAST(o_custkey % 1000 AS STRING) END
      || CASE WHEN o_orderkey % 97 = 5 THEN ',more' ELSE '' END"""
_BROKEN = "(o_orderkey % 89 = 3 OR o_orderkey % 97 = 5)"


@query(
    "scan_quarantine",
    f"""
    SELECT {_LINE} AS line, (SELECT count(*) FROM orders WHERE NOT {_BROKEN}) AS n_good,
           (SELECT CAST(sum(o_custkey % 1000) AS BIGINT) FROM orders WHERE NOT {_BROKEN}) AS price_sum
    FROM orders WHERE {_BROKEN}
    """,
)
def scan_quarantine(spark, sf_dir):
    """Orders as lines of text, some of them broken: what fits is read, the rest is set aside."""
    path = scratch_path(spark, "lines")
    table(spark, sf_dir, "orders").selectExpr(f"{_LINE} value").write.text(path)
    rows, quarantined = read_with_quarantine(spark, path, "orderkey long, custkey long, price int", header=False)
    kept = rows.agg(F.struct(F.count("*").alias("n"), F.sum("price").alias("sum")).alias("s")).scalar()
    return quarantined.select("line", kept["n"].alias("n_good"), kept["sum"].alias("price_sum"))


# ---- joins ----

_JOIN_WORDS = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}


# All orders have a customer, but few customers have events: rows of the left side alone. Each
# customer with events has orders, so joins that keep the right side take labels and vectors,
# of which either side has ids that the other lacks (counted at sf0.01 and 0.1).
def join_sides(spark, sf_dir, how: str):
    """(left, right, key, name of the right) of the join of each type."""
    if how in ("inner", "left"):
        orders = table(spark, sf_dir, "orders").selectExpr(
            "o_custkey user_id", "o_orderkey", "o_totalprice value")
        users = table(spark, sf_dir, "events").groupBy("user_id").agg(
            F.count("*").alias("n_events"), F.max("value").alias("value"))
        return orders, users, "user_id", "events"
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality label", "toxic")
    vectors = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id doc_id", "label", "size(embedding) dimension")
    return labels, vectors, "doc_id", "embeddings"


def _register_join(how: str) -> None:
    if how in ("inner", "left"):
        sql = f"""
        SELECT o_custkey AS user_id, o.o_orderkey, o.o_totalprice AS value, u.n_events, u.value AS value_events
        FROM orders o
        {_JOIN_WORDS[how]} (SELECT user_id, count(*) AS n_events, max(value) AS value
                            FROM events GROUP BY 1) u ON o_custkey = u.user_id
        """
    else:
        sql = f"""
        SELECT coalesce(doc_id, vec_id) AS doc_id, quality AS label, toxic, label AS label_embeddings,
               len(embedding) AS dimension
        FROM labels {_JOIN_WORDS[how]} embeddings ON doc_id = vec_id
        """

    @query(f"join_{how}", sql)
    def build(spark, sf_dir):
        left, right, key, name = join_sides(spark, sf_dir, how)
        return join_tables(left, right, [key], how, name)


for _how in JOIN_TYPES:
    _register_join(_how)

CHAIN = {
    "pipeline_name": "places",
    "main_goal": "customers with nation and region",
    "initial_tables": ["customer", "nation", "region"],
    "join_operations": [
        {"left_table": "customer", "right_table": "nation", "on_columns": ["nationkey"]},
        {"left_table": "customer", "right_table": "region", "join_type": "inner",
         "on_columns": ["regionkey"]},
    ],
}


@query(
    "join_chain",
    """
    SELECT n_regionkey AS regionkey, c_nationkey AS nationkey, c_custkey AS custkey, c_name AS name,
           n_name AS name_nation, r_name AS name_region
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    """,
)
def join_chain(spark, sf_dir):
    frames = {
        "customer": table(spark, sf_dir, "customer").selectExpr(
            "c_custkey custkey", "c_nationkey nationkey", "c_name name"
        ),
        "nation": table(spark, sf_dir, "nation").selectExpr(
            "n_nationkey nationkey", "n_regionkey regionkey", "n_name name"
        ),
        "region": table(spark, sf_dir, "region").selectExpr("r_regionkey regionkey", "r_name name"),
    }
    return run_spec(CHAIN, TableSource(spark, frames=frames))


LABELLED = {
    "pipeline_name": "labelled documents",
    "main_goal": "documents with their quality",
    "join_operations": [
        {"left_table": "documents", "right_table": "labels", "join_type": "left", "on_columns": "doc_id"}
    ],
    "data_cleaning_steps": [
        {"type": "imputation", "details": {"strategy": "median", "columns": "quality"}},
        {"type": "conversion", "details": {"types": {"toxic": "double"}}},
    ],
    "scoring_model": {"name": "m", "target_column": "quality", "features": ["doc_id", "n_chars", "toxic"]},
}


@query(
    "run_base_path",
    """
    SELECT d.doc_id, n_chars, CAST(toxic AS DOUBLE) AS toxic,
           CAST(coalesce(quality, (SELECT median(quality) FROM documents LEFT JOIN labels USING (doc_id))) AS DOUBLE) AS quality
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def run_base_path(spark, sf_dir):
    return run_spec(LABELLED, TableSource(spark, sf_dir, fmt="parquet")).withColumn(
        "quality", F.col("quality").cast("double")
    )


# ---- roll-ups ----


@query(
    "agg_numeric_by_key",
    f"""
    SELECT l_orderkey,
      {", ".join(
        f"{stable_sql(f'avg({c})')} AS {c}_mean, {stable_sql(f'sum({c})')} AS {c}_sum, "
        f"count({c}) AS {c}_count, min({c}) AS {c}_min, max({c}) AS {c}_max"
        for c in ("l_quantity", "l_extendedprice", "l_discount"))}
    FROM lineitem GROUP BY 1
    """,
)
def agg_numeric_by_key(spark, sf_dir):
    columns = ("l_quantity", "l_extendedprice", "l_discount")
    out = aggregates.roll_up(table(spark, sf_dir, "lineitem"), ["l_orderkey"], columns)
    return out.withColumns({f"{c}_{f}": stable(f"{c}_{f}") for c in columns for f in ("mean", "sum")})


@query(
    "agg_status_counts",
    """
    SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS l_returnflag_A_count,
           count(*) FILTER (WHERE l_returnflag = 'N') AS l_returnflag_N_count,
           count(*) FILTER (WHERE l_returnflag = 'R') AS l_returnflag_R_count,
           count(*) FILTER (WHERE l_linestatus = 'X') AS l_linestatus_X_count
    FROM lineitem GROUP BY 1
    """,
)
def agg_status_counts(spark, sf_dir):
    status = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["X"]}
    return aggregates.roll_up(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [], status=status)


@query(
    "agg_features",
    f"""
    SELECT c_custkey AS user_id, c_mktsegment, m AS ev_value_mean, s AS ev_value_sum, n AS ev_value_count,
           err AS ev_event_type_error_count, pur AS ev_event_type_purchase_count
    FROM customer LEFT JOIN (
      SELECT user_id, {stable_sql("avg(value)")} AS m, {stable_sql("sum(value)")} AS s, count(value) AS n,
             count(*) FILTER (WHERE event_type = 'error') AS err,
             count(*) FILTER (WHERE event_type = 'purchase') AS pur
      FROM events GROUP BY 1) e ON c_custkey = e.user_id
    """,
)
def agg_features(spark, sf_dir):
    spec = {
        "initial_tables": ["customer", "events"],
        "feature_engineering_steps": [
            {"type": "aggregation",
             "details": {"table": "events", "group_by": ["user_id"], "columns": ["value"],
                         "functions": ["mean", "sum", "count"],
                         "status": {"event_type": ["error", "purchase"]}, "prefix": "ev_"}}
        ],
    }
    frames = {
        "customer": table(spark, sf_dir, "customer").selectExpr("c_custkey user_id", "c_mktsegment"),
        "events": table(spark, sf_dir, "events"),
    }
    out = run_spec(spec, TableSource(spark, frames=frames))
    return out.withColumns({c: stable(c) for c in ("ev_value_mean", "ev_value_sum")})


# ---- cleaning ----


def _with_event_features(spark, sf_dir):
    """Customers with the total and the top type of their events; most have none."""
    events = table(spark, sf_dir, "events")
    total = events.groupBy("user_id").agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    )
    top = (
        events.groupBy("user_id", "event_type")
        .agg(F.count("*").alias("n"))
        .groupBy("user_id")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("best"))
        .selectExpr("user_id", "best.event_type top_type")
    )
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey user_id")
    return customers.join(total, "user_id", "left").join(top, "user_id", "left")


_EVENT_FEATURES = """
    total AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
              FROM events GROUP BY 1),
    per_type AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    top AS (SELECT user_id, event_type AS top_type FROM (
              SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn
              FROM per_type) WHERE rn = 1),
    base AS (SELECT c_custkey AS user_id, total, top_type FROM customer
             LEFT JOIN total ON c_custkey = total.user_id LEFT JOIN top ON c_custkey = top.user_id)
"""
_TOP_TYPE = """(SELECT top_type FROM base WHERE top_type IS NOT NULL
                GROUP BY 1 ORDER BY count(*) DESC, top_type LIMIT 1)"""


def _impute_sql(total: str, top: str) -> str:
    return f"WITH {_EVENT_FEATURES} SELECT user_id, {total} AS total, {top} AS top_type FROM base"


_MEAN = stable_sql("coalesce(total, (SELECT avg(total) FROM base))")
_MEDIAN = stable_sql("coalesce(total, (SELECT median(total) FROM base))")
_MODE = f"coalesce(top_type, {_TOP_TYPE})"


@query("impute_mean", _impute_sql(_MEAN, "top_type"))
def impute_mean(spark, sf_dir):
    out = cleaning.impute(_with_event_features(spark, sf_dir), "mean", ["total"])
    return out.withColumn("total", stable("total"))


@query("impute_median", _impute_sql(_MEDIAN, "top_type"))
def impute_median(spark, sf_dir):
    out = cleaning.impute(_with_event_features(spark, sf_dir), "median", ["total"])
    return out.withColumn("total", stable("total"))


@query("impute_mode", _impute_sql("total", _MODE))
def impute_mode(spark, sf_dir):
    return cleaning.impute(_with_event_features(spark, sf_dir), "mode", ["top_type"])


@query("impute_all", _impute_sql(_MEAN, _MODE))
def impute_all(spark, sf_dir):
    out = cleaning.impute(_with_event_features(spark, sf_dir))
    return out.withColumn("total", stable("total"))


@query(
    "outlier_filter",
    """
    SELECT event_id, user_id, value FROM events,
      (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
    WHERE abs(value - m) / s <= 3.0
    """,
)
def outlier_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return cleaning.drop_outliers(events, ["value"])


@query(
    "outlier_cap",
    f"""
    SELECT event_id, user_id, {stable_sql("least(greatest(value, m - 3 * s), m + 3 * s)")} AS value
    FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
    """,
)
def outlier_cap(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return cleaning.cap_outliers(events, ["value"]).withColumn("value", stable("value"))


@query(
    "dedup",
    """
    SELECT doc_id, text, source FROM (
      SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
    WHERE rn = 1
    """,
)
def dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return cleaning.deduplicate(docs, ["text"], ["doc_id"])


@query(
    "convert_types",
    """
    SELECT doc_id, TRY_CAST(replace(source, 'src', '') AS INTEGER) AS source_number,
           TRY_CAST(lang AS DOUBLE) AS lang_number, CAST(n_chars AS VARCHAR) AS n_chars
    FROM documents
    """,
)
def convert_types(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "replace(source, 'src', '') source_number", "lang lang_number", "n_chars"
    )
    return cleaning.convert_types(
        docs, {"source_number": "int", "lang_number": "double", "n_chars": "string"}
    )


# Cells of every shape a cleaning step meets, made from each line's flags and dates.
_CELL = """CASE l_returnflag || l_linestatus
      WHEN 'AF' THEN '  ' || l_returnflag || ' ' || l_linestatus || '  '
      WHEN 'AO' THEN chr(9) || l_returnflag || chr(10)
      WHEN 'NF' THEN '   '
      WHEN 'NO' THEN ''
      WHEN 'RF' THEN NULL
      ELSE l_returnflag END"""


@query(
    "clean_strings",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey,
           nullif(regexp_replace({_CELL}, '^\\s+|\\s+$', '', 'g'), '') AS cell
    FROM lineitem
    """,
)
def clean_strings(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", f"{_CELL} cell"
    )
    return cleaning.clean_strings(cells)


# ---- features ----

_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "one_hot",
    "SELECT c_custkey, c_mktsegment, "
    + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS c_mktsegment_{s}" for s in _SEGMENTS)
    + " FROM customer",
)
def one_hot(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return features.one_hot(customers, "c_mktsegment")


@query(
    "one_hot_sparse",
    """
    SELECT o_orderkey, count(DISTINCT o_custkey) OVER () AS size,
           dense_rank() OVER (ORDER BY o_custkey) - 1 AS at, CAST(1 AS DOUBLE) AS value, CAST(1 AS BIGINT) AS n_set
    FROM orders
    """,
)
def one_hot_sparse(spark, sf_dir):
    """Each order's customer as a sparse vector over all customers with orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    made = features.one_hot_sparse(orders, "o_custkey")
    vector = F.col("o_custkey_vector")
    return made.select(
        "o_orderkey", vector["size"].alias("size"), F.get(vector["indices"], F.lit(0)).alias("at"),
        F.get(vector["values"], F.lit(0)).alias("value"), F.size(vector["indices"]).cast("long").alias("n_set"))


_CLASHING = """p_type || CASE p_size % 3 WHEN 0 THEN ' x' WHEN 1 THEN '-x' ELSE '_x' END"""
_PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "one_hot_clashing_names",
    "SELECT p_partkey, v, "
    + ", ".join(
        f"CAST(v = '{t}{end}' AS INTEGER) AS v_{t}_x{suffix}"
        for t in _PART_TYPES
        for end, suffix in ((" x", ""), ("-x", "_2"), ("_x", "_3"))
    )
    + f" FROM (SELECT p_partkey, {_CLASHING} AS v FROM part)",
)
def one_hot_clashing_names(spark, sf_dir):
    values = [t + end for t in _PART_TYPES for end in (" x", "-x", "_x")]
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_CLASHING} v")
    return features.one_hot(parts, "v", values)


@query(
    "scale_standard",
    f"""
    SELECT c_custkey, c_acctbal, {stable_sql("(c_acctbal - m) / s", 6)} AS c_acctbal_scaled
    FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)
    """,
)
def scale_standard(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    out = features.scale(customers, ["c_acctbal"])
    return out.withColumn("c_acctbal_scaled", stable("c_acctbal_scaled", 6))


@query(
    "scale_minmax",
    """
    SELECT event_id, value, (value - lo) / (hi - lo) AS value_scaled
    FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)
    """,
)
def scale_minmax(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return features.scale(events, ["value"], "minmax")


@query(
    "polynomial",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount,
           l_quantity * l_quantity AS l_quantity_squared, l_discount * l_discount AS l_discount_squared,
           l_quantity * l_discount AS l_quantity_x_l_discount
    FROM lineitem
    """,
)
def polynomial(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount"
    )
    return features.polynomial(lines, ["l_quantity", "l_discount"])


@query(
    "date_features",
    """
    SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month,
           CAST(day(ts) AS INTEGER) AS ts_day, CAST(isodow(ts) - 1 AS INTEGER) AS ts_weekday,
           CAST(hour(ts) AS INTEGER) AS ts_hour, CAST(quarter(ts) AS INTEGER) AS ts_quarter
    FROM events
    """,
)
def date_features(spark, sf_dir):
    return features.date_parts(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts"]).drop("ts")


@query(
    "ratio",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount,
           CASE WHEN l_discount <> 0 THEN l_extendedprice / l_discount END AS price_per_discount
    FROM lineitem
    """,
)
def ratio(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount"
    )
    return features.ratio(lines, "l_extendedprice", "l_discount", "price_per_discount")


@query(
    "expression",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount,
           l_extendedprice * (1 - l_discount) AS net
    FROM lineitem
    """,
)
def expression(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount"
    )
    return features.expression(lines, "net", "l_extendedprice * (1 - l_discount)")


@query(
    "select_features",
    "SELECT n_chars, lang, quality FROM documents LEFT JOIN labels USING (doc_id)",
)
def select_features(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    joined = join_tables(docs, labels, ["doc_id"], "left", "labels")
    return features.select_features(joined, ["n_chars", "lang", "n_chars"], "quality")


# ---- sinks ----


@query(
    "sink_parquet_roundtrip",
    "SELECT o_orderkey AS orderkey, o_totalprice AS totalprice, o_orderdate AS orderdate FROM orders",
)
def sink_parquet_roundtrip(spark, sf_dir):
    spec = {
        "initial_tables": ["orders"],
        "output_format": "parquet",
        "output_location": scratch_path(spark, "orders-parquet"),
    }
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey orderkey", "o_totalprice totalprice", "o_orderdate orderdate"
    )
    result = run_and_save(spark, spec, TableSource(spark, frames={"orders": orders}))
    return spark.read.parquet(result.location)


@query(
    "sink_csv_roundtrip",
    """
    SELECT CAST(o_orderkey AS INTEGER) AS orderkey, o_totalprice AS totalprice,
           o_orderstatus AS status, o_orderpriority AS priority
    FROM orders
    """,
)
def sink_csv_roundtrip(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey orderkey", "o_totalprice totalprice", "o_orderstatus status",
        "o_orderpriority priority",
    )
    location = save(orders, scratch_path(spark, "orders-csv"), "csv")
    verify_written(spark, location, "csv")
    return read_csv_table(spark, location)
