"""Catalog queries: inference over exported tables, and bulk catalogs made from ``part``."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, functions as F

from loomwright.functions.names import normalize_column_name
from loomwright.operators.vectors import hashing_embedder
from loomwright.plans.catalog import (
    dictionary_entries, enrich_columns, global_columns, ingest_catalog, missing_described,
    nested_catalog,
)
from loomwright.queries.base import query, table
from loomwright.queries.retrieval import embedded_sql, lexical_sql
from loomwright.sources.index_store import DocumentIndex
from loomwright.sources.tables import (
    blank_na_tokens, discover_csv_tables, profile_tables, table_names,
)
from loomwright.storage import scratch_path, stage

# ---- schema inference over a folder of CSV tables ----

_INFERRED = {
    "region": "r_regionkey I, r_name S",
    "nation": "n_nationkey I, n_name S, n_regionkey I",
    "customer": "c_custkey I, c_name S, c_nationkey I, c_acctbal D, c_mktsegment S",
    "supplier": "s_suppkey I, s_name S, s_nationkey I, s_acctbal D",
    "part": "p_partkey I, p_name S, p_brand S, p_type S, p_size I, p_retailprice D",
    "orders": "o_orderkey I, o_custkey I, o_orderstatus S, o_totalprice D, o_orderdate T, o_orderpriority S",
    "lineitem": "l_orderkey I, l_partkey I, l_suppkey I, l_linenumber I, l_quantity D, "
    "l_extendedprice D, l_discount D, l_tax D, l_returnflag S, l_linestatus S, l_shipdate T",
    "events": "event_id I, ts T, user_id I, event_type S, value D, props S",
    "labels": "doc_id I, quality I, toxic I",
    "documents": "doc_id I, text S, lang S, source S, n_chars I",
    "pages": "page_id I, url S, html S",
    "benchmark": "item_id I, text S",
    "conversations": "conv_id I, turn I, role S, text S",
}
_TYPE_TEXT = {"I": "IntegerType()", "S": "StringType()", "D": "DoubleType()", "T": "TimestampType()"}


def _inferred_rows() -> str:
    return ", ".join(
        f"('{t}', '{c.split()[0]}', '{_TYPE_TEXT[c.split()[1]]}')"
        for t, columns in _INFERRED.items()
        for c in columns.split(", ")
    )


def _export(spark, sf_dir, names) -> str:
    """CSV tables of a folder, written side by side."""
    folder = scratch_path(spark, "tables")

    def write(name: str) -> None:
        writer = table(spark, sf_dir, name).write.option("header", True).option("escape", '"')
        writer.csv(f"{folder}/{name}.csv")

    with ThreadPoolExecutor(max_workers=8) as pool:
        list(pool.map(write, names))
    return folder


@query(
    "catalog_infer",
    f"""
    SELECT v.*, r.n_rows FROM (VALUES {_inferred_rows()}) v(table_name, column_name, data_type)
    JOIN ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _INFERRED)}) r
    USING (table_name)
    """,
)
def catalog_infer(spark, sf_dir):
    """All tables that CSV can hold: vectors are the exception."""
    found = discover_csv_tables(spark, _export(spark, sf_dir, _INFERRED))
    profile = stage(profile_tables(spark, found, multi_line=True), "profile")
    counts = profile.where("position = 0").select("table_name", "n_rows")
    nested = nested_catalog(profile.drop("n_rows"), table_names(spark, found)).join(counts, "table_name")
    return nested.select(
        "table_name", "n_rows", F.explode("columns").alias("column_name", "record")
    ).select("table_name", "column_name", "record.data_type", "n_rows")


_INGESTED = ("region", "nation", "part")
_INGESTED_COLUMNS = sum(len(_INFERRED[t].split(",")) for t in _INGESTED)
_NOTE_ROW = """CASE p_size % 3 WHEN 0 THEN 'P_NAME' WHEN 1 THEN ' p_brand'
      ELSE 'lost_' || CAST(p_partkey AS STRING) END"""


@query(
    "catalog_ingest",
    f"""
    SELECT 'LOST_' || p_partkey AS name, CAST({_INGESTED_COLUMNS} AS BIGINT) AS n_columns,
           CAST({_INGESTED_COLUMNS} AS BIGINT) AS n_documents, count(*) OVER () AS n_missing,
           (SELECT string_agg(DISTINCT d, ' | ' ORDER BY d) FROM (
              SELECT 'Größe ' || p_brand AS d FROM part WHERE p_size % 3 = 1 ORDER BY 1 LIMIT 1)) AS brand_text
    FROM part WHERE p_size % 3 = 2
    """,
)
def catalog_ingest(spark, sf_dir):
    """A folder of tables and a dictionary in its old encoding, ingested into an index."""
    folder = _export(spark, sf_dir, _INGESTED)
    dictionary = table(spark, sf_dir, "part").selectExpr(
        "'part.csv' Table", f"{_NOTE_ROW} Row", "'Größe ' || p_brand Description")
    dictionary.write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{folder}/notes.csv")
    index = DocumentIndex(spark, scratch_path(spark, "catalog-index"))
    built, report = ingest_catalog(spark, folder, f"{folder}/notes.csv", index)
    # The entry of the brand column, as it stands in the index.
    brand = index.read().where(F.try_variant_get("metadata", "$.normalized_column_name", "string") == "P_BRAND")
    text = brand.select(F.try_variant_get("metadata", "$.description", "string"))
    return built.missing.select(
        F.col("normalized_column_name").alias("name"),
        F.lit(report["columns"]).cast("long").alias("n_columns"),
        F.lit(report["documents"]).cast("long").alias("n_documents"),
        F.lit(report["described_but_not_found"]).cast("long").alias("n_missing"),
        text.scalar().alias("brand_text"),
    )


# ---- a catalog of many tables: every brand is a table, every part name a column ----

_BRAND = "CAST(replace(p_brand, 'Brand#', '') AS INTEGER)"
BRAND_TABLE = "'brand_' || CAST(replace(p_brand, 'Brand#', '') AS STRING)"
_TABLE = BRAND_TABLE
_COLUMN = """CASE WHEN p_size < 10 THEN '_' || replace(p_name, ' ', '_') || ' '
                 WHEN p_size < 20 THEN upper(replace(p_name, ' ', '_'))
                 ELSE replace(p_name, ' ', '_') END"""
_TYPE = """CASE p_type WHEN 'STANDARD' THEN 'IntegerType()' WHEN 'PROMO' THEN 'DoubleType()'
                      WHEN 'LARGE' THEN 'LongType()' ELSE 'StringType()' END"""
_DICT_TABLE = f"""CASE p_type
      WHEN 'ECONOMY' THEN 'brand_{{' || CAST({_BRAND} AS STRING) || '|' || CAST({_BRAND} + 1 AS STRING) || '}}.csv'
      WHEN 'PROMO' THEN '  BRAND_' || CAST({_BRAND} AS STRING) || '.CSV'
      WHEN 'SMALL' THEN CASE WHEN p_size < 5 THEN '   ' WHEN p_size < 10 THEN NULL
                             WHEN p_size < 20 THEN 'application_{{train|test}}.csv' ELSE {_TABLE} END
      ELSE {_TABLE} || '.csv' END"""
_DICT_ROW = """CASE WHEN p_size = 12 THEN 'Target' WHEN p_size = 13 THEN 'SK_ID_CURR'
      WHEN p_size = 14 THEN 'sk_bureau_id' WHEN p_size = 15 THEN NULL WHEN p_size = 16 THEN '  '
      WHEN p_size > 40 THEN replace(p_name, ' ', '') || '_note'
      ELSE ' ' || replace(p_name, ' ', '_') || '_ ' END"""
_DICT_TEXT = """CASE WHEN p_size = 20 THEN 'NA' WHEN p_size = 21 THEN NULL
      ELSE ' ' || lower(p_type) || ' value ' || CAST(p_size AS STRING) || ' é' END"""


def _columns(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .selectExpr(f"{_TABLE} table_name", f"{_COLUMN} column_name", f"{_TYPE} data_type")
        .groupBy("table_name", "column_name")
        .agg(F.min("data_type").alias("data_type"))
    )


def _dictionary(spark, sf_dir) -> DataFrame:
    return blank_na_tokens(
        table(spark, sf_dir, "part").selectExpr(
            f"{_DICT_TABLE} Table", f"{_DICT_ROW} Row", f"{_DICT_TEXT} Description"
        )
    )


_NORM = "trim(trim(upper({0}), '_ '))"

_ENTRIES_SQL = f"""
    raw AS (SELECT nullif(trim({_DICT_TABLE}), '') AS pattern, nullif(trim({_DICT_ROW}), '') AS c,
                   coalesce(trim(nullif({_DICT_TEXT}, 'NA')), '') AS d FROM part),
    expanded AS (
      SELECT c, d, unnest(CASE WHEN contains(pattern, '{{')
          THEN list_transform(string_split(regexp_extract(pattern, '[{{](.*)[}}]', 1), '|'),
                 lambda x: regexp_replace(pattern, '[{{].*[}}]', x))
          ELSE [pattern] END) AS p
      FROM raw WHERE pattern IS NOT NULL AND c IS NOT NULL),
    named AS (SELECT regexp_replace(lower(p), '\\.csv$', '') AS t, c, d FROM expanded),
    entries AS (
      SELECT t AS original_table_name, c AS original_column_name,
             {_NORM.format("c")} AS normalized_column_name, d AS description_text,
             upper(c) = 'TARGET' AND t = 'application_train' AS is_target,
             contains(upper(c), 'SK_ID') OR contains(upper(c), 'SK_BUREAU_ID') AS is_id,
             'Description for table ''' || t || ''', column ''' || c || ''': ' || d AS entry_text,
             sha256('static_desc_' || t || '-' || c || '-' || d) AS id
      FROM named WHERE t <> '')"""

_COLUMNS_SQL = f"""
    columns_in AS (
      SELECT {_TABLE} AS table_name, {_COLUMN} AS column_name, min({_TYPE}) AS data_type,
             {_NORM.format(_COLUMN)} AS norm
      FROM part GROUP BY 1, 2, 4)"""


@query("catalog_dictionary", f"WITH {_ENTRIES_SQL} SELECT * FROM entries")
def catalog_dictionary(spark, sf_dir):
    return dictionary_entries(_dictionary(spark, sf_dir))


_ASKED = """(SELECT *, 'description for table ' || table_name || ' column ' || column_name AS text,
             table_name || chr(0) || column_name AS query_id FROM {0})"""
_UNIQUE_ENTRIES = """unique_entries AS (SELECT DISTINCT id AS doc_id, entry_text AS text, * FROM entries)"""


def _enriched_sql(ranked: str) -> str:
    return f"""
    WITH {_ENTRIES_SQL}, {_COLUMNS_SQL}, {_UNIQUE_ENTRIES},
    best AS (
      SELECT * FROM (SELECT *, row_number() OVER (
          PARTITION BY original_table_name, normalized_column_name
          ORDER BY original_column_name, description_text) AS rn FROM unique_entries) WHERE rn = 1),
    exact AS (
      SELECT table_name, column_name, data_type, norm, b.*
      FROM columns_in c LEFT JOIN best b
        ON c.table_name = b.original_table_name AND c.norm = b.normalized_column_name),
    rest AS {_ASKED.format("(SELECT table_name, column_name, data_type, norm FROM exact WHERE doc_id IS NULL)")},
    {ranked}
    SELECT table_name, column_name, data_type, norm AS normalized_column_name,
           description_text AS description, is_target, is_id, 'exact' AS matched
    FROM exact WHERE doc_id IS NOT NULL
    UNION ALL
    SELECT r.table_name, r.column_name, r.data_type, r.norm, coalesce(e.description_text, ''),
           coalesce(e.is_target AND e.normalized_column_name = r.norm
                    AND e.original_table_name = r.table_name, false),
           coalesce(e.is_id AND e.normalized_column_name = r.norm
                    AND e.original_table_name = r.table_name, false),
           CASE WHEN e.doc_id IS NOT NULL THEN 'similar' END
    FROM rest r LEFT JOIN hits h USING (query_id) LEFT JOIN unique_entries e ON h.doc_id = e.doc_id
    """


@query("catalog_enrich", _enriched_sql(lexical_sql("rest", "unique_entries", 1, "hits")))
def catalog_enrich(spark, sf_dir):
    return enrich_columns(
        _columns(spark, sf_dir), dictionary_entries(_dictionary(spark, sf_dir))
    )


@query("catalog_enrich_embedded", _enriched_sql(embedded_sql("rest", "unique_entries", 1, "hits")))
def catalog_enrich_embedded(spark, sf_dir):
    return enrich_columns(
        _columns(spark, sf_dir), dictionary_entries(_dictionary(spark, sf_dir)),
        embedder=hashing_embedder(64),
    )


@query(
    "catalog_enrich_strict",
    f"""
    WITH {_ENTRIES_SQL}, {_COLUMNS_SQL}, {_UNIQUE_ENTRIES},
    asked AS {_ASKED.format("columns_in")},
    {lexical_sql("asked", "unique_entries", 3, "hits")},
    chosen AS (
      SELECT * FROM (
        SELECT a.*, e.*, e.original_table_name = a.table_name
                   AND e.normalized_column_name = a.norm AS same,
               row_number() OVER (PARTITION BY a.query_id ORDER BY
                 (e.original_table_name = a.table_name AND e.normalized_column_name = a.norm) DESC,
                 h.rank) AS rn
        FROM asked a JOIN hits h USING (query_id) JOIN unique_entries e ON h.doc_id = e.doc_id)
      WHERE rn = 1)
    SELECT c.table_name, c.column_name, c.data_type, c.norm AS normalized_column_name,
           coalesce(x.description_text, '') AS description, coalesce(x.is_target, false) AS is_target,
           coalesce(x.is_id, false) AS is_id,
           CASE WHEN x.same THEN 'exact' WHEN NOT x.same THEN 'similar' END AS matched
    FROM columns_in c LEFT JOIN chosen x
      ON c.table_name = x.table_name AND c.column_name = x.column_name
    """,
)
def catalog_enrich_strict(spark, sf_dir):
    return enrich_columns(
        _columns(spark, sf_dir), dictionary_entries(_dictionary(spark, sf_dir)), strict=True
    )


_DESCRIBED = """CASE p_type WHEN 'STANDARD' THEN '' WHEN 'PROMO' THEN 'promotion'
      WHEN 'LARGE' THEN 'size ' || CAST(p_size AS STRING) ELSE lower(p_type) || ' size ' || CAST(p_size AS STRING) END"""
_FLAGGED = "p_size = 50 AND p_type = 'PROMO'"


GLOBAL_SQL = f"""
    cat AS (
      SELECT {_TABLE} AS t, {_COLUMN} AS c, {_NORM.format(_COLUMN)} AS norm, {_TYPE} AS ty,
             {_DESCRIBED} AS d, {_FLAGGED} AS target, p_size = 1 AS ident FROM part),
    head AS (
      SELECT norm, arg_min(c, (t, c)) AS column_name,
             array_to_string(list_sort(list(DISTINCT ty)), ', ') AS types,
             array_to_string(list_sort(list(DISTINCT t)), ', ') AS tables,
             bool_or(target) AS is_target, bool_or(ident) AS is_id FROM cat GROUP BY 1),
    texts AS (SELECT norm, d, min((t, c)) AS place FROM cat WHERE d <> '' GROUP BY 1, 2),
    merged AS (
      SELECT norm, list_reduce(list(d ORDER BY place, d),
               lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || ' | ' || x END) AS description
      FROM texts GROUP BY 1),
    global_columns AS (
      SELECT norm AS normalized_column_name, column_name, types AS data_types, tables,
             coalesce(description, '') AS description, is_target, is_id,
             'dataset_metadata_global_semantic_enriched' AS source,
             'Column: ' || column_name || ', Data Type(s): ' || types || ', Description: '
               || coalesce(description, '') || '. Present in tables: ' || tables || '.' AS entry_text,
             sha256('global-col-meta-' || norm || '-' || tables || '-' || types || '-'
               || coalesce(description, '')) AS id
      FROM head LEFT JOIN merged USING (norm))"""


def merged_catalog(spark, sf_dir) -> DataFrame:
    catalog = table(spark, sf_dir, "part").selectExpr(
        f"{_TABLE} table_name", f"{_COLUMN} column_name", f"{_TYPE} data_type",
        f"{_DESCRIBED} description", f"{_FLAGGED} is_target", "p_size = 1 is_id",
    ).withColumn("normalized_column_name", normalize_column_name(F.col("column_name")))
    return global_columns(catalog)


@query("catalog_global", f"WITH {GLOBAL_SQL} SELECT * FROM global_columns")
def catalog_global(spark, sf_dir):
    return merged_catalog(spark, sf_dir).withColumns(
        {
            "data_types": F.array_join("data_type", ", "),
            "tables": F.array_join("tables_present_in", ", "),
        }
    ).drop("data_type", "tables_present_in")


@query(
    "catalog_missing",
    f"""
    WITH {_ENTRIES_SQL}, {_COLUMNS_SQL}
    SELECT normalized_column_name FROM entries EXCEPT SELECT norm FROM columns_in
    """,
)
def catalog_missing(spark, sf_dir):
    return missing_described(
        dictionary_entries(_dictionary(spark, sf_dir)), _columns(spark, sf_dir)
    )
