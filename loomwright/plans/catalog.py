"""The column catalog: dictionary entries, enrichment, merging across tables, ingest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomwright.functions.merging import merge_rows
from loomwright.functions.names import normalize_column_name, strip_blank
from loomwright.operators.joins import described_but_absent
from loomwright.operators.lexical import lexical_topk
from loomwright.operators.vectors import Embedder, cosine_topk, embed_texts, plain_words
from loomwright.sources.index_store import DocumentIndex, as_documents, with_variant_metadata
from loomwright.sources.tables import discover_csv_tables, infer_columns, read_dictionary, table_names
from loomwright.storage import stage, stage_counted

# Names, markers and text forms of the catalog.
TARGET_TABLE = "application_train"
TARGET_COLUMN = "TARGET"
ID_MARKERS = ("SK_ID", "SK_BUREAU_ID")
ENTRY_ID_PREFIX = "static_desc_"
GLOBAL_ID_PREFIX = "global-col-meta-"
ENTRY_SOURCE = "static_description_source"
SCAN_SOURCE = "spark_inferred_schema"
GLOBAL_SOURCE = "dataset_metadata_global_semantic_enriched"
ENRICHMENT_HITS = 3


def _concat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _expanded_tables(pattern: Column) -> Column:
    """Table names of a file pattern: ``a_{x|y}.csv`` names ``a_x`` and ``a_y``."""
    brace = r"\A([^{}]*)\{([^{}]*)\}([^{}]*)\z"
    choices = F.split(F.regexp_extract(pattern, brace, 2), r"\|")
    names = F.when(
        pattern.rlike(brace),
        F.transform(
            choices,
            lambda c: F.concat(
                F.regexp_extract(pattern, brace, 1), c, F.regexp_extract(pattern, brace, 3)
            ),
        ),
    ).otherwise(F.array(pattern))
    return F.transform(names, lambda n: F.regexp_replace(F.lower(n), r"\.csv\z", ""))


def dictionary_entries(
    dictionary: DataFrame,
    target_table: str = TARGET_TABLE,
    target_column: str = TARGET_COLUMN,
    id_markers: tuple[str, ...] = ID_MARKERS,
) -> DataFrame:
    """Described columns, one row per (table, column, description), with text and stable id."""

    def cell(name: str) -> Column:
        return F.nullif(strip_blank(F.col(name)), F.lit(""))

    rows = (
        dictionary.select(
            cell("Table").alias("pattern"),
            cell("Row").alias("original_column_name"),
            F.coalesce(cell("Description"), F.lit("")).alias("description_text"),
        )
        .where(F.col("pattern").isNotNull() & F.col("original_column_name").isNotNull())
        .withColumn("original_table_name", F.explode(_expanded_tables(F.col("pattern"))))
        .where(F.col("original_table_name") != "")
    )
    table, column, text = (
        F.col(c) for c in ("original_table_name", "original_column_name", "description_text")
    )
    upper = F.upper(column)
    is_id = F.lit(False)
    for marker in id_markers:
        is_id = is_id | F.contains(upper, F.lit(marker))
    return rows.select(
        table,
        column,
        normalize_column_name(column).alias("normalized_column_name"),
        text,
        ((upper == target_column) & (table == target_table)).alias("is_target"),
        is_id.alias("is_id"),
        _concat("Description for table '", table, "', column '", column, "': ", text).alias(
            "entry_text"
        ),
        F.sha2(_concat(ENTRY_ID_PREFIX, table, "-", column, "-", text), 256).alias("id"),
    )


def enrich_columns(
    columns: DataFrame, entries: DataFrame, strict: bool = False, embedder: Embedder | None = None
) -> DataFrame:
    """Catalog columns with description and flags from the dictionary.

    An entry of the same table and normalized name is joined directly. Only columns
    without one are searched by similarity; they take the description of the nearest
    entry, but no flags. ``strict`` is the literal rule: the three nearest entries are
    searched for every column, an exact one among them wins, else the nearest, and
    its flags come along. Similarity is that of words, or with an embedder the cosine
    of the vectors it makes.

    Adds description, is_target, is_id, matched ('exact', 'similar' or null).
    """
    columns = columns.withColumn(
        "normalized_column_name", normalize_column_name(F.col("column_name"))
    )
    # Read by the direct join, by the search, and to look up what was found.
    distinct_entries = stage(entries.dropDuplicates(["id"]), "entries")
    key = ["table_name", "normalized_column_name"]
    best = F.min(F.struct("original_column_name", "description_text", "is_target", "is_id"))
    exact = (
        distinct_entries.withColumnRenamed("original_table_name", "table_name")
        .groupBy(*key)
        .agg(best.alias("exact"))
    )
    if strict:
        return _enrich_by_search(columns, distinct_entries, ENRICHMENT_HITS, True, embedder)
    joined = stage(columns.join(exact, key, "left"), "columns")
    direct = joined.where("exact is not null").select(
        *columns.columns,
        F.col("exact.description_text").alias("description"),
        F.col("exact.is_target").alias("is_target"),
        F.col("exact.is_id").alias("is_id"),
        F.lit("exact").alias("matched"),
    )
    rest = joined.where("exact is null").select(*columns.columns)
    return direct.unionByName(_enrich_by_search(rest, distinct_entries, 1, False, embedder))


def _nearest_entries(
    asked: DataFrame, entries: DataFrame, k: int, embedder: Embedder | None
) -> DataFrame:
    docs = entries.select(F.col("id").alias("doc_id"), "entry_text")
    if embedder is None:
        return lexical_topk(asked, docs, k, doc_text="entry_text")
    # Both sides are read more than once by the search: written, so that no text is embedded twice.
    vectors = [
        stage(embed_texts(df, text, lambda: embedder, prepare=plain_words).drop(text), name)
        for df, text, name in (
            (asked.select("query_id", "text"), "text", "asked-vectors"),
            (docs, "entry_text", "entry-vectors"),
        )
    ]
    return cosine_topk(*vectors, k)


def _enrich_by_search(
    columns: DataFrame, entries: DataFrame, k: int, flags: bool, embedder: Embedder | None = None
) -> DataFrame:
    asked = columns.select("table_name", "column_name", "normalized_column_name").distinct().select(
        "*",
        F.sha2(F.to_json(F.struct("table_name", "column_name")), 256).alias("query_id"),
        _concat(
            "description for table ", F.col("table_name"), " column ", F.col("column_name")
        ).alias("text"),
    )
    matches = _nearest_entries(asked, entries, k, embedder).join(
        entries.select(
            F.col("id").alias("doc_id"),
            "original_table_name",
            F.col("normalized_column_name").alias("entry_name"),
            "description_text",
            F.col("is_target").alias("entry_target"),
            F.col("is_id").alias("entry_id"),
        ),
        "doc_id",
    ).join(asked.drop("text"), "query_id")
    same = (F.col("original_table_name") == F.col("table_name")) & (
        F.col("entry_name") == F.col("normalized_column_name")
    )
    order = Window.partitionBy("query_id").orderBy(same.desc(), "rank")
    chosen = (
        matches.withColumns({"_same": same, "_rn": F.row_number().over(order)})
        .where("_rn = 1")
        .select(
            "table_name",
            "column_name",
            F.col("description_text").alias("description"),
            (F.col("entry_target") & (F.col("_same") | F.lit(flags))).alias("is_target"),
            (F.col("entry_id") & (F.col("_same") | F.lit(flags))).alias("is_id"),
            F.when(F.col("_same"), "exact").otherwise("similar").alias("matched"),
        )
    )
    return columns.join(chosen, ["table_name", "column_name"], "left").select(
        *columns.columns,
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("is_target", F.lit(False)).alias("is_target"),
        F.coalesce("is_id", F.lit(False)).alias("is_id"),
        "matched",
    )


def global_columns(catalog: DataFrame) -> DataFrame:
    """One row per normalized name over all tables, with its document text and stable id.

    Order is by table, then column. Equal (name, type, table, description) values are
    merged on the map side first: a name that a third of all tables share reaches its
    task as one row per distinct value, which is no more than its result row holds.
    Names with many descriptions are merged through an index of their windows.
    """
    place = F.struct("table_name", "column_name")
    name = "normalized_column_name"
    head = catalog.groupBy(name).agg(
        F.min(place).getField("column_name").alias("column_name"),
        F.sort_array(F.collect_set("data_type")).alias("data_type"),
        F.sort_array(F.collect_set("table_name")).alias("tables_present_in"),
        F.bool_or("is_target").alias("is_target"),
        F.bool_or("is_id").alias("is_id"),
    )
    texts = (
        catalog.where("description <> ''")
        .groupBy(name, "description")
        .agg(F.min(place).alias("place"))
        .groupBy(name)
        .agg(F.sort_array(F.collect_list(F.struct("place", "description"))).alias("texts"))
        .withColumn("texts", F.transform("texts", lambda t: t["description"]))
    )
    texts = merge_rows(texts, "texts", "description")
    tables = F.array_join("tables_present_in", ", ")
    types = F.array_join("data_type", ", ")
    return (
        head.join(texts, name, "left")
        .withColumn("description", F.coalesce("description", F.lit("")))
        .select(
            name,
            "column_name",
            "data_type",
            "description",
            "is_target",
            "is_id",
            "tables_present_in",
            F.lit(GLOBAL_SOURCE).alias("source"),
            _concat(
                "Column: ", F.col("column_name"), ", Data Type(s): ", types,
                ", Description: ", F.col("description"), ". Present in tables: ", tables, ".",
            ).alias("entry_text"),
            F.sha2(
                _concat(
                    GLOBAL_ID_PREFIX, F.col(name), "-", tables, "-", types, "-", F.col("description")
                ),
                256,
            ).alias("id"),
        )
    )


def nested_catalog(catalog: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_name, columns map<name, record>); a table without readable columns stays,
    with an empty map. Of rows that repeat a column of a table, as two files of one stem give,
    the first in the order of their fields stands."""
    record = F.struct(
        F.lit(SCAN_SOURCE).alias("source"),
        *[c for c in catalog.columns if c not in ("table_name", "position")],
    )
    single = catalog.groupBy("table_name", "column_name").agg(F.min(record).alias("record"))
    nested = single.groupBy("table_name").agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "record"))).alias("columns")
    )
    joined = tables.select("table_name").join(nested, "table_name", "left")
    empty = F.create_map().cast(nested.schema["columns"].dataType)
    return joined.select("table_name", F.coalesce("columns", empty).alias("columns"))


def missing_described(entries: DataFrame, columns: DataFrame) -> DataFrame:
    """Normalized names that the dictionary describes and no table has."""
    found = columns.select(
        normalize_column_name(F.col("column_name")).alias("normalized_column_name")
    )
    return described_but_absent(entries, found, "normalized_column_name")


@dataclass(frozen=True)
class CatalogIngest:
    catalog: DataFrame
    tables: DataFrame
    global_columns: DataFrame
    missing: DataFrame
    counts: dict[str, int]


def build_catalog(
    spark: SparkSession, data_dir: str, dictionary_path: str, strict: bool = False,
    embedder: Embedder | None = None,
) -> CatalogIngest:
    """Catalog of a folder of CSV tables; dictionary entries are never written to an index.

    Each result is written once; its number of rows is observed as it is written.
    """
    found = discover_csv_tables(spark, data_dir, dictionary_path)
    columns = stage(infer_columns(spark, found), "profile")
    entries = dictionary_entries(read_dictionary(spark, dictionary_path))
    catalog, n_columns = stage_counted(enrich_columns(columns, entries, strict, embedder), "catalog")
    merged, n_documents = stage_counted(global_columns(catalog), "merged-columns")
    missing, n_missing = stage_counted(missing_described(entries, columns), "missing-columns")
    return CatalogIngest(
        catalog, table_names(spark, found), merged, missing,
        {"columns": n_columns, "documents": n_documents, "described_but_not_found": n_missing},
    )


def global_documents(merged: DataFrame) -> DataFrame:
    """Merged columns as index documents."""
    metadata = F.struct(
        "source", "normalized_column_name", "column_name", "data_type", "description",
        "is_target", "is_id", "tables_present_in",
    )
    return with_variant_metadata(
        as_documents(merged, F.col("entry_text"), metadata, F.col("id"))
    )


def ingest_catalog(
    spark: SparkSession,
    data_dir: str,
    dictionary_path: str,
    index: DocumentIndex,
    strict: bool = False,
    embedder: Embedder | None = None,
) -> tuple[CatalogIngest, dict[str, int]]:
    """Build the catalog, upsert its merged columns into the index, report counts.

    An embedder ranks the dictionary entries and makes the vectors of the index.
    """
    built = build_catalog(spark, data_dir, dictionary_path, strict, embedder)
    index.upsert(global_documents(built.global_columns), embedder=embedder)
    return built, dict(built.counts)
