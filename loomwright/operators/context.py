"""Context texts: ranked hits of two indexes put together per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Headings, line forms and the sentence for no hits.
FIRST_HEADING = "Relevant Dataset Metadata:\n"
SECOND_HEADING = "\nRelevant Approved ETL Tasks (Past Examples):\n"
FIRST_LABEL = "Dataset"
SECOND_LABEL = "Approved Task"
NO_CONTEXT = "No highly relevant context found in any vector database."
CATALOG_HITS = 5
TASK_HITS = 3


def indented(metadata: Column) -> Column:
    """A metadata variant as JSON with one field, and one list item, a line; fields by name.

    Values within an item stay on its line: metadata is flat but for lists.
    """

    def lines(items: Column, indent: str, ends: str) -> Column:
        return F.concat(
            F.lit(f"{ends[0]}\n{indent}  "), F.array_join(items, f",\n{indent}  "), F.lit(f"\n{indent}{ends[1]}")
        )

    def plain(value: Column) -> Column:
        return F.coalesce(F.to_json(value), F.lit("null"))

    def text(value: Column) -> Column:
        items = F.transform(value.try_cast("array<variant>"), plain)
        return F.when(F.size(items) > 0, lines(items, "  ", "[]")).otherwise(plain(value))

    def line(entry: Column) -> Column:
        name = F.regexp_extract(F.to_json(F.struct(entry["key"].alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)
        return F.struct(entry["key"], F.concat(name, F.lit(": "), text(entry["value"])).alias("line"))

    fields = F.array_sort(F.transform(F.map_entries(metadata.try_cast("map<string,variant>")), line))
    shown = lines(F.transform(fields, lambda f: f["line"]), "", "{}")
    return F.when(F.size(fields) > 0, shown).otherwise(F.to_json(metadata))


def assemble_context(requests: DataFrame, catalog_hits: DataFrame, task_hits: DataFrame) -> DataFrame:
    """(query_id, context) for each request.

    Hits are (query_id, rank, page_content, metadata json or null); a request has
    k of them at most, so the group that is put together has a fixed bound.
    """

    def lines(hits: DataFrame, source: int, label: str) -> DataFrame:
        line = F.concat(
            F.lit("  - Document "), F.col("rank").cast("string"), F.lit(f" ({label}): '"),
            F.col("page_content"), F.lit("'\n"),
            F.when(
                F.col("metadata").isNotNull() & (F.col("metadata") != "{}"),
                F.concat(F.lit("    Metadata: "), F.col("metadata"), F.lit("\n")),
            ).otherwise(F.lit("")),
        )
        return hits.select("query_id", F.lit(source).alias("source"), "rank", line.alias("line"))

    both = lines(catalog_hits, 1, FIRST_LABEL).unionByName(lines(task_hits, 2, SECOND_LABEL))
    joined = (
        both.groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("source", "rank", "line"))).alias("hits"))
        .select(
            "query_id",
            *[
                F.array_join(
                    F.transform(
                        F.filter("hits", lambda h: h["source"] == source), lambda h: h["line"]
                    ),
                    "",
                ).alias(name)
                for source, name in ((1, "first"), (2, "second"))
            ],
        )
    )
    first = F.when(F.col("first") != "", F.concat(F.lit(FIRST_HEADING), "first")).otherwise("")
    second = F.when(F.col("second") != "", F.concat(F.lit(SECOND_HEADING), "second")).otherwise("")
    return (
        requests.select("query_id")
        .join(joined, "query_id", "left")
        .select(
            "query_id",
            F.coalesce(
                F.when(F.col("first").isNotNull(), F.concat(first, second)), F.lit(NO_CONTEXT)
            ).alias("context"),
        )
    )
