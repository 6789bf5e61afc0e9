"""Document index: keyed upsert, delete by predicate, search; each change a job to a new table.

A document row is (id string, text_content string, metadata variant
[, embedding array<float>]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from loomwright.operators.vectors import (
    Embedder, cosine_topk, embed_texts, plain_words, project_matches,
)
from loomwright.storage import list_folder, path_exists, remove, stage


def as_documents(
    df: DataFrame, text: Column, metadata: Column | None = None, doc_id: Column | None = None
) -> DataFrame:
    """Shape rows as documents. Without a given id each row gets a random one.

    ``metadata`` is a struct or a variant; ``text_content`` stays its own column,
    so metadata can never override it.
    """
    meta = F.struct() if metadata is None else metadata
    return df.select(
        (F.uuid() if doc_id is None else doc_id).alias("id"),
        text.alias("text_content"),
        meta.alias("metadata"),
    )


def with_variant_metadata(docs: DataFrame) -> DataFrame:
    """Metadata structs as variants, so that documents of any source union."""
    return docs.withColumn("metadata", F.to_variant_object("metadata"))


def metadata_equals(key: str, value: str) -> Column:
    """Null-safe equality test on one metadata field."""
    return F.try_variant_get("metadata", f"$.{key}", "string").eqNullSafe(F.lit(value))


def last_per_id(batch: DataFrame, position: str) -> DataFrame:
    """One row per id: the last by position.

    ``row_number`` = 1 is applied on the map side too, so many copies of one id
    never meet in one task.
    """
    newest = Window.partitionBy("row.id").orderBy(F.col("row")[position].desc())
    ranked = batch.select(F.struct("*").alias("row")).withColumn("place", F.row_number().over(newest))
    return ranked.where("place = 1").select("row.*").drop(position)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same id. ``new`` has unique ids."""
    kept = old.join(new.select("id"), "id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def delete_where(docs: DataFrame, predicate: Column) -> DataFrame:
    """Drop the matching rows; a row for which the predicate is null stays."""
    return docs.where(~F.coalesce(predicate, F.lit(False)))


def check_ids(batch: DataFrame) -> None:
    """Caller ids must match the texts one to one: none may be missing."""
    bad = batch.agg(F.count_if(F.col("id").isNull() | F.col("text_content").isNull())).first()[0]
    if bad:
        raise ValueError(f"{bad} documents lack an id or a text")


def check_dimension(batch: DataFrame, dimension: int) -> None:
    """Every vector must have the index dimension."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    bad = batch.agg(F.count_if(size != dimension)).first()[0]
    if bad:
        raise ValueError(f"{bad} vectors do not have {dimension} components")


#: The physical column by which an index is laid out, from this field of the metadata.
LAYOUT, LAYOUT_FIELD = "_layout", "source"


def layout_value(value: str) -> str:
    return "=" + value  # never empty, and never taken for a number


def _layout(docs: DataFrame) -> Column:
    kind = docs.schema["metadata"].dataType
    if isinstance(kind, T.StructType):
        value = F.col(f"metadata.{LAYOUT_FIELD}") if LAYOUT_FIELD in kind.names else F.lit(None)
    else:
        value = F.try_variant_get("metadata", f"$.{LAYOUT_FIELD}", "string")
    return F.concat(F.lit(layout_value("")), value.cast("string"))


class DocumentIndex:
    """An index folder: numbered tables, of which the last complete one is current.

    A change is a job from the current table to the next one. A job that dies leaves no
    complete table, so the index stays as it was. Writers take turns: of two that
    work on one number the second fails. Rows lie by source and id, in folders by
    source, so a search in one source reads its files alone; a source with most of the
    rows is cut into ranges of ids.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None):
        self._spark = spark
        self._path = path.rstrip("/")
        self._dimension = dimension

    def _tables(self) -> list[str]:
        if not path_exists(self._spark, self._path):
            return []
        return [p for p in list_folder(self._spark, self._path) if p.rsplit("/", 1)[-1].startswith("table-")]

    def _current(self) -> DataFrame | None:
        done = [p for p in self._tables() if path_exists(self._spark, f"{p}/_SUCCESS")]
        return self._spark.read.parquet(done[-1]) if done else None

    def _write(self, docs: DataFrame) -> None:
        tables = self._tables()
        number = int(tables[-1].rsplit("-", 1)[-1]) + 1 if tables else 1
        laid = docs.withColumn(LAYOUT, _layout(docs))
        laid.repartitionByRange(LAYOUT, "id").sortWithinPartitions(LAYOUT, "id").write.partitionBy(LAYOUT).parquet(
            f"{self._path}/table-{number:09d}")

    def read(self, source: str | None = None) -> DataFrame | None:
        """The current rows, of one source if it is named; None for an index without a change.

        The filter is on the layout, so files of other sources are not read.
        """
        current = self._current()
        if current is None:
            return None
        if source is not None:
            current = current.where(F.col(LAYOUT) == layout_value(source))
        return current.drop(LAYOUT)

    def drop_old(self) -> None:
        """Remove all tables before the current one; readers that started earlier should be done."""
        done = [p for p in self._tables() if path_exists(self._spark, f"{p}/_SUCCESS")]
        for path in done[:-1]:
            remove(self._spark, path)

    def upsert(
        self, batch: DataFrame, position: str | None = None, embedder: Embedder | None = None
    ) -> None:
        """Add a batch. Equal ids within it keep the last row by position; without a position
        their order is not known, and they are refused.

        ``embedder`` makes the vectors from the plain words of the texts.
        """
        if position is not None:
            batch = last_per_id(batch, position)
        if embedder is not None:
            batch = embed_texts(batch, "text_content", lambda: embedder, prepare=plain_words)
        # Written first: it is checked and published, but computed only once.
        unique = stage(batch, "batch")
        check_ids(unique)
        if position is None:
            repeated = unique.groupBy("id").count().where("count > 1").count()
            if repeated:
                raise ValueError(f"{repeated} ids are repeated in the batch, and no position orders them")
        if self._dimension is not None:
            check_dimension(unique, self._dimension)
        current = self.read()
        self._write(unique if current is None else upsert(current, unique))

    def delete(self, predicate: Column) -> None:
        """Remove the rows for which the predicate is true."""
        current = self.read()
        if current is not None:
            self._write(delete_where(current, predicate))

    def search(
        self, queries: DataFrame, k: int, embedder: Embedder, where: Column | None = None,
        source: str | None = None,
    ) -> DataFrame:
        """The k nearest documents of each text: (query_id, id, rank, score, text_content, metadata).

        ``queries`` are (query_id, text). ``where`` filters on metadata before ranking; ``source``
        restricts the files that are read.
        """
        current = self.read(source)
        if current is None or "embedding" not in current.columns:
            raise ValueError("the index has no vectors; add documents with an embedder")
        vectors = embed_texts(
            queries.select("query_id", "text"), "text", lambda: embedder, prepare=plain_words
        )
        docs = current if where is None else current.where(where)
        matches = cosine_topk(
            vectors.select("query_id", "embedding"),
            docs.select(F.col("id").alias("doc_id"), "embedding"), k,
        )
        return project_matches(matches, docs, "text_content", "metadata").select(
            "query_id", F.col("doc_id").alias("id"), "rank", "score", "text_content", "metadata"
        )
