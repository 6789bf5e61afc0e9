"""Order MinHash fingerprints: minimal occurrence-numbered word runs in their text order.

Runs of K words are numbered by occurrence, so that repeats are elements of their own, and
hashed. The hash space is cut into BINS equal ranges; of each range the two minimal elements are
taken, put in the order in which the text has them, and hashed as a pair. Two texts agree in a
range where the same runs are minimal and stand in the same order, which edits and moves
of passages disturb. One pass over a sorted array thus serves for all BINS minima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomwright.llm.common import let, narrow, register
from loomwright.llm.quality import words_of
from loomwright.queries.base import table
from loomwright.storage import stage

K = 2
BIN_BITS = 6
BINS = 1 << BIN_BITS
PLACE_BITS = 26  # hash above, place in the text below, in one positive long
_PLACES = (1 << PLACE_BITS) - 1
_STEPS = [1 << b for b in range(PLACE_BITS - 1, -1, -1)]  # their sum is the last place there can be


def _packed(value: Column, place: Column) -> Column:
    upper = F.shiftleft(F.shiftrightunsigned(value, PLACE_BITS + 1), PLACE_BITS)
    return upper.bitwiseOR(place.cast("long").bitwiseAND(F.lit(_PLACES)))


def _upper(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def fingerprint(text: Column) -> Column:
    """Array of integers, a used range above its pair hash; empty for a text without words.

    Equal texts give equal arrays; texts that differ in white space alone do, too.
    """
    def runs(w: Column) -> Column:
        last = F.greatest(F.size(w) - K, F.lit(0))
        value = F.transform(F.sequence(F.lit(0), last), lambda i: _packed(
            F.xxhash64(*(F.get(w, i + j) for j in range(K))), i))
        return F.sort_array(value)

    def numbered(s: Column) -> Column:
        """Occurrence numbers by bisection: equal hashes are neighbours, in text order."""
        def element(x: Column, i: Column) -> Column:
            def more(n: Column, step: Column) -> Column:
                at = i - n - step
                return F.when((at >= 0) & (_upper(F.get(s, F.greatest(at, F.lit(0)))) == _upper(x)),
                              n + step).otherwise(n)

            repeats = (i > 0) & (_upper(F.get(s, F.greatest(i - 1, F.lit(0)))) == _upper(x))
            count = F.when(repeats, F.aggregate(
                F.array(*(F.lit(v) for v in _STEPS)), F.lit(0), more)).otherwise(F.lit(0))
            return _packed(F.xxhash64(_upper(x), count), x.bitwiseAND(F.lit(_PLACES)))

        return F.sort_array(F.transform(s, element))

    range_bits = 63 - BIN_BITS

    def in_range(x: Column) -> Column:
        return F.shiftright(x, range_bits)

    def minimal(e: Column) -> Column:
        """The two least of each range."""
        return F.filter(e, lambda x, i: (i < 2) | (
            in_range(F.get(e, F.greatest(i - 2, F.lit(0)))) != in_range(x)))

    def pairs(m: Column) -> Column:
        firsts = F.transform(m, lambda x, i: F.when(
            (i == 0) | (in_range(F.get(m, F.greatest(i - 1, F.lit(0)))) != in_range(x)),
            let(F.get(m, i + 1), lambda y: F.when(
                y.isNull() | (in_range(y) != in_range(x)), F.xxhash64(_upper(x))
            ).when(
                x.bitwiseAND(F.lit(_PLACES)) <= y.bitwiseAND(F.lit(_PLACES)),
                F.xxhash64(_upper(x), _upper(y)),
            ).otherwise(F.xxhash64(_upper(y), _upper(x)))).bitwiseAND(F.lit(0xFFFFFF))
            .bitwiseOR(F.shiftleft(in_range(x), 24)).cast("int")))
        return F.filter(firsts, lambda x: x.isNotNull())

    steps = let(words_of(text), lambda w: F.when(F.size(w) == 0, F.expr("CAST(array() AS ARRAY<INT>)"))
                .otherwise(let(runs(w), lambda s: let(numbered(s), lambda e: let(minimal(e), pairs)))))
    return steps


def as_text(print_: Column) -> Column:
    """Eight hexadecimal digits for each used range: two for the range, six for its pair."""
    return F.array_join(F.transform(print_, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Agreeing ranges of those that either text uses; two texts without words are alike."""
    def ranges(c: Column) -> Column:
        return F.transform(c, lambda x: F.shiftright(x, 24))

    used = F.size(F.array_union(ranges(a), ranges(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def next_ids(ids: DataFrame, chunks: int) -> DataFrame:
    """Rows (doc_id, h) with ``before``, the document whose next one this is, and its ``h``.

    Order is by falling doc_id, null last; the first follows the last. Ids are dealt by range and
    each range is ordered by itself; only the ends of the ranges meet in one window.
    """
    ranged = stage(
        ids.repartitionByRange(chunks, F.desc_nulls_last("doc_id")).select(
            "doc_id", "h", F.spark_partition_id().alias("chunk")), "fingerprint-order")
    inside = Window.partitionBy("chunk").orderBy(F.desc_nulls_last("doc_id"))
    rows = ranged.withColumns({
        "before": F.lag(F.struct("doc_id", "h")).over(inside),
        "last": F.lead(F.lit(1)).over(inside).isNull(),
    })
    ends = rows.where("last").select("chunk", F.struct("doc_id", "h").alias("tail"))
    whole = Window.orderBy("chunk")
    round_ = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("chunk", F.coalesce(
        F.lag("tail").over(whole), F.last("tail").over(round_)).alias("tail"))
    return rows.join(F.broadcast(ends), "chunk").select(
        "doc_id", F.coalesce("before", "tail").alias("before")).select(
        "doc_id", F.col("before.doc_id").alias("before"), F.col("before.h").alias("h"))


def compare_edits(docs: DataFrame) -> DataFrame:
    """One row per input row: fingerprints of its text and its edited text, and likenesses.

    The edited text ends in the beginning of the next document instead of its own last half.
    Null text is empty. Of rows that repeat a doc_id each is fingerprinted, and the least of
    their texts stands for them as next document. A null doc_id is an id, the lowest.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    prints = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns({
        "n_chars": F.length("text").cast("long"), "print": fingerprint(F.col("text"))})
    ids = docs.select(F.col("doc_id").cast("long"), F.length(text).alias("n")).groupBy("doc_id").agg(
        F.floor(F.max("n") / 2).cast("int").alias("h"))
    chunks = max(1, docs.sparkSession.sparkContext.defaultParallelism * 4)
    order = stage(next_ids(ids, chunks), "fingerprint-next")

    # What each document lends to the one before it: its beginning and its fingerprint.
    lent = prints.join(order.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")))
    lent = lent.select("before", F.struct(
        F.expr("substring(text, 1, least(h, n_chars))").alias("head"), F.col("print").alias("print")).alias("next"))
    single = lent.groupBy("before").agg(F.min("next").alias("next"))
    both = prints.join(single, F.col("doc_id").eqNullSafe(F.col("before")))
    half = F.expr("CAST(n_chars DIV 2 AS INT)")
    edited = F.concat(
        F.expr("substring(text, 1, CAST(n_chars - n_chars DIV 2 AS INT))"),
        F.substring(F.col("next.head"), F.lit(1), half))
    both = both.select("doc_id", "n_chars", "print", F.col("next.print").alias("next_print"),
                       edited.alias("edited"))
    both = both.withColumn("edited_print", fingerprint(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op8(spark, sf_dir) -> DataFrame:
    return compare_edits(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"))


register("op8_order_minhash", op8)
