"""Best-fit packing of documents into token sequences, certified by lower bounds.

Items are dealt over partitions of bounded size. Each is packed by best-fit decreasing, and
dual-feasible functions give a lower bound on the number of sequences that any packing of the
same items needs. Full sequences waste nothing and stay. The partitions exchange the rest and
pack again, those whose own count is certified, too: their sequences may fit others' better. At last,
sequences that are not full are packed as items of their own. The bound over all lengths, a histogram
of at most ``capacity`` numbers, certifies the whole and ends the exchange early.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomwright.llm.common import narrow, register, text_chunks
from loomwright.llm.tokens import Encoder, default_tokenizer
from loomwright.queries.base import table
from loomwright.storage import stage

CAPACITY = 1024
END_ID = 2
ITEMS_PER_PARTITION = 20_000
ROUNDS = 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_IDS = PIECES + ", ids array<int>"


def tokenized_pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: a document's ids and the end id; only longer ones are cut.

    The first piece of a cut document takes what is left over, all others are full. A null or
    empty text has the end id alone. Repeated rows give repeated pieces; other columns are
    not read.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for batch, _, _ in text_chunks(batches):
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row = (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    out.append((*row, ids[a:b].astype(np.int32)) if with_ids else row)
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)]
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, PIECES_IDS if with_ids else PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins.

    Open bins stand in one stack per free space; a bit mask of the stacks in use finds the
    tightest one, so the work per item does not depend on the number of bins.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, count = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = used >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                used &= ~(1 << free)
        else:
            free, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - free
        if free > size:
            stacks[free - size].append(b)
            used |= 1 << (free - size)
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the number of bins for items of these lengths."""
    return histogram_bound(np.bincount(lengths, minlength=capacity + 1), capacity)


def histogram_bound(counts: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual-feasible functions over the counts of each length.

    A dual-feasible function maps sizes so that what fits one bin sums to at most 1; its sum
    over all items therefore bounds the number of bins from below. All sums are integers.
    """
    sizes = np.arange(capacity + 1)
    best = 0
    # Sizes above capacity - t count as a full bin, sizes below t as nothing.
    for t in range(0, capacity // 2 + 1):
        mapped = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
        best = max(best, -(-int((mapped * counts).sum()) // capacity))
    # Sizes rounded down to multiples of 1/k of a bin, exact multiples of 1/(k + 1) kept.
    for k in range(1, 65):
        scaled = (k + 1) * sizes
        doubled = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((doubled * counts).sum()) // (k * capacity)))
    return best


PLACES = ", sequence_id long, offset long, filled boolean"


def _packed(items: DataFrame, step: int, capacity: int, items_per_partition: int) -> DataFrame:
    """One dealing: best-fit decreasing within each partition, written to the shared folder."""
    names = items.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + PLACES

    def run(group: pa.Table) -> pa.Table:
        lengths = group["length"].to_numpy()
        bins, offsets, count = best_fit_decreasing(lengths, capacity)
        full = np.bincount(bins, lengths, count)[bins] == capacity
        ids = ((step << 55) | (int(group["_part"][0].as_py()) << 24)) + bins
        out = group.select(names)
        for name, values, kind in (
            ("sequence_id", ids, pa.int64()), ("offset", offsets, pa.int64()), ("filled", full, pa.bool_()),
        ):
            out = out.append_column(name, pa.array(values, kind))
        return out

    parts = -(-items.count() // items_per_partition)
    key = F.pmod(F.xxhash64(F.lit(step), F.rand(step)), F.lit(parts))
    dealt = stage(items.withColumn("_part", key), f"pack-dealt-{step}")
    return stage(dealt.groupBy("_part").applyInArrow(run, ddl), f"packed-{step}")


def _sequences(packed: DataFrame) -> tuple[int, int]:
    """How many sequences there are, and how many of them are full."""
    return tuple(packed.agg(F.expr("count_if(offset = 0)"), F.expr("count_if(offset = 0 AND filled)")).first())


def pack(
    items: DataFrame,
    capacity: int = CAPACITY,
    items_per_partition: int = ITEMS_PER_PARTITION,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``items`` (any columns with a ``length`` of 1 to ``capacity``) with their places.

    Adds ``sequence_id``, ``offset`` and ``gap``, the number of sequences above the bound over all
    items (0: certified least). Each dealing is written to the shared folder, so that
    a lost executor repeats its partition alone. No items: no rows.
    """
    names = items.columns
    counts = np.zeros(capacity + 1, np.int64)
    for row in items.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    bound = histogram_bound(counts, capacity)
    done: list[DataFrame] = []
    n_done, rest, n_rest, step = 0, None, 0, 0
    open_items = items
    while step < rounds and counts.any():
        packed = _packed(open_items, step, capacity, items_per_partition)
        n, n_full = _sequences(packed)
        step += 1
        if rest is not None and n >= n_rest:
            break  # the exchange gained nothing; the earlier places stand
        rest, n_rest = packed.where("NOT filled"), n - n_full
        done.append(packed.where("filled"))
        n_done += n_full
        if n_done + n_rest <= bound or n <= n_full or counts.sum() <= items_per_partition:
            break
        open_items = rest.select(*names)
    # Sequences of few small items only fit each other as wholes: these are the items now.
    merges = 0
    while n_rest > 1 and n_done + n_rest > bound and merges < rounds and counts.sum() > items_per_partition:
        wholes = rest.groupBy("sequence_id").agg(F.sum("length").alias("length"))
        merged = _packed(
            wholes.withColumnRenamed("sequence_id", "_old"), step, capacity, items_per_partition)
        n, n_full = _sequences(merged)
        step, merges = step + 1, merges + 1
        if n >= n_rest:
            break
        moved = merged.select(
            "_old", F.col("sequence_id").alias("_new"), F.col("offset").alias("_at"), F.col("filled").alias("_full"))
        packed = stage(
            rest.join(moved, rest["sequence_id"] == moved["_old"]).select(
                *names, F.col("_new").alias("sequence_id"), (F.col("_at") + F.col("offset")).alias("offset"),
                F.col("_full").alias("filled")),
            f"pack-merged-{step}")
        rest, n_rest = packed.where("NOT filled"), n - n_full
        done.append(packed.where("filled"))
        n_done += n_full
    if rest is None:
        return items.limit(0).selectExpr("*", "0L AS sequence_id", "0L AS offset", "0 AS gap")
    result = rest
    for part in done:
        result = result.unionByName(part)
    return result.drop("filled").withColumn("gap", F.lit(n_done + n_rest - bound).cast("int"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their places."""
    return pack(stage(tokenized_pieces(docs, tokenizer), "pieces"))


def sequences(packed: DataFrame) -> DataFrame:
    """The id sequences, for items packed with their ``ids``. At most ``capacity`` ids each."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def op4(spark, sf_dir) -> DataFrame:
    return pack_documents(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"))


register("op4_packing", op4)
