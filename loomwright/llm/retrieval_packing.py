"""Lexical retrieval packing: sequences of documents that a BM25 index finds near each other.

Whole windows of long documents are sequences of their own; what is left of each document, always
less than a window, is an item. Terms are token ids, so their document counts over all items
are one small table. Items go, in the order of weighted minima of their terms, to shards of
bounded size; each shard holds an inverted index with BM25 weights. The first unused item is
the seed of a window, the index returns the unused items by their score, and they fill the window, the last
one up to its end; the rest of it stays in the index. A shard passes what no longer makes a
window on to the next, and a task to a further round, in which these meet anew. The last few
tokens of all become sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loomwright.llm.common import mix, narrow, register, text_chunks
from loomwright.llm.tokens import Encoder, default_tokenizer, vocabulary_size
from loomwright.queries.base import table
from loomwright.storage import spread, stage

CAPACITY = 1024
END_ID = 0
K1 = 1.2
B = 0.75
ITEMS_PER_SHARD = 1024
TOKENS_PER_TASK = 2_000_000
MOST_TASKS = 20_000
MINIMA = 3

PIECE = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = [c.split()[0] for c in PIECE.split(", ")]
_KINDS = [pa.int64()] * 8 + [pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


def _task() -> int:
    return TaskContext.get().partitionId() if TaskContext.get() else 0


def id_type(tokenizer: str) -> str:
    return "<u2" if vocabulary_size(tokenizer) <= 1 << 16 else "<u4"


def tokenized(
    docs: DataFrame, tokenizer: str, kind: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """Whole windows of each document, placed, and its last part as an item without a sequence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made = Encoder(tokenizer), _task() << 33
        for batch, _, _ in text_chunks(batches):
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                for at in range(0, n, capacity):
                    part, made = ids[at:at + capacity], made + 1
                    whole = len(part) == capacity
                    out.append((
                        made, doc_id, at, len(part), zlib.crc32(part.tobytes()) if whole else None, n,
                        made if whole else None, 0 if whole else None,
                        part.astype(kind).tobytes() if keep_ids or not whole else None))
            yield _batch(out)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, PIECE)


def _terms(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item number, term and count of each distinct term of each item, in this order."""
    owner = np.repeat(np.arange(len(items)), [len(x) for x in items])
    keys, counts = np.unique((owner << 32) | np.concatenate(items).astype(np.int64), return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, counts


def _read(batch: pa.RecordBatch, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in batch["ids"].to_pylist()]


def document_counts(items: DataFrame, kind: str) -> dict[int, int]:
    """In how many items each term stands, over all items. At most one entry per token of the
    vocabulary comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                terms = _terms(_read(batch.slice(first, 2000), kind))[1]
                counts = np.bincount(terms)
                held = np.pad(held, (0, max(0, len(counts) - len(held))))
                held[:len(counts)] += counts
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(held[there])], ["term", "n"])

    counted = items.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.collect()}


class Weights:
    """What BM25 needs of the whole corpus: inverse document frequencies and the mean length."""

    def __init__(self, counts: dict[int, int], n_items: int, mean_length: float):
        self.idf = np.zeros(max(counts, default=0) + 1)
        terms = np.fromiter(counts.keys(), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        self.idf[terms] = np.log1p((n_items - n + 0.5) / (n + 0.5))
        self.mean_length = mean_length
        # An exponential race: a term comes first among a set's terms with a chance in proportion
        # to its weight, and sets that share weight often have the same first term.
        self.places = np.empty((MINIMA, len(self.idf)), np.int64)
        for k in range(MINIMA):
            draws = mix(np.arange(len(self.idf), dtype=np.uint64) * np.uint64(MINIMA) + np.uint64(k + 1))
            race = -np.log((draws >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54) / np.maximum(self.idf, 1e-9)
            self.places[k, np.argsort(race, kind="stable")] = np.arange(len(race))

    def score(self, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The BM25 weight of each (term, count, item length)."""
        norm = K1 * (1 - B + B * lengths / self.mean_length)
        return self.idf[terms] * counts * (K1 + 1) / (counts + norm)


class Index:
    """An inverted index: for each term the items that have it, with their BM25 weights."""

    def __init__(self, items: list[np.ndarray], weights: Weights):
        self.size = len(items)
        owner, terms, counts = _terms(items)
        lengths = np.array([len(x) for x in items])
        self.of_item = np.searchsorted(owner, np.arange(self.size + 1))
        scores = weights.score(terms, counts, lengths[owner])
        present, self.local = np.unique(terms, return_inverse=True)
        order = np.argsort(self.local, kind="stable")
        self.items, self.scores = owner[order], scores[order]
        bounds = np.searchsorted(self.local[order], np.arange(len(present) + 1)).tolist()
        self.ranges = [slice(a, b) for a, b in zip(bounds, bounds[1:])]

    def search(self, seed: int) -> np.ndarray:
        """The score of every item for the distinct terms of one."""
        wanted = [self.ranges[t] for t in self.local[self.of_item[seed]:self.of_item[seed + 1]].tolist()]
        return np.bincount(
            np.concatenate([self.items[r] for r in wanted]),
            np.concatenate([self.scores[r] for r in wanted]), self.size)


class _Item:
    __slots__ = ("row", "doc_id", "start", "doc_tokens", "ids")

    def __init__(self, row, doc_id, start, doc_tokens, ids):
        self.row, self.doc_id, self.start, self.doc_tokens, self.ids = row, doc_id, start, doc_tokens, ids

    def take(self, n: int, sequence: int, offset: int, keep: str | None) -> tuple:
        """The first n ids as a piece; the rest stays."""
        part, self.ids = self.ids[:n], self.ids[n:]
        crc = zlib.crc32(part.astype("<u4").tobytes())
        at, self.start = self.start, self.start + n
        return (self.row, self.doc_id, at, n, crc, self.doc_tokens, sequence, offset,
                part.astype(keep).tobytes() if keep else None)


def _fill_windows(items: list[_Item], weights: Weights, capacity: int, sequence: int, keep: str | None):
    """Pieces of all whole windows the items make, and the items that are left."""
    index = Index([x.ids for x in items], weights)
    left = sum(len(x.ids) for x in items)
    unused = np.ones(len(items), bool)
    pieces, seed = [], 0
    while left >= capacity:
        while not unused[seed]:
            seed += 1
        sequence, offset, now, scores = sequence + 1, 0, seed, None
        while True:
            n = min(len(items[now].ids), capacity - offset)
            pieces.append(items[now].take(n, sequence, offset, keep))
            unused[now] = len(items[now].ids) > 0
            offset += n
            if offset == capacity:
                break
            if scores is None:
                scores = np.where(unused, index.search(seed), -1.0)
            scores[now] = -1.0
            now = int(scores.argmax())
        left -= capacity
    return pieces, [x for x in items if len(x.ids)], sequence


def _powers_of_two(items: list[_Item], sequence: int, keep: str | None) -> list[tuple]:
    """The rest as sequences of powers of two."""
    pieces, left = [], sum(len(x.ids) for x in items)
    queue = list(items)
    while left:
        size, offset, sequence = 1 << (left.bit_length() - 1), 0, sequence + 1
        left -= size
        while offset < size:
            n = min(len(queue[0].ids), size - offset)
            pieces.append(queue[0].take(n, sequence, offset, keep))
            offset += n
            if not len(queue[0].ids):
                queue.pop(0)
    return pieces


def _round(
    items: DataFrame, weights, round_: int, last: bool, kind: str, capacity: int, items_per_shard: int, keep_ids: bool
) -> DataFrame:
    """Pieces that are placed, and items that are left, in the order the partitions come in."""
    keep = kind if keep_ids else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, held = (round_ << 58) | (_task() << 33), []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("row", "doc_id", "start", "doc_tokens")]
            for item in map(_Item, *columns, _read(batch, kind)):
                held.append(item)
                if len(held) >= items_per_shard:
                    pieces, held, sequence = _fill_windows(held, weights.value, capacity, sequence, keep)
                    yield _batch(pieces)
        pieces = []
        if held:
            pieces, held, sequence = _fill_windows(held, weights.value, capacity, sequence, keep)
        if last:
            pieces += _powers_of_two(held, sequence, keep)
        else:
            pieces += [(x.row, x.doc_id, x.start, len(x.ids), None, x.doc_tokens, None, None, x.ids.astype(kind).tobytes())
                       for x in held]
        yield _batch(pieces)

    return items.select(*_NAMES).mapInArrow(run, PIECE)


def _signed(items: DataFrame, weights, kind: str) -> DataFrame:
    """Items with the first of their terms in each order of ``Weights.places``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, terms, _ = _terms(_read(batch, kind))
            first = np.searchsorted(owner, np.arange(batch.num_rows))
            for k in range(MINIMA):
                batch = batch.append_column(
                    f"m{k}", pa.array(np.minimum.reduceat(weights.value.places[k][terms], first)))
            yield batch

    return items.mapInArrow(run, PIECE + "".join(f", m{k} long" for k in range(MINIMA)))


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    items_per_shard: int = ITEMS_PER_SHARD,
    tokens_per_task: int = TOKENS_PER_TASK,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A null or empty text has the end id alone. Repeated rows are packed each; a row without
    doc_id, too. Other columns are not read. No documents: no rows. ``ids`` is null unless
    asked for. Copies may be any share of the items: equal signatures are dealt over
    partitions by a hash of the row, and a shard is bounded by its number of items.
    """
    tokenizer = tokenizer or default_tokenizer()
    kind = id_type(tokenizer)
    spark = docs.sparkSession
    pieces = stage(tokenized(docs, tokenizer, kind, capacity, end_id, keep_ids), "retrieval-pieces")
    done, items = [pieces.where("sequence_id IS NOT NULL")], pieces.where("sequence_id IS NULL")
    n_items, tokens = items.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    weights = spark.sparkContext.broadcast(
        Weights(document_counts(items, kind), n_items, tokens / max(1, n_items)))
    round_ = 1
    while tokens:
        tasks = min(-(-tokens // tokens_per_task), MOST_TASKS)
        order = [*(f"m{k}" for k in range(MINIMA)), F.xxhash64(F.lit(round_), "row"), "row"]
        signed = _signed(items, weights, kind)
        dealt = signed.repartition(1) if tasks == 1 else signed.repartitionByRange(tasks, *order)
        packed = stage(
            _round(dealt.sortWithinPartitions(*order), weights, round_, tasks == 1, kind, capacity,
                   items_per_shard, keep_ids),
            f"retrieval-packed-{round_}")
        done.append(packed.where("sequence_id IS NOT NULL"))
        items = packed.where("sequence_id IS NULL")
        tokens = items.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        round_ += 1
    weights.unpersist()
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.drop("row")


def op11(spark, sf_dir) -> DataFrame:
    return pack(spread(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"))).drop("ids")


register("op11_retrieval_packing", op11)
