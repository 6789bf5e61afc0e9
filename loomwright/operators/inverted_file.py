"""Approximate nearest vectors: an inverted file of trained centroids with product-quantised codes.

Centroids and codebooks are trained on a sample of bounded size; every vector is indexed. A vector
goes to the list of its nearest centroid, and what is left of it is coded by one byte for each
few dimensions. A query reads the codes of the lists nearest to it and keeps its best; only these are
compared with it exactly. How many lists and how many exact comparisons a recall takes is
measured on the sample against the exact answer.

Lists near each other lie in blocks with their codes and vectors. A query is sent once to each
block that it reads from, with the code score that its best reach in the sample; what reaches it
is compared where it lies, and only the k best and a count leave the block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomwright.operators.topk import best_k
from loomwright.operators.vectors import SCORE_DECIMALS, unit_rows
from loomwright.storage import spread, stage

SAMPLE = 10_000
TRIALS = 200
TARGET = 0.97
MAX_LISTS = 4096
CODE_DIMENSIONS = 2
CODEWORDS = 256
CODEBOOK_SAMPLE = 4000
ROUNDS = 10
# A block holds as many rows as these bytes at 8 a dimension. Smaller sides are cut so that each core
# gets a few pairs of blocks, but not below the least rows.
BLOCK_BYTES = 64 << 20
LEAST_BLOCK = 1000
PAIRS_PER_CORE = 4
# Queries and vectors of one product of codes, and pairs of one exact comparison.
QUERY_STEP = 1024
DOC_STEP = 4096
PAIR_STEP = 65_536
# A block keeps this many times the expected candidates of a query, so that a crowd of equal codes stays bounded.
MOST_EXPECTED = 4
# Code scores are single: what is this little below a floor counts as reaching it.
FLOOR_MARGIN = 1e-5

_PRESENT = "embedding IS NOT NULL AND size(embedding) > 0"


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point by Euclidean distance."""
    half = (centres * centres).sum(axis=1) / 2
    out = np.empty(len(points), np.int64)
    step = max(1, 4_000_000 // len(centres))
    for at in range(0, len(points), step):
        out[at:at + step] = (points[at:at + step] @ centres.T - half).argmax(axis=1)
    return out


def _k_means(points: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds; a centre without points stays where it is."""
    centres = points[draw.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        owner = _nearest(points, centres)
        counts = np.bincount(owner, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        held = counts > 0
        centres[held] = sums[held] / counts[held, None]
    return centres


@dataclass
class Quantiser:
    """Centroids of the lists, and a codebook for each group of dimensions of what they leave."""

    centroids: np.ndarray
    codebooks: list[np.ndarray]

    def lists_of(self, vectors: np.ndarray) -> np.ndarray:
        return _nearest(vectors, self.centroids)

    def nearest_lists(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n lists whose centroids have the greatest inner product with each vector."""
        return np.argsort(-(vectors @ self.centroids.T), axis=1, kind="stable")[:, :n]

    def encode(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = vectors - self.centroids[lists]
        parts = np.split(rest, np.cumsum([b.shape[1] for b in self.codebooks])[:-1], axis=1)
        return np.stack([_nearest(p, b) for p, b in zip(parts, self.codebooks)], axis=1).astype(np.uint8)

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        parts = [b[codes[:, i]] for i, b in enumerate(self.codebooks)]
        return self.centroids[lists] + np.concatenate(parts, axis=1)


def train(sample: np.ndarray, lists: int, seed: int = 7) -> Quantiser:
    """A quantiser for unit vectors like those of the sample."""
    draw = np.random.default_rng(seed)
    centroids = _k_means(sample, lists, draw)
    rest = (sample - centroids[_nearest(sample, centroids)])[:CODEBOOK_SAMPLE]
    groups = np.array_split(np.arange(sample.shape[1]), -(-sample.shape[1] // CODE_DIMENSIONS))
    return Quantiser(centroids, [_k_means(rest[:, g], CODEWORDS, draw) for g in groups])


def calibrate(quantiser: Quantiser, sample: np.ndarray, k: int, target: float) -> tuple[int, int]:
    """How many lists hold, and how far down the codes' ranking stand, ``target`` of the k nearest
    of some sampled vectors among the sample."""
    asked = sample[:TRIALS]
    exact = asked @ sample.T
    best = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    lists = quantiser.lists_of(sample)
    place = np.argsort(quantiser.nearest_lists(asked, len(quantiser.centroids)), axis=1)
    probes = np.sort(np.take_along_axis(place, lists[best], axis=1).ravel()) + 1
    coded = asked @ quantiser.decode(lists, quantiser.encode(sample, lists)).T
    level = np.take_along_axis(coded, best, axis=1)
    depth = np.sort((coded[:, None, :] > level[:, :, None]).sum(axis=2).ravel()) + 1
    at = min(len(probes) - 1, math.ceil(target * len(probes)))
    return int(probes[at]), int(depth[at])


@dataclass
class Layout:
    """The blocks of the lists: the first and how many each list has, and the lists of each block."""

    first: np.ndarray
    pieces: np.ndarray
    members: list[np.ndarray]


def lay_out(centroids: np.ndarray, sizes: np.ndarray, rows: int, seed: int = 7) -> Layout:
    """Blocks of about ``rows`` vectors from lists near each other; a larger list is cut into several.

    No block has more than ``rows`` and one list of at most as many.
    """
    groups = _k_means(centroids, max(1, round(sizes.sum() / rows)), np.random.default_rng(seed))
    order = np.argsort(_nearest(centroids, groups), kind="stable")
    pieces = np.maximum(1, -(-sizes // rows))
    whole, cut = order[pieces[order] == 1], order[pieces[order] > 1]
    first = np.zeros(len(sizes), np.int64)
    # Whole lists one after the other: the block that the start of one falls into.
    first[whole] = np.unique((np.cumsum(sizes[whole]) - sizes[whole]) // rows, return_inverse=True)[1]
    n_whole = int(first[whole].max()) + 1 if len(whole) else 0
    first[cut] = n_whole + np.cumsum(pieces[cut]) - pieces[cut]
    members = [whole[first[whole] == b] for b in range(n_whole)]
    members += [np.array([at]) for at in cut for _ in range(pieces[at])]
    return Layout(first, pieces, members)


@dataclass
class _Shared:
    """What tasks of a search need: the quantiser, the layout and the codes of the sample."""

    quantiser: Quantiser
    layout: Layout
    sample_lists: np.ndarray
    sample: np.ndarray


def _first_of_each(groups: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the first n of their group, where groups follow each other."""
    starts = np.flatnonzero(np.diff(groups, prepend=-1))
    return np.arange(len(groups)) - np.repeat(starts, np.diff(starts, append=len(groups))) < n


class _Block:
    """The vectors of one block by list, to be compared with the queries that read some of its lists."""

    def __init__(self, shared: _Shared, docs: pa.Table):
        lists = docs.column("list").to_numpy().astype(np.int64)
        order = np.argsort(lists, kind="stable")
        docs, lists = docs.take(pa.array(order)), lists[order]
        self.lists = shared.layout.members[docs.column("block")[0].as_py()]
        self.ids = docs.column("doc_id").combine_chunks()
        self.vectors = unit_rows(docs.column("embedding"))
        codes = np.frombuffer(b"".join(docs.column("codes").to_pylist()), np.uint8).reshape(len(lists), -1)
        self._decoded = shared.quantiser.decode(lists, codes).astype(np.float32)
        self._starts, self._ends = np.searchsorted(lists, self.lists), np.searchsorted(lists, self.lists, "right")
        self._place = np.empty(len(lists), np.int64)  # in the order of ids
        self._place[np.argsort(self.ids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(lists))

    def _best(self, q: np.ndarray, d: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Rows of the n best of each query: score descending, id ascending."""
        order = np.lexsort((self._place[d], -scores, q))
        return order[_first_of_each(q[order], n)]

    def _candidates(self, asked: np.ndarray, floors: np.ndarray, reads: np.ndarray, depth: int):
        """Pairs of queries and vectors of their lists whose codes reach the floor, the ``depth`` best of each query."""
        found, held = [], 0

        def shortened():
            pairs = [np.concatenate(x) for x in zip(*found)]
            kept = self._best(*pairs, depth) if np.bincount(pairs[0]).max() > depth else slice(None)
            return tuple(x[kept] for x in pairs)

        for i, (start, end) in enumerate(zip(self._starts, self._ends)):
            readers = np.flatnonzero(reads[:, i])
            vectors = asked if len(readers) == len(asked) else asked[readers]
            for at in range(start, end if len(readers) else start, DOC_STEP):
                scores = vectors @ self._decoded[at:min(at + DOC_STEP, end)].T
                cells = np.flatnonzero(scores >= floors[readers, None])
                if len(cells):
                    q, d = np.divmod(cells, scores.shape[1])
                    found.append((readers[q], at + d, scores.ravel()[cells]))
                    held += len(cells)
                if held > QUERY_STEP * max(DOC_STEP, 2 * depth):
                    found = [shortened()]
                    held = len(found[0][0])
        return shortened()[:2] if found else None

    def nearest(self, queries: pa.Table, k: int, depth: int) -> Iterator[tuple]:
        """(rows of queries, rows of vectors, scores, compared), the count with the first row of a query alone."""
        asked = unit_rows(queries.column("embedding"))
        single = asked.astype(np.float32)
        floors = queries.column("floor").to_numpy().astype(np.float32)
        bits = np.frombuffer(b"".join(queries.column("reads").to_pylist()), np.uint8).reshape(len(asked), -1)
        reads = np.unpackbits(bits, axis=1, count=len(self.lists)).astype(bool)
        for at in range(0, len(asked), QUERY_STEP):
            part = slice(at, at + QUERY_STEP)
            pairs = self._candidates(single[part], floors[part], reads[part], depth)
            if pairs is None:
                continue
            q, d = pairs[0] + at, pairs[1]
            cosine = np.concatenate([
                (self.vectors[d[i:i + PAIR_STEP]] * asked[q[i:i + PAIR_STEP]]).sum(axis=1)
                for i in range(0, len(q), PAIR_STEP)])
            scores = np.round(cosine, SCORE_DECIMALS)
            best = self._best(q, d, scores, k)
            compared = np.where(_first_of_each(q[best], 1), np.bincount(q)[q[best]], 0)
            yield q[best], d[best], scores[best], compared


class InvertedFile:
    """Codes of all vectors by list, and the vectors for the last comparison."""

    def __init__(self, docs: DataFrame, k: int = 3, lists: int | None = None, target: float = TARGET,
                 sample: int = SAMPLE, seed: int = 7):
        """Index ``docs`` (doc_id, embedding) for searches of up to k neighbours.

        Null, empty and zero vectors are no neighbours. Of equal vectors only the k least ids
        can be in a result; the others are left out, so copies cannot crowd a list. The
        sample has the rows with the least hashes of their ids.
        """
        spark = docs.sparkSession
        self.k = k
        copies = Window.partitionBy("embedding").orderBy("doc_id")
        zero = F.forall("embedding", lambda x: x == 0)
        self.docs = stage(
            docs.where(_PRESENT).where(~zero).select("doc_id", "embedding")
            .withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy"),
            "inverted-vectors")
        self.size = self.docs.count()
        drawn = self.docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("embedding").toArrow()
        self.quantiser, self.probes, self.depth = None, 0, 0
        if not self.size:
            return
        vectors = unit_rows(drawn.column("embedding"))
        self._dimensions = vectors.shape[1]
        n_lists = lists or max(1, min(round(math.sqrt(self.size)), MAX_LISTS, len(vectors) // 8))
        self.quantiser = train(vectors, n_lists, seed)
        self.probes, depth = calibrate(self.quantiser, vectors, k, target)
        # Ranks among the sample are ranks among its share of all vectors.
        self.depth = max(2 * k, math.ceil(depth * self.size / len(vectors)))
        self.level = max(2 * k, depth)
        handle = spark.sparkContext.broadcast(self.quantiser)
        self.codes = stage(self._coded(handle), "inverted-codes")
        sizes = np.zeros(len(self.quantiser.centroids), np.int64)
        for row in self.codes.groupBy("list").count().collect():
            sizes[row["list"]] = row["count"]
        layout = lay_out(self.quantiser.centroids, sizes, self._block_rows(self.size), seed)
        of_sample = self.quantiser.lists_of(vectors)
        coded = self.quantiser.decode(of_sample, self.quantiser.encode(vectors, of_sample))
        self._layout = layout
        self._handle = spark.sparkContext.broadcast(_Shared(self.quantiser, layout, of_sample, coded.astype(np.float32)))

    def _block_rows(self, rows: int) -> int:
        """Rows of a block of a side: few blocks, so that what meets them all travels seldom."""
        cores = self.docs.sparkSession.sparkContext.defaultParallelism
        each = math.ceil(rows / math.ceil(math.sqrt(PAIRS_PER_CORE * cores)))
        return max(1, min(max(each, LEAST_BLOCK), BLOCK_BYTES // (8 * self._dimensions)))

    def _coded(self, handle) -> DataFrame:
        kind = self.docs.schema
        schema = T.StructType([
            T.StructField("list", T.IntegerType()), kind["doc_id"], T.StructField("codes", T.BinaryType()), kind["embedding"]])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = unit_rows(batch.column("embedding"))
                lists = handle.value.lists_of(vectors)
                codes = handle.value.encode(vectors, lists)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int32()), batch.column("doc_id"),
                     pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("embedding")],
                    ["list", "doc_id", "codes", "embedding"])

        return spread(self.docs).mapInArrow(run, schema)

    def _probed(self, queries: DataFrame) -> DataFrame:
        """Queries with a floor for codes and, for each block that has lists they read, a bit for each of its lists.

        The floor is the score of the ``level``-th best code of the sample in these lists; without as
        many there is none.
        """
        handle, probes, level = self._handle, self.probes, self.level
        part = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("reads", T.BinaryType())])
        schema = T.StructType([
            queries.schema["query_id"], queries.schema["embedding"],
            T.StructField("floor", T.DoubleType()), T.StructField("parts", T.ArrayType(part))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shared = handle.value
            members = shared.layout.members
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    rows = batch.slice(at, 512)
                    vectors, n = unit_rows(rows.column("embedding")), rows.num_rows
                    reads = np.zeros((n, len(shared.quantiser.centroids)), bool)
                    np.put_along_axis(reads, shared.quantiser.nearest_lists(vectors, probes), True, axis=1)
                    floors = np.full(n, -np.inf)
                    if len(shared.sample) > level:
                        codes = vectors.astype(np.float32) @ shared.sample.T
                        if not reads.all():
                            codes[~reads[:, shared.sample_lists]] = -np.inf
                        last = codes.shape[1] - level
                        floors = np.partition(codes, last, axis=1)[:, last].astype(np.float64) - FLOOR_MARGIN
                    met = [np.flatnonzero(reads[:, lists].any(axis=1)) for lists in members]
                    asking = np.concatenate(met)
                    order = np.argsort(asking, kind="stable")
                    bits = [b.tobytes() for lists, q in zip(members, met) for b in np.packbits(reads[np.ix_(q, lists)], axis=1)]
                    parts = pa.StructArray.from_arrays(
                        [pa.array(np.repeat(np.arange(len(met)), [len(q) for q in met]), pa.int32()), pa.array(bits, pa.binary())],
                        ["block", "reads"]).take(pa.array(order))
                    ends = np.concatenate([[0], np.cumsum(np.bincount(asking, minlength=n))])
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("query_id"), rows.column("embedding"), pa.array(floors),
                         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)],
                        ["query_id", "embedding", "floor", "parts"])

        return queries.mapInArrow(run, schema)

    def _compared(self, asked: DataFrame, schema: T.StructType) -> DataFrame:
        """The k best of each query within each block, and how many it was compared with there."""
        spark, layout = asked.sparkSession, self._layout
        parts = asked.select("query_id", "embedding", "floor", F.explode("parts").alias("part"))
        # Both tables are small: a row for each list, of which there are at most MAX_LISTS, and one for each block.
        places = F.broadcast(spark.createDataFrame(
            [(i, int(b), int(n)) for i, (b, n) in enumerate(zip(layout.first, layout.pieces))], "list int, first int, pieces int"))
        deals = F.broadcast(parts.groupBy("part.block").agg(
            F.ceil(F.count("*") / self._block_rows(asked.count())).cast("int").alias("deals")))
        left = parts.select("query_id", "embedding", "floor", "part.*").join(deals, "block").withColumn(
            "deal", F.pmod(F.xxhash64("query_id", "embedding"), F.col("deals")).cast("int")).drop("deals")
        block = (F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("int")
        right = self.codes.where("doc_id IS NOT NULL").join(places, "list").withColumn("block", block).drop(
            "first", "pieces").join(deals, "block").withColumn("deal", F.explode(F.expr("sequence(0, deals - 1)"))).drop("deals")
        handle, k, depth = self._handle, self.k, MOST_EXPECTED * self.depth
        kinds = to_arrow_schema(schema)

        def run(queries: pa.Table, docs: pa.Table) -> pa.Table:
            if not queries.num_rows or not docs.num_rows:
                return kinds.empty_table()
            block, names = _Block(handle.value, docs), queries.column("query_id").combine_chunks()
            found = [
                pa.table([names.take(pa.array(q)), block.ids.take(pa.array(d)), pa.array(scores), pa.array(compared)], schema=kinds)
                for q, d, scores, compared in block.nearest(queries, k, depth)]
            return pa.concat_tables(found) if found else kinds.empty_table()

        left, right = left.toDF(*left.columns), right.toDF(*right.columns)
        return left.groupBy("block", "deal").cogroup(right.groupBy("block", "deal")).applyInArrow(run, schema)

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score, rank, compared): the k nearest of each query (query_id, embedding).

        ``compared`` is the number of vectors the query was compared with exactly. Equal query
        vectors are searched once. Null, empty and zero query vectors find nothing.
        """
        queries = queries.where(_PRESENT).where(~F.forall("embedding", lambda x: x == 0)).select("query_id", "embedding")
        schema = T.StructType([
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("doc_id", self.docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
        if self.quantiser is None:
            return queries.sparkSession.createDataFrame([], schema).selectExpr("*", "1 AS rank", "0L AS compared")
        asked = stage(
            self._probed(queries.groupBy("embedding").agg(F.min("query_id").alias("query_id")).where("query_id IS NOT NULL")),
            "inverted-queries")
        found = self._compared(asked, schema.add("compared", T.LongType()))
        counted = found.withColumn("compared", F.sum("compared").over(Window.partitionBy("query_id")))
        answers = best_k(counted, self.k)
        asked = asked.select("query_id", "embedding")
        members = queries.join(asked.withColumnRenamed("query_id", "searched"), "embedding").select("query_id", "searched")
        return members.join(answers.withColumnRenamed("query_id", "searched"), "searched").select(
            "query_id", "doc_id", "score", "rank", "compared")


def approximate_topk(queries: DataFrame, docs: DataFrame, k: int = 3, **settings) -> DataFrame:
    """The k nearest of each query by an inverted file that is built for it."""
    return InvertedFile(docs, k, **settings).search(queries)
