"""Near-duplicates by MinHash: universal hash minima, banding, verification, components.

1. Texts with equal shingle sets form classes; one member, the least doc_id, stands for each.
2. A signature holds the least value of many universal hashes. Bands of it are bucket keys.
3. Within a bucket, signatures are compared; what they link forms clusters.
4. Within a cluster, full shingle sets are compared; what they link forms the components.

Steps 3 and 4 must lose no link and may not pair everybody with everybody. Each group has a hub,
the member that meets most others; all members are compared with it. Those it does not link are
then compared with all members, in blocks of bounded size, and of each block only a
spanning forest of its links is passed on, which is all that components need.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomwright.llm.common import mix, narrow, register, text_chunks, word_hashes
from loomwright.llm.components import connected_components
from loomwright.queries.base import table
from loomwright.storage import stage

ROWS = 5
#: Chance that two texts just at the limit share no band; the number of bands follows from it.
MISS = 1e-6
BLOCK = 128
SEED = 20_240_601


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; fewer words count as one shingle."""
    chained = np.full(len(hashes), 0x51ED270B0A1F39C1, np.uint64)
    n = len(hashes)
    for j in range(k):
        upto = max(n - j, 0)
        chained[:upto] = mix(chained[:upto] * np.uint64(0xD1342543DE82EF95) + hashes[j:])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(chained[a:b - k + 1]))
        elif b > a:
            whole = np.full(1, 0x2545F4914F6CDD1D, np.uint64)
            for h in hashes[a:b]:
                whole = mix(whole * np.uint64(0xD1342543DE82EF95) + h)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift functions: a strongly universal family of 32-bit hashes."""
    draw = np.random.Generator(np.random.PCG64(SEED))
    a = draw.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], draw.integers(0, 1 << 63, count, dtype=np.uint64)[:, None]


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = family
    keys = shingles >> np.uint64(32)
    least = np.full(len(a), 1 << 32, np.uint64)
    for i in range(0, len(keys), 1024):
        values = a * keys[None, i:i + 1024]
        values += b
        values >>= np.uint64(32)
        np.minimum(least, values.min(axis=1), out=least)
    return least


SKETCH = (
    "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"
)


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Set size, two hashes of the whole set, band keys and signature bytes of each text."""
    bands = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _family(bands * ROWS)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch, data, offsets in text_chunks(batches):
            sets = shingle_sets(*word_hashes(data, offsets), k)
            keys, bytes_ = [], []
            for s in sets:
                if not len(s):
                    keys.append(None)
                    bytes_.append(None)
                    continue
                least = signature(s, family)
                acc = salt.copy()
                for column in least.reshape(bands, ROWS).T:
                    acc = mix(acc * np.uint64(0xD1342543DE82EF95) + column)
                keys.append(acc.view(np.int64))
                bytes_.append(least.astype(np.uint8).tobytes())

            def total(values: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
                sums = np.array([values(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                return pa.array(sums.view(np.int64))

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    total(lambda s: s), total(lambda s: mix(s ^ np.uint64(0x6A09E667F3BCC909))),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, SKETCH)


# ---- spanning links within groups ----

Matrix = Callable[[list[bytes], list[bytes]], np.ndarray]


def _signature_links(percent: int) -> Matrix:
    """Equal signature bytes, with five standard deviations of room below the limit."""
    n, p = bands_for(percent) * ROWS, percent / 100
    need = math.floor(n * p - 5.2 * math.sqrt(n * p * (1 - p)))

    def linked(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a = np.frombuffer(b"".join(left), np.uint8).reshape(len(left), n)
        b = np.frombuffer(b"".join(right), np.uint8).reshape(len(right), n)
        return np.stack([(row == b).sum(axis=1) >= need for row in a])

    return linked


def _set_links(percent: int) -> Matrix:
    """100 * intersection >= percent * union, exactly."""

    def side(sets: list[np.ndarray], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[place] == values
        order = np.argsort(place[hit], kind="stable")
        return owner[hit][order], place[hit][order]

    def linked(left: list[bytes], right: list[bytes]) -> np.ndarray:
        a = [np.frombuffer(x, np.uint64) for x in left]
        b = [np.frombuffer(x, np.uint64) for x in right]
        sizes = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])
        both = np.zeros((len(a), len(b)))
        shared = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), True)
        if len(shared):
            sides = [side(a, shared), side(b, shared)]
            for first in range(0, len(shared), 8192):
                dense = []
                for (owner, place), count in zip(sides, (len(a), len(b))):
                    lo, hi = np.searchsorted(place, [first, first + 8192])
                    block = np.zeros((count, min(8192, len(shared) - first)), np.float32)
                    block[owner[lo:hi], place[lo:hi] - first] = 1
                    dense.append(block)
                both += dense[0] @ dense[1].T
        return 100 * both >= percent * (sizes - both)

    return linked


def spanning_links(members: DataFrame, matrix: Matrix, label: str, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect whatever ``matrix`` links within each group.

    ``members`` are (g, id, weight, payload), written already. No group meets in one task: the
    hub's payload is joined to the members, and the rest goes in blocks.
    """
    stats = members.groupBy("g").agg(
        F.count("*").alias("n"), F.max(F.struct("weight", (-F.col("id")).alias("low"))).alias("top"))
    stats = stats.select("g", "n", (-F.col("top.low")).alias("hub"))
    hubs = members.join(stats, "g").where("id = hub").select(
        "g", "n", "hub", F.col("payload").alias("hub_payload")).dropDuplicates(["g"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub, own = batch["hub_payload"].to_pylist(), batch["payload"].to_pylist()
            linked = [bool(matrix([x], [y])[0, 0]) for x, y in zip(hub, own)]
            yield pa.RecordBatch.from_arrays(
                [batch["g"], batch["n"], batch["id"], batch["hub"], pa.array(linked, pa.bool_())],
                ["g", "n", "id", "hub", "linked"],
            )

    starred = stage(
        members.join(hubs, "g").where("id <> hub").select(
            "g", "n", "id", "hub", "payload", "hub_payload"
        ).mapInArrow(star, "g long, n long, id long, hub long, linked boolean"),
        f"{label}-hubs",
    )
    direct = starred.where("linked").select(F.col("id").alias("a"), F.col("hub").alias("b"))

    rest = starred.where("NOT linked AND n > 2").select("g", "n", "id")
    open_groups = rest.groupBy("g").agg(F.count("*").alias("u"), F.first("n").alias("n")).select(
        "g", F.ceil(F.col("u") / block).alias("nu"), F.ceil(F.col("n") / block).alias("na"))
    open_groups = stage(open_groups, f"{label}-open")
    wide = members.join(open_groups, "g").select("g", "id", "payload", "nu", "na")
    own = F.xxhash64("id")
    left = (
        wide.join(rest.select("g", "id"), ["g", "id"], "left_semi")
        .withColumn("ub", F.pmod(own, F.col("nu")))
        .withColumn("ab", F.explode(F.sequence(F.lit(0).cast("long"), F.col("na") - 1)))
        .withColumn("rest", F.lit(True))
    )
    right = (
        wide.withColumn("ab", F.pmod(own, F.col("na")))
        .withColumn("ub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nu") - 1)))
        .withColumn("rest", F.lit(False))
    )
    columns = ["g", "ub", "ab", "rest", "id", "payload"]

    def forest(group: pa.Table) -> pa.Table:
        ids, payload = group["id"].to_numpy(), group["payload"].to_pylist()
        rest_here = group["rest"].to_numpy(zero_copy_only=False).astype(bool)
        rows, columns_ = np.flatnonzero(rest_here), np.flatnonzero(~rest_here)
        a, b = [], []
        if len(rows) and len(columns_):
            linked = matrix([payload[i] for i in rows], [payload[i] for i in columns_])
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for i, j in np.argwhere(linked).tolist():
                x, y = int(ids[rows[i]]), int(ids[columns_[j]])
                if find(x) != find(y):
                    root[find(x)] = find(y)
                    a.append(x)
                    b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = left.select(columns).unionByName(right.select(columns))
    return direct.unionByName(blocks.groupBy("g", "ub", "ab").applyInArrow(forest, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Texts of equal shingle sets are linked, and texts with 100 * intersection >= percent * union.
    A text without words is linked with nothing. Repeated rows share a component; a row
    without doc_id takes the component of its text, null if no equal text has an id. Columns
    other than doc_id and text are not read.
    """
    docs = narrow(docs, "doc_id", "text")
    sketched = stage(sketches(docs, k, percent), "minhash-sketches")
    classes = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"),
        F.first("signature").alias("payload"))
    classes = stage(classes, "minhash-classes")

    # Buckets with the same members in several bands are compared once.
    placed = classes.select(F.explode("bands").alias("g"), F.col("rep").alias("id"))
    several = (
        placed.groupBy("g").agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"),
            F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
        .where("n > 1").groupBy("n", "x", "y").agg(F.min("g").alias("g")).select("g", "n")
    )
    buckets = stage(placed.join(several, "g").select("g", "n", "id"), "minhash-buckets")
    weights = buckets.groupBy("id").agg(F.sum("n").alias("weight"))
    weights = stage(weights, "minhash-weights")
    signed = weights.join(classes, weights["id"] == classes["rep"]).select("id", "weight", "payload")
    members = stage(buckets.select("g", "id").join(signed, "id"), "minhash-members")
    similar = spanning_links(members, _signature_links(percent), "minhash-signatures")
    clusters = connected_components(similar, "minhash-clusters")

    # Full sets of clustered texts. An id that is repeated with another text is told by its set.
    chosen = (
        clusters.join(weights, clusters["node"] == weights["id"])
        .join(classes.select("rep", "set_a", "set_b"), F.col("id") == F.col("rep"))
        .select(F.col("component").alias("g"), "id", "weight", "set_a", "set_b")
    )

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            sets = shingle_sets(*word_hashes(data, offsets), k)
            a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            same = pa.array(a == batch["set_a"].to_numpy())
            out = pa.RecordBatch.from_arrays(
                [batch["g"], batch["id"], batch["weight"],
                 pa.array([s.tobytes() for s in sets], pa.binary())], ["g", "id", "weight", "payload"])
            yield out.filter(same)

    texts = docs.withColumnRenamed("doc_id", "id").join(chosen.hint("merge"), "id").select(
        "g", "id", "weight", "set_a", F.col("text").cast("string"))
    sets = stage(
        texts.mapInArrow(full, "g long, id long, weight long, payload binary"), "minhash-sets")
    confirmed = spanning_links(sets, _set_links(percent), "minhash-confirmed")
    found = connected_components(confirmed, "minhash-components")

    labelled = classes.select("set_a", "set_b", "rep").join(
        found, F.col("rep") == F.col("node"), "left"
    ).select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    result = sketched.select("doc_id", "n_shingles", "set_a", "set_b").join(
        labelled, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one whose id is the least; the columns of ``docs``.

    Of rows that repeat a kept id one stays. Rows without an id stay, since nothing can name
    the document that would stand for them.
    """
    judged = stage(near_duplicates(docs, k, percent), "minhash-verdicts")
    # Shuffled at every size: the list grows with the corpus and must not be broadcast.
    dropped = judged.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    left = docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    repeated = stage(
        judged.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
        .where("n > 1").select("doc_id"), "minhash-repeated")
    if repeated.isEmpty():
        return left
    single = left.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    first = left.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return single.unionByName(first)


def op1(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS ws
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3
    THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)] END) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id
  WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, c = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)"""

register("op1_minhash", op1, ORACLE)
