"""Language-model scoring: a log-frequency Bloom filter of quantised n-gram counts.

Counting: tasks count the words and word pairs of their texts and send each shard of the hash space
one packed row. A shard adds them up, so that counts are exact whatever the input's size.
Filter: a pair's count c is stored as 1 + floor(log c / log BASE) entries, numbered from 1;
a reader probes 1, 2, ... until one is missing, which gives the count within a factor of BASE.
Each shard fills a segment of its own, with room for all its pairs. Segments that have at most
``max_bytes`` together are broadcast to the workers. Larger ones stay in the staged table and the
probes travel: each block of texts sends every shard its distinct pairs, the shard's segment
answers them with levels, and the answers go back to the block. Both ways probe the same segments,
so that scores are the same, and the filter answers every pair at any size.
Words: exact counts, by a broadcast of at most ``max_frequent`` words and a join for the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loomwright.llm.common import mix, narrow, register, text_chunks, word_hashes
from loomwright.queries.base import table
from loomwright.storage import stage

BASE = 1.5
PROBES = 4
FIRST_PROBES = 8  # of level 1, which tells seen pairs from unseen ones
MAX_BYTES = 128 << 20
MAX_FREQUENT = 1_000_000
CHARS_PER_SHARD = 8_000_000
MAX_SHARDS = (1 << 24) - 1
FLUSH = 2_000_000
BLOCK_BYTES = 2 << 20  # of text whose distinct pairs travel together
LAMBDA = 0.6

END = np.uint64(0xE0D0E0D0E0D0E0D1)  # the end token, and what precedes the first word
_PAIR = np.uint64(0x9FB21C651E98DF25)


def held_out(doc_id) -> F.Column:
    """Documents kept from training: crc32 of the id as text leaves 1 by division by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, texts one after the other, each with its end; their previous tokens;
    the token offsets by text."""
    hashes, bounds = word_hashes(data, offsets)
    n = len(offsets) - 1
    tokens = np.insert(hashes, bounds[1:], END)
    places = bounds + np.arange(n + 1)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[places[:-1]] = END
    return tokens, before, places


_LOW = np.uint64((1 << 40) - 1)
_SHIFT = np.uint64(40)


def pair_hashes(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + tokens)


def addresses(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shard (24 bits) and key (40 bits) of each pair; sorted addresses are sorted by shard."""
    return ((hashes >> _SHIFT) % np.uint64(shards)) << _SHIFT | (hashes & _LOW)


def cut_by_shard(asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shards that sorted addresses have, and the bounds of each one's part."""
    shards, first = np.unique(asked >> _SHIFT, return_index=True)
    return shards.astype(np.int64), np.r_[first, len(asked)]


def _sum_by(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


# ---- counting ----

# Words keep 64 bits. A pair keeps its shard, which its upper 24 bits choose, and its lower 40 bits
# there. Shards stay as large as they are when the corpus grows, so that two pairs of one shard share
# 40 bits about as rarely (10^-6 of a million pairs) in a corpus of any size.
PACKED = "shard long, words binary, word_counts binary, pairs binary, pair_counts binary"


def _packed(words, word_counts, pairs, pair_counts, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of one task's counts, one for each shard that has any: words by hash modulo, pairs
    (sorted) by their addresses."""
    word_shard = (words % np.uint64(shards)).astype(np.int64)
    by_word = np.argsort(word_shard, kind="stable")
    word_shard = word_shard[by_word]
    pair_shard = (pairs >> _SHIFT).astype(np.int64)
    present = np.union1d(word_shard, pair_shard)
    words, word_counts = words[by_word], word_counts[by_word].astype(np.int64)
    pair_counts = pair_counts.astype(np.int64)
    cuts = [np.searchsorted(of, present, side=side) for of in (word_shard, pair_shard) for side in ("left", "right")]
    rows = [
        (s, words[a:b].tobytes(), _pack_counts(word_counts[a:b]), _pack40(pairs[c:d]), _pack_counts(pair_counts[c:d]))
        for s, a, b, c, d in zip(present.tolist(), *cuts)
    ]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] + [pa.binary()] * 4)],
            ["shard", "words", "word_counts", "pairs", "pair_counts"],
        )


def _pack40(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _pack_counts(counts: np.ndarray) -> bytes:
    """One byte each; 255 announces eight bytes at the end, in order."""
    large = counts >= 255
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def _unpack_counts(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    large = counts == 255
    counts[large] = np.frombuffer(raw, "<i8", int(large.sum()), n)
    return counts


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's range; 0 for level 0."""
    return np.where(levels > 0, np.sqrt(BASE) ** (2 * levels - 1), 0.0) if len(levels) else levels * 1.0


def _bits(keys: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    """Places of the bits of entry ``level`` of each key, by double hashing."""
    first = mix(keys + np.full(1, level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    second = mix(first ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    steps = np.arange(FIRST_PROBES if level == 1 else PROBES, dtype=np.uint64)[:, None]
    return (first + steps * second) % np.asarray(size, np.uint64)


def fill_segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A segment with all entries of these keys, half full."""
    levels = levels_of(counts)
    entries = FIRST_PROBES * len(levels) + PROBES * int((levels - 1).sum())
    size = max(64, math.ceil(entries / math.log(2) / 8) * 8)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max()) + 1 if len(levels) else 1):
        bits[_bits(keys[levels >= level], level, size).ravel().astype(np.int64)] = True
    return np.packbits(bits)


class Filter:
    """The joined segments. An address's segment is that of its shard."""

    def __init__(self, segments: dict[int, bytes], shards: int):
        sizes = np.array([max(8, len(segments.get(s, b""))) for s in range(shards)], np.int64)
        self.bytes = np.zeros(int(sizes.sum()), np.uint8)
        self.first = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.uint64) * np.uint64(8)
        self.size = (sizes * 8).astype(np.uint64)
        for s, raw in segments.items():
            at = int(self.first[s]) // 8
            self.bytes[at:at + len(raw)] = np.frombuffer(raw, np.uint8)

    def levels(self, asked: np.ndarray) -> np.ndarray:
        """Quantised counts by repeated membership probes, for all addresses at once."""
        out = np.zeros(len(asked), np.int64)
        left, level = np.arange(len(asked)), 1
        shard, keys = (asked >> _SHIFT).astype(np.int64), asked & _LOW
        while len(left):
            s = shard[left]
            places = _bits(keys[left], level, self.size[s]) + self.first[s]
            byte = self.bytes[(places >> np.uint64(3)).astype(np.int64)]
            there = ((byte >> (7 - (places & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)
            left = left[there]
            out[left] = level
            level += 1
        return out


COUNTED = "shard long, words binary, word_counts binary, segment binary"


def train(docs: DataFrame) -> tuple[DataFrame, int]:
    """Shard rows with exact word counts and a filter segment of all pairs; the number of shards.

    ``docs`` has text and training (boolean). The shards grow with the characters, so
    that the rows of one stay small; hashes spread evenly, and a frequent word or pair is one
    entry in each task's rows, however often it stands there.
    """
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    shards = min(max(8, math.ceil(chars / CHARS_PER_SHARD)), MAX_SHARDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            w = _sum_by(np.concatenate([x[0] for x in words]), np.concatenate([x[1] for x in words]))
            p = _sum_by(np.concatenate([x[0] for x in pairs]), np.concatenate([x[1] for x in pairs]))
            words.clear()
            pairs.clear()
            yield from _packed(*w, *p, shards)

        for batch, data, offsets in text_chunks(batches):
            tokens, before, _ = token_hashes(data, offsets)
            words.append(_sum_by(tokens, None))
            pairs.append(_sum_by(addresses(pair_hashes(before, tokens), shards), None))
            held += len(pairs[-1][0])
            if held > FLUSH:
                yield from flush()
                held = 0
        if words:
            yield from flush()

    def add_up(group: pa.Table) -> pa.Table:
        def counts_of(column: str, keys: list[bytes], width: int) -> np.ndarray:
            return np.concatenate([
                _unpack_counts(c, len(k) // width) for c, k in zip(group[column].to_pylist(), keys)])

        packs = group["words"].to_pylist()
        words, word_counts = _sum_by(
            np.frombuffer(b"".join(packs), np.uint64), counts_of("word_counts", packs, 8))
        packs = group["pairs"].to_pylist()
        pairs, pair_counts = _sum_by(_unpack40(b"".join(packs)), counts_of("pair_counts", packs, 5))
        return pa.table({
            "shard": group["shard"][:1], "words": pa.array([words.tobytes()], pa.binary()),
            "word_counts": pa.array([_pack_counts(word_counts)], pa.binary()),
            "segment": pa.array([fill_segment(pairs, pair_counts).tobytes()], pa.binary()),
        })

    training = docs.where("training").select(F.col("text").cast("string"))
    counted = training.mapInArrow(count, PACKED).groupBy("shard").applyInArrow(add_up, COUNTED)
    return stage(counted, "lm-counts"), shards


# ---- scoring ----

SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
    "rest array<struct<times: bigint, w: bigint, n_w: bigint, v: bigint, n_v: bigint, seen: double>>"
)


def blocks_of(docs: DataFrame) -> DataFrame:
    """Rows of whole texts with their ids, at most BLOCK_BYTES of text together (or one text),
    compressed. A block's number is that of its first row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
        for batch, _, _ in text_chunks(batches, limit=BLOCK_BYTES):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block", "texts"])
            row += len(batch)

    return stage(docs.mapInArrow(pack, "block long, texts binary"), "lm-blocks")


def block_texts(raw: pa.Scalar) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The rows of a block, their UTF-8 bytes and offsets."""
    return next(text_chunks(iter([pa.ipc.open_stream(raw.as_buffer()).read_next_batch()]), limit=1 << 62))


def routed_levels(blocks: DataFrame, segments: DataFrame, shards: int) -> DataFrame:
    """Levels of the distinct pairs of each block (block, shard, levels), in the order of their
    addresses: probes go to the segment of their shard, and only its answers come back.

    A pair travels once from a block, however often it stands there, so that a shard gets no more
    probes for a hot pair than there are blocks.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch["block"].to_pylist(), batch["texts"]):
                _, data, offsets = block_texts(raw)
                tokens, before, _ = token_hashes(data, offsets)
                asked = np.unique(addresses(pair_hashes(before, tokens), shards))
                present, cuts = cut_by_shard(asked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(present), block)), pa.array(present),
                     pa.array([_pack40(asked[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["block", "shard", "keys"])

    def probe(asked: pa.Table, segment: pa.Table) -> pa.Table:
        keys = asked["keys"].to_pylist()
        filter_ = Filter({0: raw for raw in segment["segment"].to_pylist()}, 1)
        levels = np.minimum(filter_.levels(_unpack40(b"".join(keys))), 255).astype(np.uint8)
        cuts = np.r_[0, np.cumsum([len(k) // 5 for k in keys], dtype=np.int64)]
        return pa.table({
            "block": asked["block"], "shard": asked["shard"],
            "levels": pa.array([levels[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    asked = blocks.mapInArrow(ask, "block long, shard long, keys binary")
    return asked.groupBy("shard").cogroup(segments.groupBy("shard")).applyInArrow(
        probe, "block long, shard long, levels binary")


def score(docs: DataFrame, max_bytes: int = MAX_BYTES, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` interpolates the pair's relative frequency with the word's: LAMBDA * c(v, w) / c(v)
    + (1 - LAMBDA) * (c(w) + 0.5) / (N + 0.5 * (V + 1)), with exact word counts and a pair count
    within a factor of sqrt(BASE). Neither bound leaves anything out or changes a score: segments
    beyond ``max_bytes`` are probed where they lie, and words beyond ``max_frequent`` are ``rest``,
    which joins look up. Null or empty texts have the end token alone. A row without doc_id is trained on. Without training
    texts every count is 0. Repeated rows are counted and scored each.
    """
    spark = docs.sparkSession
    docs = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("training", ~held_out(F.col("doc_id")))
    counted, shards = train(docs)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch["words"], batch["word_counts"]):
                keys = np.frombuffer(words.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(_unpack_counts(counts.as_py(), len(keys)))], ["w", "c"])

    totals = counted.select("words", "word_counts").mapInArrow(unpack, "w long, c long")
    # The frequent words: all above the least count that leaves no more than the bound.
    by_count = totals.groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(
        F.count("*").alias("n"), F.sum("c").alias("sum")).orderBy(F.desc("c")).collect()
    n_train, n_types = sum(r["sum"] for r in by_count), sum(r["n"] for r in by_count)
    cut, taken = 100_001, 0
    for r in by_count:
        if taken + r["n"] > max_frequent:
            break
        taken, cut = taken + r["n"], r["c"]
    frequent = totals.where(F.col("c") >= cut).toArrow()
    keys = frequent["w"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    lexicon = spark.sparkContext.broadcast((keys[order], frequent["c"].to_numpy()[order]))
    all_known = cut <= 1
    log_total = math.log10(n_train + 0.5 * (n_types + 1)) if n_train else math.log10(0.5)
    total = n_train + 0.5 * (n_types + 1)

    def scored_rows(batch, row, tokens, before, hashes, places, level) -> pa.RecordBatch:
        """Rows numbered from ``row`` of the texts of ``batch``, given the levels of their pairs."""
        known_keys, known_counts = lexicon.value
        types, inverse = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(known_keys, types), max(len(known_keys) - 1, 0))
        found = known_keys[at] == types if len(known_keys) else np.zeros(len(types), bool)
        counts = np.where(found, known_counts[at], 0) if len(known_keys) else np.zeros(len(types), np.int64)
        base = np.where(found, np.log10(counts + 0.5), 0.0)[inverse]
        if all_known:
            base[~found[inverse]] = math.log10(0.5)
        n = len(places) - 1
        starts = places[:-1]
        end_at = np.searchsorted(types, END)

        def now_and_before(of_types: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            now = of_types[inverse]
            previous = np.empty_like(now)
            previous[1:] = now[:-1]
            previous[starts] = of_types[end_at]
            return now, previous

        now, previous = now_and_before(counts)
        known_here, known_before = now_and_before(found)
        seen = count_of(level)
        ask_word = ~known_here & (not all_known)
        ask_before = ~known_before & (not all_known) & (level > 0)
        late = ask_word | ask_before
        share = np.divide(seen, previous, out=np.zeros_like(seen), where=previous > 0)
        unigram = np.minimum((now + 0.5) / total, 1.0)
        p = LAMBDA * np.minimum(share, 1.0) + (1 - LAMBDA) * unigram
        # What waits for a join, each pair of a text once.
        which = np.flatnonzero(late)
        owner = np.searchsorted(places, which, side="right") - 1
        order = np.lexsort((hashes[which], owner))
        which, owner = which[order], owner[order]
        new = np.ones(len(which), bool)
        new[1:] = (hashes[which[1:]] != hashes[which[:-1]]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        times = np.diff(first, append=len(which))
        which, cuts = which[first], np.searchsorted(owner[first], np.arange(n + 1))

        def asked(values: np.ndarray, ask: np.ndarray) -> pa.Array:
            return pa.array(values[which].view(np.int64), mask=~ask[which])

        rest = pa.StructArray.from_arrays(
            [pa.array(times.astype(np.int64)), asked(tokens, ask_word), pa.array(now[which]),
             asked(before, ask_before), pa.array(previous[which]), pa.array(seen[which])],
            ["times", "w", "n_w", "v", "n_v", "seen"])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(row, row + n)), batch["doc_id"], batch["held_out"],
                pa.array(np.diff(places)), pa.array(np.add.reduceat(known_here.astype(np.int64), starts)),
                pa.array(np.add.reduceat(base, starts)),
                pa.array(np.add.reduceat(np.where(late, 0.0, np.log10(p)), starts)),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), rest),
            ],
            ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest"],
        )

    def probe_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
        for batch, data, offsets in text_chunks(batches):
            tokens, before, places = token_hashes(data, offsets)
            hashes = pair_hashes(before, tokens)
            level = shared.value.levels(addresses(hashes, shards))
            yield scored_rows(batch, row, tokens, before, hashes, places, level)
            row += len(batch)

    def take_answers(block: pa.Table, answers: pa.Table) -> pa.Table:
        batch, data, offsets = block_texts(block["texts"][0])
        tokens, before, places = token_hashes(data, offsets)
        hashes = pair_hashes(before, tokens)
        _, inverse = np.unique(addresses(hashes, shards), return_inverse=True)
        raw = b"".join(answers.sort_by("shard")["levels"].to_pylist())
        level = np.frombuffer(raw, np.uint8).astype(np.int64)[inverse]
        return pa.Table.from_batches(
            [scored_rows(batch, block["block"][0].as_py(), tokens, before, hashes, places, level)])

    texts = docs.select("doc_id", (~F.col("training")).alias("held_out"), "text")
    segments = counted.select("shard", "segment")
    needed = segments.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    if needed <= max_bytes:
        shared = spark.sparkContext.broadcast(
            Filter({r["shard"]: bytes(r["segment"]) for r in segments.collect()}, shards))
        scored = stage(texts.mapInArrow(probe_here, SCORED), "lm-scored")
        shared.unpersist()
    else:
        blocks = blocks_of(texts)
        answered = routed_levels(blocks, segments, shards)
        scored = stage(
            blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(take_answers, SCORED),
            "lm-scored")
    lexicon.unpersist()
    rest = scored.select("row", F.posexplode("rest").alias("pos", "x")).select("row", "pos", "x.*")

    def looked_up(rest: DataFrame, key: str, table_: DataFrame, out: str) -> DataFrame:
        """``out`` of the row of ``table_`` with the key; what asks for none meets none, spread evenly."""
        spread_key = F.coalesce(F.col(key), F.xxhash64("row", "pos"))
        found = table_.select(F.col(table_.columns[0]).alias("_key"), F.col(table_.columns[1]).alias(out))
        return rest.withColumn("_at", spread_key).join(found, F.col("_at") == F.col("_key"), "left").select(
            *rest.columns, F.when(F.col(key).isNotNull(), F.col(out)).alias(out))

    absent = F.lit(None).cast("long")
    if all_known:
        rest = rest.withColumns({"late_w": absent, "late_v": absent})
    else:
        rare = totals.where(F.col("c") < cut)
        rest = looked_up(looked_up(rest, "w", rare, "late_w"), "v", rare, "late_v")
    rest = rest.select(
        "row", "times", "w", F.col("late_w").isNotNull().alias("known"),
        F.when(F.col("w").isNull(), F.col("n_w")).otherwise(F.coalesce("late_w", F.lit(0))).alias("c_w"),
        F.when(F.col("v").isNull(), F.col("n_v")).otherwise(F.coalesce("late_v", F.lit(0))).alias("c_v"), "seen")
    share = F.when(F.col("c_v") > 0, F.least(F.col("seen") / F.col("c_v"), F.lit(1.0))).otherwise(0.0)
    unigram = F.least((F.col("c_w") + F.lit(0.5)) / F.lit(float(total)), F.lit(1.0))
    asks = F.col("w").isNotNull()
    late = rest.groupBy("row").agg(
        F.sum(F.when(asks, F.col("times") * F.log10(F.col("c_w") + F.lit(0.5))).otherwise(0.0)).alias("late_base"),
        F.sum(F.when(asks & F.col("known"), F.col("times")).otherwise(0)).alias("late_known"),
        F.sum(F.col("times") * F.log10(F.lit(LAMBDA) * share + F.lit(1 - LAMBDA) * unigram)).alias("late_score"))
    return scored.join(late, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("late_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_total))
        .alias("base_score"),
        (F.col("score") + F.coalesce("late_score", F.lit(0.0))).alias("score"),
    )


def op7(spark, sf_dir) -> DataFrame:
    return score(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"))


register("op7_lm_score", op7)
