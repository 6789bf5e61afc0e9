"""Periodic runs of words: block convolution at dyadic scales, then extension of the seeds.

At scale b a text is cut into blocks of b words. The squared differences between a block and
what follows it at each distance of b to 2b - 1 sum to zero exactly where the block occurs
again; the sums are correlations, computed by a number-theoretic transform in as many prime
fields as their size needs, so that zero means equal. A run of period q and at least 3 q words
holds a whole block of the scale just below q and its next occurrence, so no run is missed.
Such a pair (place, distance) is a seed, which is extended to both sides.

Two exact tests spare most transforms: a block can only occur again if each of its words does so
within 2b words, and inside a known run of a smaller period only multiples of that period match.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomwright.llm.common import narrow, register, text_chunks
from loomwright.queries.base import table
from loomwright.storage import spread

MIN_WORDS = 6
MIN_EXPONENT = 4

# Primes k * 2^e + 1 with a generator. Their product is above 2^85.
FIELDS = ((469762049, 3), (167772161, 3), (754974721, 11))
#: Longest block that is transformed; at larger scales the first words of a block stand for it.
LONGEST_BLOCK = 1 << 18
#: Words in one batch of transforms.
BATCH = 1 << 19


@lru_cache(maxsize=128)
def _powers(prime: int, root: int, size: int) -> np.ndarray:
    """Powers of a root of unity of order ``size``, half of them."""
    step = pow(root, (prime - 1) // size, prime)
    out = np.ones(1, np.uint64)
    while len(out) < size // 2:
        factor = np.uint64(pow(step, len(out), prime))
        out = np.concatenate([out, out * factor % np.uint64(prime)])
    return out


def _transform(rows: np.ndarray, prime: int, root: int) -> np.ndarray:
    """The number-theoretic transform of each row; its length is a power of two."""
    count, size = rows.shape
    powers, p = _powers(prime, root, size), np.uint64(prime)
    length, stride = size, 1
    while length > 1:
        half = length // 2
        rows = rows.reshape(count, length, stride)
        low, high = rows[:, :half], rows[:, half:]
        out = np.empty((count, half, 2, stride), np.uint64)
        total = low + high
        out[:, :, 0] = np.where(total >= p, total - p, total)
        out[:, :, 1] = (low + p - high) * powers[::stride][:half, None] % p
        rows, length, stride = out, half, stride * 2
    return rows.reshape(count, size)


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray, largest: int) -> np.ndarray:
    """Where the squared differences of block and window sum to zero: (row, shift) as booleans.

    ``blocks`` has b words (a power of two) a row, ``windows`` 2b - 1; words are numbers of
    0 to ``largest``. Shift r compares the block with words r to r + b - 1 of the window.
    """
    count, b = blocks.shape
    size = 2 * b
    bound, product = b * largest * largest, 1
    equal = np.ones((count, b), bool)
    for prime, root in FIELDS:
        p = np.uint64(prime)
        x = np.zeros((count, size), np.uint64)
        y = np.zeros((count, size), np.uint64)
        x[:, :b], y[:, :size - 1] = blocks, windows
        x %= p
        y %= p
        own = (x * x % p).sum(axis=1) % p
        passed = np.zeros((count, size + 1), np.uint64)
        np.cumsum(y * y % p, axis=1, out=passed[:, 1:])
        around = (passed[:, b:2 * b] - passed[:, :b]) % p
        inverse = pow(root, prime - 2, prime)
        # The transform by the inverse root turns the product into a correlation.
        both = _transform(x, prime, inverse) * _transform(y, prime, root) % p
        cross = _transform(both, prime, inverse)[:, :b] * np.uint64(pow(size, prime - 2, prime)) % p
        equal &= (own[:, None] + around) % p == np.uint64(2) * cross % p
        product *= prime
        if product > bound:
            return equal
    raise ValueError(f"numbers up to {largest} are too large for blocks of {b} words")


def _seeds(padded: np.ndarray, starts: np.ndarray, scale: int, largest: int) -> Iterator[tuple]:
    """Arrays (block starts, distances) of zero mismatches at distances of scale to 2 scale - 1."""
    b = min(scale, LONGEST_BLOCK)
    rows = max(1, BATCH // (2 * b))
    for first in range(0, len(starts), rows):
        at = starts[first:first + rows, None]
        blocks = padded[at + np.arange(b)]
        for distance in range(scale, 2 * scale, b):
            places = np.minimum(at + distance + np.arange(2 * b - 1), len(padded) - 1)
            row, shift = np.nonzero(zero_mismatches(blocks, padded[places], largest))
            yield at[row, 0], distance + shift


def _extent(ids: np.ndarray, at: int, end: int, d: int) -> tuple[int, int]:
    """The longest stretch around words [at, end + d) in which words d apart are equal."""
    n, step = len(ids) - d, 32
    while end < n:
        differ = ids[end:min(end + step, n)] != ids[end + d:min(end + step, n) + d]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = min(end + step, n), step * 2
    step = 32
    while at > 0:
        low = max(0, at - step)
        differ = ids[low:at] != ids[low + d:at + d]
        if differ.any():
            at -= int(differ[::-1].argmax())
            break
        at, step = low, step * 2
    return at, end + d


def _is_primitive(ids: np.ndarray, at: int, d: int) -> bool:
    """No smaller period divides d in the d words from ``at``."""
    rest, factor = d, 2
    root = ids[at:at + d]
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            q = d // factor
            if np.array_equal(root[q:], root[:-q]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def find_runs(
    ids: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT
) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period.

    ``ids`` numbers the words from 0, equal words alike. A run is a stretch with smallest
    period q and at least max(min_words, min_exponent * q) words that no neighbour extends.
    """
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods can lack a whole block")
    n = len(ids)
    if n < max(min_words, min_exponent):
        return []
    order = np.argsort(ids, kind="stable")
    again = ids[order[1:]] == ids[order[:-1]]
    reach = np.full(n, n, np.int64)  # words to the next equal one
    reach[order[:-1][again]] = (order[1:] - order[:-1])[again]
    largest = int(ids.max()) + 1
    padded = np.append(ids, largest).astype(np.uint64)  # the last stands for all words after the text
    found: list[tuple[int, int, int]] = []
    known = np.zeros((0, 3), np.int64)  # stretches (start, end, period)
    scale = 1
    while scale * min_exponent <= n:
        starts = np.flatnonzero(reach < 2 * scale) * scale
        for s, e, q in known:
            if len(starts) and q <= scale:
                starts = starts[(starts < s) | (starts + 3 * scale - 1 > e)]
        fresh = []
        for places, distances in _seeds(padded, starts, scale, largest):
            b = min(scale, LONGEST_BLOCK)
            for s, e, q in known:
                inside = (places >= s) & (places + distances + b <= e) & (distances % q == 0)
                places, distances = places[~inside], distances[~inside]
            for k in np.lexsort((places, distances)):
                at, d = int(places[k]), int(distances[k])
                if fresh and fresh[-1][2] == d and fresh[-1][0] <= at and at + b + d <= fresh[-1][1]:
                    continue
                s, e = _extent(ids, at, at + b, d)
                fresh.append((s, e, d))
                if e - s >= max(min_words, min_exponent * d) and _is_primitive(ids, s, d):
                    found.append((s, e - s, d))
        if fresh:
            # What is shorter than three periods holds no block and window of a later scale.
            long = [x for x in set(fresh) if x[1] - x[0] >= 3 * x[2]]
            known = np.concatenate([known, np.array(long, np.int64).reshape(-1, 3)])
        pairs = len(reach) // 2
        reach = np.maximum(reach[:2 * pairs:2], reach[1:2 * pairs:2])
        scale *= 2
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def planted(n: int, h: int) -> np.ndarray:
    """Which word stands at each of n places when the hash h makes a text periodic from a place on."""
    index = np.arange(n)
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        index[a:] = a + (index[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return index


SCANNED = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def scan(
    docs: DataFrame,
    plant: Column | None = None,
    min_words: int = MIN_WORDS,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """One row per input row: doc_id, n_words, its runs, and the text without their repeats.

    Of each run the first period stays; the words that stay are joined by one space. Null and
    empty texts have no words, no runs and the empty text. Repeated rows are scanned each.
    Columns other than doc_id and text are not read. ``plant`` is a hash by which a text is made
    periodic first (see ``planted``); where it is null the text stays. Texts are handled whole,
    one after the other; what a task holds is bounded by a text's own size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            n_words, lists, rows, texts = [], [0], [], []
            for first, last, h in zip(offsets, offsets[1:], batch["plant"].to_pylist()):
                words = data[first:last].tobytes().split()  # by the six white-space bytes
                if h is not None:
                    words = [words[i] for i in planted(len(words), h)] if h % 10 == 0 else words
                ids = pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy()
                runs = find_runs(ids.astype(np.int64), min_words, min_exponent)
                if runs:
                    stays = np.ones(len(words), bool)
                    for start, length, period in runs:
                        stays[start + period:start + length] = False
                    words = [words[i] for i in np.flatnonzero(stays)]
                n_words.append(len(ids))
                rows.extend(runs)
                lists.append(len(rows))
                texts.append(b" ".join(words))
            columns = np.array(rows, np.int64).reshape(-1, 3).T
            runs = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_words, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(lists, pa.int32()), runs),
                 pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    hashes = F.lit(None).cast("long") if plant is None else plant.cast("long")
    source = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), hashes.alias("plant"))
    return source.mapInArrow(run, SCANNED)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; ties: least start, then period."""
    def better(best: Column, x: Column) -> Column:
        here, there = x["length"] * best["period"], best["length"] * x["period"]
        return F.when(best.isNull() | (here > there), x).otherwise(best)  # runs are in order

    return F.aggregate(
        runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def op12(spark, sf_dir) -> DataFrame:
    docs = spread(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"))
    scanned = scan(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    line = F.transform("runs", lambda x: F.concat(
        F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")),
        F.lit("\n")))
    best = scanned.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


register("op12_runs", op12)
