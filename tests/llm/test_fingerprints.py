import hashlib

import pytest
from pyspark.sql import functions as F

from loomwright.llm import fingerprints as fp
from tests.llm.helpers import DOCS, HARD, documents, with_clashes


def edited(docs):
    """doc_id -> sha256, by the contract's words."""
    ids = sorted({d for d, _ in docs}, key=lambda d: (d is None, -(d or 0)))
    least = {i: min(t or "" for d, t in docs if d == i) for i in ids}
    out = []
    for d, t in docs:
        text, following = t or "", least[ids[(ids.index(d) + 1) % len(ids)]]
        half = len(text) // 2
        new = text[:len(text) - half] + following[:half]
        out.append((d, len(text), hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_texts(spark):
    docs = [*HARD, (7, "another text of seven"), (-5, "lowest id"), (40, "z " * 40)]
    got = fp.compare_edits(with_clashes(documents(spark, docs))).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == edited(docs)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fp.compare_edits(spark.createDataFrame([], DOCS)).count() == 0
    alone = fp.compare_edits(documents(spark, [(1, "a b c d")])).first()
    assert alone.near_next == 1.0


def prints(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in frame.orderBy("i").select(fp.fingerprint(F.col("t"))).collect()]


def near(a, b):
    used = {x >> 24 for x in [*a, *b]}
    return len(set(a) & set(b)) / len(used) if used else 1.0


def test_equal_texts_and_empty(spark):
    a, b, c, d = prints(spark, ["the same words here", "the same words here", "", "\n "])
    assert a == b and c == d == []


def test_order_and_repeats_matter(spark):
    words = [f"w{i}" for i in range(600)]
    base = " ".join(words)
    swapped = " ".join(words[300:] + words[:300])  # the same runs but one, in another order
    halved = " ".join(words[:300] + [f"v{i}" for i in range(300)])
    few = " ".join(words[:290] + ["x"] + words[291:])
    a, b, c, d = prints(spark, [base, swapped, halved, few])
    assert near(a, d) > 0.85
    assert 0.2 < near(a, b) < 0.8  # a set of runs alone would be near 1
    assert 0.1 < near(a, c) < 0.5
    once, thrice = prints(spark, [" ".join(words[:100]), " ".join(words[:100] * 3)])
    assert near(once, thrice) < 0.7  # later occurrences are elements of their own


def test_occurrence_numbers_are_exact(spark):
    """A reading in plain Python with the same hashes."""
    texts = ["a b " * 40 + "c", "x " * 300, "p q r p q r p q", "one"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    mask = (1 << 64) - 1

    def hash64(*values):
        kinds = ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}L" if abs(v) > 2**31 else f"CAST({v} AS INT)" for v in values)
        return spark.sql(f"SELECT xxhash64({kinds})").first()[0]

    got = [r[0] for r in frame.select(fp.fingerprint(F.col("t"))).collect()]
    for text, print_ in zip(texts, got):
        w = text.split()
        runs = [tuple(w[i:i + 2]) for i in range(max(len(w) - 1, 1))]
        codes = {}
        for run in set(runs):
            codes[run] = (hash64(*run) & mask) >> (fp.PLACE_BITS + 1) if len(run) == 2 else None
        if None in codes.values():
            continue
        elements, seen = [], {}
        wanted = sorted({(codes[r], runs[:i].count(r)) for i, r in enumerate(runs)})
        numbered = {k: (hash64(k[0] if k[0] > 2**31 else k[0], k[1]) & mask) >> (fp.PLACE_BITS + 1) for k in wanted}
        for i, run in enumerate(runs):
            n = seen.get(run, 0)
            seen[run] = n + 1
            elements.append((numbered[(codes[run], n)], i))
        bins = {}
        for value, place in sorted(elements):
            bins.setdefault(value >> (37 - fp.BIN_BITS), []).append((place, value))
        assert sorted(bins) == sorted(x >> 24 for x in print_)


@pytest.mark.parametrize("n", [1, 2, 50])
def test_next_ids(spark, n):
    ids = spark.createDataFrame([(i * 3, i) for i in range(n)], "doc_id long, h int")
    got = {r.doc_id: (r.before, r.h) for r in fp.next_ids(ids, 7).collect()}
    assert got == {i * 3: ((i + 1) % n * 3, (i + 1) % n) for i in range(n)}


def test_occurrences_beyond_131072_stay_apart(spark):
    a, b = prints(spark, ["x " * 140_000, "x " * 200_000])
    assert near(a, b) < 0.9  # of the longer text's elements 30 % are its own
    assert sum(fp._STEPS) == fp._PLACES
