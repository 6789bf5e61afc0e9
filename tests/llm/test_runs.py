"""Runs against a brute force over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from loomwright.llm import runs
from tests.llm.helpers import DOCS, HARD, documents, rows, with_clashes, words


def brute_runs(w, min_words=6, exponent=4):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(min_words, exponent * q):
                part = w[i:i + length]
                if not any(part[k:] == part[:-k] for k in range(1, q)):
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = words(text, fold=False)
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    drop = {i for s, l, q in found for i in range(s + q, s + l)}
    best = None
    for s, l, q in found:
        if best is None or l * best[2] > best[1] * q:
            best = (s, l, q)
    listing = "".join(f"{s},{l},{q}\n" for s, l, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    start, length, period = best or (None, None, None)
    milli = 1000 * length // period if best else None
    return doc_id, len(found), start, length, period, milli, sha(listing), sha(kept)


def numbers(w):
    seen = {}
    return np.array([seen.setdefault(x, len(seen)) for x in w], np.int64)


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    draw = random.Random(seed)
    w = []
    while len(w) < draw.randint(1, 400):
        root = [draw.choice("abc"[:draw.randint(1, 3)]) for _ in range(draw.randint(1, 40))]
        power = draw.randint(1, 9)
        w += (root * power)[:max(1, len(root) * power - draw.randint(0, len(root)))]
    assert runs.find_runs(numbers(w)) == brute_runs(w)


def test_fibonacci_and_thue_morse_and_constant():
    a, b = "a", "ab"
    while len(b) < 900:
        a, b = b, b + a
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    for w in (b, morse, "a" * 3000, ("ab" * 300 + "c") * 5, "aaaab" * 40 + "aaaaaaa"):
        assert runs.find_runs(numbers(w)) == brute_runs(list(w))


def test_large_scales_use_the_first_words_of_a_block(monkeypatch):
    monkeypatch.setattr(runs, "LONGEST_BLOCK", 4)
    monkeypatch.setattr(runs, "BATCH", 64)
    draw = random.Random(5)
    for root in (7, 33, 90):
        w = [draw.choice("abcd") for _ in range(50)] + [draw.choice("abcde") for _ in range(root)] * 5
        assert runs.find_runs(numbers(w)) == brute_runs(w)


@pytest.mark.parametrize("b", [1, 2, 8, 64])
def test_zero_means_equal_in_each_field_size(b):
    draw = np.random.default_rng(b)
    for largest in (3, 50_000, 1 << 24):
        blocks = draw.integers(0, 2, (5, b)).astype(np.uint64) * np.uint64(largest)
        windows = draw.integers(0, 2, (5, 2 * b - 1)).astype(np.uint64) * np.uint64(largest)
        windows[0, b - 1:2 * b - 1] = blocks[0]
        got = runs.zero_mismatches(blocks, windows, largest)
        expected = [[(blocks[i] == windows[i, r:r + b]).all() for r in range(b)] for i in range(5)]
        assert got.tolist() == np.array(expected).tolist()


def test_fewer_than_three_periods_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(10, np.int64), min_exponent=2)


def test_hard_rows(spark):
    hard = [*HARD, (12, "ha " * 5), (13, "ha " * 6), (14, "x a b a b a b a b y"), (15, "A a A a A a A a")]
    hard += [(i, "one two three four five six seven eight nine ten " * 6) for i in range(100, 160)]
    docs = with_clashes(documents(spark, hard))
    got = runs.scan(docs, __import__("pyspark.sql.functions").sql.functions.expr("crc32(string(doc_id))"))
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    for doc_id, text in hard:
        if doc_id == 9:  # one word 60,000 times is too much for the brute force
            assert [tuple(x) for x in by_id[9][0].runs][0][2] in (1, 6)
            continue
        r, e = by_id[doc_id][0], brute_row(doc_id, text)
        listing = "".join(f"{x.start},{x.length},{x.period}\n" for x in r.runs)
        assert (len(r.runs), hashlib.sha256(listing.encode()).hexdigest()) == (e[1], e[6])
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == e[7]
    assert len(by_id[7]) == 2
    assert runs.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = runs.op12(spark, sf_dir)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = sorted((brute_row(*d) for d in docs), key=repr)
    assert rows(got, *names) == expected
    assert any(e[1] for e in expected)
