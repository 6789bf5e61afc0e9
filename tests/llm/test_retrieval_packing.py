"""Pieces, scores and neighbours of lexical retrieval packing."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomwright.llm import retrieval_packing as rp
from loomwright.llm import tokens
from tests.llm.helpers import DOCS, HARD, documents, with_clashes


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, plain, capacity=1024):
    """Each id in one piece, gapless sequences, and no padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    expected = Counter()
    for doc_id, text in docs:
        expected[doc_id] += len(plain(text))
    assert {d: sum(r.length for r in p) for d, p in by_doc.items()} == expected
    copies = Counter(d for d, _ in docs)
    for doc_id, text in docs:
        if copies[doc_id] > 1:
            continue
        ids, at = plain(text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    full = sum(1 for s in by_sequence.values() if sum(n for _, n in s) == capacity)
    assert full == sum(expected.values()) // capacity
    return by_sequence


def prose(seed, n, words=("alpha beta gamma delta".split())):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) for _ in range(n))


@pytest.mark.parametrize("limits", [{}, {"tokens_per_task": 9000, "items_per_shard": 20}])
def test_hard_rows(spark, plain, limits):
    docs = [*HARD, (20, "Special <|endoftext|> text <|endoftext|>"), (21, " a" * 1022), (22, " a" * 1023),
            (23, " a" * 1024), (24, " word" * 3000)]
    docs += [(100 + i, prose(i, 10 + 37 * i % 900)) for i in range(120)]
    docs += [(300 + i, "the same text again and again " * 9) for i in range(200)]
    rows = rp.pack(with_clashes(documents(spark, docs)), **limits).collect()
    check(rows, docs, plain)
    assert rp.pack(spark.createDataFrame([], DOCS)).count() == 0
    assert [r.length for r in rp.pack(documents(spark, [(1, None)])).collect()] == [1]


def test_ids_are_kept(spark, plain):
    docs = [(1, "a few words"), (2, " and" * 1500), (3, None), (4, "other words")]
    rows = rp.pack(documents(spark, docs), keep_ids=True).collect()
    for doc_id, text in docs:
        parts = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == doc_id)
        assert np.frombuffer(b"".join(p for _, p in parts), "<u2").tolist() == plain(text)


def test_scores_are_bm25():
    draw = random.Random(1)
    items = [np.array([draw.randint(0, 30) for _ in range(draw.randint(1, 40))]) for _ in range(25)]
    counts = Counter(t for x in items for t in set(x.tolist()))
    mean = sum(map(len, items)) / len(items)
    index = rp.Index(items, rp.Weights(counts, len(items), mean))
    for seed in range(len(items)):
        expected = []
        for x in items:
            total = 0.0
            for t in set(items[seed].tolist()):
                tf = int((x == t).sum())
                idf = math.log(1 + (len(items) - counts[t] + 0.5) / (counts[t] + 0.5))
                total += idf * tf * (rp.K1 + 1) / (tf + rp.K1 * (1 - rp.B + rp.B * len(x) / mean))
            expected.append(total)
        assert np.allclose(index.search(seed), expected)


def test_document_counts_cover_all_items(spark):
    docs = [(i, prose(i, 5 + i % 50)) for i in range(300)]
    pieces = rp.tokenized(documents(spark, docs), tokens.default_tokenizer(), "<u2")
    expected = Counter(t for r in pieces.collect() for t in set(np.frombuffer(bytes(r.ids), "<u2").tolist()))
    assert rp.document_counts(pieces.where("sequence_id IS NULL"), "<u2") == expected


def test_windows_hold_neighbours(spark, plain):
    draw = random.Random(2)
    topics = [["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(3)) for _ in range(60)] for _ in range(12)]
    docs = [(i, prose(i, draw.randint(20, 60), topics[i % 12])) for i in range(1200)]
    rows = rp.pack(documents(spark, docs), tokens_per_task=40_000, items_per_shard=100).collect()
    check(rows, docs, plain)
    windows = defaultdict(Counter)
    for r in rows:
        windows[r.sequence_id][r.doc_id % 12] += r.length
    share = sum(max(c.values()) for c in windows.values()) / sum(sum(c.values()) for c in windows.values())
    assert share > 0.6  # by chance about 0.2


def test_query(spark, plain):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(rp.op11(spark, sf_dir).collect(), docs, plain)
