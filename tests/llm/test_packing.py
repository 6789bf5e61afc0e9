import itertools
import random
import zlib

import numpy as np
import pytest

from loomwright.llm import packing
from tests.llm.helpers import DOCS, HARD, documents, with_clashes


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def optimal(sizes, capacity):
    """Least number of bins, by trying all assignments."""
    best = len(sizes)

    def place(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(sizes):
            best = len(free)
            return
        for j in range(len(free)):
            if free[j] >= sizes[i]:
                place(i + 1, free[:j] + [free[j] - sizes[i]] + free[j + 1:])
        place(i + 1, free + [capacity - sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bounds_hold_and_packings_are_valid(seed):
    draw = random.Random(seed)
    sizes = np.array([draw.randint(1, 20) for _ in range(draw.randint(1, 9))])
    bins, offsets, count = packing.best_fit_decreasing(sizes, 20)
    best = optimal(sorted(sizes.tolist(), reverse=True), 20)
    assert packing.lower_bound(sizes, 20) <= best <= count
    for b in range(count):
        spans = sorted((o, o + s) for o, s, x in zip(offsets, sizes, bins) if x == b)
        assert spans[0][0] == 0 and spans[-1][1] <= 20
        assert all(p[1] == q[0] for p, q in itertools.pairwise(spans))


def test_bound_sees_more_than_the_sum():
    assert packing.lower_bound(np.array([11] * 6), 20) == 6
    assert packing.lower_bound(np.array([7] * 6), 20) == 3


def check_places(result, capacity=1024):
    by_sequence = {}
    for r in result:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


def test_documents(spark):
    docs = [*HARD, (20, "Special <|endoftext|> text"), (21, "word " * 1023), (22, "word " * 1024), (23, "word " * 3000)]
    result = packing.pack_documents(with_clashes(documents(spark, docs))).collect()
    check_places(result)
    expected = []
    for doc_id, text in docs:
        ids = reference_ids(text)
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            expected.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in result]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_gaps_are_exchanged(spark):
    draw = random.Random(3)
    sizes = [draw.randint(300, 700) for _ in range(600)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "item long, length long")
    one = packing.pack(items, items_per_partition=60, rounds=1).collect()
    more = packing.pack(items, items_per_partition=60, rounds=4).collect()
    assert sorted(r.item for r in more) == list(range(600))
    assert len(check_places(more)) <= len(check_places(one))
    assert len(check_places(more)) >= packing.lower_bound(np.array(sizes), 1024)


@pytest.mark.parametrize("sizes, per_partition, best", [
    ([3] * 100, 10, 1), ([700] * 30 + [400] * 30 + [300] * 10, 10, 45), ([512] * 99, 10, 50), ([1024] * 30, 7, 30),
])
def test_sequences_of_certified_partitions_meet(spark, sizes, per_partition, best):
    """Each partition has the least count for its own items, but not for all."""
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    rows = packing.pack(items, items_per_partition=per_partition).collect()
    assert sorted(r.item for r in rows) == list(range(len(sizes)))
    found = len(check_places(rows))
    bound = packing.lower_bound(np.array(sizes), 1024)
    assert {r.gap for r in rows} == {found - bound}
    assert found <= best + (best > 40)


@pytest.mark.parametrize("limit", [5, 1_000_000])
def test_ids_are_those_of_the_plain_call(monkeypatch, limit):
    """On both sides of the switch between the encoders, special tokens in the text included."""
    from loomwright.llm import tokens

    monkeypatch.setattr(tokens, "LONGEST_FAST_TEXT", limit)
    encode = tokens.Encoder(tokens.default_tokenizer())
    end = "<|endoftext|>"
    for text in ("", f"x {end} y", end, end * 3, f"{end} a", f"a{end}", "<|endoftext", f"<|{end}|>", f"\n{end}\n ",
                 "Ünïcode ẞ 漢字 \U0001F600  end", "it's  we'll\t\n x" * 50, "\u00a0\u2003 a\u0301", "12345 678"):
        assert encode(text).tolist() == reference_ids(text)[:-1]
    assert encode(f"x {end} y").tolist() == [87, 220, 50256, 331]


def test_sequences_hold_the_ids(spark):
    docs = documents(spark, [(1, "a few words"), (2, "and " * 1500), (3, None)])
    packed = packing.pack(packing.tokenized_pieces(docs, with_ids=True))
    ids = [r["ids"] for r in packing.sequences(packed).collect()]
    assert max(map(len, ids)) <= 1024
    assert sorted(itertools.chain(*ids)) == sorted(itertools.chain(*(reference_ids(t) for t in ("a few words", "and " * 1500, None))))
