from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import segmentation as seg
from tests.llm.helpers import DOCS, HARD, documents, with_clashes


@pytest.fixture(scope="module")
def pieces():
    return seg.Pieces(seg.default_model(), 1.0)


def test_lossless_and_reproducible(spark):
    docs = [*HARD, (20, "▁ literal ▁▁ marks"), (21, "  spaces   "), (22, "a\n\nb\r\n\tc"), (23, "\x00\x01<0x0A>"),
            (24, "▁"), (25, " ")]
    frame = with_clashes(documents(spark, docs))
    one = seg.sample_segmentations(frame, F.col("doc_id")).collect()
    two = seg.sample_segmentations(frame.repartition(3), F.col("doc_id")).collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in one)
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    back = seg.decode(spark.createDataFrame(one, "doc_id long, ids array<int>, n_pieces long, lossless boolean"))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr((d, t or "")) for d, t in docs)
    assert seg.sample_segmentations(spark.createDataFrame([], DOCS), F.col("doc_id")).count() == 0


def test_the_usual_decoder_reads_the_ids(pieces):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=seg.default_model())
    text = "Hello wörld, 漢字 \U0001F600 and more\nlines"
    data = np.frombuffer(text.encode(), np.uint8)
    ids, counts = seg.encode_chunk(data, np.array([0, len(data)]), np.array([3], np.uint64), pieces)
    assert counts.tolist() == [len(ids)] and model.decode(ids.tolist()) == text


def all_ways(text, pieces):
    """Every segmentation of a marked text with its weight, by recursion."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=seg.default_model())
    size = model.get_piece_size()
    known = {model.id_to_piece(i): -np.log(min(-model.get_score(i), float(size)) + 2)
             for i in range(259, size)}
    ways = []

    def walk(rest, done, weight):
        if not rest:
            ways.append((tuple(done), weight))
        for k in range(1, len(rest) + 1):
            if rest[:k] in known:
                walk(rest[k:], [*done, model.piece_to_id(rest[:k])], weight + known[rest[:k]])

    walk(text, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in ways])
    return {s: float(np.exp(w - total)) for s, w in ways}


def test_samples_follow_the_lattice(pieces):
    expected = all_ways("▁there", pieces)
    n = 40_000
    data = np.frombuffer(b"there" * n, np.uint8)
    ids, counts = seg.encode_chunk(data, np.arange(n + 1) * 5, seg.mix(np.arange(n, dtype=np.uint64)), pieces)
    cuts = np.r_[0, np.cumsum(counts)]
    drawn = Counter(tuple(ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:]))
    assert set(drawn) <= set(expected)
    for way, p in expected.items():
        assert abs(drawn[way] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4, (way, p)


@pytest.mark.parametrize("text", ["thereqxthere", "zzzz", "aaaaaa"])
def test_parts_and_walks_follow_the_lattice(pieces, monkeypatch, text):
    monkeypatch.setattr(seg, "CUT", 2)
    monkeypatch.setattr(seg, "SIDE_BY_SIDE", 3)
    expected = all_ways("▁" + text, pieces)
    n = 20_000
    data = np.frombuffer(text.encode() * n, np.uint8)
    keys = seg.mix(np.arange(n, dtype=np.uint64))
    ids, counts = seg.encode_chunk(data, np.arange(n + 1) * len(text), keys, pieces)
    cuts = np.r_[0, np.cumsum(counts)]
    drawn = Counter(tuple(ids[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:]))
    assert set(drawn) <= set(expected)
    for way, p in expected.items():
        assert abs(drawn[way] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 2e-4, (way, p)


def test_walked_alone_or_side_by_side(pieces, monkeypatch):
    text = "a" * 150 + "there" * 40 + "=" * 170 + "漢字" * 60 + "\U0001F600é▁"
    data = np.frombuffer(text.encode() * 3, np.uint8)
    offsets, keys = np.arange(4) * (len(data) // 3), np.arange(3, dtype=np.uint64)
    together = seg.encode_chunk(data, offsets, keys, pieces)
    monkeypatch.setattr(seg, "SIDE_BY_SIDE", 8)
    alone = seg.encode_chunk(data, offsets, keys, pieces)
    assert all(np.array_equal(a, b) for a, b in zip(together, alone))
    for k in range(3):  # a row's sample does not depend on the rows beside it
        single = seg.encode_chunk(data[:offsets[1]], offsets[:2], keys[k:k + 1], pieces)[0]
        first = int(alone[1][:k].sum())
        assert np.array_equal(single, alone[0][first:first + len(single)])
        assert pieces.decode(single.tolist()) == text


def test_long_texts_without_blanks(pieces):
    rng = np.random.default_rng(3)
    texts = ["a" * 100_000, "".join(map(chr, rng.integers(0x4E00, 0x9000, 50_000))),
             "".join(map(chr, rng.integers(33, 127, 50_000)))]
    raw = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(r) for r in raw])]
    ids, counts = seg.encode_chunk(
        np.frombuffer(b"".join(raw), np.uint8), offsets, np.arange(3, dtype=np.uint64), pieces)
    upto = np.r_[0, np.cumsum(counts)]
    assert [pieces.decode(ids[a:b].tolist()) for a, b in zip(upto[:-1], upto[1:])] == texts


def test_two_words_are_drawn_apart(pieces):
    n = 5000
    data = np.frombuffer(b"there there" * n, np.uint8)
    ids, counts = seg.encode_chunk(data, np.arange(n + 1) * 11, seg.mix(np.arange(n, dtype=np.uint64)), pieces)
    assert len(set(counts.tolist())) > 3


def test_sharp_weights_give_one_way():
    sharp = seg.Pieces(seg.default_model(), 200.0)
    data = np.frombuffer(b"there" * 100, np.uint8)
    ids, counts = seg.encode_chunk(data, np.arange(101) * 5, seg.mix(np.arange(100, dtype=np.uint64)), sharp)
    assert len(set(counts.tolist())) == 1
