import random

import numpy as np
import pytest

from loomwright.llm import minhash
from loomwright.llm.components import connected_components
from tests.llm.helpers import DOCS, HARD, documents, rows, with_clashes, words


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(docs, k, percent):
    sets = [(d, shingles(t, k)) for d, t in docs]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), d == find(d)) for d, s in sets)


def family(seed, n, edits, size=120):
    draw = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(size)] = f"e{draw.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_matches_brute_force(spark, k, percent):
    texts = family(1, 150, 5) + family(2, 40, 2, 30) + [f"alone {i} text of its own" for i in range(10)]
    texts += texts[:7] + [texts[0].upper(), "", "  ", "one", "one", "one two"]
    docs = list(enumerate(texts, 100))
    got = minhash.near_duplicates(documents(spark, docs), k, percent)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(brute(docs, k, percent), key=repr)


def test_blocks_find_links_the_hub_lacks(spark):
    """With the smallest blocks every link that the hub does not give comes from a block."""
    texts = family(3, 60, 9, 100)
    sets = {i: np.unique([hash(s) & (2**63 - 1) for s in shingles(t, 3)]).astype(np.uint64) for i, t in enumerate(texts)}
    members = spark.createDataFrame(
        [(1, i, 1 if i == 17 else 0, s.tobytes()) for i, s in sets.items()],
        "g long, id long, weight long, payload binary")
    links = minhash.spanning_links(members, minhash._set_links(85), "test", block=7)
    found = {r[0]: r[1] for r in connected_components(links, "test").collect()}
    expected = {d: c for d, _, c, _ in brute(list(enumerate(texts)), 3, 85)}
    assert {d: found.get(d, d) for d in expected} == expected


def test_hard_rows(spark):
    got = minhash.near_duplicates(with_clashes(documents(spark, HARD)), 3, 85)
    result = rows(got, "doc_id", "n_shingles", "component_id", "kept")
    assert len(result) == len(HARD)
    assert (1, 0, 1, True) in result and (3, 0, 3, True) in result
    assert (7, 5, 6, False) in result and (6, 5, 6, True) in result
    assert (None, 2, None, True) in result
    empty = minhash.near_duplicates(spark.createDataFrame([], DOCS), 3, 85)
    assert empty.count() == 0


def test_deduplicate_keeps_one_of_each(spark):
    docs = with_clashes(documents(spark, HARD))
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = sorted(r[0] for r in kept.collect() if r[0] is not None)
    assert ids == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11]
    twice = documents(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "x"), (None, "x")])
    assert sorted(map(str, (r[0] for r in minhash.deduplicate(twice).collect()))) == ["5", "None", "None"]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(900, 901), (901, 900), (5, 5)], "a long, b long")
    found = dict(map(tuple, connected_components(links, "path").collect()))
    assert len(found) == 203 and all(found[i] == 0 for i in range(201)) and found[901] == 900


def test_number_of_bands_follows_from_the_limit():
    for percent in (80, 85, 95):
        bands = minhash.bands_for(percent)
        assert (1 - (percent / 100) ** minhash.ROWS) ** bands <= minhash.MISS
