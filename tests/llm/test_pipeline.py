"""Each stage on its own input, and the whole, on the smallest tables."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_minhash import brute as linked
from tests.llm.test_packing import check_places, reference_ids
from tests.llm.test_quality import brute as measures
from tests.llm.test_secrets import brute_base

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, out[-1], SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_and_columns(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "secret scans", "best-fit packing"]
    for frame in results[1:-1]:
        assert frame.columns == results[0].columns


def test_quality_stage(results):
    before, after = ({r.doc_id: r.text for r in f.collect()} for f in results[:2])
    passing = {d for d, t in before.items() if not measures(t)[5]}
    assert set(after) <= passing and len(after) >= 0.95 * len(passing)


def test_duplicate_stage(results):
    before = sorted((r.doc_id, r.text) for r in results[1].collect())
    after = {r.doc_id: r.text for r in results[2].collect()}
    assert set(after) == {d for d, _, c, kept in linked(before, 5, 80) if kept}
    assert after.items() <= dict(before).items()


def test_secret_stage(results):
    before, after = ({r.doc_id: r.text for r in f.collect()} for f in results[2:4])
    assert set(before) == set(after)
    changed = {d for d in before if before[d] != after[d]}
    assert changed == {d for d, t in before.items() if brute_base(t)}
    assert all("[secret]" in after[d] for d in changed)


def test_packing_stage(results):
    pieces = results[4].collect()
    check_places(pieces)
    lengths = Counter()
    for r in pieces:
        lengths[r.doc_id] += r.length
    texts = {r.doc_id: r.text for r in results[3].collect()}
    assert set(lengths) == set(texts)
    for doc_id, text in list(texts.items())[:20]:
        ids = reference_ids(text)
        assert lengths[doc_id] == len(ids)
        for r in pieces:
            if r.doc_id == doc_id:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())


def test_run(spark, results):
    assert corpus_pipeline.run(spark, SF_DIR).count() == results[-1].count()


def staged(spark, docs):
    """All stages, each on what the one before it returns, written and read again."""
    from loomwright.storage import stage

    out = [docs]
    for name, run_stage in corpus_pipeline.STAGES:
        out.append(stage(run_stage(spark, out[-1], SF_DIR), "pipeline-test"))
    return out


def test_hard_tables(spark):
    """Nulls in any column, repeated rows, a very long text, clashing names, no rows at all."""
    from tests.llm.helpers import DOCS, HARD, documents, with_clashes

    prose = lambda seed, n: " ".join(f"w{(i * seed) % 997}x{i}" for i in range(n))
    good = [(100 + i, prose(i + 3, 80), f"s{i % 3}") for i in range(12)]
    rows = [*HARD, *good, good[0], (None, prose(50, 90), None), (200, prose(50, 90), "s1"), (300, prose(77, 30_000), "s2"),
            (301, prose(91, 70) + " token: please go on, pleased", "s2"), (302, prose(92, 70) + " api_key=abc123abc123abc", None)]
    out = staged(spark, with_clashes(documents(spark, rows)))
    for frame in out[1:-1]:
        assert frame.columns == out[0].columns
    kept = sorted(((r.doc_id, r.text) for r in out[1].collect()), key=repr)
    assert kept == sorted(((d, t) for d, t, *_ in rows if not measures(t)[5]), key=repr)
    texts = {r.doc_id: r.text for r in out[3].collect()}
    assert {100 + i for i in range(12)} | {300, 301, 302} <= set(texts)
    assert texts[301].endswith("token: [secret] go on, pleased") and texts[302].endswith("api_key=[secret]")
    check_places(out[4].collect())
    assert {r.doc_id for r in out[4].select("doc_id").collect()} == set(texts)
    empty = staged(spark, spark.createDataFrame([], DOCS))
    assert [f.count() for f in empty] == [0] * 5
