import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.operators.context import NO_CONTEXT, assemble_context
from loomwright.operators.inverted_file import InvertedFile, approximate_topk, lay_out
from loomwright.operators.lexical import WordScorer, lexical_topk, route_by_words
from loomwright.operators.topk import best_k, rank_in_blocks
from loomwright.operators.vectors import (
    CosineScorer, cosine_topk, embed_texts, hashing_embedder,
)
from loomwright.sources.index_store import (
    DocumentIndex, as_documents, check_dimension, check_ids, delete_where, last_per_id, metadata_equals,
)
from loomwright.storage import scratch_path


def tuples(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())


@pytest.fixture(scope="module")
def vectors(spark):
    """400 vectors, a third of them copies of one, one zero vector and one null."""
    rng = np.random.default_rng(1)
    made = [[float(x) for x in rng.standard_normal(16)] for _ in range(400)]
    for i in range(0, 400, 3):
        made[i] = made[0]
    made[7] = [0.0] * 16
    rows = [(i, v) for i, v in enumerate(made)] + [(400, None)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(5), made


def brute_force(made, queries, k):
    unit = np.array(made, dtype=np.float32).astype(np.float64)
    with np.errstate(invalid="ignore"):
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    out = []
    for q in queries:
        scores = np.round(unit @ unit[q], 9)
        order = sorted((i for i in range(len(made)) if not np.isnan(scores[i])), key=lambda i: (-scores[i], i))
        out += [(q, i, r) for r, i in enumerate(order[:k], 1) if not np.isnan(scores[i])]
    return sorted(out)


def sides(df):
    return df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "doc_id")


def test_cosine_topk_is_exact_on_both_paths(vectors):
    df, made = vectors
    queries, docs = sides(df)
    shared = tuples(cosine_topk(queries, docs, 4))
    blocks = tuples(cosine_topk(queries, docs, 4, max_shared=10))
    assert shared == blocks
    asked = [i for i in range(400) if i != 7]
    assert [(q, d, r) for q, d, _, r in shared] == brute_force(made, asked, 4)


def test_all_vectors_travel_once_for_thousands_of_queries(vectors, monkeypatch):
    from loomwright.operators import vectors as module

    blocks = []

    def recording(queries, *args, query_block=2048, **settings):
        blocks.append(math.ceil(8000 / query_block))
        return rank_in_blocks(queries, *args, query_block=query_block, **settings)

    monkeypatch.setattr(module, "rank_in_blocks", recording, raising=False)
    queries, docs = sides(vectors[0])
    assert tuples(cosine_topk(queries, docs, 2, max_shared=10)) == tuples(cosine_topk(queries, docs, 2))
    assert blocks == [1]


def test_small_blocks_and_buckets_give_the_same(vectors, spark):
    df, _ = vectors
    queries, docs = sides(df.where("embedding is not null"))
    expected = tuples(cosine_topk(queries, docs, 3))
    schema = cosine_topk(queries, docs, 3).drop("rank").schema
    small = rank_in_blocks(queries, docs, CosineScorer(), 3, schema, query_block=37, doc_block=50)
    assert tuples(best_k(small, 3)) == expected
    one_bucket = rank_in_blocks(
        queries.withColumn("b", F.lit("x")), docs.withColumn("b", F.lit("x")), CosineScorer(), 3,
        schema, bucket="b", query_block=37, doc_block=50,
    )
    assert tuples(best_k(one_bucket, 3)) == expected


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_ids_of_any_type_on_both_paths(vectors, kind):
    df, _ = vectors
    queries, docs = sides(df.withColumn("id", F.col("id").cast(kind)))
    few = queries.limit(3)
    assert tuples(cosine_topk(few, docs, 2)) == tuples(cosine_topk(few, docs, 2, max_shared=1))


def test_filter_comes_before_ranking(vectors):
    df, _ = vectors
    queries, docs = sides(df)
    hits = cosine_topk(queries, docs, 2, where=F.col("doc_id") > 300)
    assert hits.where("doc_id <= 300").count() == 0
    assert hits.groupBy("query_id").count().where("count <> 2").count() == 0


def test_approximate_topk_recall_and_copies(vectors):
    df, _ = vectors
    queries, docs = sides(df)
    exact = {(q, d) for q, d, _, _ in tuples(cosine_topk(queries, docs, 3))}
    found = tuples(approximate_topk(queries, docs, 3))
    assert len({(q, d) for q, d, _, _ in found} & exact) / len(exact) > 0.9
    # Every copy finds the smallest ids of its own vector.
    copies = [(q, d) for q, d, _, _ in found if q % 3 == 0]
    assert {d for _, d in copies} == {0, 3, 6} and len(copies) == 3 * 134


def test_inverted_file_reads_few_lists_of_clustered_vectors(spark):
    """40 tight groups: a query reads the codes of few lists and compares few vectors exactly."""
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((40, 24))
    made = centres[np.arange(4000) % 40] + 0.15 * draw.standard_normal((4000, 24))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "id bigint, embedding array<float>")
    queries, docs = sides(df)
    queries = queries.where("query_id % 20 = 0")
    index = InvertedFile(docs, 5, sample=1500)
    assert index.probes <= len(index.quantiser.centroids) / 5
    found = index.search(queries).collect()
    exact = {(q, d) for q, d, _, _ in tuples(cosine_topk(queries, docs, 5))}
    assert len({(r.query_id, r.doc_id) for r in found} & exact) / len(exact) > 0.9
    assert max(r.compared for r in found) < 4000 / 10
    scores = {(q, d): s for q, d, s, _ in tuples(cosine_topk(queries, docs, 50))}
    assert all(abs(scores[r.query_id, r.doc_id] - r.score) < 1e-8 for r in found if (r.query_id, r.doc_id) in scores)


def test_rows_that_leave_a_search_do_not_grow_with_the_table(spark, monkeypatch):
    """Only the k best of a block are ranked, however many vectors a query is compared with."""
    from loomwright.operators import inverted_file

    monkeypatch.setattr(inverted_file, "LEAST_BLOCK", 100, raising=False)
    ranked = []

    def counting(candidates, k):
        ranked.append(candidates.count())
        return best_k(candidates, k)

    monkeypatch.setattr(inverted_file, "best_k", counting)
    draw = np.random.default_rng(5)
    made = [(i, [float(x) for x in v]) for i, v in enumerate(draw.standard_normal((3000, 16)))]
    most = []
    for n in (1500, 3000):
        queries, docs = sides(spark.createDataFrame(made[:n], "id bigint, embedding array<float>"))
        queries = queries.where("query_id < 300")
        ranked.clear()
        found = InvertedFile(docs, 3, sample=400).search(queries).collect()
        most.append(max(ranked))
        exact = {(q, d) for q, d, _, _ in tuples(cosine_topk(queries, docs, 3))}
        assert len({(r.query_id, r.doc_id) for r in found} & exact) / len(exact) > 0.9
        assert min(r.compared for r in found) > 3
    blocks = 1 + math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))
    assert max(most) <= 300 * 3 * blocks and most[1] <= 1.3 * most[0]


def test_blocks_of_lists_give_the_same(spark, monkeypatch):
    """Few large blocks, many small ones, and lists that are cut into several."""
    from loomwright.operators import inverted_file

    draw = np.random.default_rng(6)
    made = draw.standard_normal((600, 12))
    made[:200] = made[0] + 0.2 * draw.standard_normal((200, 12))  # one long list
    df = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(made)], "id string, embedding array<double>")
    queries, docs = sides(df)
    out = []
    for least, most in ((1000, 64 << 20), (40, 64 << 20), (1, 8 * 12 * 25)):
        monkeypatch.setattr(inverted_file, "LEAST_BLOCK", least)
        monkeypatch.setattr(inverted_file, "BLOCK_BYTES", most)
        index = InvertedFile(docs, 3, lists=9, sample=500)
        out.append(sorted(tuple(r) for r in index.search(queries).collect()))
    assert index._layout.pieces.max() > 1 and len(index._layout.members) > 20
    assert len(out[0]) == 1800 and out[0] == out[1] == out[2]


def test_layout_bounds_blocks_and_places_each_list_once():
    draw = np.random.default_rng(7)
    sizes = np.array([0, 10, 250, 99, 100, 101, 1, 0, 60, 60])
    layout = lay_out(draw.standard_normal((10, 4)), sizes, 100)
    held = np.zeros(len(layout.members))
    for at, (first, pieces) in enumerate(zip(layout.first, layout.pieces)):
        for b in range(first, first + pieces):
            assert at in layout.members[b] and (pieces == 1 or len(layout.members[b]) == 1)
            held[b] += sizes[at] / pieces
    assert sum(len(m) for m in layout.members) == layout.pieces.sum() == 13
    assert max(held) < 200


def test_candidates_are_cut_by_code_in_steps(monkeypatch):
    """Hundreds of vectors with one code: the pairs that are held stay bounded, and ties go by id."""
    from loomwright.operators import inverted_file

    for name, value in (("QUERY_STEP", 8), ("DOC_STEP", 16), ("PAIR_STEP", 5)):
        monkeypatch.setattr(inverted_file, name, value)
    draw = np.random.default_rng(8)
    docs, asked = draw.standard_normal((300, 4)), draw.standard_normal((20, 4))
    docs[50:] = docs[50]
    quantiser = inverted_file.train(docs / np.linalg.norm(docs, axis=1, keepdims=True), 3)
    unit = docs / np.linalg.norm(docs, axis=1, keepdims=True)
    lists = quantiser.lists_of(unit)
    shared = inverted_file._Shared(quantiser, lay_out(quantiser.centroids, np.bincount(lists, minlength=3), 1000), lists, unit)
    ids = [f"{i:03}" for i in draw.permutation(300)]
    kind = pa.list_(pa.float64())
    block = inverted_file._Block(shared, pa.table({
        "list": pa.array(lists, pa.int32()), "doc_id": ids, "codes": [c.tobytes() for c in quantiser.encode(unit, lists)],
        "embedding": pa.array(docs.tolist(), kind), "block": pa.array([0] * 300, pa.int32())}))
    queries = pa.table({"query_id": range(20), "embedding": pa.array(asked.tolist(), kind),
                        "floor": [-np.inf] * 20, "reads": [b"\xe0"] * 20})
    got = {}
    for q, d, scores, compared in block.nearest(queries, 3, 290):
        for row, doc, score, n in zip(q, d, scores, compared):
            got.setdefault(int(row), []).append((block.ids[doc].as_py(), score, int(n)))
    for q, v in enumerate(asked):
        exact = sorted((-round(float(c), 9), i) for c, i in zip(unit @ v / np.linalg.norm(v), ids))[:3]
        assert [(i, n) for i, _, n in got[q]] == [(i, n) for (_, i), n in zip(exact, (290, 0, 0))]


def test_inverted_file_of_few_or_no_vectors(spark):
    kind = "id string, embedding array<float>"
    queries, docs = sides(spark.createDataFrame([("a", [1.0, 0.0, 1.0]), ("b", [0.0, 0.0, 0.0]), ("c", None), ("d", [])], kind))
    assert tuples(approximate_topk(queries, docs, 3)) == [("a", "a", 1.0, 1)]
    assert approximate_topk(queries, docs.limit(0), 3).count() == 0


@pytest.fixture(scope="module")
def texts(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta the the the".split()
    rng = np.random.default_rng(2)
    made = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(300)]
    for i in range(0, 300, 3):
        made[i] = "the one text that a third share, The END"
    made[5] = "x " * 5000 + "alpha"
    return spark.createDataFrame(list(enumerate(made)), "id bigint, text string"), made


def lexical_brute_force(made, k):
    import re
    from collections import Counter

    bags = [Counter(w for w in re.split(r"[^a-z]+", t.lower()) if w) for t in made]
    norms = [sum(c * c for c in b.values()) ** 0.5 for b in bags]
    out = []
    for q, bag in enumerate(bags):
        scored = []
        for d, other in enumerate(bags):
            dot = float(sum(c * other[w] for w, c in bag.items()))
            if dot:
                scored.append((-dot / (norms[d] * norms[q]), d))
        out += [(q, d, -s, r) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_lexical_topk_is_exact_on_both_paths(texts):
    df, made = texts
    queries, docs = sides(df)
    expected = lexical_brute_force(made, 3)
    assert tuples(lexical_topk(queries, docs, 3)) == expected
    assert tuples(lexical_topk(queries, docs, 3, max_shared=5)) == expected


def test_documents_go_only_to_blocks_that_ask_for_their_words(spark):
    queries = spark.createDataFrame(
        [(1, ["red", "red"]), (2, ["blue"]), (3, ["green"]), (4, [])], "query_id int, words array<string>")
    docs = spark.createDataFrame(
        [("a", ["red", "red", "sky", "blue"]), ("b", ["sky"]), ("c", ["green"]), ("d", [])], "doc_id string, words array<string>")
    asked, routed = route_by_words(queries, docs, 4)
    by_block = {}
    for r in asked.collect():
        by_block.setdefault(r.block, set()).update(r.words)
    rows = routed.collect()
    have = {"a": {"red", "sky", "blue"}, "b": {"sky"}, "c": {"green"}, "d": set()}
    assert {(r.doc_id, r.block) for r in rows} == {
        (d, b) for d, w in have.items() for b, asked_for in by_block.items() if w & asked_for}
    for r in rows:
        assert set(r.words) == have[r.doc_id] & by_block[r.block]
        assert r.squares == (6.0 if r.doc_id == "a" else 1.0)


def test_long_postings_are_met_in_pieces(texts, monkeypatch):
    import pyarrow as pa

    from loomwright.operators import lexical

    _, made = texts
    words = pa.array([[w for w in t.lower().split()] for t in made])
    queries = pa.table({"words": words})
    docs = pa.RecordBatch.from_arrays([words], names=["words"])
    scorer = WordScorer()
    state = scorer.prepare(queries)

    def scores():
        parts = list(scorer.score(state, docs))
        return np.concatenate([r for r, _ in parts]), np.concatenate([s for _, s in parts])

    rows, whole = scores()
    monkeypatch.setattr(lexical, "_BATCH_CELLS", 1000)
    rows_again, pieces = scores()
    assert (rows == rows_again).all()
    np.testing.assert_array_equal(whole, pieces)


def test_embedding_batches(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id int, text string")
    out = {r.id: r.embedding for r in embed_texts(df, "text", lambda: hashing_embedder(8), batch_size=2).collect()}
    assert sum(x * x for x in out[1]) == pytest.approx(1.0, abs=1e-6)
    assert sorted(x for x in out[1] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert set(out[2]) == set(out[3]) == {0.0}


def test_context_of_requests_with_and_without_hits(spark):
    hits = "query_id bigint, rank int, page_content string, metadata string"
    requests = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    first = spark.createDataFrame([(1, 2, "B", None), (1, 1, "A", '{"s":1}')], hits)
    second = spark.createDataFrame([(1, 1, "T", "{}")], hits)
    out = {r.query_id: r.context for r in assemble_context(requests, first, second).collect()}
    assert out[2] == NO_CONTEXT
    assert out[1] == (
        "Relevant Dataset Metadata:\n  - Document 1 (Dataset): 'A'\n    Metadata: {\"s\":1}\n"
        "  - Document 2 (Dataset): 'B'\n\nRelevant Approved ETL Tasks (Past Examples):\n"
        "  - Document 1 (Approved Task): 'T'\n"
    )


# ---- the document index ----


def batch(spark, rows):
    df = spark.createDataFrame(rows, "id string, text_content string, source string, pos int")
    return df.select(
        "id", "text_content", F.to_variant_object(F.struct("source")).alias("metadata"), "pos"
    )


def content(index):
    return sorted((r.id, r.text_content) for r in index.read().select("id", "text_content").collect())


def test_upsert_replaces_keeps_the_last_and_is_idempotent(spark):
    index = DocumentIndex(spark, scratch_path(spark, "test-index"))
    assert index.read() is None
    index.upsert(batch(spark, [("a", "old", "s", 0), ("b", "b", None, 1)]), "pos")
    new = batch(spark, [("a", "newest", "s", 9), ("a", "newer", "s", 2), ("c", "c", "t", 1)])
    for _ in range(2):
        index.upsert(new, "pos")
        assert content(index) == [("a", "newest"), ("b", "b"), ("c", "c")]
    index.delete(metadata_equals("source", "s"))
    assert content(index) == [("b", "b"), ("c", "c")]  # a null source survives
    index.delete(metadata_equals("missing", "x"))
    assert content(index) == [("b", "b"), ("c", "c")]


def test_a_change_is_a_new_table(spark, tmp_path):
    path = str(tmp_path / "index")
    index = DocumentIndex(spark, path)
    index.upsert(batch(spark, [(f"k{i}", f"text {i}", "s", 0) for i in range(400)]), "pos")
    index.upsert(batch(spark, [("k1", "new", "t", 0)]), "pos")
    index.delete(F.col("id") == "k2")
    before = content(index)
    assert len(before) == 399 and ("k1", "new") in before
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == [f"table-{i:09d}" for i in (1, 2, 3)]
    (tmp_path / "index" / "table-000000004").mkdir()  # of a job that died
    assert content(index) == before
    index.drop_old()
    assert content(index) == before
    index.upsert(batch(spark, [("k2", "again", "s", 0)]), "pos")
    assert len(content(index)) == 400
    assert (tmp_path / "index" / "table-000000005").exists()


def test_a_search_in_one_source_reads_its_files_alone(spark):
    index = DocumentIndex(spark, scratch_path(spark, "test-index"), dimension=16)
    rows = batch(spark, [(f"k{i}", f"text {i}", ("s", "t", "", "12", "a b/c=d", None)[i % 6], 0) for i in range(60)])
    index.upsert(rows, "pos", embedder=hashing_embedder(16))
    for source in ("s", "", "12", "a b/c=d"):
        part = index.read(source)
        assert part.count() == 10
        files = {f for f in part.inputFiles()}
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(_layout" in plan and "metadata" in part.columns
        read = part.select(F.input_file_name().alias("f")).distinct().collect()
        assert {r.f for r in read} < files | {r.f for r in read} and all("_layout=" in r.f for r in read)
        assert len({r.f.split("_layout=")[1].split("/")[0] for r in read}) == 1
    assert index.read("none").count() == 0 and index.read().count() == 60


def test_any_column_name_survives_last_per_id(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "id string, place int, _rn int")
    assert [tuple(r) for r in last_per_id(rows, "place").collect()] == [("a", 6)]


def test_repeated_ids_need_a_position(spark):
    index = DocumentIndex(spark, scratch_path(spark, "test-index"))
    with pytest.raises(ValueError, match="repeated"):
        index.upsert(batch(spark, [("a", "x", "s", 0), ("a", "y", "s", 1)]).drop("pos"))


def test_search_filters_and_returns_content(spark):
    index = DocumentIndex(spark, scratch_path(spark, "test-index"), dimension=16)
    rows = batch(spark, [("a", "red apple", "s", 0), ("b", "red apple", "t", 0), ("c", "blue sky", "t", 0)])
    index.upsert(rows, "pos", embedder=hashing_embedder(16))
    asked = spark.createDataFrame([(1, "Apple, RED"), (2, None)], "query_id int, text string")
    hits = index.search(asked, 2, hashing_embedder(16), metadata_equals("source", "t")).collect()
    assert [(h.query_id, h.id, h.rank, h.text_content) for h in hits if h.rank == 1] == [(1, "b", 1, "red apple")]
    index.delete(F.col("id") == "b")
    in_source = index.search(asked, 2, hashing_embedder(16), source="s").where("query_id = 1").collect()
    assert [h.id for h in in_source] == ["a"]
    hits = index.search(asked, 2, hashing_embedder(16)).where("rank = 1").collect()
    assert [h.id for h in hits] == ["a"]
    with pytest.raises(ValueError, match="no vectors"):
        DocumentIndex(spark, scratch_path(spark, "test-index")).search(asked, 1, hashing_embedder(16))


def test_index_checks(spark):
    with pytest.raises(ValueError, match="lack an id"):
        check_ids(spark.createDataFrame([(None, "t")], "id string, text_content string"))
    vectors = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "embedding array<float>")
    with pytest.raises(ValueError, match="2 vectors"):
        check_dimension(vectors, 2)
    made = as_documents(spark.range(3), F.lit("t"))
    assert made.select("id").distinct().count() == 3
    df = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, p boolean")
    assert [r.id for r in delete_where(df, F.col("p")).orderBy("id").collect()] == [1, 3]
