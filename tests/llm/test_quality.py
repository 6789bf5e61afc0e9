from collections import Counter

from loomwright.llm import quality
from tests.llm.helpers import DOCS, HARD, documents, rows, with_clashes, words


def brute(text):
    w = words(text, fold=False)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    places = {p for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 50 or 100 * len(places) > 50 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(places), failed


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts(spark):
    docs = [*HARD, (30, "# a|b\n# a|b\n \n\nx <y>\nx <y> "), (31, "a a a a a a"), (32, "a b c a b c x a b c")]
    got = quality.judge(with_clashes(documents(spark, docs)))
    assert rows(got, "doc_id", *COUNTS) == sorted(((d, *brute(t)) for d, t in docs), key=repr)
    assert quality.judge(spark.createDataFrame([], DOCS)).count() == 0


def hosts(spark):
    text = lambda i, n=60: " ".join(f"w{i}n{j}" for j in range(n))
    shared = "Cookie notice\taccept ALL of it"
    rows_ = [(i, f"{text(i)}\n{shared if i % 2 else shared.lower()}", "a") for i in range(40)]
    long_shared = " ".join(f"menu{j}" for j in range(300))
    rows_ += [(100 + i, f"{text(100 + i)}\n{long_shared}", "b") for i in range(30)]
    rows_ += [(150 + i, f"{text(150 + i, 310)}\n{long_shared}", "b") for i in range(20)]
    rows_ += [(200 + i, f"{text(200 + i)}\n{shared}", "c") for i in range(5)]
    rows_ += [(300 + i, text(300), "d") for i in range(50)]  # copies are one document
    # Near copies: each has one line of its own, the others stand in all.
    lines = [text(400 + k, 12) for k in range(10)]
    rows_ += [(400 + i, "\n".join([*lines[:i % 10], text(500 + i, 12), *lines[i % 10 + 1:]]), "e") for i in range(60)]
    return documents(spark, rows_), rows_


def test_common_lines_go_and_depleted_documents(spark):
    docs, rows_ = hosts(spark)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[i].words_left == 60 and got[i].kept for i in range(40))
    assert all(got[100 + i].words_left == 60 and not got[100 + i].kept for i in range(30))
    assert all(got[150 + i].words_left == 310 and got[150 + i].kept for i in range(20))
    assert all(got[200 + i].words_left == 66 and got[200 + i].kept for i in range(5))
    assert all(got[300 + i].words_left == 60 and got[300 + i].kept for i in range(50))
    assert all(got[400 + i].words_left == 120 and got[400 + i].kept for i in range(60))


def test_the_limit_does_not_grow_with_the_host(spark):
    text = lambda i: " ".join(f"w{i}n{j}" for j in range(60))
    docs = documents(spark, [(i, text(i) + ("\nshared by few" if i < 20 else ""), "h") for i in range(3000)])
    got = quality.judge(docs).where("words_left < n_words")
    assert sorted(r.doc_id for r in got.collect()) == list(range(20))


def test_common_lines_of_the_given_table_go(spark):
    """Lines that 20 or more distinct texts of a host share, and clean documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    judged = quality.judge(docs)
    changed = judged.where("words_left < n_words").count()
    assert changed > 500
    assert judged.where("NOT base_failed AND NOT kept").count() == 0
    assert quality.clean(docs).count() == judged.where("NOT base_failed").count()


def test_clean_keeps_all_other_lines(spark):
    docs, rows_ = hosts(spark)
    cleaned = quality.clean(with_clashes(docs))
    assert cleaned.columns == with_clashes(docs).columns
    got = {r.doc_id: r for r in cleaned.collect()}
    assert sorted(got) == [d for d, _, h in rows_ if not 100 <= d < 130]
    assert got[3].text == rows_[3][1].split("\n")[0] and got[3].n_chars == len(got[3].text)
    assert got[201].text == dict((r[0], r[1]) for r in rows_)[201]


def test_clean_of_hard_rows(spark):
    left = quality.clean(documents(spark, HARD))
    assert sorted(r.doc_id for r in left.collect()) == []
    assert quality.clean(spark.createDataFrame([], DOCS)).count() == 0
    null_host = documents(spark, [(1, " ".join(f"w{i}" for i in range(60)), None)])
    assert quality.clean(null_host).count() == 1
