"""Pairs that are scored within a document's row, against plain versions and joins."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators import retrieval as R

ODD = ["a-b_c+. A.B x x X", "", None, "ſKKİ é1é", "퟿-- ++a a- 中文abc中", "sve2 SVE supports", "the the of " * 50]


def corpus_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "ordinal long, search_text string")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_equal_native_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(50).collect()
    corpus = corpus_of(spark, ODD + [r["text"] for r in docs])
    native = {r["ordinal"]: r["t"] for r in corpus.select("ordinal", X.tokens(F.col("search_text")).alias("t")).collect()}
    got = R.token_counts(corpus).collect()
    assert len(got) == len(native) > 50
    for r in got:
        assert r["dl"] == len(native[r["ordinal"]]) and dict(zip(r["terms"], r["tfs"], strict=True)) == Counter(native[r["ordinal"]])


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)] + ["the", "support"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))) for _ in range(300)] + ["the support w1"] * 40 + ODD
    corpus = corpus_of(spark, texts)
    asks = [(i, " ".join(rng.choice([*words, "unknown"], 9))) for i in range(30)] + [(30, ""), (31, "the support w1"), (32, "zzz")]
    queries = spark.createDataFrame(asks, "query_id long, query string")
    counts = R.token_counts(corpus).cache()
    stats = R.stats_of(counts)
    return queries, counts, R.idf(R.postings_of(counts), stats), stats


def test_pairs_need_no_join_with_postings(scored, monkeypatch):
    """A term that every document has made a row of a join for each query and document."""
    found = R.bm25(*scored)
    assert "Join" not in plan_of(found) and "Aggregate" not in plan_of(found)
    rows = lambda df: sorted((r["query_id"], r["ordinal"], r["score"], r["n_q"], r["n_salient"], r["n_direct"]) for r in df.collect())
    whole = rows(found)
    monkeypatch.setattr(R, "few", lambda *_: False)
    joined = rows(R.bm25(*scored))
    assert [r[:2] + r[3:] for r in whole] == [r[:2] + r[3:] for r in joined] and len(whole) > 5000
    assert max(abs(a[2] - b[2]) for a, b in zip(whole, joined, strict=True)) < 1.5e-6


@pytest.mark.parametrize("step", [200, 5000, 2_000_000])
def test_tasks_keep_what_can_be_among_the_best(scored, monkeypatch, step):
    best = lambda df, k: sorted(tuple(r) for r in R.bm25_topk(df, k).collect())
    monkeypatch.setattr(R, "STEP", step)
    for depth in (1, 5, 45, 1000):
        assert best(R.bm25(*scored, depth), depth) == best(R.bm25(*scored), depth)


def test_matches_are_counted_within_a_row(spark):
    corpus = corpus_of(spark, [*ODD, "x y"])
    terms = spark.createDataFrame([(1, "x"), (1, "y"), (1, "the"), (2, "sve"), (3, "none")], "query_id long, term string")
    found = R.matches(terms, corpus)
    assert "Join" not in plan_of(found) and "Aggregate" not in plan_of(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 1), (1, 6, 1), (1, 7, 2), (2, 5, 1)]


def test_questions_are_found_in_one_pass(spark):
    texts = ["what is x? yes", "xwhat is x?y", "What is x?", "", None, "?!", "is"]
    asked = [(1, "what is x?"), (2, "?!"), (3, ""), (4, None), (5, "absent"), (6, "is"), (7, "is")]
    corpus = corpus_of(spark, texts)
    found = R.documents_with(corpus, spark.createDataFrame(asked, "query_id long, q string"))
    assert len(re.findall("LogicalRDD|LocalRelation", plan_of(found))) <= 4
    want = sorted((i, n) for i, q in asked for n, t in enumerate(texts) if q is not None and t is not None and q in t)
    assert sorted(tuple(r) for r in found.collect()) == want


def kept(spark):
    return lambda df, name: df.cache()


@pytest.mark.parametrize("step", [30, 4_000_000])
def test_a_batch_reads_a_corpus_once(spark, monkeypatch, step):
    """all terms were written as strings, and grouped twice; documents' terms were counted again for their marks."""
    texts = [*ODD, "the sme sme2x SVE1 -.-sme server", "--- -a", "x" * 200]
    monkeypatch.setattr(R, "TEXT_STEP", step)
    rows = R.batch_counts(corpus_of(spark, texts), ["sve2", "the", "x"]).collect()
    plain = [Counter(x.lower() for x in re.findall(r"[A-Za-z0-9][A-Za-z0-9_\-+.]*", t or "")) for t in texts]
    docs = {r["ordinal"]: r for r in rows if r["dl"] is not None}
    assert len(docs) == len(texts)
    for n, p in enumerate(plain):
        r = docs[n]
        assert r["dl"] == p.total() and dict(zip(r["ids"], r["tfs"], strict=True)) == {k: p[t] for k, t in enumerate(["sve2", "the", "x"]) if t in p}
        assert sorted(r["marks"]) == sorted(t for t in p if t in R.MARKS or re.fullmatch("(sme|sve)[0-9]*", t))
    df = Counter()
    for r in rows:
        if r["dl"] is None:
            assert r["ordinal"] is None
            df.update(dict(zip(r["words"], r["dfs"], strict=True)))
    assert df == Counter(t for p in plain for t in p)


def test_pairs_by_ids_equal_pairs_by_terms(scored, spark, monkeypatch):
    queries, counts, weights, stats = scored
    texts = counts.select("ordinal", F.array_join(F.flatten(F.zip_with("terms", "tfs", lambda t, n: F.array_repeat(t, n))), " ").alias("search_text"))
    got = R.counted(queries, texts, kept(spark))
    assert "terms" not in got[0].columns
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert [(r[0], r[1]) for r in rows(got[1])] == [(r[0], r[1]) for r in rows(weights)]
    want = rows(R.bm25(*scored, 45))
    assert rows(R.bm25_topk(R.bm25(queries, *got, 45), 45)) == rows(R.bm25_topk(R.bm25(*scored, 45), 45)) and len(want) > 500
    pairs = R.bm25_topk(R.bm25(*scored, 45), 45).select("query_id", "ordinal")
    marked = lambda c: sorted((r["query_id"], r["ordinal"], r["n_q"], r["n_salient"], r["n_direct"], sorted(r["marks"])) for r in R.with_body(pairs, queries, texts, c).collect())
    assert marked(got[0]) == marked(counts)
    monkeypatch.setattr(R, "few", lambda *_: False)
    more = R.counted(queries, texts, kept(spark))
    assert "terms" in more[0].columns and [r[:2] for r in rows(more[1])] == [r[:2] for r in rows(weights)]


def test_prepass_counts_no_terms_again(spark, monkeypatch):
    """the terms of all documents were counted anew for the marks of the paired ones."""
    from quarrymill.plans import catalogue

    def again(*_, **__):
        raise AssertionError

    monkeypatch.setattr(R, "token_counts", again)
    assert catalogue.QUERIES["lexical_prepass"](spark, "/root/testdata/sf0.001").count() > 1000


def test_texts_of_others_are_not_shuffled(spark):
    """all texts were shuffled to find the candidates'."""
    from quarrymill.plans import catalogue

    meta = catalogue.corpus(spark, "/root/testdata/sf0.001")
    found = R.document_terms(meta, meta.select("ordinal").filter("ordinal < 9"))
    assert re.search(r"Join LeftSemi.*strategy=broadcast", plan_of(found)) and found.count() == 9


def test_denial_is_looked_for_by_its_word(spark):
    from quarrymill import config as C

    assert all(C.DENIED in p for p in C.NEGATIVE_SUPPORT)
    texts = ["Does  NOT\nsupport x", "unsupported", "doesn't Support", "supports", "no", "", None, "İ UNSUPPORTED"]
    plain = re.compile("(?i)" + "|".join(C.NEGATIVE_SUPPORT))
    got = {r["ordinal"]: r["d"] for r in corpus_of(spark, texts).select("ordinal", X.denies_support(F.col("search_text")).alias("d")).collect()}
    assert got == {n: None if t is None else bool(plain.search(t)) for n, t in enumerate(texts)}


def test_pairs_find_their_texts_without_a_shuffle(spark):
    """the texts of all documents were shuffled to meet a few pairs."""
    from quarrymill.plans import catalogue

    found = catalogue.candidates("q", "t")(spark, "/root/testdata/sf0.001")
    assert re.search(r"Join Inner.*strategy=broadcast", plan_of(found)) and found.count() == 200


def test_a_text_is_cut_once_for_its_matches(spark):
    """within the filter of the question's tokens, the text was cut for each of them."""
    pairs = spark.createDataFrame([("sve x x y", "sve2 X z"), ("sve", ""), ("", "a"), (None, None)], "q string, t string")
    found = pairs.select(X.match_count(X.tokens(F.col("q")), X.tokens(F.col("t"))).alias("n"))
    assert plan_of(found).count("regexp_extract_all") == 2
    assert [r["n"] for r in found.collect()] == [3, 0, 0, 0]


def test_no_term_of_a_document_is_a_row(spark, monkeypatch):
    """every term of every document was a row, grouped twice."""
    from quarrymill.plans import catalogue

    def as_rows(*_, **__):
        raise AssertionError

    monkeypatch.setattr(R, "postings_of", as_rows)
    assert catalogue.QUERIES["url_dedup"](spark, "/root/testdata/sf0.001").count() > 1000
