"""Operators against slow twins that state the method step by step, and odd tables."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from quarrymill.llm import archives, labelled, language, mixing, near_dedup, pieces, quality, subword, texthash, token_counts, toxicity, vectors

R = random.Random(9)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_equals_explicit_lengths(docs, labels):
    """Every window's two compressed lengths, one call each, and the fit by hand."""
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    learn = labels.filter(labelled.crc_mod("doc_id", 3) != 1).select("doc_id", F.col("toxic").alias("label"))
    sample, counts = labelled.sample_labelled(docs, learn, 2000)
    m = toxicity.fit(sample, counts)
    by = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False) for d in (m["base"], m["marked"])]
    for r in docs.limit(60).collect():
        diff = [len(by[0].compress(b" " + w + toxicity.PAD)) - len(by[1].compress(b" " + w + toxicity.PAD)) for w in toxicity.split(r["text"])]
        n = [sum(d >= cut for d in diff) for cut in toxicity.CUTS]
        x = [1.0, *(math.log1p(k) for k in n), *(math.log1p(1000 * k / max(1, len(diff))) for k in n)]
        z = sum(a * b for a, b in zip(x, m["w"], strict=True))
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_language_equals_explicit_cosines(docs):
    """Prototypes and documents as bundled vectors, compared by cosine."""
    letters, table = language.letter_vectors(11), language.symbol_table()
    rows = docs.select("doc_id", "text", "lang").collect()

    def vector(text):
        ids, _, _ = language.trigrams([text], table)
        return language.bundle(ids, np.ones(len(ids)), letters)

    sums = {}
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vector(r["text"])
    names = sorted(sums)
    proto = np.stack([sums[n] / np.linalg.norm(sums[n]) for n in names])
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    for r in rows:
        v = vector(r["text"])
        best = np.sort(proto @ v)[::-1]
        if np.linalg.norm(v) > 0 and best[0] - best[1] > 1e-6 * np.linalg.norm(v):
            assert got[r["doc_id"]] == names[int((proto @ v).argmax())]


def test_posteriors_equal_explicit_averages(docs, labels):
    """Each text's bag of features, averaged feature by feature, through the softmax."""
    learn = labels.filter(labelled.crc_mod("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    table, names = subword.fit(*labelled.sample_labelled(docs, learn, 1500))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    for r in docs.limit(80).collect():
        ids, w = next(subword.bags([r["text"] or ""]))
        z = (w[:, None].astype(np.float64) * table[ids]).sum(axis=0) + table[-1]
        p = np.exp(z - z.max())
        assert got[r["doc_id"]] == pytest.approx((p / p.sum())[names.index(1)], abs=1e-4)


def test_rates_equal_explicit_least_squares(spark):
    """The same steps over all rows in one array; the targets are met and the residual says so."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}
    rows = mixing.fit_rates(docs, docs.select("doc_id", F.col("lang").alias("label")), targets).select("n_tokens", "posterior", "rate", "residual").collect()
    n, p = np.array([r["n_tokens"] for r in rows], float), np.array([r["posterior"] for r in rows])
    w = np.array([targets[x] for x in sorted(targets)])
    once = n @ p
    goal, rate = w * (once / w).max(), np.array([r["rate"] for r in rows])
    gap = np.abs((rate * n) @ p - goal).max() / goal.sum()
    assert rate.min() >= 0 and gap == pytest.approx(rows[0]["residual"], abs=1e-9)
    assert gap <= 1e-6
    # Of all rates that meet the targets none changes less: the change is one combination of posteriors wherever a rate is over 0.
    on = rate > 1e-9
    move = np.linalg.lstsq(p[on], rate[on] - 1, rcond=None)[0]
    assert np.allclose(p[on] @ move, rate[on] - 1, atol=1e-6) and (p[~on] @ move <= -1 + 1e-6).all()
    kept = mixing.fit_rates(docs, docs.select("doc_id", F.col("lang").alias("label")), {"en": 0.6, "fr": 0.4}).select("n_tokens", "posterior", "rate").collect()
    now = sum(np.array(r["posterior"]) * r["n_tokens"] * r["rate"] for r in kept)
    names = sorted(targets)
    assert now[names.index("de")] == pytest.approx(once[names.index("de")], rel=1e-4)  # no target: it keeps its tokens


def test_words_that_end_with_a_segment():
    data = b"a" * 2**20 + b" b c"
    count = lambda b: len(texthash.words(np.frombuffer(b, np.uint8), np.array([0, len(b)]), texthash.powers())[0])
    assert count(data) == 3 and count(b"a" * (2**21 + 5) + b" b") == 2 and count((b"x" * 9 + b" ") * 300_000) == 300_000


def test_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "y"), (3, b, "y"), (4, b + " z", "z"), (None, a, "n"), (9, "", "e"), (9, None, "e"), (8, "q", "e"), (8, "q", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = {(r["doc_id"], r["text_hash"]): r["component_id"] for r in near_dedup.near_dedup(df).collect()}
    assert {v for (i, _), v in got.items() if i in (1, 2, 3, 4)} == {1}
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in near_dedup.keep_one(df).collect()), key=str)
    assert kept == sorted([(0, a), (1, a), (1, b), (8, "q"), (9, ""), (9, None)], key=str)


def test_near_dedup_recall(docs, spark):
    """All links of an exact join over a whole table, and a hot source whose documents share 45 per cent of their words."""
    stem = " ".join(f"s{i}" for i in range(90))
    hot = [(10_000 + i, stem + " " + " ".join(f"t{i}x{j}" for j in range(110)) + (" end" if i % 2 else "")) for i in range(0, 400)]
    hot += [(20_000 + i, t + " more") for i, t in hot[:60]]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(hot, "doc_id long, text string"))
    sets = {}
    for r in df.collect():
        w = (r["text"] or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                top[q] = p
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df, node_size=32).collect()}
    assert got == {i: root(i) for i in ids}


def test_postings_walk():
    """Ties, repeated ids and early stops give the scores of brute force."""
    rng = np.random.default_rng(4)
    for spread in (1.0, 30.0):
        x = np.floor(256 * rng.normal(size=(700, 12)) * np.exp(rng.normal(size=(700, 1)) * math.log(spread)))
        x[50:60] = x[40]
        ids = np.arange(700)
        ids[5] = 4
        rows = list(vectors.postings(ids, x))
        q, own = x[::50], ids[::50]
        found = [tuple(r) for out in vectors.impact_search(rows[1:], rows[0][2], rows[0][3], q, own, 5) for r in zip(*out, strict=True)]
        want = []
        for v, i in zip(q, own, strict=True):
            others = [(-float(x[p] @ v), ids[p]) for p in range(700) if ids[p] != i]
            want += [(i, j, -s) for s, j in sorted(others)[:5]]
        assert [(a, b, c) for a, b, c in found] == want
    with pytest.raises(ValueError, match="exact"):
        list(vectors.impact_search([(0, 60, np.array([0]), np.array([2.0**30]))], np.array([1]), np.array([2.0**60]), np.array([[2.0**30]]), np.array([2]), 1))


def test_repeated_query_ids(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.5, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vectors.exact_topk(df).orderBy("rank").collect()]
    assert got == [(50, 1, 1, 128 * 256), (50, 2, 2, 128 * 256)]


def test_empty_tables(docs, labels, spark):
    none = docs.limit(0)
    v = spark.read.parquet(f"{SF}/embeddings.parquet").limit(0)
    assert near_dedup.near_dedup(none).count() == near_dedup.keep_one(none).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert pieces.encode_pieces(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert vectors.exact_topk(v).count() == vectors.near_vectors(v).count() == 0
    assert mixing.fit_rates(none, none.select("doc_id", F.col("lang").alias("label")), {"en": 1.0}).count() == 0


def test_clashing_columns(docs, labels):
    """Columns named like what operators use inside stay as they are."""
    d = docs.limit(40)
    for c in ("_text", "_ids", "_copy", "id", "label", "held"):
        d = d.withColumn(c, F.lit("own"))
    path = public_tokenizers.path("piece_bpe_32k.model")
    outs = [token_counts.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")), pieces.encode_pieces(d, path), quality.score_quality(d, labels), toxicity.score_toxicity(d, labels), language.identify(d), near_dedup.keep_one(d)]
    outs.append(mixing.apply_rates(mixing.fit_rates(d, d.select("doc_id", F.col("lang").alias("label")), {"en": 1.0}), d.columns))
    for out in outs:
        rows = out.collect()
        assert rows and all(r[c] == "own" for r in rows for c in ("_text", "_ids", "_copy", "id", "label", "held"))


def test_long_texts(spark, docs, labels):
    """Texts over a mebibyte, without blanks and with many."""
    long = spark.createDataFrame([(10**6, "x" * (2**20 + 7)), (10**6 + 1, "the of and " * 120_000)], "doc_id long, text string")
    d = docs.unionByName(long, allowMissingColumns=True)
    new = lambda df: df.filter("doc_id >= 1000000").count()
    assert new(quality.score_quality(d, labels)) == new(toxicity.score_toxicity(d, labels)) == new(language.identify(d)) == new(near_dedup.near_dedup(d)) == 2
    rates = mixing.fit_rates(d, docs.select("doc_id", F.col("lang").alias("label")), {"en": 1.0}).filter("doc_id >= 1000000")
    assert {r["n_tokens"] for r in rates.collect()} >= {360_000}


def test_equal_merges_and_merge_fallback():
    """The path is the merge procedure's on every word: no fallback exists."""
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    score = {p: s for p, s, t in model["pieces"] if t in (1, 4)}
    fst = pieces.Transducer(pieces.compile_model(model))
    words = [" " * R.randrange(40) + "".join(R.choice("abcdeéntions\t▁") for _ in range(R.randrange(1, 12))) for _ in range(300)]
    for w in words:
        want = pieces.merged("▁" + w.replace(" ", "▁"), score)[0]
        got = [model["pieces"][i][0] for i in np.frombuffer(fst.encode_all([w])[0], dtype="<i4")]
        assert "".join(got) == "".join(p if p in score else "".join(f"<0x{b:02X}>" for b in p.encode()) for p in want) and len([g for g in got if g in score]) == len([p for p in want if p in score])
    with pytest.raises(ValueError, match="equal score"):
        pieces.compile_model({"pieces": [("a", 0.0, 1), ("b", 0.0, 1), ("ab", -1.0, 1), ("ba", -1.0, 1)], "kind": 2, "prefix": True})


def test_archive_errors():
    head = b"filedesc://x 0.0.0.0 20000101000000 text/plain 0\n"
    for data, message in ((head + b"u 1.2.3.4 20000101000000 text/html 10\nabc", "cut off"), (head + b"u 1.2.3.4 20000101000000 text/html ten\nabc", "declares")):
        with pytest.raises(ValueError, match=message):
            list(archives.parse_arc(data))
    for data, message in ((b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc", "cut off"), (b"WARC/1.0\r\nContent-Length: x\r\n\r\nabc", "declares"), (b"WARC/1.0\r\nWARC-Type: response", "declares")):
        with pytest.raises(ValueError, match=message):
            list(archives.parse_warc(data))
    whole = archives.member(b"abc") + archives.EMPTY + archives.member(b"def")
    assert archives.inflated(whole, "f") == b"abcdef" and archives.inflated(b"plain", "f") == b"plain"
    with pytest.raises(ValueError, match="cut off"):
        archives.inflated(whole[:-4], "f")


def test_a_member_for_each_record(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", "<p>" + "y" * 1200) for i in range(3)], "page_id long, url string, html string")
    arc, warc = f"{tmp_path}/arc", f"{tmp_path}/warc"
    archives.write_arc(df.coalesce(1), arc)
    archives.convert_to_warc(spark, arc, warc)
    (raw,) = [bytes(r["content"]) for r in archives.read_files(spark, warc).collect()]
    members, ids = [], set()
    while raw:
        unpack = zlib.decompressobj(31)
        members.append(unpack.decompress(raw))
        raw = unpack.unused_data
    records = [m for m in members if m]
    assert len(records) == 4 and all(m.startswith(b"WARC/1.0\r\n") and m.endswith(b"\r\n\r\n") for m in records)
    for m in records[1:]:
        ids.add(archives.header_value(m, "WARC-Record-ID"))
    revisit = next(m for m in records if b"WARC-Type: revisit" in m)
    assert len(ids) == 3 and archives.header_value(revisit, "WARC-Refers-To") in ids and archives.header_value(revisit, "WARC-Refers-To-Target-URI") == "http://h/2" and archives.header_value(revisit, "WARC-Refers-To-Date")


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    q = corpus_pipeline.quality(spark, docs, SF)
    assert q.columns == docs.columns and q.exceptAll(docs).count() == 0
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in rows)
    one = corpus_pipeline.dedup(spark, docs, SF)
    assert one.columns == docs.columns and 0 < one.count() < docs.count()
