"""Operators against brute force, libraries and round trips, with the odd cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import archives, mixing, near_dedup, pieces, quality, token_counts, toxicity, vectors
from quarrymill.llm.language import identify
from quarrymill.llm.shared import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"
R = random.Random(5)
BASE = [" ".join(R.choice("alpha beta gamma delta rho sigma tau phi chi psi".split()) + str(R.randrange(300)) for _ in range(80)) for _ in range(12)]


def near(text, k):
    w = text.split()
    w[k] = "changed"
    return " ".join(w)


TEXTS = [*BASE, *BASE[:3], *(near(t, 40) for t in BASE[:6]), *(near(near(t, 40), 7) for t in BASE[:3]), None, "", "  \n\t", "one", "ONE", "one two", "x " * 30000, BASE[0].upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, R.choice(["en", "fr", None]), "s", None, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None, None), (3, TEXTS[3], "en", "s", None, None)], DOCS)


def brute_components(items, k, percent):
    sets = {}
    for i, t in items:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    ids, top = sorted(sets), {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                x, y = sets[a], sets[b]
                if a < b and x and y and 100 * len(x & y) >= percent * len(x | y) and top[a] != top[b]:
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    return top, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("small", [128, 2])
def test_near_dedup(docs, small):
    got = near_dedup.near_dedup(docs, shingle_words=4, node_size=small, block_size=2).collect()
    want, sizes = brute_components(list(enumerate(TEXTS)), 4, 80)
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], sizes[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
        else:
            assert r["component_id"] is None and r["kept"]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == got[100] == 100


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, path, chunk=200, overlap=16).collect()}
    t = Tokenizer.from_file(path)
    for i, text in enumerate(TEXTS):
        assert got[i]["n_tokens"] == len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[i]["n_bytes"] == len((text or "").encode())


def test_token_counts_without_blanks():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        c = token_counts.Counter(f.read(), 50, 8)
    t = Tokenizer.from_file(path)
    for text in ("a1b2" * 300, "x<|endoftext|>y " * 40, "é́ ß" * 100, "word " * 200):
        assert c([text]) == [len(t.encode(text, add_special_tokens=False).ids)]


def test_token_counts_after_a_run_without_blanks():
    """A run that covers whole chunks between ordinary words: no token is counted twice."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        model = f.read()
    t = Tokenizer.from_file(path)
    words = " ".join(R.choice("alpha beta gamma delta of the and".split()) for _ in range(400))
    for chunk, overlap, run in ((50, 8, 100), (50, 8, 67), (50, 8, 230), (200, 16, 410), (20, 30, 90)):
        c = token_counts.Counter(model, chunk, overlap)
        for before in (0, 30, 47, 60, 120):
            for filler in ("a1B2/", "日本語"):
                text = words[:before] + " " + (filler * run)[:run] + " " + words
                assert c([text]) == [len(t.encode(text, add_special_tokens=False).ids)]


def vector_table(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 8)).round(3)
    v[100:110] = v[:10] * 2 + 0.01
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)]
    odd = [(200, None, 1), (201, [1.0, None] + [0.0] * 6, 1), (202, [float("nan")] * 8, 1), (203, [0.0] * 8, 1), (204, rows[5][1], 1), (250, [float("inf")] * 8, 1)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), rows + [(203, [0.0] * 8, 1), (204, rows[5][1], 1)]


def test_near_vectors(spark):
    df, rows = vector_table(spark)
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, cell_size=40, block=8, probes=3).collect()}
    rows = [r for r in rows if any(r[1])]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T) >= 0.95
    np.fill_diagonal(link, False)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * link.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (200, 201, 202, 203, 250))
    assert got[204]["component_id"] == 5 and not got[204]["kept"]


@pytest.mark.parametrize(("cell_size", "block"), [(4, 16), (4, 300), (100, 16)])
def test_near_vectors_dense_group(spark, cell_size, block):
    """All links and components of brute force, with cells much more than probes and a group of a third of the rows."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 64))
    v[:500] = v[0] + rng.normal(size=(500, 64)) * 0.17 * np.linalg.norm(v[0]) / 8
    v[500:700] = v[700:900] + rng.normal(size=(200, 64)) * 0.3
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df, cell_size=cell_size, block=block).collect()}
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (x @ x.T) >= 0.95
    np.fill_diagonal(link, False)
    top = np.arange(len(x))
    while True:
        new = np.minimum(top, np.where(link, top[None, :], len(x)).min(axis=1))
        if (new == top).all():
            break
        top = new
    assert link[:500, :500].sum() > 50_000
    assert [got[i]["n_links"] for i in range(len(x))] == link.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == top.tolist()


def test_exact_topk(spark):
    df, rows = vector_table(spark)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.exact_topk(df, block=16, query_block=2).collect()}
    ids, z = np.array([r[0] for r in rows]), np.floor(np.array([r[1] for r in rows]) * 256)
    for q in np.flatnonzero(ids % 50 == 0):
        s = z @ z[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        assert [got[ids[q], r + 1] for r in range(5)] == [(ids[i], int(s[i])) for i in order]


def test_pieces(docs, spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, fst = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(pieces.compile_model(pieces.read_model(path)))
    parts = [" ", "  ", "a", "the", "\n", "\t", "é", "日本", "🎉", "ing", "Th", "0", "<s>", "́", " " * 20, "tion", "\x00"]
    for text in ["".join(R.choice(parts) for _ in range(R.randrange(12))) for _ in range(500)]:
        ids = fst.encode_all([text])[0]
        assert np.frombuffer(ids, dtype="<i4").tolist() == library.encode(text)
        assert fst.decode(ids).decode() == text
    encoded = pieces.encode_pieces(docs, path)
    back = {r["doc_id"]: r for r in pieces.decode_pieces(encoded, path, text_col="decoded").collect()}
    assert all(back[i]["decoded"] == (t or "") and back[i]["round_trip"] for i, t in enumerate(TEXTS))


def test_unigram_path():
    model = {"pieces": [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -3.0, 1), ("c", -3.0, 1), ("bc", -2.0, 1)], "kind": 1, "prefix": True}
    ids = pieces.Transducer(pieces.compile_model(model)).encode_all(["abc"])[0]
    assert [model["pieces"][i][0] for i in np.frombuffer(ids, dtype="<i4")] == ["▁a", "bc"]


def labelled(spark):
    rows = []
    for i in range(400):
        words = [R.choice("lorem ipsum dolor sit amet sed magna".split()) + R.choice(["", "a", "o", "um"]) for _ in range(60)]
        toxic, good = i % 4 == 0, i % 3 != 0
        if toxic:
            for at in (5, 25, 45):
                words[at] = R.choice(["wretch", "vermin", "cretin"])
        text = " ".join(words) if good else "| ".join(words)
        rows.append((i, text, "en", "s", 1, "x", int(good), int(toxic)))
    df = spark.createDataFrame(rows, DOCS + ", quality int, toxic int")
    return df.drop("quality", "toxic"), df.select("doc_id", "quality", "toxic")


def test_classifiers(spark, docs):
    d, y = labelled(spark)
    for f, label, fold, held in ((quality.score_quality, "quality", 5, 0), (toxicity.score_toxicity, "toxic", 3, 1)):
        rows = f(d, y).join(y, "doc_id").collect()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == held) for r in rows)
        assert sum(r["predicted"] == r[label] for r in rows if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in rows)
        assert f(docs, y).count() == len(TEXTS) + 2
        assert f(docs, y.limit(0)).count() == len(TEXTS) + 2
        assert f(docs.limit(0), y).count() == 0


def test_language(spark, docs):
    rows = [(i, " ".join(R.choice(("the and of with" if i % 2 else "der und das mit").split()) for _ in range(30)), "en" if i % 2 else "de", "s", 1, "x") for i in range(100)]
    d = spark.createDataFrame([*rows, (1000, "123 !", None, "s", 1, "x"), (1001, None, None, "s", 1, "x")], DOCS)
    got = {r["doc_id"]: r["lang_pred"] for r in identify(d).collect()}
    assert all(got[r[0]] == r[2] for r in rows) and got[1000] == got[1001] == "und"
    assert identify(docs).count() == len(TEXTS) + 2 and identify(docs.limit(0)).count() == 0


def test_mixing(spark, docs):
    rows = [(i, " ".join(R.choice(("the and of with" if i % 4 else "der und das mit").split()) for _ in range(30)), "en" if i % 4 else "de", "s", 1, "x") for i in range(200)]
    d = spark.createDataFrame(rows, DOCS)
    rated = mixing.fit_rates(d, d.select("doc_id", F.col("lang").alias("label")), {"en": 0.5, "de": 0.5})
    got = rated.select("posterior", "n_tokens", "rate").collect()
    token = np.array([np.array(r["posterior"]) * r["n_tokens"] * r["rate"] for r in got]).sum(axis=0)
    assert abs(token[0] / token.sum() - 0.5) < 1e-3 and min(r["rate"] for r in got) >= 0
    kept = mixing.apply_rates(rated, d.columns)
    assert kept.columns == d.columns and kept.select("doc_id").distinct().count() == 200
    assert mixing.fit_rates(docs, docs.select("doc_id", F.col("lang").alias("label")), {}).filter("rate = 1").count() == len(TEXTS) + 2


def test_archives(spark):
    body = "<p>" + "é" * 600
    rows = [(1, "http://a b/", body), (2, None, body), (3, "u", body), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "WARC/1.0\r\n\r\n\r\nx\n" * 100), (None, "u", body)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in archives.archive_pages(df).collect()}
    assert len(got) == 8
    assert [got[i]["refers_to"] for i in (1, 2, 3, 4, 5)] == [3, 3, None, None, None]
    assert got[1]["record_type"] == "revisit" and got[1]["payload_bytes"] == 1203 and got[6]["payload_bytes"] == 0 and got[7]["payload_bytes"] == len(rows[6][2])
    assert archives.archive_pages(df.limit(0)).count() == 0


def test_old_arc_url_with_blanks():
    data = b"filedesc://x 0.0.0.0 20000101000000 text/plain 76\n1 0 A\nURL IP-address Archive-date Content-type Archive-length\n" + b"\n" * 14 + b"http://a b c 1.2.3.4 20010203040506 text/html 3\nabc\n"
    assert [(f["URL"], f["Archive-date"], c) for f, c in archives.parse_arc(data)] == [("http://a%20b%20c", "20010203040506", b"abc")]
