"""Hard negatives, alignment and line dedup against plain versions, with odd tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from quarrymill.llm import alignment, hard_negatives, line_dedup

R = random.Random(4)
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- lines


def plain_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    held = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                held[key(x)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [1, 40, 10_000])
def test_lines_equal_plain_version(spark, heavy):
    """A hot line in a third of the rows, repeated rows, ids and lines, odd blanks, nulls, an id that is null."""
    pool = [f"Line number {i} of some text" for i in range(40)] + ["short", "", "  ", "ÄÖÜ ÄÖÜ ÄÖÜ", "äöü äöü äöü", "\tTabbed line of text\x0b", "tabbed LINE of text", " Line number 1 of some text"]
    rows = [(i, "\n".join(([" the HOT line of all "] if R.random() < 0.4 else []) + R.choices(pool, k=R.randrange(0, 9)))) for i in range(150)]
    rows += [(7, None), (200, None), (201, ""), (202, "\n"), (203, "\n\n"), rows[3], rows[3], (3, "the hot line of all\nanother text of the same id"), (None, "the hot line of all\nLine number 2 of some text\nnobody else has this line")]
    rows += [(300, "only one document has this line"), (300, "only one document has this line")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, `a.b` string").withColumnRenamed("a.b", "id")
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(docs, heavy=heavy).collect()]
    assert sorted(got, key=str) == plain_lines(rows)


def test_lines_odd_tables(spark):
    schema = "doc_id long, text string, `a.b` int, kept string, `first` int, m map<string,int>"
    empty = spark.createDataFrame([], schema)
    assert line_dedup.dedup_lines(empty).count() == 0
    long = "\n".join(f"a line of its own number {i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long, 5, "old", 6, {"k": 1}), (2, long + "\nthe end of it", 7, "old", 8, None)], schema)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1]["kept"] == long and got[2]["kept"] == "the end of it" and got[2]["n_dropped"] == 60_000
    assert got[1]["a.b"] == 5 and got[1]["m"] == {"k": 1} and got[2]["first"] == 8


# ---- alignment


def plain_alignment(rows):
    pair = alignment.Pair(open(A, encoding="utf-8").read(), open(B, "rb").read())
    aligned, count = [], Counter()
    for i, text in rows:
        links, groups, na, nb = [], [], 0, 0
        if text:
            a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            ends = [np.cumsum([len(t[x]) for x in ids]).tolist() for t, ids in ((pair.a_bytes, a), (pair.b_bytes, b))]
            spelt = [b"".join(t[x] for x in ids) for t, ids in ((pair.a_bytes, a), (pair.b_bytes, b))]
            if spelt[0] == spelt[1] == (" " + text).encode():
                na, nb, cuts = len(a), len(b), sorted(set(ends[0]) & set(ends[1]))
                at_a, at_b = dict(zip(ends[0], a, strict=True)), dict(zip(ends[1], b, strict=True))  # no token is empty, so ends differ
                links = [(at_a[c], at_b[c]) for c in cuts]
                of = lambda ids, e: np.split(np.array(ids), np.searchsorted(e, cuts, side="right")[:-1])  # noqa: E731, B023
                groups = [",".join(map(str, x.tolist())) + "|" + ",".join(map(str, y.tolist())) for x, y in zip(of(a, ends[0]), of(b, ends[1]), strict=True)]
        count.update(links)
        aligned.append((i, na, nb, groups, links))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(i, na, nb, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, g, x in aligned]


ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b ", "\ta\n b", "x\n\n y", "▁", "a ▁ b", "a▁b c d", "<0x41>", "<0x41> b <0x0A>", "<|endoftext|>", "a <|endoftext|> b", "<s> </s> <unk>", "it's we'll 'tis", "é ü 日本語 text", "日本 語 🙂 🙂🙂 x", " nbsp   x", "a b  c", "\x1c \x1d a \x85 b", "​ zero ​", "1234 56 7890123", "!!! ??? ...", "\x00 a \x00", "aa" * 300, "ﬁ ﬁne", "é é", "x\r\n y\r z"]


def random_text():
    signs = ["a", "b", "The", "'s", "'", " ", "  ", "\n", "\t", "é", "日", "🙂", "1", "23", "▁", ".", "-", " ", "<0x41>", "_"]
    return "".join(R.choices(signs, weights=[6, 6, 4, 1, 1, 12, 2, 1, 1, 1, 1, 1, 2, 1, 0.1, 2, 1, 0.5, 0.2, 1], k=R.randrange(1, 40)))


@pytest.mark.parametrize("heavy,part", [(1, 50), (20, 200), (100_000, 2_000_000)])
def test_alignment_equals_plain_version(spark, heavy, part):
    """All counts and digests, whether pairs are broadcast or meet their blocks, in one part or several."""
    prose = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    texts = ODD + [random_text() for _ in range(250)] + prose + ["the hot words"] * 120
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(alignment.align_tokenizers(docs, A, B, heavy=heavy, part=part).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert [tuple(r) for r in got] == plain_alignment(rows)


def test_alignment_odd_tables(spark):
    schema = "doc_id long, text string, `a.b` int, codes string, n_a string, `row` int"
    assert alignment.align_tokenizers(spark.createDataFrame([], schema), A, B).count() == 0
    only_null = alignment.align_tokenizers(spark.createDataFrame([(1, None, 2, "c", "n", 3)] * 2, schema), A, B).collect()
    assert [(r["doc_id"], r["a.b"], r["codes"], r["row"], r["n_a"], r["groups_sha256"]) for r in only_null] == [(1, 2, "c", 3, 0, "")] * 2
    long = "".join(R.choices("abcde", k=1_200_000))  # one word of over 1 MiB
    rows = [(1, long), (2, "some words " * 120_000), (3, None)]
    got = {r["doc_id"]: r for r in alignment.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), A, B, with_groups=True).collect()}
    want = {r[0]: r for r in plain_alignment([rows[1], rows[2]])}
    assert got[2]["groups_sha256"] == want[2][-1] and got[2]["groups"].count(";") == got[2]["n_groups"] - 1
    assert got[1]["n_a"] > 0 and got[3]["n_a"] == 0


# ---- hard negatives


def plain_negatives(rows):
    ok = [(i, label, np.floor(np.array(v, dtype=float) * 256)) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in ok), default=0)
    ok = [(i, label, np.pad(v, (0, width - len(v)))) for i, label, v in ok]
    anchors = {}
    for i, label, v in ok:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (v.tolist(), str(label))), (v.tolist(), str(label)))
    out = []
    for i, (v, label) in anchors.items():
        scored = sorted((-int(np.dot(v, w)), j, str(lab)) for j, lab, w in ok if j != i)
        lists = {}
        for s, j, lab in [x for x in scored if x[2] == label][:5]:
            lists.setdefault(-s, []).append(j)
        for p, ids in lists.items():
            fits = [(-s, j) for s, j, lab in scored if lab != label and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(i, j, k, n, p, s) for j in ids for k, (s, n) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_plain_version(spark, seed):
    """A third of the rows are copies of one vector under one label; ties, zeros, shorter vectors, repeated ids and rows."""
    g = np.random.default_rng(seed)
    centre = g.normal(size=(6, 8))
    rows = [(int(i), int(g.integers(0, 4)), (centre[g.integers(0, 6)] + g.normal(size=8) * g.choice([0.05, 0.6])).tolist()) for i in range(900)]
    rows = [(i, 1, centre[0].tolist()) if i % 3 == 0 else (i, label, v) for i, label, v in rows]
    rows += [(50, 2, rows[50][2]), (100, 3, (-centre[0]).tolist()), rows[7], rows[7], (1000, 1, [0.0] * 8), (1050, 2, [0.25, 0.5]), (-50, 0, centre[2].tolist())]
    rows += [(1100, None, centre[0].tolist()), (None, 1, centre[0].tolist()), (1150, 1, None), (1200, 1, [1.0] * 7 + [float("nan")]), (1250, 1, []), (1300, 1, [None] + [1.0] * 7), (1350, 0, (centre[0] * 40).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(6)
    for block, anchor_block, pivots in ((64, 8, 12), (4096, 4096, 128)):
        got = sorted(tuple(r) for r in hard_negatives.mine(table, block=block, anchor_block=anchor_block, pivots=pivots, sample_size=300).collect())
        assert got == plain_negatives(rows)


def test_walk_stops_by_proof():
    """In groups that lie apart most runs are never read, and the best are found all the same."""
    g = np.random.default_rng(3)
    centre = g.normal(size=(16, 12)) * 10
    v = np.floor((centre[np.repeat(np.arange(16), 512)] + g.normal(size=(8192, 12)) * 0.1) * 256)
    length = float(np.sqrt((v * v).sum(axis=1).max()))
    unit = hard_negatives.unit_vectors(v, length)
    c = hard_negatives.unit_vectors(np.floor(centre * 256), max(length, float(np.sqrt(((centre * 256) ** 2).sum(axis=1).max())) + 1))
    d = np.sqrt(((unit[:, None] - c[None]) ** 2).sum(axis=2))
    pivot = d.argmin(axis=1)
    order = np.lexsort((d[np.arange(len(v)), pivot], pivot))
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            read.append(len(out))
            return out

    block = hard_negatives.Block(pivot[order], d[order, pivot[order]], order, np.zeros(len(v), np.int64), v[order].view(Counted))
    q = v[:1]
    near = np.sqrt(((np.concatenate([q / np.linalg.norm(q), [[0.0]]], axis=1)[:, None] - c[None]) ** 2).sum(axis=2))
    best = hard_negatives.walk(block, q, np.array([0]), np.array([0]), near, length, True, np.array([[np.inf]]), np.array([[-np.inf]]), 5)
    assert np.asarray(best.score[0]).tolist() == np.sort(v[1:] @ q[0])[::-1][:5].tolist()
    assert sum(read) < len(v) / 2


def test_negatives_odd_tables(spark):
    schema = "vec_id long, label string, embedding array<float>, anchor long, pivot int"
    assert hard_negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(50, "a", [1.0], 1, 2), (1, "b", [1.0], 1, 2)], schema)).count() == 0
    rows = [(50, "a", [1.0], 1, 2), (1, "a", [1.0], 1, 2), (2, "b", [0.75], 1, 2)]
    assert [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, schema)).collect()] == [(50, 1, 1, 2, 65536, 49152)]


# ---- odd columns and foreign files


def test_columns_of_any_name_and_kind(spark):
    """Dots, blanks and backticks in names, names that operators write, maps and variants, in every operator over texts and the pipeline's stages."""
    import corpus_pipeline
    from quarrymill.llm import language, mixing, near_dedup, pieces, quality, token_counts, toxicity

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = docs.selectExpr("*", "doc_id AS `a.b`", "source AS `c d`", "lang AS `e``f`", "map('k', doc_id) AS m", "parse_json('[1]') AS v", "1 AS _text", "2 AS _c0", "3 AS rate", "4 AS score")
    want = {r["doc_id"]: (r["doc_id"], r["source"], r["lang"], 1, 2) for r in docs.collect()}
    word, piece = public_tokenizers.path("word_bpe_49k.json"), B
    for out in (
        token_counts.count_tokens(odd.drop("m", "v"), word), pieces.decode_pieces(pieces.encode_pieces(odd.drop("m", "v", "text"), piece, text_col="c d"), piece), toxicity.score_toxicity(odd.drop("m", "v"), labels), language.identify(odd.drop("m", "v")),
        quality.score_quality(odd.drop("m", "v"), labels), mixing.fit_rates(odd.drop("m", "v"), docs.selectExpr("doc_id", "lang AS label"), corpus_pipeline.TARGETS), line_dedup.dedup_lines(odd), near_dedup.keep_one(odd),
    ):
        rows = out.select("doc_id", "`a.b`", "`c d`", "`e``f`", "_text", "_c0").collect()
        assert rows and all(tuple(r)[1:] == want[r["doc_id"]] for r in rows)


def test_one_row_of_equal_rows_with_maps(spark):
    from quarrymill.llm import near_dedup

    rows = spark.sql("SELECT * FROM VALUES (1L, 'a b c d e f g', map('x', 1)), (1L, 'a b c d e f g', map('x', 2)), (2L, 'a b c d e f g', map()), (3L, '', map()), (NULL, 'a b c d e f g', NULL) AS t(doc_id, text, m)")
    assert sorted(str(r["doc_id"]) for r in near_dedup.keep_one(rows).collect()) == ["1", "3", "None"]


def test_warc_of_other_writers(spark, tmp_path):
    """Records named by uuid, digests in hex, absent or of another kind, revisits without a length."""
    import base64

    from quarrymill.llm import archives

    body = b"<p>hello"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    record = lambda kind, block, *more: ("WARC/1.0\r\n" + "\r\n".join([f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>", "WARC-Target-URI: https://e.org/", *more, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    sha = hashlib.sha1(body)
    path = tmp_path / "warc"
    path.mkdir()
    (path / "a.warc").write_bytes(
        record("warcinfo", b"x: y\r\n") + record("response", http + body) + record("response", http + body, f"WARC-Payload-Digest: sha1:{sha.hexdigest()}") + record("response", http + body, "WARC-Payload-Digest: sha256:abc")
        + record("revisit", http, "WARC-Refers-To: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha.digest()).decode()}") + record("revisit", http) + record("metadata", b"m")
    )
    got = [tuple(r)[1:5] for r in archives.read_warc(spark, str(path)).collect()]
    assert got == [(len(body), sha.hexdigest(), "response", None)] * 3 + [(None, sha.hexdigest(), "revisit", None), (None, None, "revisit", None)]
    (path / "b.warc").write_bytes(record("response", http + body, "WARC-Payload-Digest: sha1:" + "0" * 40))
    with pytest.raises(Exception, match="doesn't have its digest"):
        archives.read_warc(spark, str(path)).collect()
