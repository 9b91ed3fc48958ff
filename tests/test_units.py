"""Literals for parsers, reranking and the streaming twins."""

import io
import zipfile

from pyspark.sql import functions as F

from quarrymill.operators import operations as O
from quarrymill.operators import retrieval as R
from quarrymill.sources import sections as S
from quarrymill.sources import slides
from quarrymill.streaming import traffic


def test_html_sections():
    page = "<html><nav><p>x</p></nav><main><h1>T</h1><p>a <b>b</b></p><h2 id=s>U</h2><ul><li>one<li>two</ul><pre>c\nd</pre></main></html>"
    assert S.html_sections(page)[0] == (["T"], "a b")
    assert S.html_sections(page)[1][0] == ["T", "U"]
    assert S.html_sections("") == []


def test_html_root_and_loose_text():
    page = "<body><p>around</p><div class='content'><p>inner</p></div><article><h1>A</h1><p>x</p></article><p>after</p></body>"
    assert S.html_sections(page) == [(["A"], "x")]
    assert S.html_sections(page.replace("article", "section")) == [([], "inner")]
    assert S.html_sections("<div>only  text</div>") == [([], "only text")]


def deck(order, notes=True):
    a, r = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    slide = lambda *lines: f'<s xmlns:a="{a}">' + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</s>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide("First", "Click to add title", "3 / 9"))
        z.writestr("ppt/slides/slide2.xml", slide("Second", "more"))
        z.writestr("ppt/slides/slide3.xml", "broken <")
        if order:
            z.writestr("ppt/presentation.xml", f'<p xmlns:r="{r}"><i r:id="b"/><i r:id="a"/><i r:id="zz"/></p>')
            z.writestr("ppt/_rels/presentation.xml.rels", '<R><Relationship Id="a" Type="t/slide" Target="slides/slide1.xml"/><Relationship Id="b" Type="t/slide" Target="/ppt/slides/slide2.xml"/></R>')
        if notes:
            z.writestr("ppt/slides/_rels/slide1.xml.rels", '<R><Relationship Id="n" Type="t/notesSlide" Target="../notesSlides/notesSlide1.xml"/></R>')
            z.writestr("ppt/notesSlides/notesSlide1.xml", slide("Say this"))
    return out.getvalue()


def test_slides(spark):
    assert slides.slide_sections(deck(True)) == [(["Slide 1"], "Second\n\nmore"), (["Slide 2"], "First\n\nSpeaker notes:\nSay this")]
    assert slides.slide_sections(deck(False, False)) == [(["Slide 1"], "First"), (["Slide 2"], "Second\n\nmore")]
    assert slides.slide_sections(b"no deck") == slides.slide_sections(None) == []
    df = spark.createDataFrame([(1, "pptx", bytearray(deck(True))), (2, "markdown", bytearray(b"# A\n\n\xffb")), (3, "pdf", bytearray(b"%PDF-1.7")), (4, "pptx", None)], "id long, format string, content binary")
    assert [tuple(r)[:4:2] for r in S.sections(df).orderBy("id", "n").collect()] == [(1, "Slide 1"), (1, "Slide 2"), (2, "A")]


def test_pages():
    assert slides.page_sections("A long first paragraph of far more than twelve words does not name the text.\n\nMy title\n\nOVERVIEW\n\nSome text is here.\fmore text follows\n\n12") == ("My title", [(["Page 1", "OVERVIEW"], "A long first paragraph of far more than twelve words does not name the text.\n\nSome text is here."), (["Page 2", "12"], "more text follows")])
    assert slides.page_sections("") == slides.page_sections(None) == ("", [])
    assert slides.page_sections("\f", "Named") == ("Named", [([], "Named")])


def test_markdown_sections():
    text = "# T {#t}\npara\n```\n# no heading\n```\n## U\nmore"
    assert [h for h, _ in S.markdown_sections(text)] == [["T"], ["T", "U"]]


def test_notebook():
    book = '{"cells": [{"cell_type": "markdown", "source": ["# A"]}, {"cell_type": "code", "source": "x=1", "outputs": [{"text": ["1"]}]}]}'
    assert S.notebook_markdown(book) == "# A\n\n```python\nx=1\n```\n\n```\n1\n```"
    assert S.notebook_markdown("plain") == "plain"


def test_rerank_prefers_title_and_keeps_all(spark):
    meta = spark.createDataFrame([(1, "SME2 guide", "u", "", "https://a.example.org/sme2", "", "tutorial", "p", "k", "devices support SME2"), (2, "other", "u", "", "https://a.example.org/x", "", "brief", "p", "k", "nothing")], "ordinal long, title string, heading string, heading_path string, url string, resolved_url string, doc_type string, product string, keywords string, search_text string")
    q = spark.createDataFrame([(7, "sme2 support")], "query_id long, query string")
    fused = spark.createDataFrame([(7, 1, 0.1, None, None, None, 1.0, 1), (7, 2, 0.1, None, None, None, 1.0, 2)], "query_id long, ordinal long, rrf double, prepass double, prepass_rank int, distance double, bm25 double, ord int")
    got = {r["ordinal"]: r["rerank"] for r in R.rerank(q, meta, fused).collect()}
    assert len(got) == 2 and got[1] > got[2]


def test_pack(spark):
    df = spark.createDataFrame([(1, [200, 200, 300, 10]), (2, []), (3, [700])], "k int, u array<bigint>")
    got = {r["k"]: r["p"] for r in df.select("k", O.pack(F.col("u")).alias("p")).collect()}
    assert got == {1: [400, 310], 2: [], 3: [700]}


def test_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet("/root/testdata/sf0.001/", pathGlobFilter="events.parquet")
    q = traffic.windows(stream).writeStream.outputMode("complete").format("memory").queryName("traffic").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: {tuple(r) for r in df.select(F.col("window_start").cast("string"), "event_type", "n").collect()}
    assert key(spark.table("traffic")) == key(O.traffic(batch))


def test_parsed_page():
    page = '<html><head><title>Own</title></head><body><main><h1 id="top">T</h1><p>see <a href="../x?a=1#f">the <b>x</b></a> and <a href="mailto:a@b">mail</a></p><p>Copy</p><h2 id="s">U</h2><h4>deep</h4><ul><li><a href="/y">why</a></li></ul><code>x = 1</code></main></body></html>'
    title, found = S.parse_html(page, "https://h.example.org/a/b/c", "given")
    assert title == "T"
    assert found == [
        (["T"], "see the x and mail\n\nLinked references: the x https://h.example.org/a/x?a=1#f", "top"),
        (["T", "U", "deep"], "- why\n\nLinked references: why https://h.example.org/y\n\n```\nx = 1\n```", "s"),
    ]
    assert S.parse_html('<meta property="og:title" content="Social"><title>Own</title><p>x</p>', "", "given")[0] == "Social"


def test_parsed_markdown():
    text = "---\ntitle: no\n---\n# T {#t}\nsee [one](/p) ![image](/q)\n\nCopy\n### A\na\n### B {#b}\nb\n~~~\n# code\n```\nc"
    title, found = S.parse_markdown(text, "https://h.example.org/a/", "given")
    assert title == "T"
    assert found == [
        (["T"], "see [one](/p) ![image](/q)\n\nLinked references: one https://h.example.org/p", "t"),
        (["T", "A"], "a", "t"),
        (["T", "A", "B"], "b\n\n~~~\n# code\n```\n\nc", "b"),
    ]
    assert S.parse_markdown("", "", "given") == ("given", [])


def test_notebook_errors_and_deck_title():
    book = '{"cells": [{"cell_type": "code", "source": "x", "outputs": [{"output_type": "error", "ename": "E", "evalue": "v"}, {"output_type": "error", "traceback": ["t1", "t2"]}, {"output_type": "stream", "text": "s"}]}]}'
    assert S.notebook_markdown(book) == "```python\nx\n```\n\n```\nE v\n```\n\n```\nt1t2\n```\n\n```\ns\n```"
    assert S.PARSERS["pptx"](deck(True), "", "given")[0] == "Second"


def test_stream_pairs(spark):
    """Each call with the result of its id that comes in time."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sql("SELECT id, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts FROM range(6)").write.parquet(f"{folder}/c")
    spark.sql("SELECT id, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, id + CASE WHEN id = 3 THEN 90 ELSE 1 END) AS ts, 'r' || id AS result FROM range(4)").write.parquet(f"{folder}/r")
    calls, results = spark.readStream.schema("id long, ts timestamp").parquet(f"{folder}/c"), spark.readStream.schema("id long, ts timestamp, result string").parquet(f"{folder}/r")
    joined = traffic.pairs(calls, results).select("c.id", "r.result")
    q = joined.writeStream.format("memory").queryName("pairs").option("checkpointLocation", f"{folder}/k").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("pairs").collect() if r["result"]}
    assert got == {(0, "r0"), (1, "r1"), (2, "r2")}
