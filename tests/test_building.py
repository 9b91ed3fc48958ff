"""The crawl, the router, positions, index artefacts and logs against plain versions."""

import base64
import json
import random
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from quarrymill.operators import order as O
from quarrymill.operators import registry as G
from quarrymill.operators import retrieval as R_
from quarrymill.operators import router
from quarrymill.sources import crawl as W
from quarrymill.streaming import toollog as T

R = random.Random(5)


def test_elements(spark):
    html = '<p id="t">A <b>bold</b> title<a class="x y" href="../up?q=1#f">go  <i>there</i></a><a href="mailto:a@b">m<a href="//h.org/z">w</a><div link="card">c</div><ads-tag>kw</ads-tag><script>var a = "<b>"</script><a href=>'
    found = [tuple(r)[2:] for r in W.elements(spark.createDataFrame([("https://e.org/a/b/c", html), ("u", None), (None, "")], "url string, html string")).orderBy("n").collect()]
    assert found == [
        ("p", "t", [], None, "A bold title go there m w c kw"), ("a", None, ["x", "y"], "https://e.org/a/up?q=1#f", "go there"), ("a", None, [], None, "m"), ("a", None, [], "https://h.org/z", "w"),
        ("div", None, [], "https://e.org/a/b/card", "c"), ("ads-tag", None, [], None, "kw"), ("a", None, [], None, ""),
    ]


def test_crawl_equals_breadth_first_search(spark):
    """Random graphs with cycles, links to oneself, pages that nobody has, fragments, repeated pages, and two rules by level."""
    pages, links = {}, {}
    for i in range(60):
        url = f"https://e.org/{i % 7}/{i}"
        refs = [(R.choice(["s", "s", "t"]), f"../{(k := R.randrange(0, 70)) % 7}/{k}" + R.choice(["", "#x"])) for _ in range(R.randrange(0, 4))] + [("s", f"#{i}")]
        links[url] = [(c, urldefrag(urljoin(url, h))[0]) for c, h in refs]
        pages[url] = "".join(f'<a class="{c}" href="{h}">x</a>' for c, h in refs)
    rows = [(u, h) for u, h in pages.items()] + [("https://e.org/0/0", pages["https://e.org/0/0"]), (None, "<p>"), ("https://e.org/3/3#again", pages["https://e.org/3/3"])]
    want, last, level = {"https://e.org/0/0": (0, None), "https://gone.org/": (0, None)}, ["https://e.org/0/0"], 0
    while last:
        new = {}
        for u in last:
            for c, to in links.get(u, []):
                if c in ("s", "t")[: 1 + (level > 0)] and to not in want:
                    new[to] = min(new.get(to, u), u)
        level += 1
        want |= {u: (level, p) for u, p in new.items()}
        last = sorted(new)
    table = spark.createDataFrame(rows, "url string, html string")
    seeds = spark.createDataFrame([("https://e.org/0/0#top",), ("https://gone.org/",), (None,)], "url string")
    got = W.crawl(table, seeds, [W.has_class("s"), F.lit(True)]).collect()
    assert {r["url"]: (r["level"], r["parent"]) for r in got} == want and len(got) == len(want)
    assert all(r["found"] == (r["url"] in pages) for r in got)
    assert W.crawl(table, seeds.limit(0), [F.lit(True)]).count() == 0
    assert max(r["level"] for r in W.crawl(table, seeds, [F.lit(True)], most_levels=2).collect()) == 2


def test_topic_links_in_pre_order(spark):
    leaf = lambda x, *below: {"_links": {"self": [{"href": x}]}, "topics": list(below)}
    tree = {"topic": {"topics": [leaf("a", leaf("b", leaf("c")), {"topics": [leaf("d")]}), leaf("e"), {"_links": {}}, {"_links": {"self": []}, "topics": None}]}}
    deep = leaf("0")
    for i in range(1, 300):
        deep = leaf(str(i), deep)
    rows = [(1, json.dumps(tree)), (2, "no json"), (3, "[1]"), (4, json.dumps({"topic": {}})), (5, None), (6, json.dumps({"topic": {"topics": [deep]}}))]
    found = router.topic_links(spark.createDataFrame(rows, "id long, content string")).orderBy("id", "part").collect()
    of = lambda i: [r["address"] for r in found if r["id"] == i]
    assert of(1) == ["a", "b", "c", "d", "e"] and of(2) == of(3) == of(5) == [None] and of(4) == []
    assert of(6) == [str(i) for i in range(299, -1, -1)]


def test_router_covers_every_source(spark):
    code = lambda html: json.dumps({"title": "T", "topic": {"content": base64.b64encode(html.encode()).decode()}})
    page = "<html><body><h1>Head</h1><p>Some text</p></body></html>"
    snapshot = [
        ("https://t.org/talk", "# Talk\n\nSpoken words", None), ("https://w.org/p", page, "text/html"), ("https://w.org/empty", "", "text/html"), ("https://l.org/path/x", '<html><p><a href="one">1</a><a href="/path/x/two/">2</a><a href="/other">3</a><a href="./one#again">4</a></p></html>', None),
        ("https://l.org/path/x/one/", page, None), ("https://api.org/documentation/1/2/y", json.dumps({"title": "Manual", "keywords": ["k", ""], "versionLabel": "v9", "topic": {"topics": [{"_links": {"self": [{"href": "https://api.org/documentation/1/7/y/t?rev=1&a=b"}]}}]}}), None),
        ("https://api.org/documentation/1/7/y/t?rev=1&a=b", code(page), None), ("https://api.org/documentation/2/2/y", code(page), None), ("https://api.org/documentation/3/2/y", "oops", None), ("https://www.w.org/doc", "Title\n\nBody text is long enough to be a body.", "application/pdf"),
    ]
    sources = [
        (1, "https://v.org/1", "S1", None, "a;b", "https://t.org/talk"), (2, "https://v.org/2", "S2", "", "", "https://t.org/none"), (3, "https://w.org/p/", "S3", "Guide", "", ""), (4, "https://w.org/empty", "S4", "", "", " "), (5, "https://l.org/path/x/", "S5", "", "", None),
        (6, "https://docs.org/documentation/1/2/y", "S6", "", "x", ""), (7, "https://docs.org/documentation/2/2/y", "S7", "", "", ""), (8, "https://docs.org/documentation/3/2/y", "S8", "", "", ""), (9, "https://d.org/?package=p", "S9", "Ecosystem Dashboard", "", ""), (10, "https://d.org/?package=q", "S10", "Ecosystem Dashboard", "", ""),
        (11, "https://d.org/", "S11", "Ecosystem Dashboard", "", ""), (12, "https://nowhere.org/", "S12", "", "", ""), (13, "https://www.w.org/doc", "S13", "", "", ""), (14, None, None, None, None, None),
    ]
    s = spark.createDataFrame(sources, "id long, url string, name string, doc_type string, keywords string, transcript_url string")
    entries = spark.createDataFrame([("p", "Ecosystem Dashboard - P 3.1", "kw", "https://d.org/?package=p", "Works")], "slug string, display_name string, keywords string, url string, content string")
    routes = router.Routes("docs.org", "api.org", r"^https://l\.org/path/")
    chunks, rejects = router.route(s, spark.createDataFrame(snapshot, "url string, content string, content_type string"), entries, routes)
    got = {(r["id"], r["part"]): r for r in chunks.collect()}
    bad = sorted((r["id"], r["reason"], r["address"]) for r in rejects.collect())
    assert bad == [(2, "not in the snapshot", "https://t.org/none"), (4, "no parseable content", "https://w.org/empty"), (5, "not in the snapshot", "https://l.org/path/x/two/"), (8, "no topic document", "https://api.org/documentation/3/2/y"), (10, "no dashboard entry", "https://d.org/?package=q"), (11, "no package named", "https://d.org/"), (12, "not in the snapshot", "https://nowhere.org/"), (14, "not in the snapshot", "")]
    assert sorted(got) == [(1, 0), (3, 0), (5, 0), (5, 1), (6, 0), (7, 0), (9, 0), (13, 0)]
    assert got[1, 0]["url"] == "https://v.org/1" and got[1, 0]["doc_type"] == "Transcript" and got[1, 0]["keywords"] == "a, b, S1" and got[1, 0]["resolved_url"] == "https://t.org/talk"
    assert got[6, 0]["url"] == "https://docs.org/documentation/1/2/y/t?a=b" and got[6, 0]["version"] == "v9" and got[6, 0]["keywords"] == "x, S6, k" and got[6, 0]["title"] == "Head"
    assert got[9, 0]["content"] == "Works" and got[9, 0]["version"] == "3.1" and got[13, 0]["title"] == "Title" and got[13, 0]["content_type"] == "pdf"
    out = {r["id"]: r for r in router.outcomes(s, routes, chunks, rejects).collect()}
    assert sorted(out) == list(range(1, 15)) and all(r["n_chunks"] + r["n_rejects"] > 0 for r in out.values())


def test_positions_equal_a_sort(spark):
    """A group of a third of the rows over many partitions, ties broken by id, nulls, an empty table."""
    rows = [(i, None if i % 17 == 0 else R.randrange(0, 9), "hot" if i % 3 == 0 else R.choice(["a", "b", None])) for i in range(1000)]
    R.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, k int, g string").repartition(7)
    first = lambda x: (x is not None, x)
    for parts in (None, 13):
        got = O.positions(df, "k", "id", parts=parts).collect()
        assert [r["id"] for r in sorted(got, key=lambda r: r["position"])] == [r[0] for r in sorted(rows, key=lambda r: (first(r[1]), r[0]))]
        assert sorted(r["position"] for r in got) == list(range(1000))
        within = O.positions_within(df, "g", "k", "id", parts=parts).collect()
        for g in ("hot", "a", "b", None):
            mine = sorted((r for r in within if r["g"] == g), key=lambda r: r["position"])
            assert [r["position"] for r in mine] == list(range(len(mine)))
            assert [r["id"] for r in mine] == [r[0] for r in sorted((r for r in rows if r[2] == g), key=lambda r: (first(r[1]), r[0]))]
    assert O.positions(df.limit(0), "id").count() == O.positions_within(df.limit(0), "g", "id").count() == 0


def test_log_goes_on_after_a_restart(spark, tmp_path):
    """Calls before and results after a restart meet; broken lines stay apart; a batch played again changes nothing; what never comes is given up."""
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    line = lambda n, kind, second, text: (f"c-{n}", kind, second, n, 0, text)
    frame = lambda rows: spark.createDataFrame(rows, "id string, kind string, s long, conv_id long, turn long, text string").withColumn("ts", F.timestamp_seconds("s"))
    T.append(frame([line(n, "call", 1000 + n, "ask") for n in range(6)] + [line(0, "result", 1001, "done!")]), log)
    spark.createDataFrame([("not json",), ('{"id":"c-9"',), ("{}",)], "value string").write.mode("append").text(log)
    T.run(spark, log, out, files=2)
    T.append(frame([line(n, "result", 1010 + n, "done") for n in (1, 2, 7)] + [line(3, "result", 1003 + 7200, "too late")]), log)
    T.run(spark, log, out)
    T.run(spark, log, out)  # nothing new
    pairs = lambda: sorted(((r["conv_id"], r["call_chars"], r["result_chars"]) for r in T.read(spark, out, "pairs").collect()), key=str)
    assert pairs() == [(0, 3, 5), (1, 3, 4), (2, 3, 4)]
    assert sorted(r["broken"] for r in T.read(spark, out, "errors").collect()) == ["not json", '{"id":"c-9"', "{}"]
    T.close(spark, log, out, "2001-01-01 00:00:00")
    known = lambda x: (x[0], x[2] is None)
    assert sorted(map(known, pairs())) == [(n, n > 2) for n in range(6)]
    assert sorted(pairs(), key=known) == [(0, 3, 5), (1, 3, 4), (2, 3, 4), (3, 3, None), (4, 3, None), (5, 3, None)]
    rows = spark.createDataFrame([(1,), (2,)], "x int")
    for _ in range(2):
        T.by_batch(str(tmp_path / "sink"))(rows, 4)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2


def test_documents_with_short_and_long_questions(spark):
    """Whole texts as they stand: inner tokens, tokens that are parts of longer ones, signs alone, a question that nothing holds."""
    texts = [(1, "the blue-green deployment of caches"), (2, "recache it; blue"), (3, "deploy? yes!"), (4, ""), (5, None), (6, "a cache of blue green things")]
    asked = [(1, "cache"), (2, "blue"), (3, "?"), (4, "of caches"), (5, "cache of blue green"), (6, "zebra"), (7, "it; blu"), (8, "a c"), (9, "yes!")]
    corpus = spark.createDataFrame(texts, "ordinal long, search_text string")
    got = sorted(tuple(r) for r in R_.documents_with(corpus, spark.createDataFrame(asked, "query_id long, q string")).collect())
    assert got == sorted((i, o) for i, q in asked for o, t in texts if t and q in t)


def test_pre_order_equals_recursion(spark):
    """Forests with ties, deep chains, nodes that only a cycle leads to, and no rows."""
    rows = [(0, None, 3), (1, None, 1), *((i, R.randrange(0, i), R.randrange(0, 3)) for i in range(2, 60)), (90, 91, 0), (91, 90, 0), (92, 404, 0)]
    below = {}
    for i, parent, o in rows:
        below.setdefault(parent, []).append((o, i))
    want = []

    def walk(parent, depth):
        for _, i in sorted(below.get(parent, [])):
            want.append((i, depth))
            walk(i, depth + 1)

    walk(None, 0)
    df = spark.createDataFrame(rows, "id long, parent long, ord int")
    assert [(r["id"], r["depth"]) for r in O.pre_order(df).orderBy("position").collect()] == want
    assert O.pre_order(df.limit(0)).count() == 0


def test_a_missing_registry_is_empty(spark, tmp_path):
    assert G.read_sources(spark, str(tmp_path / "none.csv")).count() == 0
