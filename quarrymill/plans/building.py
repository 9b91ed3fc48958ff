"""Queries that build a knowledge base: the crawl, the source router, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators import operations as O
from quarrymill.operators import order, retrieval, router, search_index
from quarrymill.plans.catalogue import CTE, EXPECTED, ORACLES, PRODUCTS, asked, cases, corpus, query, table
from quarrymill.plans.more import dashboard_entries
from quarrymill.sources import crawl as W
from quarrymill.storage import materialize, new_path
from quarrymill.streaming import toollog

# ---- the crawl

PAGE = "regexp_replace(url, '#.*$', '')"
SITE = "regexp_extract(u, '^(https?://[^/?#]*)', 1)"


def site_map(spark, d):
    """The pages with links between them: each leads to three others and back to the one it comes from, and to what must not be followed."""
    p = table(spark, d, "pages").filter("url IS NOT NULL").groupBy(W.page_key(F.col("url")).alias("url")).agg(F.min("page_id").alias("id"))
    child = p.filter("id > 0").select(F.floor((F.col("id") - 1) / 3).alias("up"), F.col("url").alias("child"))
    back = p.select(F.col("id").alias("up"), F.col("url").alias("parent")).join(p.filter("id > 0").select(F.floor((F.col("id") - 1) / 3).alias("up"), "id"), "up").select("id", "parent")
    anchor = lambda c, kind: F.concat(F.lit(f'<p><a class="{kind}" href="'), c, F.lit('">on</a></p>'))
    down = child.groupBy("up").agg(F.array_join(F.sort_array(F.collect_list(anchor(F.col("child"), "step"))), "").alias("down"))  # three at most
    mobile = anchor(F.concat(F.lit("https://never.example.org/"), F.col("id")), "step mobile")
    card = F.when(F.col("id") % 10 == 0, F.concat(F.lit('<div class="step" link="/missing/'), "id", F.lit('">card</div>'))).otherwise("")
    linked = p.join(down, p["id"] == down["up"], "left").join(back, "id", "left")
    body = table(spark, d, "pages").select(F.col("page_id").alias("id"), "html")
    whole = linked.join(body, "id").select("id", "url", F.concat(F.coalesce("html", F.lit("")), F.lit("<article>"), F.coalesce("down", F.lit("")), F.coalesce(anchor(F.col("parent"), "step"), F.lit("")), mobile, card, F.lit('<p><a class="step" href="mailto:a@example.org">mail</a></p></article>')).alias("html"))
    return whole


@query(f"""WITH RECURSIVE n AS (SELECT {PAGE} AS u, min(page_id) AS id FROM pages GROUP BY 1),
    e AS (SELECT p.u AS a, c.u AS b FROM n c JOIN n p ON p.id = (c.id - 1) // 3 WHERE c.id > 0 UNION SELECT c.u, p.u FROM n c JOIN n p ON p.id = (c.id - 1) // 3 WHERE c.id > 0 UNION SELECT u, {SITE} || '/missing/' || id FROM n WHERE id % 10 = 0),
    r AS (SELECT u, 0 AS level FROM n WHERE id = 0 UNION SELECT e.b, r.level + 1 FROM r JOIN e ON e.a = r.u WHERE r.level < 16),
    l AS (SELECT u, min(level) AS level FROM r GROUP BY u)
    SELECT l.u AS url, CAST(l.level AS INTEGER) AS level, (SELECT min(e.a) FROM e JOIN l m ON m.u = e.a WHERE e.b = l.u AND m.level = l.level - 1) AS parent, l.u IN (SELECT u FROM n) AS found FROM l""")
def crawl_levels(spark, d):
    """Breadth first from page 0 over links of one class, through cycles, cards and links to pages that nobody has."""
    pages = site_map(spark, d)
    return W.crawl(pages.select("url", "html"), pages.filter("id = 0").select("url"), [W.has_class("step") & ~W.has_class("mobile")])


# ---- the router

ROUTES = router.Routes(docs_host="docs.example.org", service="api.example.org", steps=r"^https://learn\.example\.org/paths/", products=PRODUCTS)


def given_sources(spark, d):
    """Sources of all routes, some of which fail, and the snapshot that they read: every page is what one source reads."""
    p = table(spark, d, "pages").filter("page_id IS NOT NULL").groupBy(F.col("page_id").alias("id")).agg(F.min("url").alias("page"), F.min("html").alias("html"))
    key, kind, broken = F.col("id"), F.col("id") % 5, F.col("id") % 25 < 5
    at = lambda begin, end="": F.concat(F.lit(begin), key, F.lit(end))
    slug = F.when(broken, "none").otherwise(F.concat(F.lit("slug-"), key % 400))
    url = F.when(kind == 0, at("https://video.example.org/")).when(kind == 1, F.concat(F.lit("https://dash.example.org/?package="), slug)).when(kind == 2, at("https://docs.example.org/documentation/", "/2.1/x")).when(kind == 3, at("https://www.example.org/page/")).otherwise(at("https://learn.example.org/paths/", "/"))
    doc_type = F.when(kind == 1, "Ecosystem Dashboard").when(kind == 4, "Learning Path").otherwise("")
    talk = F.when(kind == 0, F.when(broken, at("https://gone.example.org/")).otherwise(at("https://talk.example.org/", ".html"))).otherwise("")
    sources = p.select("id", url.alias("url"), at("Source ").alias("name"), doc_type.alias("doc_type"), F.lit("a; b").alias("keywords"), talk.alias("transcript_url"))

    kept = lambda rows, where, content, kind=None: rows.select(where.alias("url"), content.alias("content"), F.lit(kind).cast("string").alias("content_type"))
    html = F.coalesce("html", F.lit(""))
    link = lambda end: F.struct(F.struct(F.array(F.struct(at("https://api.example.org/documentation/", end).alias("href"))).alias("self")).alias("_links"), F.array().cast("array<string>").alias("topics"))
    tree = F.to_json(F.struct(at("Manual ").alias("title"), F.array(F.lit("b"), F.lit("manual")).alias("keywords"), F.lit("7.5").alias("versionLabel"), F.struct(F.array(link("/9/x/t1"), link("/9/x/t2")).alias("topics")).alias("topic")))
    topic = F.to_json(F.struct(at("Topic ").alias("title"), F.struct(F.base64(html.cast("binary")).alias("content")).alias("topic")))
    path = F.concat(F.lit('<html><body><p>The first step is <a href="one/?x=1">here</a>, the next <a href="/paths/'), key, F.lit('/two#part">here</a> and <a href="/paths/">all</a>.</p></body></html>'))
    of = lambda k: p.filter(kind == k)
    api = at("https://api.example.org/documentation/", "/2.1/x")
    snapshot = kept(of(0).filter(~broken), at("https://talk.example.org/", ".html"), html)
    for more in (
        kept(of(2), api, F.when(broken, "no document").otherwise(tree)), kept(of(2).filter(~broken), at("https://api.example.org/documentation/", "/9/x/t1"), topic), kept(of(2).filter("id % 2 = 0").filter(~broken), at("https://api.example.org/documentation/", "/9/x/t2"), topic),
        kept(of(3).filter(~broken), at("https://www.example.org/page/"), html, "text/html"), kept(of(4), at("https://learn.example.org/paths/"), path), kept(of(4), at("https://learn.example.org/paths/", "/one"), html, "text/html"), kept(of(4).filter(~broken), at("https://learn.example.org/paths/", "/two/"), F.lit("# Two\n\nSome words of the second step.")),
    ):
        snapshot = snapshot.unionByName(more)
    return sources, snapshot


def routed(spark, d):
    sources, snapshot = given_sources(spark, d)
    return router.route(sources, snapshot, dashboard_entries(spark, d), ROUTES)


@query("""WITH s AS (SELECT page_id AS id, page_id % 5 AS kind, page_id % 25 < 5 AS broken, length(coalesce(any_value(html), '')) > 0 AS text, page_id % 2 = 0 AS even, count(*) AS copies FROM pages GROUP BY page_id),
    e AS (SELECT DISTINCT 'slug-' || (p_partkey % 400) AS slug FROM part),
    x AS (SELECT s.*, kind = 1 AND (broken OR slug IS NULL) AS no_entry FROM s LEFT JOIN e ON slug = 'slug-' || (id % 400)),
    r AS (SELECT *, CASE kind WHEN 0 THEN 'transcript' WHEN 1 THEN 'dashboard' WHEN 2 THEN 'topics' ELSE 'page' END AS route,
        CASE WHEN kind IN (0, 3) AND broken THEN ['not in the snapshot'] WHEN kind IN (0, 3) AND NOT text THEN ['no parseable content'] WHEN no_entry THEN ['no dashboard entry'] WHEN kind = 2 AND broken THEN ['no topic document']
             WHEN kind = 2 THEN list_concat(CASE WHEN text THEN [] ELSE ['no parseable content'] END, CASE WHEN even THEN CASE WHEN text THEN [] ELSE ['no parseable content'] END ELSE ['not in the snapshot'] END)
             WHEN kind = 4 THEN list_concat(CASE WHEN text THEN [] ELSE ['no parseable content'] END, CASE WHEN broken THEN ['not in the snapshot'] ELSE [] END) ELSE [] END AS bad,
        CASE WHEN kind IN (0, 3) THEN 1 WHEN kind = 1 THEN 1 WHEN kind = 2 THEN CASE WHEN broken THEN 1 ELSE 2 END ELSE 3 END AS asked FROM x)
    SELECT id, route, CAST(asked - len(bad) AS BIGINT) AS n_documents, CAST(len(bad) AS BIGINT) AS n_rejects, array_to_string(list_sort(list_distinct(bad)), '; ') AS reasons FROM r""")
def routed_sources(spark, d):
    """Every source once, with the documents that became chunks and those that were rejected, and why."""
    sources, snapshot = given_sources(spark, d)
    chunks, rejects = router.route(sources, snapshot, dashboard_entries(spark, d), ROUTES)
    return router.outcomes(sources, ROUTES, chunks, rejects).drop("n_chunks")


@query()
def routed_chunks(spark, d):
    """Chunk records of all routes."""
    return routed(spark, d)[0]


@query()
def routed_rejects(spark, d):
    """What gave no chunks, and why."""
    return routed(spark, d)[1]


# ---- global order

SITE_SQL = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id AS pos, url, {SITE_SQL} AS site FROM pages), ex AS (SELECT * FROM p WHERE pos % 3 = 0),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS nth FROM p WHERE pos % 3 <> 0) WHERE nth = 1 AND url NOT IN (SELECT url FROM ex)),
    l AS (SELECT site, max(pos) AS after FROM ex GROUP BY site),
    a AS (SELECT url, site, pos AS major, 0 AS minor FROM ex UNION ALL SELECT f.url, f.site, coalesce(after, 1099511627776), pos + 1 FROM f LEFT JOIN l USING (site))
    SELECT url, site, row_number() OVER (ORDER BY major, minor, url) - 1 AS position FROM a""")
def registry_positions(spark, d):
    """The registry with new sources in their places: behind the last of their site, as positions from 0."""
    p = table(spark, d, "pages").select(F.col("page_id").alias("pos"), "url", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("site"))
    placed = O.register_sources(p.filter("pos % 3 = 0"), p.filter("pos % 3 <> 0"))
    return order.positions(placed, "major", "minor", "url").select("url", "site", "position")


@query(r"""SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, doc_id AS id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words FROM documents""")
def source_chunks(spark, d):
    """Each source's chunk ids in order, a row each: the ordered list of the statistics, whatever its length."""
    c = table(spark, d, "documents").select("source", F.col("doc_id").alias("id"), F.size(F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0))).cast("long").alias("n_words"))
    return order.positions_within(c, "source", "id").select("source", "position", "id", "n_words")


@query("""WITH RECURSIVE n AS (SELECT min(page_id) AS id, url FROM pages GROUP BY url), t AS (SELECT id, CASE WHEN id > 0 THEN (id - 1) // 3 END AS parent, (id * 7) % 10 AS ord FROM n),
    w AS (SELECT id, 0 AS depth, [ord, id] AS k FROM t WHERE parent IS NULL UNION ALL SELECT t.id, depth + 1, k || [t.ord, t.id] FROM t JOIN w ON t.parent = w.id)
    SELECT id, CAST(depth AS INTEGER) AS depth, row_number() OVER (ORDER BY k) - 1 AS position FROM w""")
def topic_order(spark, d):
    """A tree of pages as readers meet it: each before what is below it, at any depth."""
    n = table(spark, d, "pages").groupBy("url").agg(F.min("page_id").alias("id"))
    tree = n.select("id", F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 3)).alias("parent"), (F.col("id") * 7 % 10).alias("ord"))
    return order.pre_order(tree).select("id", "depth", "position")


# ---- index artefacts


def stored_index(spark, d):
    path = new_path(spark, "index")
    search_index.write_index(corpus(spark, d), path)
    return search_index.read_index(spark, path)


@query(ORACLES["bm25_topk"])
def index_topk(spark, d):
    """BM25's first five from the persisted index, by bounds of blocks and optional terms."""
    return search_index.topk(stored_index(spark, d), asked(spark, d), 5)[0]


@query()
def index_reads(spark, d):
    """How many postings the queries' terms have, and how many were read for their first five."""
    return search_index.topk(stored_index(spark, d), asked(spark, d), 5)[1]


@query("SELECT doc_id AS ordinal, source AS title, lang AS heading, ['tutorial', 'tuning guide', 'brief', 'reference architecture'][doc_id % 4 + 1] AS doc_type, '' AS version, CASE WHEN doc_id % 3 = 0 THEN 'https://r.example.org/' || doc_id ELSE 'https://docs.example.org/' || source || '/' || (doc_id % 97) END AS resolved_url FROM documents")
def index_metadata(spark, d):
    """Metadata read back from the artefacts, with defaults for what documents lack."""
    c = corpus(spark, d).withColumn("resolved_url", F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("https://r.example.org/"), "ordinal")).otherwise(F.when(F.col("ordinal") % 3 == 1, F.lit(""))))
    path = new_path(spark, "metadata")
    search_index.with_defaults(c).write.parquet(path)
    return spark.read.parquet(path).select("ordinal", "title", "heading", "doc_type", "version", "resolved_url")


# ---- the tool log as a stream


def tool_log(spark, d):
    """Conversations as a log of calls and results, with lines that were cut off."""
    c = table(spark, d, "conversations")
    call = F.col("role") == "user"
    turn = F.when(call, F.col("turn")).otherwise(F.col("turn") - 1)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn"))
    rows = c.filter("role IN ('user', 'assistant')").select(F.concat_ws("-", F.col("conv_id"), turn).alias("id"), F.when(call, toollog.CALL).otherwise(toollog.RESULT).alias("kind"), at.alias("ts"), "conv_id", turn.alias("turn"), "text")
    log, out = new_path(spark, "log"), new_path(spark, "pairs")
    toollog.append(rows, log)
    cut = rows.filter("kind = 'call' AND conv_id % 5 = 3").select(F.substring(F.to_json(F.struct("id", "kind")), 1, 20).alias("value"))
    cut.write.mode("append").text(log)
    toollog.run(spark, log, out)
    toollog.close(spark, log, out, "2033-01-01 00:00:00")
    return out


@query(ORACLES["call_result_pairs"])
def call_result_stream(spark, d):
    """Calls and their results from the running log, over two runs: what came, then what the closing mark gives up."""
    return toollog.read(spark, tool_log(spark, d), "pairs").drop("id")


@query("""SELECT substr('{"id":"' || conv_id || '-' || turn || '","kind":"call"}', 1, 20) AS broken FROM conversations WHERE role = 'user' AND conv_id % 5 = 3""")
def log_errors(spark, d):
    """Lines of the log that are no records, apart from those that are."""
    return toollog.read(spark, tool_log(spark, d), "errors")


# ---- the evaluation report


@query(f"""WITH {CTE}, {EXPECTED}, hit AS (SELECT query_id, min(rank) AS r FROM tp JOIN ex USING (query_id, ordinal) WHERE rank <= 5 GROUP BY query_id),
    c AS (SELECT e.query_id, r FROM (SELECT DISTINCT query_id FROM ex) e LEFT JOIN hit USING (query_id)),
    er AS (SELECT item_id AS query_id, 'no expected document' AS reason FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM ex)),
    m AS (SELECT count(*) AS total, coalesce(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 0) AS h1, coalesce(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 0) AS h3, coalesce(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 0) AS h5, coalesce(avg(coalesce(1.0::DOUBLE / r, 0)), 0) AS mrr, count(*) FILTER (WHERE r IS NULL) AS misses, (SELECT count(*) FROM er) AS errors FROM c)
    SELECT 'metric' AS kind, x.position, x.name, x.value FROM (SELECT unnest([{{position: 1, name: 'asked', value: total::VARCHAR}}, {{position: 2, name: 'errors', value: errors::VARCHAR}}, {{position: 3, name: 'misses', value: misses::VARCHAR}}, {{position: 4, name: 'hit at 1', value: printf('%.1f%%', 100 * h1::DOUBLE)}}, {{position: 5, name: 'hit at 3', value: printf('%.1f%%', 100 * h3::DOUBLE)}}, {{position: 6, name: 'hit at 5', value: printf('%.1f%%', 100 * h5::DOUBLE)}}, {{position: 7, name: 'mrr', value: printf('%.3f', mrr)}}]) AS x FROM m)
    UNION ALL SELECT 'miss', CAST(row_number() OVER (ORDER BY query_id) AS INTEGER) AS position, query_id::VARCHAR, 'not found' FROM c WHERE r IS NULL QUALIFY position <= 10
    UNION ALL SELECT 'error', CAST(row_number() OVER (ORDER BY query_id) AS INTEGER) AS position, query_id::VARCHAR, reason FROM er QUALIFY position <= 10""")
def eval_report(spark, d):
    """What an evaluation prints: percentages, the mean reciprocal rank, and the first ten misses and errors of one run."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    found = materialize(cases(spark, d), "cases")
    errors = b.join(found.select("query_id"), "query_id", "left_anti").select("query_id", F.lit("no expected document").alias("reason"))
    return retrieval.eval_report(found, errors)
