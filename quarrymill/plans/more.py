"""Queries over the registry, command output, topics, links and evaluation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill import config as C
from quarrymill.functions import text as X
from quarrymill.functions import urls as U
from quarrymill.operators import registry as G
from quarrymill.operators import reports as P
from quarrymill.operators import retrieval as R
from quarrymill.plans.catalogue import CTE, EXPECTED, FLAGSHIP, FOUND, LINK_SQL, PATHS, addresses, asked, corpus, literal, query, stop_list, table, tok_sql, vectors
from quarrymill.storage import new_path

# ---- the source registry

SOURCE_SQL = """s AS (SELECT page_id AS pos, regexp_extract(url, '^https?://([^/?#]*)', 1) AS site_name, 'CC, "BY" 4.0' AS license_type, 'Page, ' || page_id || chr(10) || 'of ' || url AS display_name, CASE WHEN page_id % 7 = 3 THEN ' ' ELSE url END AS url, 'a; b' AS keywords, CASE WHEN page_id % 3 = 0 THEN 'https://t.example.org/' || page_id ELSE '' END AS transcript_url FROM pages)"""


def sources(spark, d):
    p = table(spark, d, "pages")
    return p.select(F.col("page_id").alias("pos"), F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("site_name"), F.lit('CC, "BY" 4.0').alias("license_type"), F.concat(F.lit("Page, "), "page_id", F.lit("\nof "), "url").alias("display_name"), F.when(F.col("page_id") % 7 == 3, " ").otherwise(F.col("url")).alias("url"), F.lit("a; b").alias("keywords"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://t.example.org/"), "page_id")).otherwise("").alias("transcript_url"))


@query(f"WITH {SOURCE_SQL} SELECT site_name, license_type, display_name, url, keywords, transcript_url FROM s WHERE trim(url) <> ''")
def csv_sources(spark, d):
    """The registry written as CSV and read back: commas, quotes and line ends in cells stay, rows without a url go."""
    path = new_path(spark, "registry")
    G.write_sources(sources(spark, d), path)
    return G.read_sources(spark, path)


@query(f"WITH {SOURCE_SQL}, w AS (SELECT url, coalesce(nullif(trim(transcript_url), ''), url) AS fetch_url FROM s WHERE trim(url) <> ''), c AS (SELECT url AS u, min(md5(html)) AS content FROM pages GROUP BY url) SELECT url, fetch_url, content FROM w LEFT JOIN c ON u = fetch_url")
def transcript_override(spark, d):
    snapshot = table(spark, d, "pages").groupBy("url").agg(F.min(F.md5(F.col("html").cast("binary"))).alias("content"))
    return G.fetch_targets(sources(spark, d).filter("trim(url) <> ''"), snapshot).select("url", "fetch_url", "content")


RULES = {"Guide": {"titles": ["src0", "src2"]}, "Reference": {"urls": [r"/1\d", r"/7(\?|$)"]}, "Post": {"authors": [(["en", "fr"], "src", "1"), (["de"], "src2", "")]}}


@query("""WITH i AS (SELECT doc_id, ['Guide', 'Reference', 'Post', 'Other'][doc_id % 4 + 1] AS kind, source AS title, CASE WHEN doc_id % 11 = 5 THEN '' ELSE 'https://docs.example.org/' || doc_id END AS url, lang AS author FROM documents)
    SELECT doc_id, coalesce(url <> '' AND CASE kind WHEN 'Guide' THEN title IN ('src0', 'src2') WHEN 'Reference' THEN regexp_matches(url, '/1\\d') OR regexp_matches(url, '/7(\\?|$)') WHEN 'Post' THEN (author IN ('en', 'fr') AND starts_with(title, 'src') AND contains(title, '1')) OR (author IN ('de') AND starts_with(title, 'src2')) ELSE false END, false) AS relevant FROM i""")
def item_relevance(spark, d):
    kind = F.element_at(X.words_in(["Guide", "Reference", "Post", "Other"]), (F.col("doc_id") % 4 + 1).cast("int"))
    url = F.when(F.col("doc_id") % 11 == 5, "").otherwise(F.concat(F.lit("https://docs.example.org/"), "doc_id"))
    return table(spark, d, "documents").select("doc_id", G.relevant(kind, F.col("source"), url, F.col("lang"), RULES).alias("relevant"))


@query("""WITH p AS (SELECT p_partkey, ['term'] || flatten([string_split(p_name, ' '), string_split(p_brand, '#')]) || string_split('l1|l2|' || p_type || '|' || p_brand, '|')[3:] AS k FROM part)
    SELECT p_partkey, array_to_string(list_sort(list_distinct(k)), '|') AS keywords FROM p""")
def item_keywords(spark, d):
    words = F.array(F.regexp_replace("p_name", " ", "|"), F.regexp_replace("p_brand", "#", "|"))
    products = F.array(F.concat(F.lit("l1|l2|"), "p_type", F.lit("|"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(G.item_keywords(F.lit("term"), words, products)), "|").alias("keywords"))


MERGED = literal("k long, a string, b string", (1, "x,y", "y, z ,,x"), (2, "x", ""), (3, "", "q"))


@query(f"WITH m AS (SELECT k, string_split(a, ',') AS a, list_filter(list_transform(string_split(b, ','), lambda x: trim(x)), lambda x: x <> '') AS b FROM {MERGED[1]}) SELECT k, array_to_string(a || list_filter(b, lambda x: NOT list_contains(a, x)), '|') AS keywords FROM m")
def merge_keywords(spark, d):
    return MERGED[0](spark).select("k", F.array_join(G.merge_keywords(F.split("a", ","), F.split("b", ",")), "|").alias("keywords"))


@query("SELECT DISTINCT 'slug-' || (p_partkey % 400) AS slug, 'Ecosystem Dashboard - ' || last(p_name ORDER BY p_partkey) AS display_name, last(p_name ORDER BY p_partkey) || ', mit, ' || last(p_brand ORDER BY p_partkey) AS keywords, 'https://dash.example.org/?package=slug-' || (p_partkey % 400) AS url, 'Works on ' || last(p_type ORDER BY p_partkey) || '.' || chr(10) || chr(10) || '[Download ' || last(p_name ORDER BY p_partkey) || ' here.](https://d.example.org/' || max(p_partkey) || ')' || chr(10) || chr(10) || 'To get started quickly, here are some helpful guides from different sources:' || chr(10) || '- [One](https://g.example.org/1)' || chr(10) || '- [Two](https://g.example.org/2)' AS content FROM part GROUP BY p_partkey % 400")
def dashboard_entries(spark, d):
    row = F.concat(F.lit('<tr class="main-sw-row tag-license-mit tag-category-'), "p_brand", F.lit('" data-title="'), "p_name", F.lit('" data-title-urlized="slug-'), F.col("p_partkey") % 400, F.lit('"><td><a class="download-icon-a" href="https://d.example.org/'), "p_partkey", F.lit('">x</a></td></tr><tr><td><div class="description">Works <b>on</b>  '), "p_type", F.lit('.</div><section><ul><li><a href="https://g.example.org/1">One</a></li><li><a href="https://g.example.org/2">Two</a></li></ul></section></td></tr>'))
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("<table><tr><th>Name</th></tr>"), row, F.lit("</table>")).alias("html"))
    return G.dashboard_entries(pages, "https://dash.example.org/")


@query("SELECT p_partkey AS id, 'slug-' || (p_partkey % 400) AS slug FROM part")
def dashboard_sources(spark, d):
    asks = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("https://dash.example.org/?x=1&package="), F.concat(F.lit("slug-"), F.col("p_partkey") % 400), F.lit("#top")).alias("url"))
    none = asks.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("https://dash.example.org/?package=unknown").alias("url"))
    return G.dashboard_sources(asks.select(F.col("id").cast("long"), "url").unionByName(none), dashboard_entries(spark, d)).select("id", "slug")


@query("""WITH o AS (SELECT s_suppkey % 50 AS op_id, arg_min(s_name, s_suppkey) AS operation FROM supplier GROUP BY ALL),
    i AS (SELECT p_partkey, p_name AS name, ['neon', 'wide'][p_partkey % 2 + 1] AS isa, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 10 END AS op_id, p_name || ' ' || p_type AS description, p_brand AS rt FROM part WHERE p_partkey % 3 <> 0)
    SELECT name, 'The `' || name || '` intrinsic is part of the ' || isa || ' instruction set architecture.' || CASE WHEN len(string_split(description, ' ')) > 5 THEN ' Here is a brief intrinsic description: ' || description || chr(10) || chr(10) ELSE '' END || 'The signature for this intrinsic function is as follows:' || chr(10) || '`' || rt || ' ' || name || ' (a, b);`' || chr(10) || chr(10) || 'Compiler flags: `' || CASE isa WHEN 'neon' THEN '-mn' ELSE '-mw' END || '`' || chr(10) || 'Header: `' || CASE isa WHEN 'neon' THEN 'n.h' ELSE 'w.h' END || '`' || CASE WHEN op_id IS NULL THEN '' ELSE chr(10) || 'This is how `' || name || '` operates:' || chr(10) || operation END AS content FROM i LEFT JOIN o USING (op_id)""")
def intrinsic_texts(spark, d):
    ops = table(spark, d, "supplier").select((F.col("s_suppkey") % 50).alias("op_id"), F.col("s_name").alias("content"), F.col("s_suppkey").alias("pos"))
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.col("p_name").alias("name"), F.element_at(X.words_in(["neon", "wide"]), (key % 2 + 1).cast("int")).alias("isa"), F.when(key % 3 == 0, F.array(F.lit("old"))).otherwise(F.array(F.lit("old"), F.lit("new"))).alias("architectures"), F.when(key % 5 != 0, key % 10).alias("op_id"), F.concat_ws(" ", "p_name", "p_type").alias("description"), F.col("p_brand").alias("return_type"), F.array(F.lit("a"), F.lit("b")).alias("arguments"))
    return G.intrinsic_texts(rows, ops, {"neon": ("-mn", "n.h"), "wide": ("-mw", "w.h")}, "new")


# ---- command output

ANSI_SQL = r"regexp_replace(o, '\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])', '', 'g')"


@query(f"WITH x AS (SELECT doc_id, chr(27) || '[1;31m' || coalesce(text, '') || chr(27) || '[0m' || chr(27) || 'M' AS o, CASE WHEN doc_id % 2 = 0 THEN source END AS e FROM documents), y AS (SELECT doc_id, {ANSI_SQL} AS o, coalesce(e, '') AS e FROM x) SELECT doc_id, md5(right(CASE WHEN o <> '' AND e <> '' THEN o || chr(10) || '[stderr]' || chr(10) || e WHEN o <> '' THEN o ELSE e END, 50000)) AS output FROM y")
def command_output(spark, d):
    esc = F.lit("\x1b")
    out = F.concat(esc, F.lit("[1;31m"), F.coalesce("text", F.lit("")), esc, F.lit("[0m"), esc, F.lit("M"))
    err = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return table(spark, d, "documents").select("doc_id", F.md5(P.tail(P.both_outputs(P.plain_output(out), err)).cast("binary")).alias("output"))


ARGUMENTS = literal("k long, s string", (1, "me@host:22:/home/a b.pem"), (2, "me@host:22:/home/key.pem"), (3, "-i /home/u/key.pem"), (4, "plain"), (5, "a@b:1:x:2:y.pem"))


@query(rf"SELECT k, CASE WHEN regexp_matches(s, '@[^\s:]+:\d+:[^\s]+\.pem$') THEN regexp_extract(s, '^(.*):', 1) || ':[REDACTED_KEY_PATH]' ELSE regexp_replace(s, '/[^\s:]+\.pem', '[REDACTED_KEY_PATH]', 'g') END AS safe FROM {ARGUMENTS[1]}")
def redact_arguments(spark, d):
    return ARGUMENTS[0](spark).select("k", P.redact_argument(F.col("s")).alias("safe"))


MOUNTS = literal("k long, line string", (1, "tmpfs /run/keys tmpfs rw 0 0"), (2, "tmpfs /run/keys/a\\040b tmpfs rw 0 0"), (3, "proc /proc proc rw 0 0"), (4, "tmpfs /run/keys tmpfs rw 0 0"), (5, "short"), (6, ""))


@query(f"WITH m AS (SELECT k, replace(list_filter(string_split_regex(trim(line), '\\s+'), lambda x: x <> '')[2], '\\040', ' ') AS mount FROM {MOUNTS[1]}) SELECT mount, min(k) AS k FROM m WHERE starts_with(mount, '/run/keys') GROUP BY mount")
def mount_scan(spark, d):
    return P.mounts(MOUNTS[0](spark), "/run/keys")


@query("""WITH t AS (SELECT event_id, 's' || event_id AS id, CASE event_id % 3 WHEN 0 THEN '{"data": {"invocation": {"session_id": "s' || event_id || '"}}}' WHEN 1 THEN 'noise' || chr(10) || '{"other": 1}' || chr(10) || '  {"data": {"invocation": {"session_id": "s' || event_id || '"}}}' ELSE 'nothing {' END AS s FROM events)
    SELECT event_id, CASE WHEN event_id % 3 < 2 THEN id END AS session FROM t""")
def nested_ids(spark, d):
    whole = F.concat(F.lit('{"data": {"invocation": {"session_id": "s'), "event_id", F.lit('"}}}'))
    text = F.when(F.col("event_id") % 3 == 0, whole).when(F.col("event_id") % 3 == 1, F.concat(F.lit('noise\n{"other": 1}\n  '), whole)).otherwise("nothing {")
    return table(spark, d, "events").select("event_id", P.first_json(text, "$.data.invocation.session_id").alias("session"))


TABLES_ = literal("k long, s string", (1, "\x1b[1m┃ name ┃ n ┃ n ┃  ┃\x1b[0m\n━━━\n┃ f ┃ 1,234 ┃ .5 ┃ x ┃\n┃ g ┃ -7 ┃\n┃ h ┃ 1 ┃ 2 ┃ 3 ┃ 4 ┃\nnoise\n┃ only ┃\n┃  ┃  ┃"), (2, "none"), (3, "┃ a ┃ a ┃\r\n┃ 1.50 ┃ 1e3 ┃"))


@query(f"""WITH l AS (SELECT k, unnest(string_split_regex(regexp_replace(s, '\x1b\\[1m|\x1b\\[0m', '', 'g'), '\\r?\\n')) AS l, generate_subscripts(string_split_regex(s, '\\r?\\n'), 1) AS n FROM {TABLES_[1]}),
    c AS (SELECT k, n, list_transform(string_split(trim(l)[2:-2], '┃'), lambda x: trim(x)) AS c FROM l WHERE starts_with(trim(l), '┃') AND ends_with(trim(l), '┃') AND length(trim(l)) > 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS row FROM c WHERE len(c) > 1 AND len(list_filter(c, lambda x: x <> '')) > 0),
    h AS (SELECT k, unnest(c) AS h, unnest(range(len(c))) AS pos FROM r WHERE row = 0), b AS (SELECT k, pos, CASE WHEN h = '' THEN 'column_' || (pos + 1) ELSE h END AS b FROM h),
    d AS (SELECT k, pos, b, row_number() OVER (PARTITION BY k, b ORDER BY pos) AS nth FROM b),
    t AS (SELECT r.k, row, pos, CASE WHEN nth = 1 THEN b ELSE b || '_' || nth END AS header, coalesce(c[pos + 1], '') AS text FROM r JOIN d ON r.k = d.k WHERE row > 0)
    SELECT k, CAST(row AS INTEGER) AS row, CAST(pos AS INTEGER) AS pos, header, text, CASE WHEN regexp_full_match(replace(text, ',', ''), '[-+]?\\d+') THEN CAST(replace(text, ',', '') AS BIGINT) END AS whole, CASE WHEN regexp_full_match(replace(text, ',', ''), '[-+]?\\d*\\.\\d+') THEN CAST(replace(text, ',', '') AS DOUBLE) END AS fraction FROM t""")
def rendered_table_cells(spark, d):
    return P.table_cells(TABLES_[0](spark))


REGISTRY = literal("k long, s string", (1, "-- header\n-- name: hot.default\nSELECT 1\nFROM a\n\n-- name: hot.other\n\n-- name: cpu.default\nSELECT 2;"), (2, "  --  name :  hot.default  \nSELECT 3"), (3, "no blocks"))


@query(f"""WITH b AS (SELECT k, unnest(regexp_extract_all(s, '(?m)^\\s*--\\s*name\\s*:\\s*(.+?)\\s*$', 1)) AS name, unnest(string_split_regex(s, '(?m)^\\s*--\\s*name\\s*:\\s*(.+?)\\s*$')[2:]) AS body, generate_subscripts(regexp_extract_all(s, '(?m)^\\s*--\\s*name\\s*:\\s*(.+?)\\s*$', 1), 1) AS n FROM {REGISTRY[1]}),
    t AS (SELECT split_part(trim(name), '.', 1) AS recipe, split_part(trim(name), '.', 2) AS query, k, n, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS sql FROM b) SELECT recipe, query, arg_max(sql, k * 1000 + n) AS sql FROM t WHERE sql <> '' GROUP BY ALL""")
def sql_registry(spark, d):
    return P.query_registry(REGISTRY[0](spark))


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, length(text)::BIGINT AS chars FROM conversations")
def log_append(spark, d):
    """Calls and then results appended to one log of JSON lines, read back."""
    path, c = new_path(spark, "log"), table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    for part in (c.filter("role = 'user'"), c.filter("role <> 'user'")):
        P.append_log(part, path)
    rows = spark.read.schema("conv_id long, turn long, role string, text string").json(path)
    return rows.select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


# ---- topics, links, paths


@query("SELECT doc_id, md5(coalesce(text, '')) AS html FROM documents")
def topic_html(spark, d):
    """Topic documents of the documentation service: JSON whose content is base64."""
    topic = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("source").alias("title"), F.struct(F.base64(F.coalesce("text", F.lit("")).cast("binary")).alias("content")).alias("topic"))).alias("json"))
    content = F.coalesce(F.try_to_binary(F.get_json_object("json", "$.topic.content"), F.lit("base64")), F.lit(b""))
    return topic.select("doc_id", F.md5(F.decode(content, "UTF-8").cast("binary")).alias("html"))


@query(f"""{LINK_SQL}, a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/' AS base, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, href FROM l), b AS (SELECT page_id, base, regexp_replace(regexp_replace(CASE WHEN starts_with(href, '/') THEN site || href ELSE href END, '[?#].*$', ''), '/*$', '/') AS u FROM a)
    SELECT page_id, array_to_string(list_sort(list(DISTINCT u)), ' ') AS steps FROM b WHERE starts_with(u, base) AND u <> base GROUP BY page_id""")
def step_urls(spark, d):
    """Links of a page below a source's address (here its site's), each once with one closing slash."""
    p = table(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    base = F.concat(F.regexp_extract("url", "^(https?://[^/?#]*)", 1), F.lit("/"))
    u = F.when(F.col("href").startswith("/"), F.concat(F.regexp_extract("url", "^(https?://[^/?#]*)", 1), "href")).otherwise(F.col("href"))
    u = F.concat(F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), "/+$", ""), F.lit("/"))
    links = p.select("page_id", base.alias("base"), u.alias("u")).filter(F.col("u").startswith(F.col("base")) & (F.col("u") != F.col("base"))).distinct()
    return links.groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list("u")), " ").alias("steps"))  # a page's own links


@query(f"{LINK_SQL}, o AS (SELECT page_id, url, list_transform(regexp_extract_all(html, '<a href=\"([^\"]*)\"[^>]*>([^<]*)</a>', 0), lambda x: regexp_extract(x, '>([^<]*)</a>', 1) || ' ' || regexp_extract(x, 'href=\"([^\"]*)\"', 1)) AS e FROM pages) SELECT page_id, CASE WHEN len(e) = 0 THEN url ELSE url || chr(10) || chr(10) || 'Linked references: ' || array_to_string(e, ' ') END AS evidence FROM o")
def link_evidence(spark, d):
    """A block's text with what it links to."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"[^>]*>([^<]*)</a>'), F.lit(0))
    e = F.transform(found, lambda x: F.concat_ws(" ", F.regexp_extract(x, ">([^<]*)</a>", 1), F.regexp_extract(x, 'href="([^"]*)"', 1)))
    return table(spark, d, "pages").select("page_id", F.when(F.size(e) == 0, F.col("url")).otherwise(F.concat("url", F.lit("\n\nLinked references: "), F.array_join(e, " "))).alias("evidence"))


@query(f"""WITH p AS (SELECT k, p FROM {PATHS[1]} UNION ALL SELECT page_id + 1000, regexp_replace(url, '^https?://', '') || '/build/x' FROM pages), s AS (SELECT k, string_split(p, '/') AS s FROM p),
    f AS (SELECT k, s, list_position(list_transform(s, lambda x: list_contains({stop_list(C.EXCLUDED_NAMES)}, x) OR ends_with(x, '.egg-info')), true) AS i FROM s), t AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS path FROM f WHERE i > 0) SELECT path, CAST(count(*) OVER () AS BIGINT) AS n FROM t""")
def excluded_listing(spark, d):
    """What a workspace leaves out: the topmost excluded folder or file of each path, once, and their number."""
    more = addresses("p")(spark, d).withColumn("p", F.concat(F.regexp_replace("p", "^https?://", ""), F.lit("/build/x")))
    s = F.split("p", "/")
    name = lambda x: x.isin(C.EXCLUDED_NAMES) | F.greatest(*(x.endswith(e) for e in C.EXCLUDED_SUFFIXES), F.lit(False))
    first = F.array_position(F.transform(s, name), True).cast("int")
    found = PATHS[0](spark).unionByName(more).select(first.alias("i"), s.alias("s")).filter("i > 0").select(F.array_join(F.slice("s", 1, F.col("i")), "/").alias("path")).distinct()
    return found.crossJoin(F.broadcast(found.agg(F.count("*").alias("n"))))  # one row


@query(f"SELECT bool_or(len({tok_sql('text')}) > 0) AS has_words, CAST(count(*) FILTER (WHERE len({tok_sql('text')}) = 0) AS BIGINT) AS n_rejected FROM documents")
def corpus_check(spark, d):
    """Whether there is anything to index, and how many documents have nothing."""
    n = F.size(X.tokens(F.col("text")))
    return table(spark, d, "documents").agg(F.bool_or(n > 0).alias("has_words"), F.count_if(n == 0).alias("n_rejected"))


SERVICES = literal("k long, u string, s string", (1, "https://docs.example.org/documentation/1/2/x", "https://api.example.net/documentation/1/9/x/y?rev=3&a=b&c=#f"), (2, "https://docs.example.org/documentation/1", "https://api.example.net/documentation/1/9/x"), (3, "https://docs.example.org/other/z", "https://api.example.net/other/z?rev=1"))


@query(f"""WITH p AS (SELECT k, u, list_filter(string_split(regexp_extract(s, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p, list_filter(string_split(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS o, list_filter(string_split(regexp_extract(s, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^rev(=|$)')) AS q, regexp_extract(s, '(#.*)$', 1) AS f FROM {SERVICES[1]})
    SELECT k, 'https://api.example.net' || regexp_extract(u, '^https?://[^/?#]*(.*)$', 1) AS service, 'https://docs.example.org/' || array_to_string(CASE WHEN len(p) >= 3 AND p[1] = 'documentation' THEN p[1:2] || [CASE WHEN len(o) >= 3 THEN o[3] ELSE p[3] END] || p[4:] ELSE p END, '/') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END || f AS shown FROM p""")
def service_urls(spark, d):
    """A documentation url at its service, and a service's url as readers see it: the source's version, no revision."""
    return SERVICES[0](spark).select("k", U.service_url(F.col("u"), "api.example.net").alias("service"), U.shown_url(F.col("s"), F.col("u"), "docs.example.org").alias("shown"))


# ---- evaluation of the flagship


@query(f"""WITH {FLAGSHIP}, {FOUND}, {EXPECTED}, eu AS (SELECT DISTINCT ex.query_id, 'https://docs.example.org/' || source || '/' || (doc_id % 97) AS base FROM ex JOIN documents ON ordinal = doc_id), hit AS (SELECT f.query_id, min(f.rank) AS r FROM fi f JOIN eu ON eu.query_id = f.query_id AND eu.base = regexp_replace(regexp_replace(f.url, '[?#].*$', ''), '/+$', '') GROUP BY f.query_id),
    c AS (SELECT q.query_id, r FROM (SELECT DISTINCT query_id FROM eu) q LEFT JOIN hit USING (query_id))
    SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE r IS NULL) AS BIGINT) AS misses, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_at_3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM c""")
def eval_flagship(spark, d):
    """The flagship's hits by url without query, fragment and closing slash, and its misses."""
    c = corpus(spark, d)
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    expected = R.documents_with(c, b).join(c.select("ordinal", U.base(F.col("url")).alias("base")), "ordinal").select("query_id", "base").distinct()
    found = R.search(asked(spark, d), c, vectors(spark, d)).select("query_id", "rank", U.base(F.col("url")).alias("base"))
    hit = found.join(expected, ["query_id", "base"]).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    cases = expected.select("query_id").distinct().join(hit, "query_id", "left")
    return R.eval_metrics(cases).join(cases.agg(F.count_if(F.col("first_rank").isNull()).alias("misses")))
