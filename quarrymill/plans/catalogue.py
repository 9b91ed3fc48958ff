"""All queries of the engine with their SQL twins.

``query`` registers a function under its name, with SQL that gives the same rows
where SQL can. Literal inputs are given once and used by both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill import config as C
from quarrymill.functions import text as X
from quarrymill.functions import urls as U
from quarrymill.operators import chunking as K
from quarrymill.operators import operations as O
from quarrymill.operators import retrieval as R
from quarrymill.sources import sections as S
from quarrymill.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(columns: str, *rows: tuple):
    """The same rows for Spark and as an SQL VALUES list."""
    code = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(map(code, r)) + ")" for r in rows)
    names = [c.split()[0] for c in columns.split(", ")]
    return (lambda spark: spark.createDataFrame(rows, columns)), f"(VALUES {values}) AS t({', '.join(names)})"


def given(spark: SparkSession, lit: tuple, rows: DataFrame | None) -> DataFrame:
    """The literal rows, after those of a table where there are some."""
    return lit[0](spark) if rows is None else rows.unionByName(lit[0](spark))


TOK = r"(?i)[a-z0-9][a-z0-9_\-+.]*"
SQL_TOKENS = f"list_transform(regexp_extract_all(coalesce({{c}}, ''), '{TOK}'), lambda x: lower(x))"
stop_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
tok_sql = lambda c: SQL_TOKENS.format(c=c)
salient_sql = lambda c, words=C.STOPWORDS: f"list_filter({tok_sql(c)}, lambda x: NOT list_contains({stop_list(words)}, x))"

# ---- text


@query(f"SELECT doc_id, CAST(len({tok_sql('text')}) AS BIGINT) AS n, md5(array_to_string({tok_sql('text')}, ' ')) AS tokens FROM documents")
def tokenize(spark, d):
    t = X.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens"))


@query(f"SELECT item_id, array_to_string({salient_sql('text')}, ' ') AS salient, array_to_string({salient_sql('text', C.DIRECT_STOPWORDS)}, ' ') AS direct FROM benchmark")
def salient_tokens(spark, d):
    t = X.tokens(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.without(t, C.STOPWORDS), " ").alias("salient"), F.array_join(X.without(t, C.DIRECT_STOPWORDS), " ").alias("direct"))


@query(f"""SELECT page_id, array_to_string(flatten(list_transform({tok_sql('url')}, lambda t: CASE WHEN regexp_matches(t, '[_\\-+.]')
    THEN list_concat([t], list_filter(string_split_regex(t, '[_\\-+.]+'), lambda x: x <> '')) ELSE [t] END)), ' ') AS tokens FROM pages""")
def url_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(X.split_tokens(F.col("url")), " ").alias("tokens"))


@query(r"SELECT doc_id, CAST(ceil(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) * 0.85::DOUBLE) AS BIGINT) AS n FROM documents")
def estimate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("n"))


RAW = literal("k long, s string", (1, "a\r\nb\rc"), (2, " x \t\t y  "), (3, "p\n\n\n\n\nq"), (4, None), (5, ""), (6, "one two"))


@query(rf"SELECT k, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(s, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS clean FROM {RAW[1]}")
def clean_text(spark, d, rows=None):
    return given(spark, RAW, rows).select("k", X.clean(F.col("s")).alias("clean"))


@query(f"WITH q AS (SELECT item_id, {salient_sql('text')} AS t FROM benchmark) SELECT item_id, array_to_string([array_to_string(t[i:i+1], ' ') for i in range(1, len(t)) if true], '|') AS bigrams, array_to_string([array_to_string(t[i:i+2], ' ') for i in range(1, len(t) - 1) if true], '|') AS trigrams FROM q")
def query_ngrams(spark, d):
    q = table(spark, d, "benchmark").select("item_id", X.without(X.tokens(F.col("text")), C.STOPWORDS).alias("t"))
    return q.select("item_id", F.array_join(X.ngrams(F.col("t"), 2), "|").alias("bigrams"), F.array_join(X.ngrams(F.col("t"), 3), "|").alias("trigrams"))


@query(r"WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w FROM documents) SELECT doc_id, md5(CASE WHEN len(w) <= 50 THEN text ELSE array_to_string(w[len(w)-49:len(w)], ' ') END) AS tail FROM w")
def overlap_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.overlap_tail(F.col("text"), C.CHUNK_OVERLAP).cast("binary")).alias("tail"))


@query(r"WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents) SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS sentences FROM s")
def sentence_split(spark, d):
    s = X.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|").cast("binary")).alias("sentences"))


FRONT = literal("k long, s string", (1, "---\ntitle: a\n---\n\nbody"), (2, "no front"), (3, "---\nopen only"), (4, "﻿---\na: b\n---\nx"), (5, ""))


@query(f"""WITH b AS (SELECT k, CASE WHEN s[1] = chr(65279) THEN s[2:] ELSE s END AS s FROM {FRONT[1]}),
    e AS (SELECT k, s, CASE WHEN starts_with(s, '---') THEN strpos(s[4:], chr(10) || '---') ELSE 0 END AS p FROM b)
    SELECT k, CASE WHEN p > 0 THEN ltrim(s[p + 3 + 4:], chr(10) || ' ') ELSE s END AS body FROM e""")
def strip_frontmatter(spark, d, rows=None):
    return given(spark, FRONT, rows).select("k", X.strip_frontmatter(F.col("s")).alias("body"))


BOILER_SQL = " OR ".join(["regexp_matches(l, '^©\\s*\\d{4}')", "regexp_matches(l, '^\\d+\\s*/\\s*\\d+$')", "regexp_matches(l, '^\\d+$')", *("regexp_matches(l, '(?i)" + p.replace("'", "''") + "')" for p in C.BOILERPLATE)])
LINES = literal("k long, s string", (1, "Skip to content"), (2, "© 2024 x"), (3, "3 / 10"), (4, "42"), (5, "Copy"), (6, "Copy this"), (7, ""), (8, "About | Contact us | Privacy | Sitemap"), (9, "Last updated at: now"))


@query(f"WITH x AS (SELECT k, trim(s) AS l FROM {LINES[1]}), y AS (SELECT doc_id + 1000 AS k, trim(unnest(string_split(text, chr(10)))) AS l FROM documents), z AS (SELECT * FROM x UNION ALL SELECT * FROM y) SELECT k, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN l <> '' AND ({BOILER_SQL}) THEN 1 ELSE 0 END) AS BIGINT) AS n_boilerplate FROM z GROUP BY k")
def boilerplate_lines(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") + 1000).alias("k"), F.explode(F.split("text", "\n")).alias("s")).unionByName(LINES[0](spark))
    return rows.groupBy("k").agg(F.count("*").alias("n_lines"), F.sum(X.is_boilerplate(F.col("s")).cast("long")).alias("n_boilerplate"))


HEADS = literal("k long, s string", (1, "GETTING STARTED"), (2, "Getting started"), (3, "STOP HERE."), (4, "A B C D E F G H I J K L M"), (5, "1234"), (6, "API: USE IT"), (7, "Getting Started Now"), (8, "It'S A Title"), (9, "iPhone Setup"))


@query(rf"SELECT k, length(s) <= 120 AND len(regexp_extract_all(s, '\S+')) <= 12 AND NOT regexp_matches(s, '[.!?:]$') AND (upper(s) = s OR (NOT regexp_matches(s, '(?:^|[^\p{{L}}])\p{{Ll}}') AND NOT regexp_matches(s, '\p{{L}}\p{{Lu}}'))) AS heading FROM {HEADS[1]}")
def heading_like(spark, d, rows=None):
    return given(spark, HEADS, rows).select("k", X.shouted_heading(F.col("s")).alias("heading"))


@query(r"SELECT page_id, regexp_extract(url, '(?i)\b(v?\d+(?:\.\d+){0,2})\b', 1) AS version FROM pages")
def derive_version(spark, d):
    return table(spark, d, "pages").select("page_id", X.version_of(F.col("url")).alias("version"))


@query("SELECT p_partkey, lower(array_to_string(list_transform(string_split(p_name, ' '), lambda x: trim(x)), ', ')) AS keywords FROM part")
def keywords_format(spark, d):
    return table(spark, d, "part").select("p_partkey", X.format_keywords(F.split("p_name", " ")).alias("keywords"))


KEYS = literal("k long, s string, title string", (1, "a; b,c", "c"), (2, " , ;", "T"), (3, None, "T"), (4, "x,x", "y"))


@query(f"WITH w AS (SELECT k, title, list_filter(list_transform(string_split_regex(coalesce(s, ''), '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS w FROM {KEYS[1]}) SELECT k, array_to_string(CASE WHEN list_contains(w, title) THEN w ELSE list_append(w, title) END, '|') AS keywords FROM w")
def parse_keywords(spark, d, rows=None):
    return given(spark, KEYS, rows).select("k", F.array_join(X.keyword_list(F.col("s"), F.col("title")), "|").alias("keywords"))


@query("SELECT doc_id, md5(concat_ws(' ', nullif(source, ''), nullif(lang, ''), nullif(text, ''))) AS search_text FROM documents")
def search_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.search_text(F.col("source"), F.col("lang"), F.col("text")).cast("binary")).alias("search_text"))


SECRETS = literal("k long, s string", (1, "x -----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- y"), (2, "ssh -i /home/u/key.pem host"), (3, "nothing"), (4, ""))


@query(rf"SELECT k, regexp_replace(regexp_replace(s, '(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----', '[REDACTED_PRIVATE_KEY]', 'g'), '/[^\s:]+\.pem', '[REDACTED_KEY_PATH]', 'g') AS safe FROM {SECRETS[1]}")
def redact_secrets(spark, d, rows=None):
    return given(spark, SECRETS, rows).select("k", X.redact(F.col("s")).alias("safe"))


@query("SELECT doc_id, md5(right(text, 50000)) AS tail FROM documents")
def tail_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.right("text", F.lit(50000)).cast("binary")).alias("tail"))


SUPPORT = literal("k long, s string", (1, "It does  not support SVE2."), (2, "Unsupported here"), (3, "supported"), (4, "doesn't support"), (5, "no support"), (6, ""))


@query(f"SELECT k, regexp_matches(s, '(?i){'|'.join(C.NEGATIVE_SUPPORT).replace(chr(39), chr(39) * 2)}') AS denied FROM {SUPPORT[1]}")
def negative_support(spark, d, rows=None):
    return given(spark, SUPPORT, rows).select("k", X.denies_support(F.col("s")).alias("denied"))


IMAGES = literal("k long, s string", (1, "nginx"), (2, "nginx:1.2"), (3, "Org/App:latest"), (4, "org/app"))


@query(f"WITH p AS (SELECT k, lower(split_part(s, ':', 1)) AS r, CASE WHEN contains(s, ':') THEN substr(s, strpos(s, ':') + 1) ELSE 'latest' END AS tag FROM {IMAGES[1]}) SELECT k, CASE WHEN contains(r, '/') THEN r ELSE 'library/' || r END AS repository, tag FROM p")
def image_spec(spark, d):
    r = F.lower(F.split_part("s", F.lit(":"), F.lit(1)))
    tag = F.when(F.col("s").contains(":"), F.expr("substr(s, locate(':', s) + 1)")).otherwise("latest")
    return IMAGES[0](spark).select("k", F.when(r.contains("/"), r).otherwise(F.concat(F.lit("library/"), r)).alias("repository"), tag.alias("tag"))


CELLS = literal("k long, s string", (1, " 1,234 "), (2, ".5"), (3, "-7"), (4, "1.5e3"), (5, ""), (6, "abc"))


@query(rf"WITH c AS (SELECT k, replace(trim(s), ',', '') AS c, trim(s) AS s FROM {CELLS[1]}) SELECT k, CASE WHEN regexp_full_match(c, '[-+]?\d+') THEN CAST(c AS BIGINT) END AS whole, CASE WHEN regexp_full_match(c, '[-+]?\d*\.\d+') THEN CAST(c AS DOUBLE) END AS fraction, CASE WHEN NOT regexp_full_match(c, '[-+]?\d+') AND NOT regexp_full_match(c, '[-+]?\d*\.\d+') THEN s END AS other FROM c")
def coerce_cells(spark, d):
    c = F.regexp_replace(F.trim("s"), ",", "")
    whole, fraction = c.rlike(r"^[-+]?\d+$"), c.rlike(r"^[-+]?\d*\.\d+$")
    return CELLS[0](spark).select("k", F.when(whole, c.try_cast("long")).alias("whole"), F.when(fraction, c.try_cast("double")).alias("fraction"), F.when(~whole & ~fraction, F.trim("s")).alias("other"))


HEADERS = literal("pos long, s string", (1, "a"), (2, "b"), (3, "a"), (4, ""), (5, "a"))


@query(f"WITH h AS (SELECT pos, CASE WHEN trim(s) = '' THEN 'column_' || pos ELSE trim(s) END AS b FROM {HEADERS[1]}), n AS (SELECT pos, b, row_number() OVER (PARTITION BY b ORDER BY pos) AS n FROM h) SELECT pos, CASE WHEN n = 1 THEN b ELSE b || '_' || n END AS header FROM n")
def dedupe_headers(spark, d):
    from pyspark.sql import Window

    h = HEADERS[0](spark).select("pos", F.when(F.trim("s") == "", F.concat(F.lit("column_"), "pos")).otherwise(F.trim("s")).alias("b"))
    n = h.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy("pos")))
    return n.select("pos", F.when(F.col("n") == 1, F.col("b")).otherwise(F.concat_ws("_", "b", "n")).alias("header"))


REPORT = literal("k long, s string", (1, "┃ name ┃ n ┃\n━━━\n┃ f ┃ 1,234 ┃\n┃ g ┃\nnoise"), (2, "none"))


@query(f"WITH l AS (SELECT k, unnest(string_split(s, chr(10))) AS l FROM {REPORT[1]}) SELECT k, trim(string_split(trim(l, '┃ '), '┃')[1]) AS first_cell, CAST(len(string_split(trim(l, '┃ '), '┃')) AS BIGINT) AS cells FROM l WHERE starts_with(trim(l), '┃')")
def parse_rendered_table(spark, d):
    line = REPORT[0](spark).select("k", F.explode(F.split("s", "\n")).alias("l")).filter(F.trim("l").startswith("┃"))
    cells = F.split(F.regexp_replace("l", "^[┃ ]+|[┃ ]+$", ""), "┃")
    return line.select("k", F.trim(cells[0]).alias("first_cell"), F.size(cells).cast("long").alias("cells"))


# ---- URLs

ADDRESSES = literal("k long, u string", (1, " https://a.example.org/x "), (2, "chrome-extension://abc/https://b.example.org/y"), (3, None), (4, ""), (5, "https://github.com/o/r/blob/main/docs/a.md"), (6, "https://a.example.org/x/y/z?b=1&utm_source=q&c=#f"), (7, "https://a.example.org/x?package= foo #z"), (8, "https://sub.example.org:8080/p/"))
NORM = "regexp_replace(coalesce(u, ''), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT k, CASE WHEN regexp_matches({NORM}, '^chrome-extension://.*https:/') THEN 'https://' || regexp_extract({NORM}, '^chrome-extension://.*?https:/+(.*)$', 1) ELSE {NORM} END AS url FROM {ADDRESSES[1]}")
def normalize_url(spark, d, rows=None):
    return given(spark, ADDRESSES, rows).select("k", U.normalize(F.col("u")).alias("url"))


@query(f"SELECT k, CASE WHEN regexp_matches({NORM}, '^chrome-extension://.*https:/') THEN 'https://' || regexp_extract({NORM}, '^chrome-extension://.*?https:/+(.*)$', 1) ELSE regexp_replace({NORM}, '^https://github\\.com/([^/]+)/([^/]+)/blob/([^/]+)/([^?#]+)$', 'https://raw.githubusercontent.com/\\1/\\2/\\3/\\4') END AS url FROM {ADDRESSES[1]}")
def fetch_url(spark, d, rows=None):
    return given(spark, ADDRESSES, rows).select("k", U.fetchable(F.col("u")).alias("url"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS base FROM pages")
def url_base(spark, d):
    return table(spark, d, "pages").select("page_id", U.base(F.col("url")).alias("base"))


@query("SELECT page_id, split_part(url, '#', 1) || '#s' || page_id AS url FROM pages")
def url_fragment(spark, d):
    return table(spark, d, "pages").select("page_id", U.with_fragment(F.col("url"), F.concat(F.lit("s"), "page_id")).alias("url"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS f, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS h FROM pages)
    SELECT page_id, f || '?' || array_to_string(list_append(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^utm_source(=|$)')), 'utm_source=kb'), '&') || h AS url FROM p""")
def utm_tag(spark, d):
    return table(spark, d, "pages").select("page_id", U.tag_utm(F.col("url"), "kb").alias("url"))


@query("SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages")
def query_param(spark, d):
    return table(spark, d, "pages").select("page_id", U.query_param(F.col("url"), "page").alias("page"))


@query("SELECT page_id, regexp_matches(lower(url), '^https?://([^/]*\\.)?example\\.org([:/?#]|$)') AS inside FROM pages")
def domain_flag(spark, d):
    return table(spark, d, "pages").select("page_id", U.in_domain(F.col("url"), "example.org").alias("inside"))


@query("SELECT page_id, len(list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) = 2 AS root FROM pages")
def root_url_flag(spark, d):
    return table(spark, d, "pages").select("page_id", U.is_root(F.col("url"), 2).alias("root"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<h4[^>]*>.*?</h4>', '', 'g'), '(?s)<pre[^>]*>(.*?)</pre>', '`\1`', 'g'), '(?s)<h[1-6][^>]*>(.*?)</h[1-6]>', '\1' || chr(10), 'g'), '<[^>]+>', '', 'g')) AS text FROM pages")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.html_text(F.col("html")).cast("binary")).alias("text"))


LINK_SQL = """WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


@query(f"{LINK_SQL} SELECT page_id, href, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY page_id, href")
def extract_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(f"{LINK_SQL} SELECT page_id, CASE WHEN regexp_matches(href, '^(mailto|tel|javascript):') THEN NULL WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || href ELSE NULL END AS link FROM l")
def resolve_links(spark, d):
    l = table(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    h = F.col("href")
    link = F.when(h.rlike("^(mailto|tel|javascript):"), None).when(h.rlike("^https?://"), h).when(h.startswith("/"), F.concat(F.regexp_extract("url", "^(https?://[^/?#]*)", 1), h))
    return l.select("page_id", link.alias("link"))


LABELLED_LINK = '<a href="([^"]*)"[^>]*>([^<]*)</a>'
LABELS = literal("k long, url string, label string", (1, "https://a.example.org/x", "Read the guide to tuning"), (2, "https://a.example.org/x#part", "here"), (3, "https://a.example.org/x", "this"), (4, "mailto:x@example.org", "Write to us now"), (5, None, "two words"), (6, "https://a.example.org/#", ""))


@query(f"""WITH l AS (SELECT page_id + 1000 AS k, unnest(regexp_extract_all(html, '{LABELLED_LINK}', 1)) AS href, unnest(regexp_extract_all(html, '{LABELLED_LINK}', 2)) AS label, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site FROM pages),
    a AS (SELECT k, CASE WHEN starts_with(href, '/') THEN site || href ELSE href END AS url, label FROM l UNION ALL SELECT * FROM {LABELS[1]})
    SELECT k, url, label, coalesce(regexp_matches(url, '^https?:'), false) AND (regexp_matches(coalesce(url, ''), '#.') OR len({salient_sql('label', C.LINK_STOPWORDS)}) >= 2) AS meaningful FROM a""")
def meaningful_links(spark, d):
    both = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(LABELLED_LINK), F.lit(i)).alias(n) for i, n in ((1, "href"), (2, "label"))))
    l = table(spark, d, "pages").select((F.col("page_id") + 1000).alias("k"), F.regexp_extract("url", "^(https?://[^/?#]*)", 1).alias("site"), F.inline(both))
    l = l.select("k", F.when(F.col("href").startswith("/"), F.concat("site", "href")).otherwise(F.col("href")).alias("url"), "label").unionByName(LABELS[0](spark))
    return l.withColumn("meaningful", U.is_meaningful_link(F.col("url"), F.col("label")))


PRODUCTS = [("Network", ["thention"], ["example.net"], []), ("Spanish", [], [], ["/es/"])]


@query(r"""WITH p AS (SELECT page_id, url, lower(concat_ws(' ', regexp_extract(html, '<title>([^<]*)', 1), url, '', '')) AS said FROM pages)
    SELECT page_id, CASE WHEN contains(said, 'thention') OR regexp_matches(lower(url), '^https?://([^/]*\.)?example\.net([:/?#]|$)') THEN 'Network' WHEN contains(url, '/es/') THEN 'Spanish' ELSE 'Documentation' END AS product FROM p""")
def derive_product(spark, d):
    none = F.lit("")
    return table(spark, d, "pages").select("page_id", U.product_of(F.regexp_extract("html", "<title>([^<]*)", 1), F.col("url"), none, none, PRODUCTS).alias("product"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS f, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS h FROM pages)
    SELECT page_id, f || '?' || array_to_string(list_append(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^utm_source(=|$)')), 'utm_source=kb'), '&') || h AS url,
        'Keep the address as it is.' AS url_note, CASE WHEN regexp_matches(lower(url), '^https?://([^/]*\\.)?example\\.org([:/?#]|$)') THEN 'Check the source before use.' END AS disclaimer FROM p""")
def response_decorate(spark, d):
    return R.decorate(table(spark, d, "pages").select("page_id", "url"), "kb", "example.org", "Keep the address as it is.", "Check the source before use.")


# ---- data formats


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


TREE = literal("id long, parent long, href string", (1, None, "/a"), (2, 1, "/a/b"), (3, 1, "/a/c"), (4, 3, "/a/c/d"), (5, None, "/e"))


@query(f"WITH RECURSIVE t0 AS (SELECT * FROM {TREE[1]}), w AS (SELECT id, href, 0 AS depth FROM t0 WHERE parent IS NULL UNION ALL SELECT t0.id, t0.href, depth + 1 FROM t0 JOIN w ON t0.parent = w.id) SELECT id, href, CAST(depth AS INTEGER) AS depth FROM w")
def recursive_links(spark, d):
    tree = TREE[0](spark)
    return spark.sql("WITH RECURSIVE w AS (SELECT id, href, 0 AS depth FROM {t} WHERE parent IS NULL UNION ALL SELECT x.id, x.href, depth + 1 FROM {t} x JOIN w ON x.parent = w.id) SELECT id, href, depth FROM w", t=tree)


# ---- retrieval


def corpus(spark, d):
    """Documents as the searched chunks."""
    docs = table(spark, d, "documents")
    kind = F.element_at(X.words_in(["tutorial", "tuning guide", "brief", "reference architecture"]), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("ordinal"), F.col("source").alias("title"), F.col("lang").alias("heading"), F.lit("").alias("heading_path"), F.concat(F.lit("https://docs.example.org/"), "source", F.lit("/"), (F.col("doc_id") % 97)).alias("url"),
        F.concat(F.lit("https://docs.example.org/"), "source", F.lit("/"), (F.col("doc_id") % 97)).alias("resolved_url"), kind.alias("doc_type"), F.lit("Documentation").alias("product"), F.col("lang").alias("keywords"), F.coalesce("text", F.lit("")).alias("search_text"))


def asked(spark, d):
    v = vectors(spark, d).select(F.col("ordinal").alias("query_id"), "vector")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(v, "query_id", "left")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))


CTE = f"""tk AS (SELECT doc_id, {tok_sql('text')} AS t FROM documents), fl AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tk),
    po AS (SELECT doc_id, dl, term, count(*) AS tf FROM fl GROUP BY ALL), st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM tk),
    rw AS (SELECT term, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po, st GROUP BY term),
    idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rw) ELSE raw END AS idf FROM rw),
    qt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({tok_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
    sc AS (SELECT item_id AS query_id, doc_id AS ordinal, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN po USING (term), st GROUP BY ALL),
    tp AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal DESC) AS INTEGER) AS rank FROM sc WHERE score > 0) WHERE rank <= 400)"""


@query(f"WITH {CTE} SELECT CAST(n_docs AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl FROM st")
def bm25_stats(spark, d):
    return R.corpus_stats(corpus(spark, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {CTE} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")
def idf(spark, d):
    c = corpus(spark, d)
    return R.idf(R.postings(c), R.corpus_stats(c)).select("term", "df", F.round("idf", 6).alias("idf"))


def scores(spark, d, depth=None):
    """All pairs with a common term, or what can be among each query's best ``depth``."""
    return R.bm25(asked(spark, d), *R.counted(asked(spark, d), corpus(spark, d), materialize), depth)


@query(f"WITH {CTE} SELECT query_id, CAST(count(*) AS BIGINT) AS n, round(sum(score), 2) AS total FROM sc GROUP BY query_id")
def bm25_scores(spark, d):
    return scores(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query(f"WITH {CTE} SELECT query_id, ordinal, score, rank FROM tp WHERE rank <= 5")
def bm25_topk(spark, d):
    return R.bm25_topk(scores(spark, d, 5), 5).select("query_id", "ordinal", "score", "rank")


L2 = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6)"


@query(f"SELECT a.vec_id AS ordinal, b.vec_id AS query_id, {L2} AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def l2sq(spark, d):
    v = vectors(spark, d)
    q = v.select(F.col("ordinal").alias("query_id"), F.col("vector").alias("qv"))
    return v.join(q, F.col("query_id") == F.col("ordinal") + 1).select("ordinal", "query_id", F.round(R.distance(F.col("vector"), F.col("qv")), 6).alias("distance"))


DENSE = f"dn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, ordinal) AS INTEGER) AS rank FROM (SELECT b.vec_id AS query_id, a.vec_id AS ordinal, {L2} AS distance FROM embeddings a, embeddings b WHERE b.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 100 AND distance < 1.3)"


@query(f"WITH {DENSE} SELECT query_id, ordinal, distance, rank FROM dn")
def dense_topk(spark, d):
    q = asked(spark, d).filter("vector is not null")
    return R.dense_topk(q, vectors(spark, d), 100, 1.3).select("query_id", "ordinal", "distance", "rank")


@query(f"""WITH q AS (SELECT item_id, list_distinct({tok_sql('text')}) AS q FROM benchmark), a AS (SELECT item_id, len(q) AS n, unnest(q) AS term FROM q), t AS (SELECT doc_id, unnest(list_distinct({tok_sql('text')})) AS term FROM documents)
    SELECT item_id, doc_id, round(count(*) / any_value(n)::DOUBLE, 6) AS ratio FROM a JOIN t USING (term) GROUP BY item_id, doc_id""")
def overlap_ratio(spark, d):
    """Share of a query's terms in each document that has one of them."""
    q = table(spark, d, "benchmark").select("item_id", F.array_distinct(X.tokens(F.col("text"))).alias("q"))
    found = R.matches(q.select(F.col("item_id").alias("query_id"), F.explode("q").alias("term")), table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), "text"), "text")
    sizes = q.groupBy("item_id").agg(F.max(F.size("q")).alias("n"))
    return found.join(F.broadcast(sizes) if R.few(sizes) else sizes, F.col("query_id") == F.col("item_id")).select("item_id", F.col("ordinal").alias("doc_id"), F.round(F.col("n_q") / F.col("n"), 6).alias("ratio"))


MATCH = literal("k long, q string, t string", (1, "sve perf", "sve2 notes"), (2, "sve2", "sve only"), (3, "a b", "b c"), (4, "sme sve", "sme sve2 sme2"), (5, "x", ""))


@query(f"WITH m AS (SELECT k, {tok_sql('q')} AS q, {tok_sql('t')} AS t FROM {MATCH[1]}) SELECT k, CAST(len(list_filter(q, lambda x: list_contains(t, x) OR (x IN ('sme', 'sve') AND len(list_filter(t, lambda y: regexp_full_match(y, x || '[0-9]+'))) > 0))) AS BIGINT) AS n FROM m")
def token_match(spark, d, rows=None):
    return given(spark, MATCH, rows).select("k", X.match_count(X.tokens(F.col("q")), X.tokens(F.col("t"))).alias("n"))


PHRASES = literal("k long, q string, t string", (1, "tune memory cache lines", "How to tune memory cache lines"), (2, "memory cache", "a memory cached"), (3, "one", "one"), (4, "a b c d e f g h j k", "x b c d e f g h j k"), (5, "", "x"))


@query(f"WITH m AS (SELECT k, lower(t) AS s, {salient_sql('q', C.DIRECT_STOPWORDS)} AS w FROM {PHRASES[1]}) SELECT k, round(least(0.40::DOUBLE, 0.10::DOUBLE * len([i for i in range(1, len(w)) if contains(s, array_to_string(w[i:i+1], ' '))]) + 0.16::DOUBLE * len([i for i in range(1, len(w) - 1) if contains(s, array_to_string(w[i:i+2], ' '))])), 6) AS bonus FROM m")
def phrase_bonus(spark, d, rows=None):
    terms = X.without(X.tokens(F.col("q")), C.DIRECT_STOPWORDS)
    return given(spark, PHRASES, rows).select("k", F.round(X.phrase_bonus(terms, F.lower("t")), 6).alias("bonus"))


EVIDENCE = literal("k long, q string, t string", (1, "which devices support sve2", "sve2 is supported by devices and servers"), (2, "sve support", "It does not support sve2 hardware"), (3, "sve2 support", "sve hardware"), (4, "plain words", "sve2 support"), (5, "sme capability sve", "sme2 sve capability device"), (6, "supporting servers with sve", "sve2 supporting server"))


@query(f"""WITH m AS (SELECT k, list_distinct({tok_sql('q')}) AS q, {tok_sql('t')} AS d, t FROM {EVIDENCE[1]}),
    n AS (SELECT *, len(list_filter(q, lambda x: regexp_full_match(x, '(sme|sve)[0-9]*') AND (list_contains(d, x) OR (x IN ('sme', 'sve') AND len(list_filter(d, lambda y: regexp_full_match(y, x || '[0-9]+'))) > 0)))) AS hits FROM m)
    SELECT k, round(CASE WHEN list_has_any(q, {stop_list(C.SUPPORT)}) AND hits > 0 AND list_has_any(d, {stop_list(C.SUPPORT)}) THEN 0.12::DOUBLE * hits + CASE WHEN list_has_any(q, ['device', 'devices']) AND list_has_any(d, ['device', 'devices']) THEN 0.20 ELSE 0 END + CASE WHEN list_has_any(q, ['server', 'servers']) AND list_has_any(d, ['server', 'servers']) THEN 0.10 ELSE 0 END
        + CASE WHEN list_has_any(d, ['support', 'supported', 'supports', 'capable']) THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i){'|'.join(C.NEGATIVE_SUPPORT).replace(chr(39), chr(39) * 2)}') THEN 0.25 ELSE 0 END ELSE 0 END, 6) AS score FROM n""")
def support_score(spark, d, rows=None):
    score = X.support_score(F.array_distinct(X.tokens(F.col("q"))), X.tokens(F.col("t")), F.col("t"))
    return given(spark, EVIDENCE, rows).select("k", F.round(score, 6).alias("score"))


KINDS = literal("k long, q string, t string, d string", (1, "tune latency", "x", "tuning guide"), (2, "tune latency", "x", "solution brief"), (3, "gcc guide", "gcc guide", "tutorial"), (4, "llvm guide", "x", "tuning guide"), (5, "deploy steps", "x", "reference architecture"), (6, "deploy", "x", "brief"), (7, "how to install", "x", "install guide"), (8, "words", "x", "tutorial"))


@query(f"""WITH m AS (SELECT k, {tok_sql('q')} AS q, {tok_sql('t')} AS t, d FROM {KINDS[1]}), f AS (SELECT *, list_has_any(q, {stop_list(C.COMPILER)}) AND list_contains(q, 'guide') AS guide, list_has_any(t, {stop_list(C.COMPILER)}) AS named FROM m)
    SELECT k, round((CASE WHEN NOT list_has_any(q, {stop_list(C.TUNING)}) OR guide THEN 0 WHEN d = 'tuning guide' THEN 0.30 WHEN contains(d, 'brief') THEN -0.12 ELSE 0 END
        + CASE WHEN NOT guide THEN 0 WHEN d = 'tutorial' AND named AND list_contains(t, 'guide') THEN 0.35 WHEN d = 'tuning guide' AND NOT named THEN -0.12 ELSE 0 END
        + CASE WHEN NOT list_has_any(q, {stop_list(C.REFERENCE_ARCHITECTURE)}) THEN 0 WHEN d = 'reference architecture' THEN 0.25 WHEN contains(d, 'brief') THEN -0.05 ELSE 0 END
        + CASE WHEN list_has_any(q, {stop_list(C.TUTORIAL)}) AND d IN ('tutorial', 'install guide', 'learning path', 'learning paths') THEN 0.10 ELSE 0 END)::DOUBLE, 6) AS bonus FROM f""")
def doc_type_bonus(spark, d, rows=None):
    bonus = R.doc_type_bonus(X.tokens(F.col("q")), X.tokens(F.col("t")), F.col("d"))
    return given(spark, KINDS, rows).select("k", F.round(bonus, 6).alias("bonus"))


INTENT = {"tuning": C.TUNING, "architecture": C.REFERENCE_ARCHITECTURE, "tutorial": C.TUTORIAL, "support": C.SUPPORT}
ASKED = literal("k long, q string", (1, "how to tune latency"), (2, "deploy reference architecture"), (3, "is sve2 supported"), (4, "plain words"), (5, ""))


@query(f"SELECT k, {', '.join(f'list_has_any({tok_sql(chr(113))}, {stop_list(w)}) AS {n}' for n, w in INTENT.items())} FROM {ASKED[1]}")
def intent_flags(spark, d, rows=None):
    return given(spark, ASKED, rows).select("k", *(F.arrays_overlap(X.tokens(F.col("q")), X.words_in(w)).alias(n) for n, w in INTENT.items()))


@query("SELECT * FROM (VALUES (1, 100, 50, 150, 400), (5, 100, 50, 150, 400), (50, 1000, 400, 1200, 1000), (7, 140, 70, 210, 400)) AS t(k, candidates, over_fetch, prepass, lexical)")
def depth_policy(spark, d):
    return spark.createDataFrame([tuple(R.depths(k).values()) for k in (1, 5, 50, 7)], "k int, candidates int, over_fetch int, prepass int, lexical int")


def hybrid_sql(limit: float) -> str:
    """The three lists, their fusion and the reranking, step by step."""
    hits = lambda q, d: f"len(list_intersect({q}, w_{d}))"
    widened = lambda d: f"{d} || CASE WHEN len(list_filter({d}, lambda y: regexp_full_match(y, 'sme[0-9]+'))) > 0 THEN ['sme'] ELSE [] END || CASE WHEN len(list_filter({d}, lambda y: regexp_full_match(y, 'sve[0-9]+'))) > 0 THEN ['sve'] ELSE [] END AS w_{d}"
    share = lambda q, d: f"(CASE WHEN len({q}) > 0 THEN {hits(q, d)}::DOUBLE / len({q}) ELSE 0 END)"
    exact = lambda d: f"(len(list_intersect(q, {d}))::DOUBLE / len(q))"
    grams = lambda t, n: f"[array_to_string({t}[i:i+{n - 1}], ' ') for i in range(1, len({t}) - {n - 2})]"
    held = lambda g, t: f"len(list_filter({g}, lambda g: contains({t}, g)))::DOUBLE"
    any_of = lambda a, words: f"list_has_any({a}, {stop_list(words)})"
    both = lambda d, words, v: f"CASE WHEN {any_of('q', words)} AND {any_of(d, words)} THEN {v}::DOUBLE ELSE 0 END"
    denies = f"(?i){'|'.join(C.NEGATIVE_SUPPORT)}".replace("'", "''")
    evidence = lambda d, text: (
        f"(CASE WHEN {any_of('q', C.SUPPORT)} AND {hits('cap', d)} > 0 AND {any_of(d, C.SUPPORT)} THEN 0.12::DOUBLE * {hits('cap', d)} + {both(d, ['device', 'devices'], 0.20)} + {both(d, ['server', 'servers'], 0.10)}"
        f" + CASE WHEN {any_of(d, ['support', 'supported', 'supports', 'capable'])} THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN regexp_matches({text}, '{denies}') THEN 0.25::DOUBLE ELSE 0 END ELSE 0 END)"
    )
    split = f"flatten(list_transform({tok_sql('urls')}, lambda t: CASE WHEN regexp_matches(t, '[_\\-+.]') THEN list_concat([t], list_filter(string_split_regex(t, '[_\\-+.]+'), lambda x: x <> '')) ELSE [t] END))"
    guide = f"({any_of('q', C.COMPILER)} AND list_contains(q, 'guide'))"
    bonus = f"""(CASE WHEN NOT {any_of('q', C.TUNING)} OR {guide} THEN 0 WHEN kind = 'tuning guide' THEN 0.30 WHEN contains(kind, 'brief') THEN -0.12 ELSE 0 END::DOUBLE
        + CASE WHEN NOT {guide} THEN 0 WHEN kind = 'tutorial' AND {any_of('tu', C.COMPILER)} AND list_contains(tu, 'guide') THEN 0.35 WHEN kind = 'tuning guide' AND NOT {any_of('tu', C.COMPILER)} THEN -0.12 ELSE 0 END::DOUBLE
        + CASE WHEN NOT {any_of('q', C.REFERENCE_ARCHITECTURE)} THEN 0 WHEN kind = 'reference architecture' THEN 0.25 WHEN contains(kind, 'brief') THEN -0.05 ELSE 0 END::DOUBLE
        + CASE WHEN {any_of('q', C.TUTORIAL)} AND kind IN ('tutorial', 'install guide', 'learning path', 'learning paths') THEN 0.10 ELSE 0 END::DOUBLE)"""
    phrase = f"least(0.40::DOUBLE, 0.10::DOUBLE * {held('p2', 'title_words')} + 0.16::DOUBLE * {held('p3', 'title_words')})"
    match = f"(0.35::DOUBLE * o_tu + 0.15::DOUBLE * o_li + {phrase} + CASE WHEN o_tu >= 0.75 THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN len(asked) <= 3 AND o_tu >= 0.60 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN list_contains(q, 'guide') AND list_contains(tu, 'guide') THEN 0.12::DOUBLE ELSE 0 END)"
    shallow = "(CASE WHEN len(direct) > 0 AND o_tu = 0 AND o_he < 0.5 AND len(list_intersect(list_filter(q, lambda x: NOT list_contains(direct, x)), ti || he)) >= 2 THEN 0.12::DOUBLE ELSE 0 END)"
    dense = "coalesce(greatest(0.0::DOUBLE, (1.1::DOUBLE - distance) / 1.1::DOUBLE), 0)"
    sparse = "least(1.0::DOUBLE, coalesce(bm25, 0) / 10.0::DOUBLE)"
    pre = "(least(1.0::DOUBLE, coalesce(prepass, 0) / 2.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + prepass_rank), 0))"
    provider = f"CASE WHEN {any_of('q', C.PROVIDER)} AND kind = '{C.PROVIDER_TYPE}' THEN 0.18::DOUBLE ELSE 0 END"
    return f"""{CTE}, {DENSE.replace('1.3', str(limit))},
    qa AS (SELECT item_id AS query_id, {tok_sql('text')} AS sq, {salient_sql('text')} AS st, {salient_sql('text', C.DIRECT_STOPWORDS)} AS dt FROM benchmark),
    qb AS (SELECT *, list_distinct(sq) AS q, list_distinct(st) AS salient, list_distinct(dt) AS direct, list_filter(list_distinct(sq), lambda x: regexp_full_match(x, '(sme|sve)[0-9]*')) AS cap FROM qa),
    qc AS (SELECT *, CASE WHEN len(direct) > 0 THEN direct WHEN len(salient) > 0 THEN salient ELSE q END AS asked, CASE WHEN len(salient) > 0 THEN salient ELSE q END AS pre_asked FROM qb),
    qd AS (SELECT *, CASE WHEN len(dt) > 0 THEN dt ELSE list_sort(asked) END AS pt FROM qc),
    qx AS (SELECT *, {grams('st', 2)} AS s2, {grams('st', 3)} AS s3, {grams('pt', 2)} AS p2, {grams('pt', 3)} AS p3 FROM qd),
    da AS (SELECT doc_id AS ordinal, coalesce(source, '') AS title, coalesce(lang, '') AS heading, 'https://docs.example.org/' || source || '/' || (doc_id % 97) AS url, coalesce(text, '') AS body, ['tutorial', 'tuning guide', 'brief', 'reference architecture'][doc_id % 4 + 1] AS kind FROM documents WHERE doc_id IN (SELECT ordinal FROM tp UNION SELECT ordinal FROM dn)),
    db AS (SELECT *, concat_ws(' ', nullif(url, ''), nullif(url, '')) AS urls FROM da),
    dd AS (SELECT *, list_distinct({tok_sql('title')}) AS ti, list_distinct({tok_sql('heading')}) AS he, list_distinct({tok_sql('urls')}) AS ur, list_distinct({tok_sql("concat_ws(' ', nullif(heading, ''), 'Documentation', kind)")}) AS ta, list_distinct({tok_sql('body')}) AS bo, list_distinct({split}) AS li, concat_ws(' ', title, heading, urls, heading, body) AS pre_whole, concat_ws(' ', body, title, heading, urls) AS whole, lower(concat_ws(' ', title, urls)) AS title_words FROM db),
    de AS (SELECT *, list_distinct(list_concat(ti, li)) AS tu, list_distinct(ti || he || ur || bo) AS pt_all, list_distinct(bo || ti || li || he) AS wt_all, lower(pre_whole) AS pre_lower FROM dd),
    dx AS (SELECT *, {', '.join(map(widened, ('ti', 'he', 'ur', 'ta', 'bo', 'li', 'tu', 'pt_all', 'wt_all')))} FROM de),
    pa AS (SELECT tp.query_id, tp.ordinal, tp.score, tp.rank AS br, round(least(1.0::DOUBLE, tp.score / 25.0::DOUBLE) + (0.45::DOUBLE * {share('pre_asked', 'ti')} + 0.50::DOUBLE * {share('pre_asked', 'he')} + 0.35::DOUBLE * {share('pre_asked', 'ur')} + 0.25::DOUBLE * {share('pre_asked', 'ta')} + 0.20::DOUBLE * {share('pre_asked', 'bo')})
        + (0.08::DOUBLE * {held('s2', 'pre_lower')} + 0.12::DOUBLE * {held('s3', 'pre_lower')}) + {evidence('pt_all', 'pre_whole')}, 6) AS prepass FROM tp JOIN dx USING (ordinal) JOIN qx USING (query_id) WHERE len(q) > 0),
    pr AS (SELECT query_id, ordinal, prepass, score AS bm25, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY prepass DESC, br) AS INTEGER) AS rank FROM pa WHERE prepass > 0) WHERE rank <= 150),
    li AS (SELECT query_id, ordinal, 0 AS part, rank, prepass, NULL::DOUBLE AS distance, bm25 FROM pr UNION ALL SELECT query_id, ordinal, 1, rank, NULL, distance, NULL FROM dn UNION ALL SELECT query_id, ordinal, 2, rank, NULL, NULL, score FROM tp WHERE rank <= 100),
    fu AS (SELECT query_id, ordinal, sum(1.0::DOUBLE / (60 + rank)) AS rrf, max(prepass) AS prepass, min(CASE WHEN part = 0 THEN rank END) AS prepass_rank, max(distance) AS distance, max(bm25) AS bm25, min(part * 100000 + rank) AS ord FROM li GROUP BY ALL),
    ra AS (SELECT *, {share('asked', 'bo')} AS o_bo, {share('asked', 'ti')} AS o_ti, {share('asked', 'he')} AS o_he, {share('asked', 'li')} AS o_li, {share('asked', 'tu')} AS o_tu, {share('salient', 'tu')} AS entity FROM fu JOIN dx USING (ordinal) JOIN qx USING (query_id)),
    rr AS (SELECT *, round(CASE WHEN len(q) = 0 THEN rrf WHEN len(asked) <= 3
        THEN rrf + 0.16::DOUBLE * o_bo + 0.16::DOUBLE * o_ti + 0.08::DOUBLE * o_he + 0.12::DOUBLE * entity + 0.15::DOUBLE * {dense} + 0.12::DOUBLE * {sparse} + 0.25::DOUBLE * {pre} + {match} + {evidence('wt_all', 'whole')} + {provider} + {bonus} - {shallow}
        ELSE rrf + 0.35::DOUBLE * {exact('bo')} + 0.20::DOUBLE * {exact('ti')} + 0.15::DOUBLE * {exact('he')} + 0.20::DOUBLE * entity + 0.15::DOUBLE * {dense} + 0.15::DOUBLE * {sparse} + 0.35::DOUBLE * {pre} + {evidence('wt_all', 'whole')} + {provider} + CASE WHEN list_has_any(salient, tu) THEN 0.18::DOUBLE ELSE 0 END + {bonus} END, 6) AS rerank FROM ra)"""


HYBRID, FLAGSHIP = hybrid_sql(1.3), hybrid_sql(C.DISTANCE_LIMIT)


def candidate_lists(spark, d):
    depth = R.depths(C.K)
    return R.candidates(asked(spark, d), corpus(spark, d), vectors(spark, d), depth["lexical"], depth["prepass"], depth["candidates"], 1.3)


@query(f"WITH {HYBRID} SELECT query_id, ordinal, prepass, rank FROM pr")
def lexical_prepass(spark, d):
    counted = R.counted(asked(spark, d), corpus(spark, d), materialize)
    top = R.bm25_topk(R.bm25(asked(spark, d), *counted, C.PREPASS_DEPTH), C.PREPASS_DEPTH)
    return R.lexical_prepass(asked(spark, d), corpus(spark, d), materialize(top, "bm25"), 150, counted[0]).drop("bm25")


@query(f"WITH {HYBRID} SELECT query_id, ordinal, round(rrf, 9) AS rrf FROM fu")
def rrf_fusion(spark, d):
    return candidate_lists(spark, d).select("query_id", "ordinal", F.round("rrf", 9).alias("rrf"))


@query(f"WITH {HYBRID} SELECT query_id, ordinal, round(rrf, 9) AS rrf, rerank FROM rr")
def rerank(spark, d):
    return R.rerank(asked(spark, d), corpus(spark, d), candidate_lists(spark, d)).select("query_id", "ordinal", F.round("rrf", 9).alias("rrf"), "rerank")


@query(f"WITH {CTE}, u AS (SELECT tp.*, source || '/' || (doc_id % 97) AS url FROM tp JOIN documents ON ordinal = doc_id WHERE rank <= 50) SELECT query_id, ordinal, url FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY score DESC, rank) AS nth FROM u) WHERE nth <= 1")
def url_dedup(spark, d):
    top = R.bm25_topk(scores(spark, d, 50), 50)
    urls = table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.concat("source", F.lit("/"), F.col("doc_id") % 97).alias("url"))
    rows = top.join(urls, "ordinal").withColumnsRenamed({"score": "rerank", "rank": "ord"})
    return R.dedup_urls(rows).select("query_id", "ordinal", "url")


FOUND = """be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, ord) AS r FROM rr) WHERE r <= 50),
    un AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY rerank DESC, ord) AS nth FROM be WHERE url <> '') WHERE nth = 1),
    fi AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, ord) AS INTEGER) AS rank FROM un) WHERE rank <= 5)"""


@query(f"WITH {FLAGSHIP}, {FOUND} SELECT query_id, rank, url || '?utm_source=kb' AS url, body AS snippet, title, heading, kind AS doc_type, 'Documentation' AS product, distance, rerank AS score, 'Check the source before use.' AS disclaimer FROM fi")
def search_flagship(spark, d):
    out = R.search(asked(spark, d), corpus(spark, d), vectors(spark, d))
    note = F.when(U.in_domain(F.col("url"), "example.org"), "Check the source before use.")
    return out.select("query_id", "rank", U.tag_utm(F.col("url"), "kb").alias("url"), F.col("search_text").alias("snippet"), "title", "heading", "doc_type", "product", "distance", F.col("rerank").alias("score"), note.alias("disclaimer"))


EXPECTED = "ex AS (SELECT item_id AS query_id, doc_id AS ordinal FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def cases(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return R.eval_cases(R.bm25_topk(scores(spark, d, 5), 5), R.documents_with(corpus(spark, d), b))


@query(f"WITH {CTE}, {EXPECTED}, hit AS (SELECT query_id, min(rank) AS r FROM tp JOIN ex USING (query_id, ordinal) WHERE rank <= 5 GROUP BY query_id) SELECT e.query_id, hit.r AS first_rank FROM (SELECT DISTINCT query_id FROM ex) e LEFT JOIN hit USING (query_id)")
def eval_cases(spark, d):
    return cases(spark, d)


@query(f"WITH {CTE}, {EXPECTED}, hit AS (SELECT query_id, min(rank) AS r FROM tp JOIN ex USING (query_id, ordinal) WHERE rank <= 5 GROUP BY query_id), c AS (SELECT e.query_id, r FROM (SELECT DISTINCT query_id FROM ex) e LEFT JOIN hit USING (query_id)) SELECT CAST(count(*) AS BIGINT) AS total, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_at_3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM c")
def eval_metrics(spark, d):
    return R.eval_metrics(cases(spark, d))


# ---- operations


def profile(spark, d):
    e = table(spark, d, "events")
    drill = e.select((F.col("event_id") % 500).alias("call_tree_id"), F.when(F.col("event_id") % 3 == 0, "leaf").otherwise("inner").alias("node_type"), F.col("user_id").alias("symbol_id"), F.col("event_type").alias("measurement_id"), F.col("value").alias("measurement_value"))
    symbols = table(spark, d, "customer").select(F.col("c_custkey").alias("symbol_id"), F.col("c_name").alias("name"))
    measures = e.select(F.col("event_type").alias("measurement_id")).distinct().select("measurement_id", F.concat(F.lit("m-"), "measurement_id").alias("name"), F.lit("count").alias("units"))
    return drill, symbols, measures


PROFILE = "dr AS (SELECT event_id % 500 AS call_tree_id, CASE WHEN event_id % 3 = 0 THEN 'leaf' ELSE 'inner' END AS node_type, user_id AS symbol_id, event_type AS measurement_id, value AS measurement_value FROM events)"


@query(f"WITH {PROFILE}, n AS (SELECT call_tree_id, c_name AS name, node_type, max(CASE WHEN measurement_id = 'click' THEN measurement_value ELSE 0 END) AS s, max(CASE WHEN measurement_id = 'view' THEN measurement_value ELSE 0 END) AS p FROM dr LEFT JOIN customer ON symbol_id = c_custkey GROUP BY ALL), a AS (SELECT coalesce(nullif(name, ''), 'EMPTY_SYMBOLS') AS function_name, node_type, round(sum(s), 6) AS samples, round(sum(p), 6) AS percent FROM n GROUP BY ALL) SELECT * FROM a ORDER BY samples DESC, function_name, node_type LIMIT 10")
def code_hotspots(spark, d):
    return O.code_hotspots(*profile(spark, d), samples="m-click", percent="m-view")


@query(f"WITH {PROFILE} SELECT * FROM dr")
def instruction_mix(spark, d):
    return profile(spark, d)[0]


@query(f"WITH {PROFILE} SELECT 'm-' || measurement_id AS metric, 'count' AS units, measurement_value AS value FROM dr WHERE call_tree_id = 0")
def cpu_microarchitecture(spark, d):
    drill, _, measures = profile(spark, d)
    return O.cpu_metrics(drill, measures)


@query(f"WITH {PROFILE} SELECT * FROM dr")
def memory_access(spark, d):
    """All drilldown rows."""
    return profile(spark, d)[0]


SITE = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id AS pos, url, {SITE} AS site FROM pages), ex AS (SELECT * FROM p WHERE pos % 3 = 0),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pos) AS nth FROM p WHERE pos % 3 <> 0) WHERE nth = 1 AND url NOT IN (SELECT url FROM ex)),
    l AS (SELECT site, max(pos) AS after FROM ex GROUP BY site)
    SELECT url, site, pos AS major, 0::BIGINT AS minor FROM ex UNION ALL SELECT f.url, f.site, coalesce(after, 1099511627776) AS major, pos + 1 AS minor FROM f LEFT JOIN l USING (site)""")
def register_sources(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("pos"), "url", F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("site"))
    return O.register_sources(p.filter("pos % 3 = 0"), p.filter("pos % 3 <> 0"))


@query(r"SELECT source, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS n_words, CAST(count(*) AS BIGINT) AS n_chunks, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY source")
def chunk_stats(spark, d):
    c = table(spark, d, "documents").select("source", F.size(F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0))).cast("long").alias("n_words"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"))
    return O.chunk_stats(c)


@query("WITH a AS (SELECT CAST(s_suppkey AS BIGINT) AS name, md5(CAST(s_nationkey AS VARCHAR)) AS x FROM supplier), b AS (SELECT CAST(c_custkey AS BIGINT) AS name, md5(CAST(c_nationkey AS VARCHAR)) AS y FROM customer) SELECT coalesce(a.name, b.name) AS name, CASE WHEN y IS NULL THEN 'missing' WHEN x IS NULL THEN 'unexpected' WHEN x <> y THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b ON a.name = b.name")
def manifest_diff(spark, d):
    listed = lambda t, p, key: table(spark, d, t).select(F.col(f"{p}_{key}").cast("long").alias("name"), F.md5(F.col(f"{p}_nationkey").cast("string").cast("binary")).alias("digest"))
    return O.manifest_diff(listed("supplier", "s", "suppkey"), listed("customer", "c", "custkey"))


ARCHES = literal("k long, m string", (1, "amd64,arm64"), (2, "amd64,amd64,unknown"), (3, ""), (4, "s390x"))


@query(f"WITH a AS (SELECT k, list_filter(string_split(m, ','), lambda x: x <> '') AS a FROM {ARCHES[1]}) SELECT k, CASE WHEN len(a) = 0 THEN 'error' WHEN list_has_all(a, ['amd64', 'arm64']) THEN 'success' ELSE 'warning' END AS status, array_to_string(list_filter(['amd64', 'arm64'], lambda x: NOT list_contains(a, x)), ',') AS missing FROM a")
def arch_check(spark, d):
    found = F.filter(F.split("m", ","), lambda x: x != "")
    status, missing = O.arch_check(found, ["amd64", "arm64"])
    return ARCHES[0](spark).select("k", status.alias("status"), missing.alias("missing"))


PATHS = literal("k long, p string", (1, "src/a.py"), (2, "src/.git/x"), (3, "node_modules/y/z"), (4, "a/b.egg-info/c"), (5, "builder/x"), (6, ""))


@query(f"SELECT k, len(list_filter(string_split(p, '/'), lambda s: list_contains({stop_list(C.EXCLUDED_NAMES)}, s) OR ends_with(s, '.egg-info'))) > 0 AS excluded FROM {PATHS[1]}")
def path_exclusion(spark, d, rows=None):
    return given(spark, PATHS, rows).select("k", O.excluded(F.col("p")).alias("excluded"))


@query("SELECT c.conv_id, c.turn, CAST(length(c.text) AS BIGINT) AS call_chars, CAST(length(r.text) AS BIGINT) AS result_chars FROM conversations c LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant' WHERE c.role = 'user'")
def call_result_pairs(spark, d):
    return O.call_results(table(spark, d, "conversations"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tool_traffic_windows(spark, d):
    return O.traffic(table(spark, d, "events"))


UNIT_SQL = r"list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: CAST(ceil(len(regexp_extract_all(s, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) * 0.85::DOUBLE) AS BIGINT))"


@query(f"""WITH RECURSIVE u AS (SELECT doc_id, {UNIT_SQL} AS u FROM documents),
    w AS (SELECT doc_id, 1 AS i, 0::BIGINT AS now, []::BIGINT[] AS done, u FROM u
        UNION ALL SELECT doc_id, i + 1, CASE WHEN now > 0 AND now + u[i] > 600 AND now >= 300 THEN u[i] ELSE now + u[i] END, CASE WHEN now > 0 AND now + u[i] > 600 AND now >= 300 THEN list_append(done, now) ELSE done END, u FROM w WHERE i <= len(u))
    SELECT doc_id, array_to_string(CASE WHEN now > 0 THEN list_append(done, now) ELSE done END, ',') AS sizes FROM w WHERE i = len(u) + 1""")
def chunk_pack(spark, d):
    units = F.transform(X.sentences(F.col("text")), X.estimate_tokens)
    return table(spark, d, "documents").select("doc_id", F.array_join(O.pack(units).cast("array<string>"), ",").alias("sizes"))


# ---- parsing


@query("SELECT page_id, CASE WHEN ends_with(lower(regexp_replace(url, '[?#].*$', '')), '.pdf') THEN 'pdf' WHEN contains(lower(html), '<html') THEN 'html' ELSE 'markdown' END AS format FROM pages")
def format_dispatch(spark, d):
    return table(spark, d, "pages").select("page_id", S.format_of(F.col("html"), F.col("url")).alias("format"))


def parsed(spark, d):
    p = table(spark, d, "pages")
    return S.sections(p.select(F.col("page_id").alias("id"), S.format_of(F.col("html"), F.col("url")).alias("format"), F.col("html").alias("content"), "url"))


@query()
def html_sections(spark, d):
    return parsed(spark, d)


@query()
def markdown_sections(spark, d):
    docs = table(spark, d, "documents")
    return S.sections(docs.select(F.col("doc_id").alias("id"), F.lit("markdown").alias("format"), F.concat(F.lit("# "), "source", F.lit("\n\n"), "text").alias("content")))


@query()
def paged_sections(spark, d):
    """Documents as extracted text with page breaks."""
    docs = table(spark, d, "documents")
    return S.sections(docs.select(F.col("doc_id").alias("id"), F.lit("pdf").alias("format"), F.col("text").alias("content")))


@query()
def document_chunks(spark, d):
    """Sections cut and packed with overlap: one record per chunk, with its place, kind, text and a lasting id."""
    s = parsed(spark, d).select("id", "n", "title", "url", "anchor", "heading_path", F.posexplode(K.chunks(F.col("text"))).alias("chunk", "body"))
    s = s.withColumn("path", K.heading_path(F.col("title"), F.split("heading_path", " > "))).withColumn("content", K.chunk_text(F.col("title"), F.col("path"), F.col("body")))
    kind, none = F.lit("Documentation"), F.lit("")
    heading = F.when(F.size("path") > 0, F.element_at("path", F.greatest(F.size("path"), F.lit(1)))).otherwise(F.col("title"))
    uuid = F.sha2(F.concat_ws("|", "url", "n", "chunk", "content"), 256)
    return s.select("id", "n", "chunk", uuid.alias("uuid"), "title", U.with_fragment(F.col("url"), F.col("anchor")).alias("url"), F.col("url").alias("resolved_url"), heading.alias("heading"), F.array_join("path", " > ").alias("heading_path"), kind.alias("doc_type"), U.product_of(F.col("title"), F.col("url"), kind, none, PRODUCTS).alias("product"), X.version_of(F.concat_ws(" ", "title", "url")).alias("version"), F.lit("html").alias("content_type"), "content", X.estimate_tokens(F.col("body")).alias("n_tokens"))


@query()
def text_chunks(spark, d):
    """Whole documents as single sections, cut and packed with overlap."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(K.chunks(F.col("text"))).alias("chunk", "body"))
    return docs.select("doc_id", "chunk", X.estimate_tokens(F.col("body")).alias("n_tokens"), F.md5(F.col("body").cast("binary")).alias("digest"))


# ---- the queries over literal rows, over whole tables and the literal rows


def whole(f, lit: tuple, sql: str, frame: Callable[[SparkSession, str], DataFrame]) -> None:
    """Register ``f`` over a table's rows and its literal ones as ``<name>_whole``; ``sql`` selects the same rows."""
    source = f"FROM {lit[1]}"
    assert source in ORACLES[f.__name__]
    both = ORACLES[f.__name__].replace(source, f"FROM ({sql} UNION ALL SELECT * {source}) AS t")
    QUERIES[f"{f.__name__}_whole"] = lambda spark, d: f(spark, d, frame(spark, d))
    ORACLES[f"{f.__name__}_whole"] = both


def documents(spark, d):
    return table(spark, d, "documents").select((F.col("doc_id") + 1000).alias("k"), F.col("text").alias("s"))


def lines(spark, d):
    return documents(spark, d).select("k", F.explode(F.split("s", "\n")).alias("s"))


def addresses(column):
    return lambda spark, d: table(spark, d, "pages").select((F.col("page_id") + 1000).alias("k"), F.col("url").alias(column))


def candidates(*columns):
    """The best pairs by BM25, with the texts of query and document and the document's type."""

    def frame(spark, d):
        top = materialize(R.bm25_topk(scores(spark, d, 5), 5).select("query_id", "ordinal"), "best")
        top = F.broadcast(top) if R.few(top) else top  # else all texts are shuffled
        c = corpus(spark, d).select("ordinal", F.col("search_text").alias("t"), F.col("doc_type").alias("d"))
        q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
        return c.join(top, "ordinal").join(q, "query_id").select((F.col("query_id") * (1 << 40) + F.col("ordinal") + 1000).cast("long").alias("k"), *columns)

    return frame


KIND_SQL = "['tutorial', 'tuning guide', 'brief', 'reference architecture'][doc_id % 4 + 1] AS d"
PAIR_SQL = f"SELECT * FROM (WITH {CTE} SELECT CAST(query_id * 1099511627776 + ordinal + 1000 AS BIGINT) AS k, b.text AS q, coalesce(x.text, '') AS t{{more}} FROM tp JOIN documents x ON ordinal = doc_id JOIN benchmark b ON query_id = item_id WHERE rank <= 5)"
TEXT_SQL = "SELECT doc_id + 1000 AS k, text AS s FROM documents"

for f, lit in ((clean_text, RAW), (strip_frontmatter, FRONT), (redact_secrets, SECRETS), (negative_support, SUPPORT)):
    whole(f, lit, TEXT_SQL, documents)
whole(heading_like, HEADS, "SELECT doc_id + 1000 AS k, unnest(string_split(text, chr(10))) AS s FROM documents", lines)
whole(parse_keywords, KEYS, "SELECT doc_id + 1000 AS k, text AS s, source AS title FROM documents", lambda spark, d: table(spark, d, "documents").select((F.col("doc_id") + 1000).alias("k"), F.col("text").alias("s"), F.col("source").alias("title")))
for f in (normalize_url, fetch_url):
    whole(f, ADDRESSES, "SELECT page_id + 1000 AS k, url AS u FROM pages", addresses("u"))
whole(path_exclusion, PATHS, "SELECT page_id + 1000 AS k, url AS p FROM pages", addresses("p"))
whole(intent_flags, ASKED, "SELECT item_id + 1000 AS k, text AS q FROM benchmark", lambda spark, d: table(spark, d, "benchmark").select((F.col("item_id") + 1000).alias("k"), F.col("text").alias("q")))
for f, lit in ((token_match, MATCH), (phrase_bonus, PHRASES), (support_score, EVIDENCE)):
    whole(f, lit, PAIR_SQL.format(more=""), candidates("q", "t"))
whole(doc_type_bonus, KINDS, PAIR_SQL.format(more=", " + KIND_SQL), candidates("q", "t", "d"))


@query(f"WITH {PROFILE} SELECT * FROM dr")
def memory_access_whole(spark, d):
    """All drilldown rows."""
    return profile(spark, d)[0]
