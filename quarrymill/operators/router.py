"""From registered sources to chunk records and rejects: each source goes to its route, nothing goes silently.

A source is a transcript (it names one), a dashboard entry, a topic tree of the
documentation service, or a page with its steps. A route asks a snapshot for what
it reads; what the snapshot lacks, what isn't what the route expects, and what has
no text to chunk gives a row with a reason. Documents of all routes are parsed in
one pass over Arrow batches; chunking is native.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.functions import urls as U
from quarrymill.operators import chunking as K
from quarrymill.sources import sections as S
from quarrymill.sources.crawl import elements, page_key
from quarrymill.storage import materialize

TRANSCRIPT, DASHBOARD, TOPICS, PAGE = "transcript", "dashboard", "topics", "page"


@dataclass
class Routes:
    """What a caller knows of the sources: hosts, kinds and products.

    ``steps`` is a pattern of the addresses whose pages lead to steps below them.
    """

    docs_host: str
    service: str
    steps: str
    dashboard: str = "Ecosystem Dashboard"
    products: list = field(default_factory=list)

    def of(self, url: Column, doc_type: Column, transcript: Column) -> Column:
        topics = U.in_domain(url, self.docs_host) & F.coalesce(F.get(U.path_parts(url), F.lit(0)) == "documentation", F.lit(False))
        return F.when(F.trim(F.coalesce(transcript, F.lit(""))) != "", TRANSCRIPT).when(doc_type == self.dashboard, DASHBOARD).when(topics, TOPICS).otherwise(PAGE)


def topic_links(roots: DataFrame) -> DataFrame:
    """``(id, content)`` of topic documents to ``id, part, address``: the topics' own links in pre-order, at any depth.

    Documents that are no JSON objects give a row without an address.
    """

    def walk(topic: object, out: list[str]) -> None:
        todo = [iter(topic.get("topics") or [])] if isinstance(topic, dict) else []
        while todo:  # a stack, not recursion: trees may be deep
            child = next(todo[-1], None)
            if child is None:
                todo.pop()
            elif isinstance(child, dict):
                own = (child.get("_links") or {}).get("self") or []
                if own and own[0].get("href"):
                    out.append(own[0]["href"])
                todo.append(iter(child.get("topics") or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    data = json.loads(content or "")
                    links: list[str] = []
                    walk(data.get("topic"), links)
                    rows += [(i, n, x) for n, x in enumerate(links)]
                except (ValueError, AttributeError, TypeError, KeyError):
                    rows.append((i, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))], ["id", "part", "address"])

    return roots.select("id", "content").mapInArrow(run, "id long, part int, address string")


def step_links(pages: DataFrame) -> DataFrame:
    """``(id, url, content)`` of pages to ``id, part, address``: links below a page's address, each once, in order, with one closing slash."""
    bare = lambda c: F.concat(U.base(F.col(c)), F.lit("/"))
    asked = pages.select(F.col("id").alias("source"), "url", F.col("content").alias("html"), bare("url").alias("base"))
    links = elements(asked, keep=["source", "base"]).filter("tag = 'a' AND address RLIKE '^https?:'").select("source", "base", "n", bare("address").alias("address"))
    below = links.filter(F.col("address").startswith(F.col("base")) & (F.col("address") != F.col("base")))
    return below.groupBy("source", "address").agg(F.min("n").alias("part")).select(F.col("source").alias("id"), "part", "address")


def same_page(c: Column) -> Column:
    """What two addresses of one page share: no fragment, no closing slash."""
    return F.regexp_replace(page_key(c), "/+$", "")


DOCUMENT = ["route", "part", "shown", "resolved", "doc_type", "words", "label", "content_type"]


def route(sources: DataFrame, snapshot: DataFrame, entries: DataFrame, routes: Routes) -> tuple[DataFrame, DataFrame]:
    """Chunk records and rejects ``(id, route, part, address, reason)`` of all sources.

    ``sources`` are ``(id, url, name, doc_type, keywords, transcript_url)``, each id once; ``snapshot`` is ``(url,
    content, content_type)``, each page once; ``entries`` are dashboard entries ``(slug, display_name, keywords, url,
    content)``. Null and blank cells count as empty.
    """
    none, cell = F.lit(None).cast("string"), lambda c: F.coalesce(F.col(c), F.lit(""))
    s = sources.select("id", U.normalize(F.col("url")).alias("url"), cell("name").alias("name"), cell("doc_type").alias("doc_type"), cell("keywords").alias("keywords"), U.normalize(F.col("transcript_url")).alias("transcript"))
    s = s.withColumn("route", routes.of(F.col("url"), F.col("doc_type"), F.col("transcript"))).withColumn("words", X.keyword_list(F.col("keywords"), F.col("name")))
    kept = snapshot.select(same_page(F.col("url")).alias("page"), "content", "content_type")
    fetch = F.when(F.col("route") == TRANSCRIPT, U.fetchable(F.col("transcript"))).when(F.col("route") == TOPICS, U.service_url(F.col("url"), routes.service)).otherwise(U.fetchable(F.col("url")))
    asked = s.filter(F.col("route") != DASHBOARD).withColumn("fetch", fetch)
    got = materialize(asked.join(kept, same_page(F.col("fetch")) == F.col("page"), "left").drop("page"), "fetched")
    reject = lambda df, reason, address, part=None: df.select("id", "route", (F.lit(None) if part is None else F.col(part)).cast("int").alias("part"), F.col(address).alias("address"), F.lit(reason).alias("reason"))
    rejects, held = [reject(got.filter("content IS NULL"), "not in the snapshot", "fetch")], got.filter("content IS NOT NULL")

    # Topic trees: the root names the topics, their titles and keywords come from it.
    root = F.from_json("content", "title string, keywords array<string>, products array<string>, versionLabel string")
    roots = held.filter(F.col("route") == TOPICS).withColumn("root", root)
    more = F.filter(F.concat(F.coalesce("root.keywords", F.array().cast("array<string>")), F.coalesce("root.products", F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")
    roots = roots.withColumn("words", F.array_distinct(F.concat("words", more))).withColumn("name", F.coalesce(F.nullif("root.title", F.lit("")), "name")).withColumn("label", F.nullif("root.versionLabel", F.lit("")))
    links = materialize(topic_links(roots), "topics")
    known = roots.select("id", "route", "url", "fetch", "name", "doc_type", "words", "label")
    listed = known.join(links, "id", "left")
    topics = listed.filter("part IS NOT NULL OR address IS NOT NULL").unionByName(listed.filter("part IS NULL AND address IS NULL").join(links.filter("address IS NULL").select("id"), "id", "left_anti").withColumns({"part": F.lit(0), "address": F.col("fetch")}))
    rejects.append(reject(known.join(links.filter("address IS NULL").select("id"), "id", "left_semi"), "no topic document", "fetch"))

    # Steps: pages that a page of a path links to below its own address.
    paths = held.filter((F.col("route") == PAGE) & F.col("url").rlike(routes.steps))
    steps = step_links(paths).join(paths.select("id", "route", "url", "name", "doc_type", "words", none.alias("label")), "id").withColumn("part", F.col("part") + 1)

    second = topics.select("id", "route", "part", "address", "url", "name", "doc_type", "words", "label").unionByName(steps.select("id", "route", "part", "address", "url", "name", "doc_type", "words", "label"))
    second = materialize(second.join(kept, same_page(F.col("address")) == F.col("page"), "left").drop("page"), "fetched-parts")
    rejects.append(reject(second.filter("content IS NULL"), "not in the snapshot", "address", "part"))

    # One table of documents for all routes.
    topic = F.col("route") == TOPICS
    first = held.filter(~topic).select("id", F.lit(0).alias("part"), "route", "content", "content_type", F.col("fetch").alias("resolved"), "url", "name", F.when((F.col("route") == TRANSCRIPT) & (F.col("doc_type") == ""), "Transcript").otherwise(F.col("doc_type")).alias("doc_type"), "words", none.alias("label"))
    parts = second.filter("content IS NOT NULL").select("id", "part", "route", "content", "content_type", F.col("address").alias("resolved"), F.when(topic, U.shown_url(F.col("address"), F.col("url"), routes.docs_host)).otherwise(F.col("address")).alias("url"), "name", "doc_type", "words", "label")
    docs = first.unionByName(parts).withColumn("format", F.when(topic, "topic").otherwise(S.format_of(F.col("content"), F.col("resolved"), F.col("content_type"))))
    docs = docs.withColumns({"content_type": F.when(topic, "html").otherwise(F.col("format")), "doc_type": F.when(F.col("doc_type") == "", "Documentation").otherwise(F.col("doc_type")), "shown": F.col("url")})
    base = F.when(F.col("route") == TRANSCRIPT, F.col("resolved")).otherwise(F.col("url"))
    parsed = materialize(S.sections(docs.select("id", "format", "content", base.alias("url"), F.col("name").alias("title"), *DOCUMENT), keep=DOCUMENT, empty=True), "sections")
    rejects.append(reject(parsed.filter("n IS NULL"), "no parseable content", "resolved", "part"))
    cut = materialize(parsed.filter("n IS NOT NULL").select("id", "n", "title", "anchor", "heading_path", *DOCUMENT, F.posexplode_outer(K.chunks(F.col("text"))).alias("chunk", "body")), "cut")
    cut = cut.withColumn("path", K.heading_path(F.col("title"), F.filter(F.split("heading_path", " > "), lambda x: x != "")))
    heading = F.when(F.size("path") > 0, F.element_at("path", F.greatest(F.size("path"), F.lit(1)))).otherwise(F.col("title"))
    version = F.coalesce("label", X.version_of(F.concat_ws(" ", "title", "resolved")))
    chunks = cut.filter("body IS NOT NULL").select(
        "id", "route", "part", "n", "chunk", "title", U.with_fragment(F.col("shown"), F.col("anchor")).alias("url"), F.col("resolved").alias("resolved_url"), heading.alias("heading"), F.array_join("path", " > ").alias("heading_path"),
        "doc_type", U.product_of(F.col("title"), F.col("shown"), F.col("doc_type"), F.array_join("words", " "), routes.products).alias("product"), version.alias("version"), F.array_join("words", ", ").alias("keywords"), "content_type", K.chunk_text(F.col("title"), F.col("path"), F.col("body")).alias("content"), X.estimate_tokens(F.col("body")).alias("n_tokens"),
    )
    rejects.append(reject(cut.filter("body IS NULL"), "nothing to chunk", "resolved", "part"))

    # Dashboard entries are chunks as they are.
    shown = s.filter(F.col("route") == DASHBOARD).withColumn("slug", U.query_param(F.col("url"), "package"))
    entry = entries.filter("content <> ''").select("slug", "display_name", F.col("content").alias("said"), F.col("url").alias("at"))
    met = materialize(shown.join(entry, "slug", "left"), "entries").withColumn("package", F.regexp_replace("display_name", "^Ecosystem Dashboard - ", ""))
    rejects.append(reject(met.filter("said IS NULL AND slug = ''"), "no package named", "url"))
    rejects.append(reject(met.filter("said IS NULL AND slug <> ''"), "no dashboard entry", "url"))
    package = X.keyword_list(F.col("keywords"), F.col("package"))
    cards = met.filter("said IS NOT NULL").select(
        "id", "route", F.lit(0).alias("part"), F.lit(0).alias("n"), F.lit(0).alias("chunk"), F.col("display_name").alias("title"), "url", F.col("at").alias("resolved_url"), F.col("package").alias("heading"), F.col("package").alias("heading_path"),
        F.lit(routes.dashboard).alias("doc_type"), U.product_of(F.col("display_name"), F.col("url"), F.lit(routes.dashboard), F.array_join(package, " "), routes.products).alias("product"), X.version_of(F.concat_ws(" ", "display_name", "at", F.substring("said", 1, 4000))).alias("version"), F.array_join(package, ", ").alias("keywords"), F.lit("html").alias("content_type"), F.col("said").alias("content"), X.estimate_tokens(F.col("said")).alias("n_tokens"),
    )
    out = chunks.unionByName(cards)
    uuid = F.sha2(F.concat_ws("|", "id", "part", "n", "chunk", "content"), 256)
    lost = rejects[0]
    for r in rejects[1:]:
        lost = lost.unionByName(r)
    return out.withColumn("uuid", uuid), lost


def outcomes(sources: DataFrame, routes: Routes, chunks: DataFrame, rejects: DataFrame) -> DataFrame:
    """A row for each source: its route, its chunks and rejects, and whether it gave any chunk."""
    s = sources.select("id", routes.of(U.normalize(F.col("url")), F.coalesce("doc_type", F.lit("")), F.col("transcript_url")).alias("route"))
    a = chunks.groupBy("id").agg(F.count("*").alias("n_chunks"), F.countDistinct("part").alias("n_documents"))
    b = rejects.groupBy("id").agg(F.count("*").alias("n_rejects"), F.array_join(F.sort_array(F.collect_set("reason")), "; ").alias("reasons"))  # a handful of reasons
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return s.join(a, "id", "left").join(b, "id", "left").select("id", "route", zero("n_documents"), zero("n_chunks"), zero("n_rejects"), F.coalesce("reasons", F.lit("")).alias("reasons"))
