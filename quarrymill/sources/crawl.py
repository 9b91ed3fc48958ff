"""A crawl over a snapshot of pages: breadth first, level by level, by rules of links.

Pages are parsed once to their elements with an address, an id or a tag of their
own making. Each level is a table in the shared folder: the addresses that the
level before links to by its rule and that no level has yet (an anti-join), each
with the smallest linking page as its parent. The crawl ends with a level that is
empty, so cycles end it too. Nothing reaches the driver but a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.sources.sections import VOID, clean, resolve
from quarrymill.storage import new_path

ELEMENT = "url string, n int, tag string, id string, classes array<string>, address string, text string"


class Elements(HTMLParser):
    """Elements in order: tag, id, classes, address (``href``, or the ``link`` of a card), and the span of text pieces within."""

    def __init__(self):
        super().__init__()
        self.pieces: list[str] = []
        self.found: list[list] = []
        self.open: list[tuple[str, int | None]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a":  # an anchor holds no other
            self.close_to("a")
        address, place = a.get("href") if tag == "a" else a.get("link"), None
        if address is not None or a.get("id") or "-" in tag:
            place = len(self.found)
            self.found.append([tag, a.get("id"), (a.get("class") or "").split(), address, len(self.pieces), len(self.pieces)])
        if tag not in VOID:
            self.open.append((tag, place))

    def close_to(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while True:
                name, place = self.open.pop()
                if place is not None:
                    self.found[place][5] = len(self.pieces)
                if name == tag:
                    return

    def handle_endtag(self, tag):
        self.close_to(tag)

    def handle_data(self, data):
        if data.strip() and not any(t in ("script", "style") for t, _ in self.open[-1:]):
            self.pieces.append(data)

    def rows(self, url: str) -> Iterator[tuple]:
        while self.open:
            self.close_to(self.open[-1][0])
        for n, (tag, own, classes, address, a, b) in enumerate(self.found):
            yield url, n, tag, own, classes, resolve(url, address) if address is not None else None, clean(" ".join(p.strip() for p in self.pieces[a:b]))


def page_key(u: Column) -> Column:
    """A page's address: no fragment."""
    return F.regexp_replace(u, "#.*$", "")


def elements(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(url, html)`` to the pages' elements, in order; addresses are absolute (RFC 3986), those of mail and scripts null.

    The columns of ``keep`` follow. Null and empty pages have no elements.
    """
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
    names, keep = [c.split()[0] for c in ELEMENT.split(", ")], keep or []
    base = pages.select("url", "html", *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows, of = [], []
                for k, (url, html) in enumerate(zip(*(b.column(k).slice(at, 200).to_pylist() for k in range(2)), strict=True)):
                    p = Elements()
                    p.feed(html or "")
                    p.close()
                    rows += p.rows(url or "")
                    of += [at + k] * (len(rows) - len(of))
                own = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*own, *(c.take(pa.array(of, pa.int64())) for c in b.columns[2:])], [*names, *(f"k{i}" for i in range(len(keep)))])

    fields = [*T.StructType.fromDDL(ELEMENT).fields, *base.schema.fields[2:]]
    out = base.mapInArrow(run, T.StructType(fields))
    return out.select(*names, *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)))


def has_class(name: str) -> Column:
    return F.array_contains("classes", name)


def crawl(pages: DataFrame, seeds: DataFrame, rules: list[Column], most_levels: int | None = None) -> DataFrame:
    """``url, level, parent, found``: every address that ``seeds (url)`` lead to, once, on its first level.

    ``pages`` are ``(url, html)``. Of a page on level n the elements that satisfy ``rules[n]`` (the last rule from there
    on) are followed. ``found`` tells whether the snapshot has the page; others lead nowhere. Fragments are ignored, of
    pages that differ in nothing else the smallest content is taken. ``most_levels`` bounds the levels; without it the
    crawl goes on while it finds something.
    """
    spark = pages.sparkSession
    snapshot = pages.filter("url is not null").groupBy(page_key(F.col("url")).alias("url")).agg(F.min("html").alias("html"))
    path = new_path(spark, "crawl")
    snapshot.write.parquet(f"{path}/pages")
    snapshot = spark.read.schema("url string, html string").parquet(f"{path}/pages")
    elements(snapshot).filter("address is not null").withColumn("address", page_key(F.col("address"))).distinct().write.parquet(f"{path}/elements")
    links, known = spark.read.schema(ELEMENT).parquet(f"{path}/elements"), snapshot.select("url").withColumn("found", F.lit(True))

    def keep(frontier: DataFrame, level: int) -> DataFrame:
        """A level's table: what is left of a frontier ``(url, parent)``."""
        rows = frontier.join(known, "url", "left").select("url", "parent", F.coalesce("found", F.lit(False)).alias("found"))
        rows.write.parquet(f"{path}/levels/level={level}")
        return spark.read.schema("url string, parent string, found boolean").parquet(f"{path}/levels/level={level}")

    met = lambda: spark.read.schema("url string, parent string, found boolean, level int").parquet(f"{path}/levels")
    level = 0
    last = keep(seeds.filter("url is not null").select(page_key(F.col("url")).alias("url"), F.lit(None).cast("string").alias("parent")).distinct(), 0)
    while last.limit(1).count() and (most_levels is None or level < most_levels):
        rule = rules[min(level, len(rules) - 1)]
        near = links.filter(rule).select(F.col("url").alias("parent"), F.col("address").alias("url"))
        near = near.join(last.filter("found").select(F.col("url").alias("parent")), "parent", "left_semi")
        new = near.groupBy("url").agg(F.min("parent").alias("parent")).join(met().select("url"), "url", "left_anti")
        level += 1
        last = keep(new, level)
    return met().select("url", "level", "parent", "found")
