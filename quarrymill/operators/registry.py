"""The source registry, its rules, and what becomes of its rows: all DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions import urls as U

#: The registry's header, in order, and the names of its columns here.
HEADER = {"Site Name": "site_name", "License Type": "license_type", "Display Name": "display_name", "URL": "url", "Keywords": "keywords", "Transcript Source URL": "transcript_url"}


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A registry in CSV: quoted cells of any size, absent columns as "", urls normalised; rows without a url go. Without a file it is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], ", ".join(f"{name} string" for name in HEADER.values()))
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, maxCharsPerColumn=-1)
    cell = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit("")) if name in rows.columns else F.lit("")
    rows = rows.select(*(cell(name).alias(to) for name, to in HEADER.items()))
    return rows.withColumns({"url": U.normalize(F.col("url")), "transcript_url": U.normalize(F.col("transcript_url"))}).filter("url <> ''")


def write_sources(sources: DataFrame, path: str) -> None:
    """Replace a registry, in the order of ``pos``."""
    rows = sources.orderBy("pos").select(*(F.col(to).alias(name) for name, to in HEADER.items()))
    rows.write.csv(path, header=True, quote='"', escape='"', emptyValue="", mode="overwrite")


def fetch_targets(sources: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Each source with the content of its transcript, where it names one, else of its own url; the url shown stays its own."""
    asked = sources.withColumn("fetch_url", F.coalesce(F.nullif(F.trim("transcript_url"), F.lit("")), F.col("url")))
    return asked.join(snapshot.select(F.col("url").alias("fetch_url"), "content"), "fetch_url", "left")


def relevant(kind: Column, title: Column, url: Column, author: Column, rules: dict) -> Column:
    """An editorial filter: by kind, a set of titles, patterns of urls, or authors with beginnings (and a word) of titles."""
    out = F.lit(False)
    for name, rule in rules.items():
        met = F.lit(False)
        if "titles" in rule:
            met = met | title.isin(rule["titles"])
        for pattern in rule.get("urls", []):
            met = met | url.rlike(pattern)
        for authors, begin, word in rule.get("authors", []):
            met = met | (author.isin(authors) & title.startswith(begin) & title.contains(word))
        out = F.when(kind == name, met).otherwise(out)
    return F.coalesce(out & (F.coalesce(url, F.lit("")) != ""), F.lit(False))


def item_keywords(term: Column, keywords: Column, products: Column) -> Column:
    """The search term, the parts of the keywords, and those of the products below their first two levels; each once, in order."""
    parts = F.flatten(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda x: F.split(x, r"\|")))
    below = F.flatten(F.transform(F.coalesce(products, F.array().cast("array<string>")), lambda x: F.slice(F.split(x, r"\|"), 3, F.size(F.split(x, r"\|")))))
    return F.array_distinct(F.concat(F.array(term), parts, below))


def merge_keywords(base: Column, more: Column) -> Column:
    """``base`` and behind it what it lacks of ``more``; blanks go."""
    return F.concat(base, F.array_except(F.filter(F.transform(more, lambda x: F.trim(x)), lambda x: x != ""), base))


def dashboard_entries(pages: DataFrame, url: str) -> DataFrame:
    """Package entries of dashboard pages ``(id, html)``, keyed by slug; of equal slugs the last stays."""
    cut = F.filter(F.split("html", '(?=<tr class="main-sw-row)'), lambda x: x.startswith('<tr class="main-sw-row'))
    row = pages.select("id", F.posexplode(cut).alias("n", "row"))
    pick = lambda pattern, g=1: F.regexp_extract("row", pattern, g)
    said = F.trim(F.regexp_replace(pick(r'(?s)<div class="description">(.*?)</div>'), r"(?:<[^>]+>|\s)+", " "))
    tags = F.transform(F.regexp_extract_all(pick(r'^<tr class="([^"]*)"'), F.lit(r"\S*tag-\S*"), F.lit(0)), lambda t: F.regexp_replace(F.regexp_replace(t, "tag-license-", ""), "tag-category-", ""))
    starts = F.transform(F.regexp_extract_all(pick(r'(?s)<section>(.*?)</section>'), F.lit(r'<li><a href="([^"]+)">([^<]+)</a>'), F.lit(0)), lambda x: F.concat(F.lit("- ["), F.regexp_extract(x, ">([^<]+)</a>", 1), F.lit("]("), F.regexp_extract(x, 'href="([^"]+)"', 1), F.lit(")")))
    name, load = pick('data-title="([^"]*)"'), pick('<a class="download-icon-a" href="([^"]*)"')
    guides = F.when(F.size(starts) > 0, F.concat(F.lit("To get started quickly, here are some helpful guides from different sources:\n"), F.array_join(starts, "\n")))
    content = F.concat_ws("\n\n", F.nullif(said, F.lit("")), F.when(load != "", F.concat(F.lit("[Download "), name, F.lit(" here.]("), load, F.lit(")"))), guides)
    out = row.select("id", "n", name.alias("package"), pick('data-title-urlized="([^"]*)"').alias("slug"), F.array_join(F.concat(F.array(name), tags), ", ").alias("keywords"), content.alias("content")).filter("package <> '' AND slug <> ''")
    last = out.withColumn("nth", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("id"), F.desc("n")))).filter("nth = 1")
    return last.select("slug", F.concat(F.lit("Ecosystem Dashboard - "), "package").alias("display_name"), "keywords", F.concat(F.lit(f"{url}?package="), "slug").alias("url"), "content")


def dashboard_sources(sources: DataFrame, entries: DataFrame) -> DataFrame:
    """Sources that name a package, with its entry; those whose entry is missing or empty go."""
    slug = U.query_param(F.col("url"), "package")
    return sources.select("id", slug.alias("slug")).filter("slug <> ''").join(entries.filter("content <> ''"), "slug")


def intrinsic_texts(intrinsics: DataFrame, operations: DataFrame, flags: dict[str, tuple[str, str]], architecture: str) -> DataFrame:
    """A text for each intrinsic of an architecture, with the first operation of its id; one without its operation raises an error."""
    first = operations.groupBy("op_id").agg(F.min_by("content", "pos").alias("operation"))
    isa = F.col("isa")
    flag, header = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (f, h) in flags.items():
        flag, header = F.when(isa == name, f).otherwise(flag), F.when(isa == name, h).otherwise(header)
    j = intrinsics.filter(F.array_contains("architectures", architecture)).join(first, "op_id", "left")
    described = F.when(F.size(F.split("description", " ")) > 5, F.concat(F.lit(" Here is a brief intrinsic description: "), "description", F.lit("\n\n"))).otherwise("")
    signature = F.concat("return_type", F.lit(" "), "name", F.lit(" ("), F.array_join("arguments", ", "), F.lit(");"))
    missing = F.raise_error(F.concat(F.lit("no operation "), "op_id"))
    how = F.when(F.col("op_id").isNull(), "").when(F.col("operation").isNull(), missing).otherwise(F.concat(F.lit("\nThis is how `"), "name", F.lit("` operates:\n"), "operation"))
    text = F.concat(F.lit("The `"), "name", F.lit("` intrinsic is part of the "), isa, F.lit(" instruction set architecture."), described, F.lit("The signature for this intrinsic function is as follows:\n`"), signature, F.lit("`\n\nCompiler flags: `"), flag, F.lit("`\nHeader: `"), header, F.lit("`"), how)
    return j.select("name", text.alias("content"))
