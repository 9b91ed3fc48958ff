"""A persisted BM25 index, and an exact top-k that reads only the postings that can matter.

The artefacts are tables in one folder: ``stats`` (one row), ``terms`` (df, idf and
the highest impact of any posting), ``postings`` (for each term and span of
documents one block: its documents, counts and lengths, and its highest impact;
clustered by regions of documents, and in the order of terms within one), and
``metadata``. Documents are cut into tokens once; their rows are dealt by region,
so no posting is a row of a shuffle.

A batch is answered in three passes over regions. The blocks' bounds alone tell how high each
span can score for a query. The rarest terms of a query are read first; the spans
of the documents that they favour are scored whole, and the k-th score found there
is the bar. Terms that together cannot reach the bar are optional: no
document that has only them can be among the best, so the others' blocks are read,
in spans that can reach the bar, and optional terms only where a document that is
still possible stands. Scores are complete for all that can be among the first k,
so the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill import config as C
from quarrymill.functions import text as X
from quarrymill.operators import retrieval as R
from quarrymill.storage import materialize

#: Scores are rounded to six places; bounds keep twice that apart.
CLOSE = 2e-6
#: Documents of a region, about: its blocks are built and scored as one group.
REGION = 4096
METADATA = {"title": "", "url": "", "heading": "", "heading_path": "", "doc_type": "", "product": "", "version": "", "keywords": "", "content_type": ""}


def impact(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    """What a posting adds to a score, per unit of weight; in ``bm25``'s order of operations."""
    return tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * dl / avgdl))


def with_defaults(corpus: DataFrame) -> DataFrame:
    """The metadata of each document: absent and null fields are empty, the resolved address is the address itself."""
    cell = lambda c, default: F.coalesce(F.col(c).cast("string"), default) if c in corpus.columns else default
    fields = [cell(c, F.lit(v)).alias(c) for c, v in METADATA.items()]
    return corpus.select("ordinal", *fields, F.coalesce(F.nullif(cell("resolved_url", F.lit("")), F.lit("")), cell("url", F.lit(""))).alias("resolved_url"))


@dataclass
class Index:
    """The artefacts of a folder, as tables."""

    stats: DataFrame
    terms: DataFrame
    postings: DataFrame
    metadata: DataFrame
    span: int


def regions(span: int) -> int:
    """How many ordinals a region has: whole spans, about ``REGION`` documents."""
    return max(1, REGION // span) * span


def write_index(corpus: DataFrame, path: str, span: int = 256, text: str = "search_text") -> None:
    """Write the artefacts of ``(ordinal, search_text, ...)``; ``span`` is how many ordinals share a block."""
    counts = materialize(R.token_counts(corpus, text), "counts")
    R.stats_of(counts).select("n_docs", F.coalesce("avgdl", F.lit(0.0)).alias("avgdl"), F.lit(span).alias("span")).write.parquet(f"{path}/stats")
    stats = corpus.sparkSession.read.parquet(f"{path}/stats")
    avgdl = stats.first()["avgdl"]

    def blocks(docs: pa.Table) -> pa.Table:
        """A region's documents to its blocks: postings in the order of terms, spans and ordinals, cut where term or span changes."""
        docs = docs.combine_chunks()
        terms, tfs = (docs[c].combine_chunks() for c in ("terms", "tfs"))
        sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
        ordinal, dl = (np.repeat(docs[c].to_numpy(), sizes) for c in ("ordinal", "dl"))
        known = pc.dictionary_encode(terms.flatten())
        code = known.indices.to_numpy()
        place = np.empty(len(known.dictionary), np.int64)
        place[pc.sort_indices(known.dictionary).to_numpy()] = np.arange(len(place))
        order = np.lexsort((ordinal, place[code]))
        code, ordinal, dl, tf = code[order], ordinal[order], dl[order], tfs.flatten().to_numpy()[order]
        part = ordinal // span
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])]) if len(code) else np.zeros(0, np.int64)
        ends = np.r_[first, len(code)]
        held = pa.StructArray.from_arrays([pa.array(ordinal, pa.int64()), pa.array(tf, pa.int32()), pa.array(dl, pa.int32())], ["ordinal", "tf", "dl"])
        top = np.maximum.reduceat(impact(tf, dl, avgdl), first) if len(first) else np.zeros(0)
        term = known.dictionary.take(pa.array(code[first])).cast(pa.string())
        return pa.table({"term": term, "span": pa.array(part[first], pa.int64()), "held": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held), "top": pa.array(top, pa.float64()), "n": pa.array(np.diff(ends), pa.int64())})

    region = F.floor(F.col("ordinal") / regions(span)).alias("region")
    cut = counts.select(region, F.col("ordinal").cast("long"), "dl", "terms", "tfs").groupBy("region")
    cut.applyInArrow(blocks, "term string, span long, held array<struct<ordinal:long,tf:int,dl:int>>, top double, n long").write.parquet(f"{path}/postings")
    blocks_ = corpus.sparkSession.read.parquet(f"{path}/postings").groupBy("term").agg(F.max("top").alias("top"))
    R.idf(R.postings_of(counts), stats).join(blocks_, "term").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    with_defaults(corpus).write.parquet(f"{path}/metadata")


def read_index(spark: SparkSession, path: str) -> Index:
    """The artefacts of a folder; a missing one raises Spark's own error."""
    stats, terms, postings, metadata = (spark.read.parquet(f"{path}/{name}") for name in ("stats", "terms", "postings", "metadata"))
    return Index(stats, terms, postings, metadata, stats.first()["span"])


class Region:
    """A region's blocks of asked terms as arrays, and what each asks of them.

    A match is a query's term and its block in a span; matches are in the order of queries, terms and spans.
    """

    def __init__(self, blocks: pa.Table, asked: pd.DataFrame):
        """``asked`` are ``(query, term, times, idf, optional)``, with queries as numbers from 0."""
        self.span, self.n = blocks["span"].to_numpy(), blocks["n"].to_numpy()
        term = blocks["term"].to_pandas()
        held = blocks["held"].combine_chunks()
        flat = held.flatten()
        self.ordinal, tf, dl = (flat.field(c).to_numpy().astype(np.int64) for c in ("ordinal", "tf", "dl"))
        self.tf, self.dl = tf, dl
        self.begins = np.cumsum(self.n) - self.n
        met = pd.DataFrame({"term": term, "block": np.arange(len(term)), "span": self.span}).merge(asked, on="term")
        self.met = met.sort_values(["query", "span", "term"], kind="stable")

    def scores(self, met: pd.DataFrame, avgdl: float) -> pd.DataFrame:
        """``query, span, ordinal, score`` of the matches' postings; ``read`` is added up by query, apart."""
        out = []
        for _, part in met.groupby("query", sort=False):  # a query at a time bounds the memory
            block, n = part["block"].to_numpy(), self.n[part["block"].to_numpy()]
            at = np.repeat(self.begins[block] - np.cumsum(n) + n, n) + np.arange(n.sum())
            tf, dl = self.tf[at], self.dl[at]
            weight = np.repeat(part["times"].to_numpy() * part["idf"].to_numpy(), n)
            value = weight * tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * dl / avgdl))
            docs, where = np.unique(self.ordinal[at], return_inverse=True)
            out.append((part["query"].iloc[0], docs, np.bincount(where, value, len(docs))))
        sizes = [len(d) for _, d, _ in out]
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pd.DataFrame({"query": np.repeat(np.array([q for q, _, _ in out], np.int64), sizes), "ordinal": join([d for _, d, _ in out], np.int64), "score": join([v for _, _, v in out], np.float64)})

    def read(self, met: pd.DataFrame) -> pd.Series:
        """How many postings the matches' blocks have, by query."""
        return pd.Series(self.n[met["block"].to_numpy()], met["query"].to_numpy()).groupby(level=0).sum()


def best(rows: pd.DataFrame, depth: int) -> pd.DataFrame:
    """The best ``depth`` of each query, later ordinals first among equals."""
    return rows.sort_values(["query", "score", "ordinal"], ascending=[True, False, False]).groupby("query").head(depth)


def near_best(rows: pd.DataFrame, depth: int) -> pd.DataFrame:
    """``best``, and what differs from its last only by rounding; of equal scores the ``depth`` last ordinals."""
    rows = rows.sort_values(["query", "score", "ordinal"], ascending=[True, False, False])
    bar = rows.groupby("query")["score"].transform(lambda s: s.iloc[depth - 1] if len(s) >= depth else -np.inf)
    return rows[(rows["score"] >= bar - CLOSE) & (rows.groupby(["query", "score"]).cumcount() < depth)]


def topk(index: Index, queries: DataFrame, depth: int, first_docs: int = 10, rare_share: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """``query_id, ordinal, score, rank`` of the best documents with a positive score, and ``query_id, n_postings, n_read``.

    A batch's terms are sent to the tasks (a batch of more than ``R.BROADCAST_ROWS`` is halved); each region's blocks
    of asked terms are one group, which is scored where it is, so only a query's best of a region and the number of
    postings it read leave it.
    """
    asked = queries.select("query_id", F.explode(X.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    need = materialize(index.terms.join(F.broadcast(asked) if R.few(asked) else asked, "term").withColumn("weight", F.col("times") * F.col("idf")).select("query_id", "term", "times", "idf", F.greatest(F.col("weight") * F.col("top"), F.lit(0.0)).alias("bound"), "df"), "asked-terms")
    if not R.few(need) and queries.select("query_id").distinct().count() > 1:
        middle = queries.select("query_id").distinct().agg(F.percentile_approx("query_id", 0.5)).first()[0]
        halves = [topk(index, q, depth, first_docs, rare_share) for q in (queries.filter(F.col("query_id") <= middle), queries.filter(F.col("query_id") > middle))]
        return tuple(a.unionByName(b) for a, b in zip(*halves, strict=True))
    avgdl, spark = index.stats.first()["avgdl"], queries.sparkSession
    every = need.toPandas()  # checked above
    ids = np.sort(every["query_id"].unique())
    every["query"] = np.searchsorted(ids, every["query_id"])
    every = every.sort_values(["query", "df", "term"])
    # The rarest terms, up to a share of the query's postings and one at least, choose the documents that set the bar.
    upto, total = every.groupby("query")["df"].cumsum(), every.groupby("query")["df"].transform("sum")
    every["rare"] = (every.groupby("query").cumcount() == 0) | (upto <= total * rare_share)
    terms = lambda rows: F.broadcast(spark.createDataFrame([(t,) for t in sorted(set(rows["term"]))], "term string"))
    per = regions(index.span)
    wide = per // index.span
    blocks = lambda rows: index.postings.select("term", "span", "held", "n").join(terms(rows), "term").withColumn("region", F.floor(F.col("span") / wide))
    columns = ["query", "term", "times", "idf", "bound", "rare"]
    schema = "query_id long, span long, ordinal long, score double, n_read long"

    def table(rows: pd.DataFrame, read: pd.Series) -> pa.Table:
        """Scored rows, and a row without an ordinal for what each query has read."""
        q = np.r_[rows["query"].to_numpy(np.int64), read.index.to_numpy(np.int64)]
        none = len(read)
        pad = lambda c, kind: pa.concat_arrays([pa.array(rows[c].to_numpy(), kind), pa.nulls(none, kind)])
        n = np.r_[np.zeros(len(rows), np.int64), read.to_numpy(np.int64)]
        return pa.table({"query_id": pa.array(ids[q].astype(np.int64)), "span": pa.array(np.r_[rows["ordinal"].to_numpy(np.int64) // span, np.full(none, -1)]), "ordinal": pad("ordinal", pa.int64()), "score": pad("score", pa.float64()), "n_read": pa.array(n)})

    span = index.span
    sent = spark.sparkContext.broadcast(every[columns])

    def hint(held: pa.Table) -> pa.Table:
        asks = sent.value
        r = Region(held, asks[asks["rare"]])
        return table(best(r.scores(r.met, avgdl), first_docs), r.read(r.met))

    empty = every.empty
    if empty:
        none = spark.createDataFrame([], "query_id long, ordinal long, score double, rank int")
        return none, spark.createDataFrame([], "query_id long, n_postings long, n_read long")
    hints = materialize(blocks(every[every["rare"]]).groupBy("region").applyInArrow(hint, schema), "hints")
    favoured = R.ranked(hints.filter("ordinal IS NOT NULL"), first_docs, F.desc("score"), F.desc("ordinal"), name="nth")
    first = favoured.select("query_id", "span").distinct().toPandas()  # ``first_docs`` a query
    first["query"] = np.searchsorted(ids, first["query_id"])
    chosen = spark.sparkContext.broadcast(first[["query", "span"]])

    def early(held: pa.Table) -> pa.Table:
        r = Region(held, sent.value)
        met = r.met.merge(chosen.value, on=["query", "span"])
        return table(near_best(r.scores(met, avgdl), depth), r.read(met))

    spans = F.broadcast(spark.createDataFrame([(int(x),) for x in sorted(set(first["span"]))], "span long"))
    early_ = materialize(blocks(every).join(spans, "span").groupBy("region").applyInArrow(early, schema), "first-scores")
    nth = R.ranked(early_.filter("score > 0"), depth, F.desc("score"), name="nth").filter(F.col("nth") == depth).select("query_id", "score").toPandas()  # one a query
    bar = np.full(len(ids), -CLOSE)
    bar[np.searchsorted(ids, nth["query_id"])] = nth["score"] - CLOSE
    # Optional terms: the lowest bounds whose sum stays below the bar.
    by_bound = every.sort_values(["query", "bound", "term"])
    by_bound["optional"] = by_bound.groupby("query")["bound"].cumsum() < bar[by_bound["query"]]
    rest = np.bincount(by_bound["query"], by_bound["bound"].where(by_bound["optional"], 0.0), len(ids))
    plan = spark.sparkContext.broadcast((by_bound[[*columns, "optional"]], bar, rest))

    def telling(held: pa.Table) -> pa.Table:
        asks, bar, rest = plan.value
        r = Region(held, asks)
        # The bounds of a span's blocks tell how high it can score.
        top = held["top"].to_numpy()[r.met["block"].to_numpy()]
        most = np.maximum(r.met["times"].to_numpy() * r.met["idf"].to_numpy() * top, 0.0)
        reach = r.met.assign(most=most).groupby(["query", "span"], as_index=False)["most"].sum()
        reach = reach[reach["most"].to_numpy() >= bar[reach["query"].to_numpy()]].merge(chosen.value, on=["query", "span"], how="left", indicator="seen")
        met = r.met.merge(reach.loc[reach["seen"] == "left_only", ["query", "span"]], on=["query", "span"])
        sure = met[~met["optional"]]
        found = r.scores(sure, avgdl)
        found = found[found["score"].to_numpy() + rest[found["query"].to_numpy()] >= bar[found["query"].to_numpy()]]
        found["span"] = found["ordinal"] // span
        more = met[met["optional"]].merge(found[["query", "span"]].drop_duplicates(), on=["query", "span"])
        late = found.merge(r.scores(more, avgdl).rename(columns={"score": "more"}), on=["query", "ordinal"], how="left")
        late["score"] += late["more"].fillna(0.0)
        return table(near_best(late[late["score"] > 0], depth), r.read(sure).add(r.read(more), fill_value=0))

    held = index.postings.select("term", "span", "held", "top", "n").join(terms(every), "term").withColumn("region", F.floor(F.col("span") / wide))
    late = materialize(held.groupBy("region").applyInArrow(telling, schema), "late-scores")
    scored = early_.unionByName(late).filter("ordinal IS NOT NULL").select("query_id", "ordinal", F.round("score", 6).alias("score"))
    read = hints.unionByName(early_).unionByName(late).groupBy("query_id").agg(F.sum("n_read").alias("n_read"))
    reads = need.groupBy("query_id").agg(F.sum("df").alias("n_postings")).join(read, "query_id", "left").select("query_id", "n_postings", F.coalesce("n_read", F.lit(0)).alias("n_read"))
    return R.bm25_topk(scored, depth).select("query_id", "ordinal", "score", "rank"), reads
