"""Operational analytics: profiler reports, set comparison, registries, traffic, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill import config as C


def code_hotspots(drill: DataFrame, symbols: DataFrame, measures: DataFrame, samples: str, percent: str, most: int = 10) -> DataFrame:
    """Samples per function: a pivot by conditional maximum per node, then sums."""
    j = drill.join(symbols, "symbol_id", "left").join(measures.withColumnRenamed("name", "measure"), "measurement_id", "left")
    pick = lambda name: F.max(F.when(F.col("measure") == name, F.col("measurement_value")).otherwise(0.0))
    node = j.groupBy("call_tree_id", "name", "node_type").agg(pick(samples).alias("s"), pick(percent).alias("p"))
    name = F.coalesce(F.nullif("name", F.lit("")), F.lit("EMPTY_SYMBOLS")).alias("function_name")
    out = node.groupBy(name, "node_type").agg(F.round(F.sum("s"), 6).alias("samples"), F.round(F.sum("p"), 6).alias("percent"))
    return out.orderBy(F.desc("samples"), "function_name", "node_type").limit(most)


def cpu_metrics(drill: DataFrame, measures: DataFrame, node: int = 0) -> DataFrame:
    j = drill.filter(F.col("call_tree_id") == node).join(measures, "measurement_id")
    return j.select(F.col("name").alias("metric"), "units", F.col("measurement_value").alias("value")).orderBy(F.desc("value"))


def register_sources(existing: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Known sources in order, each new url once, behind the last of its site; new sites at the end."""
    first = arrivals.filter(F.trim("url") != "").withColumn("nth", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).filter("nth = 1").drop("nth")
    new = first.join(existing.select("url").distinct(), "url", "left_anti")
    last = existing.groupBy("site").agg(F.max("pos").alias("after"))
    placed = new.join(last, "site", "left").select("url", "site", F.coalesce("after", F.lit(1 << 40)).alias("major"), (F.col("pos") + 1).alias("minor"))
    return existing.select("url", "site", F.col("pos").alias("major"), F.lit(0).cast("long").alias("minor")).unionByName(placed)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per source: words, chunks and the ordered list of ids."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x.id.cast("string")), ",")
    return chunks.groupBy("source").agg(F.sum("n_words").alias("n_words"), F.count("*").alias("n_chunks"), ids.alias("ids"))


def manifest_diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    j = ours.withColumnRenamed("digest", "a").join(theirs.withColumnRenamed("digest", "b"), "name", "full_outer")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return j.select("name", kind.alias("status"))


def arch_check(found: Column, required: list[str]) -> tuple[Column, Column]:
    """Status of an image's architectures, and which required ones are missing."""
    need = F.array(*map(F.lit, required))
    missing = F.array_except(need, found)
    return F.when(F.size(found) == 0, "error").when(F.size(missing) == 0, "success").otherwise("warning"), F.array_join(F.sort_array(missing), ",")


def excluded(path: Column) -> Column:
    """Whether any segment of a path is an excluded name."""
    return F.exists(F.split(path, "/"), lambda s: s.isin(C.EXCLUDED_NAMES) | F.greatest(*(s.endswith(x) for x in C.EXCLUDED_SUFFIXES), F.lit(False)))


def call_results(turns: DataFrame) -> DataFrame:
    """Each call with its result: the pair of log lines that share an id."""
    call = turns.filter("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("call_chars"))
    result = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("result_chars"))
    return call.join(result, ["conv_id", "turn"], "left")


def traffic(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events per tool and window; the batch twin of the stream."""
    g = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def pack(sizes: Column, least: int = C.CHUNK_LEAST, most: int = C.CHUNK_MOST) -> Column:
    """Greedy packing of ordered unit sizes into chunks, as one fold over the array."""
    step = lambda a, x: F.when((a.now > 0) & (a.now + x > most) & (a.now >= least), F.struct(F.array_append(a.done, a.now).alias("done"), x.alias("now"))).otherwise(F.struct(a.done.alias("done"), (a.now + x).alias("now")))
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("long").alias("now"))
    return F.aggregate(sizes, start, step, lambda a: F.when(a.now > 0, F.array_append(a.done, a.now)).otherwise(a.done))
