"""Global order without one task: positions by ranges, and a prefix sum over them.

Rows are partitioned by ranges of their keys, sorted within, and written with a
number that holds partition and place. The partitions' counts, as many as there
are partitions, give each its offset; a row's position is its partition's offset
plus its place. Within a group, which may span many partitions, the same is done
with the counts of each group in each partition, so a large group is no one's task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.storage import materialize, new_path

#: ``monotonically_increasing_id`` has the partition above these bits, and the place below.
PLACE_BITS = 33


def in_order(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """``df`` in a table, sorted by ``keys`` over all partitions, with ``part_`` and ``place_``.

    Rows with equal keys stand in no fixed order: name keys that differ. Nulls come first.
    """
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
    written = materialize(ranged.withColumn("at_", F.monotonically_increasing_id()), "ordered")
    return written.withColumns({"part_": F.shiftright("at_", PLACE_BITS), "place_": F.col("at_").bitwiseAND((1 << PLACE_BITS) - 1)}).drop("at_")


def positions(df: DataFrame, *keys: str, name: str = "position", parts: int | None = None) -> DataFrame:
    """``df`` with each row's position, from 0, in the order of ``keys``."""
    placed = in_order(df, *keys, parts=parts)
    # A row for each partition: a window over them is small whatever the number of rows.
    counts = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    before = counts.select("part_", (F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))).alias("before_"))
    return placed.join(F.broadcast(before), "part_").select(*df.columns, (F.coalesce("before_", F.lit(0)) + F.col("place_")).alias(name))


def positions_within(df: DataFrame, group: str, *keys: str, name: str = "position", parts: int | None = None) -> DataFrame:
    """``df`` with each row's position, from 0, within its group in the order of ``keys``; a null group is one too."""
    placed = in_order(df, group, *keys, parts=parts)
    spans = placed.groupBy(F.col(group).alias("group_"), "part_").agg(F.count("*").alias("n_"), F.min("place_").alias("first_"))
    w = Window.partitionBy("group_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition at most
    before = spans.select("group_", F.col("part_").alias("of_"), (F.coalesce(F.sum("n_").over(w), F.lit(0)) - F.col("first_")).alias("before_"))
    met = placed.join(before, (F.col("part_") == F.col("of_")) & F.col(group).eqNullSafe(F.col("group_")))
    return met.select(*df.columns, (F.col("place_") + F.col("before_")).alias(name))


def pre_order(nodes: DataFrame, most: int = 10) -> DataFrame:
    """``id, depth, path, position`` of the trees of ``nodes (id, parent, ord)``: parents before their children, those by ``ord``.

    Level by level, a table each, until one is empty; nodes that no root (a null parent) leads to, as in a cycle, are
    left out. ``most`` is the number of digits of the largest ``ord``. Brothers' paths differ: ``ord`` and id tell them
    apart.
    """
    spark = nodes.sparkSession
    path = new_path(spark, "levels")
    schema = "id long, depth int, path string"
    place = F.concat_ws(".", F.lpad(F.col("ord").cast("string"), most, "0"), F.lpad(F.col("id").cast("string"), 19, "0"))
    placed = nodes.select(F.col("id").cast("long"), F.col("parent").cast("long"), place.alias("place"))

    def keep(level: DataFrame, depth: int) -> DataFrame:
        level.write.parquet(f"{path}/level={depth}")
        return spark.read.schema(schema).parquet(f"{path}/level={depth}")

    depth, last = 0, keep(placed.filter("parent IS NULL").select("id", F.lit(0).alias("depth"), F.col("place").alias("path")), 0)
    while last.limit(1).count():
        depth += 1
        up = last.select(F.col("id").alias("parent"), F.col("path").alias("above"))
        last = keep(placed.join(up, "parent").select("id", F.lit(depth).alias("depth"), F.concat("above", F.lit("/"), "place").alias("path")), depth)
    return positions(spark.read.schema(f"{schema}, level int").parquet(path).drop("level"), "path")
