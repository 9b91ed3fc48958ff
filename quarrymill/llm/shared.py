"""What several operators share: private columns, batches of groups, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.storage import Scratch


def named(column: str) -> Column:
    """A column by its whole name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def private(taken: list[str], name: str) -> str:
    """A name that no column has, in any case."""
    used = {c.lower() for c in taken}
    while name in used:
        name += "_"
    return name


def with_text(docs: DataFrame, text_col: str, keep: list[str] | None, mine: list[str], column: Column | None = None, **more: Column) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """The kept columns under private names, ``more`` columns, and last the text; the private names; and what gives the columns their names back.

    Columns named like those that an operator writes (``mine``) are replaced. Batches and schemas
    see private names alone, so signs in names mean nothing.
    """
    cols = [c for c in (keep or docs.columns) if c.lower() not in {m.lower() for m in mine}]
    hidden = [f"_c{i}" for i in range(len(cols))]
    text = named(text_col).cast("string") if column is None else column
    base = docs.select(*(named(c).alias(h) for c, h in zip(cols, hidden, strict=True)), *(c.alias(n) for n, c in more.items()), text.alias("_text"))

    def back(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(h).alias(c) for c, h in zip(cols, hidden, strict=True)), *(c for c in df.columns if c not in hidden))

    return base, hidden, back


def by_group(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a key in one partition, adjacent, for ``whole_groups``; adaptive execution may join small partitions."""
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream sorted by ``key``, with the groups' bounds.

    Memory is bounded by one batch and the largest group.
    """
    held: list[pa.Table] = []

    def bounds(table: pa.Table) -> np.ndarray:
        k = table.column(key).to_numpy()
        return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        k = table.column(key).to_numpy()
        cut = int(np.flatnonzero(k == k[-1])[0])  # the last group may go on
        if cut == 0 and held and held[-1].column(key)[-1].as_py() == k[0]:
            held.append(table)
            continue
        held.append(table.slice(0, cut))
        whole = pa.concat_tables(held)
        held = [table.slice(cut)]
        if whole.num_rows:
            yield whole, bounds(whole)
    if held and (whole := pa.concat_tables(held)).num_rows:
        yield whole, bounds(whole)


def list_rows(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = a.chunk(0) if a.num_chunks else pa.array([], a.type)
    o = a.offsets.to_numpy().astype(np.int64)
    return a.values.slice(o[0], o[-1] - o[0]).to_numpy(zero_copy_only=False), o - o[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(node, component)``: the smallest node that is reachable.

    Alternating large-star and small-star rounds. Each round is two joins with
    minima per node; a node with very many links is a skewed key of those joins,
    which adaptive execution splits. Nothing reaches the driver but a count and a
    checksum; a round's table is deleted once the next is written.
    """
    tables = Scratch(edges.sparkSession)

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both if large else both.filter("b < a")
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = near.join(least, "a")
        moved = out.filter("b > a") if large else out
        links = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            links = links.unionByName(least.select("a", F.col("m").alias("b")))
        return links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e = tables.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars0")
    state = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was, turn = state(e), 0
    while was[0]:
        turn += 1
        e = tables.keep(star(star(e, True), False), f"stars{turn}")
        tables.drop(f"stars{turn - 1}")
        if (now := state(e)) == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
