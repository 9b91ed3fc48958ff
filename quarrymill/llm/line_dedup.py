"""Lines that several documents hold stay in the first of them only.

Lines are exploded and normalised, their keys hashed (md5, 128 bits), and the
documents of each hash counted by a minimum and a maximum of ids, which combine
before the shuffle. A key with two ids or more is repeated; its smallest id keeps
its lines, all others lose them. Keys so frequent that at most ``heavy`` of them
can exist are broadcast; a join by hash decides about the rest, so no key is more
than one part in ``heavy`` of that join's rows. The positions of a document's
dropped lines meet its text once, and the other lines are joined in their order.

Defined cases: a null or empty text is one empty line. Rows that share an id are
one document: a line found only in them is not repeated. A row without an id is
never the first holder and counts as no document, but loses what two others hold.
Keys of fewer than ``least`` characters stay. Repeated rows get the same result,
and an empty table gives an empty one. Lines of any length are hashed whole; a
text of any length has its lines in one row. Other columns are kept, whatever
their names, but for those that this operator writes.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.shared import named
from quarrymill.storage import materialize

MINE = ["n_lines", "n_dropped", "kept"]


def line_key(line: Column) -> Column:
    """Blanks of ASCII stripped at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    ascii_only = F.octet_length(line) == F.length(line)  # then ``lower``, which is cheaper, does the same
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def dedup_lines(docs: DataFrame, least: int = 10, heavy: int = 10_000, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with ``n_lines``, ``n_dropped`` and ``kept``, the text without dropped lines."""
    cols = [c for c in (keep or docs.columns) if c.lower() not in MINE]
    names = [f"c{i}" for i in range(len(cols))]
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    base = docs.select(*(named(c).alias(n) for c, n in zip(cols, names, strict=True)), named(id_col).cast("long").alias("id"), text.alias("text"))
    # Of rows with one id, equal texts have equal positions.
    base = base.withColumn("row", F.xxhash64("text", "id"))
    line = base.select("id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = materialize(line.filter(F.length("key") >= least).select("id", "row", "pos", F.unhex(F.md5(F.col("key").cast("binary"))).alias("hash")), "lines")

    counted = lines.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    repeated = materialize(counted.filter("first < last").select("hash", "first", "n"), "repeated-lines")
    rows = repeated.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= F.lit(max(1, -(-rows // heavy)))  # at most ``heavy`` keys
    frequent, others = (repeated.filter(x).select("hash", "first") for x in (often, ~often))
    loses = lambda found: found.filter(~F.col("id").eqNullSafe(F.col("first"))).select("id", "row", "pos")
    rest = lines.join(F.broadcast(frequent), "hash", "left_anti")
    lost = loses(lines.join(F.broadcast(frequent), "hash")).unionByName(loses(rest.join(others.hint("shuffle_merge"), "hash")))
    gone = lost.groupBy("id", "row").agg(F.collect_set("pos").alias("gone")).select(F.col("id").alias("id_"), F.col("row").alias("row_"), "gone")

    met = base.join(gone, F.col("id").eqNullSafe(F.col("id_")) & (F.col("row") == F.col("row_")), "left")
    met = met.select(*names, F.split("text", "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    met = met.select(*names, F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), "lines", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")).alias("stay"))
    kept = F.array_join(F.transform("stay", lambda i: F.get(F.col("lines"), i)), "\n")
    return met.select(*(F.col(n).alias(c) for n, c in zip(names, cols, strict=True)), "n_lines", "n_dropped", kept.alias("kept"))
