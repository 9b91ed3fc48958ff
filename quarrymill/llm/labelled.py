"""A bounded sample of labelled texts, drawn without moving the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.shared import named, private


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(named(id_col).cast("string").cast("binary")) % n


def sample_labelled(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """``(id, text, label)`` of about ``per_class`` texts of each label, and all labels' counts.

    ``labels`` has ``(id_col, label)``. Rows are chosen by a hash of the id, so
    the sample is the same for any order or partitioning of the input. Only the
    chosen ids are broadcast: their number is bounded by ``per_class``.
    """
    words = private([id_col, "label"], "text")
    one = labels.filter(F.col(id_col).isNotNull() & F.col("label").isNotNull()).groupBy(id_col).agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).cast("double") / float(1 << 30)
    keep = F.lit(False)
    for label, n in sorted(counts.items()):
        keep = keep | ((F.col("label") == F.lit(label)) & (draw < min(1.0, per_class / n)))
    chosen = one.filter(keep)
    text = docs.select(named(id_col).alias(id_col), named(text_col).cast("string").alias(words))
    rows = text.join(F.broadcast(chosen), id_col)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(words).alias("text"), "label"), counts
