"""Document quality by supervised subword embeddings.

Defined cases: null and empty texts score as the labels' share of good rows; a
document without a label is scored like any other; rows may repeat; with no
label to learn from every score is 1 (nothing is rejected). An empty table gives
an empty result. ``labels`` may repeat a document: its best label counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm.labelled import crc_mod, sample_labelled
from quarrymill.llm.shared import with_text
from quarrymill.llm.subword import fit, posteriors
from quarrymill.llm.texthash import powers


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500, folds: int = 5, held: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with ``held_out``, ``score`` and ``predicted``.

    The model is fit on about ``per_class`` rows of each label, held-out rows
    excluded; everything else covers all rows and whole texts.
    """
    learn = labels.filter(crc_mod(id_col, folds) != held).select(F.col(id_col), F.col("quality").cast("int").alias("label"))
    sample, counts = sample_labelled(docs, learn, per_class, id_col, text_col)
    table, names = fit(sample, counts)
    model = docs.sparkSession.sparkContext.broadcast(table)
    good = names.index(1) if 1 in names else None
    base, cols, back = with_text(docs, text_col, keep, ["held_out", "score", "predicted"], held_out=F.coalesce(crc_mod(id_col, folds) == held, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers()
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            score = posteriors(text, model.value, tables)[:, good] if good is not None else np.full(len(text), 0.0 if names else 1.0)
            columns = [batch.column(i) for i in range(len(cols))] + [batch.column(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*cols, "held_out", "score", "predicted"])

    schema = T.StructType([*base.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return back(base.mapInArrow(run, schema))
