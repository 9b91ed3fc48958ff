"""Mixing documents to target token shares of soft domains.

A classifier learned from labelled rows gives each document a posterior over the
domains. Projected-gradient least squares then fits a nonnegative rate for every
document so that the expected tokens of each domain, the sum of
rate * tokens * posterior, meet the targets. A step needs only sums over all
documents of the domains' number and its square; rates are never stored, they
follow from a posterior and one vector of the domains' number.

Defined cases: null and empty texts have no tokens and the labels' shares as
posterior; they get a rate like any other. Rows may repeat. Without labels or
targets every rate is 1. An empty table gives an empty result. A domain that
has no target keeps its tokens; a target that no label names is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm.labelled import sample_labelled
from quarrymill.llm.shared import named, private, with_text
from quarrymill.llm.subword import fit, posteriors
from quarrymill.llm.texthash import powers, segments, text_bytes, words
from quarrymill.storage import materialize


def token_counts(column: pa.Array, tables: tuple) -> np.ndarray:
    """Words between blanks of each whole text."""
    data, offsets = text_bytes(column)
    out = np.zeros(len(column), dtype=np.int64)
    for d, o, docs in segments(data, offsets):
        np.add.at(out, docs, np.diff(words(d, o, tables)[1]))
    return out


def rates(p: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Rate 1 moved along the domains' gradients, projected on what is not negative."""
    return np.maximum(0.0, 1.0 + p @ move)


def matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def totals(scored: DataFrame, moves: np.ndarray, k: int) -> list[tuple[np.ndarray, float, np.ndarray]]:
    """For each of some moves, in one pass: domain tokens, half the tokens' squared rates, and the curvature on rates over 0."""
    wide = k + 1 + k * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(moves), wide))
        for batch in batches:
            n, p = batch.column(0).to_numpy().astype(np.float64), matrix(batch.column(1), k)
            for i, move in enumerate(moves):
                r = rates(p, move)
                out[i] += np.concatenate([(r * n) @ p, [0.5 * (n * r) @ r], ((p * (n * (r > 0))[:, None]).T @ p).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], ["at", "x"])

    out = np.zeros(len(moves) * wide)
    for row in scored.select("n_tokens", "posterior").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[row["at"]] = row["x"]
    return [(x[:k], float(x[k]), x[k + 1 :].reshape(k, k)) for x in out.reshape(len(moves), wide)]


def solve(scored: DataFrame, weights: np.ndarray, close: float) -> tuple[np.ndarray, float]:
    """The move whose rates meet the targets with the least squared change, and the largest gap it leaves as a share of all tokens.

    A domain without a target (NaN) keeps its tokens; the others' budget is the
    least at which none of them has to shrink. This is projected gradient in its lazy
    form, on the rates with documents weighed by their tokens: the gradient of half
    the squared gaps for a document's rate is then p.gap, so steps against it add up
    to p.move, and the rates are the projection (onto 0 and more) of 1 + p.move;
    the tokens they give are the gradient of a convex function, so each step goes
    along the gap, preconditioned by the curvature on rates over 0, as far (of
    some lengths, tried in one pass) as takes the function down most. It ends
    when the targets are met, or when five steps bring the gap no nearer: targets
    that no rates meet leave a residual.
    """
    k, move = len(weights), np.zeros(len(weights))
    now, value, curve = totals(scored, move[None, :], k)[0]
    if not now.sum():
        return move, 0.0
    some = weights > 0
    budget = float((now[some] / weights[some]).max()) if some.any() else 0.0
    goal = np.where(np.isnan(weights), now, np.nan_to_num(weights) * budget)
    best, kept, since = np.inf, move, 0
    while True:
        left = float(np.abs(now - goal).max() / goal.sum())
        since = 0 if left < 0.99 * best else since + 1
        if left < best:
            best, kept = left, move
        if best <= close or since >= 5:
            return kept, best
        step = -np.linalg.lstsq(curve + 1e-9 * max(1e-12, np.trace(curve)) * np.eye(k), now - goal, rcond=None)[0]
        moves = move + 0.5 ** np.arange(8)[:, None] * step
        found = totals(scored, moves, k)
        i = int(np.argmin([v - goal @ m for (_, v, _), m in zip(found, moves, strict=True)]))
        if found[i][1] - goal @ moves[i] > value - goal @ move + 1e-9 * abs(value):
            return kept, best  # nothing lies lower
        move, (now, value, curve) = moves[i], found[i]


def fit_rates(docs: DataFrame, domains: DataFrame, targets: dict[str, float], per_class: int = 1000, close: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with ``n_tokens``, ``posterior``, ``rate`` and ``residual``.

    ``domains`` is the labelled table ``(id_col, label)``; the classifier is fit
    on about ``per_class`` of its rows for each label. The number of labels is
    the number of domains: small by definition. ``residual`` is the same in all
    rows: the largest gap between a domain's tokens and its target, as a share.
    """
    sample, counts = sample_labelled(docs, domains, per_class, id_col, text_col)
    table, names = fit(sample, counts)
    k = max(1, len(names))
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(table)
    base, cols, back = with_text(docs, text_col, keep, ["n_tokens", "posterior", "rate", "residual"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers()
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            p = posteriors(text, model.value, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), pa.array(token_counts(text, tables)), lists], [*cols, "n_tokens", "posterior"])

    fields = [*base.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]
    scored = materialize(base.mapInArrow(score, T.StructType(fields)), "posteriors")
    weights = np.array([max(0.0, targets.get(str(c), np.nan)) if str(c) in targets else np.nan for c in names] or [np.nan])
    some = np.nansum(weights)
    move, left = solve(scored, weights / some, close) if some > 0 else (np.zeros(k), 0.0)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = rates(matrix(batch.column(batch.num_columns - 1), k), move)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r), pa.array(np.full(len(r), left))], [*batch.schema.names, "rate", "residual"])

    return back(scored.mapInArrow(rate, T.StructType([*fields, T.StructField("rate", T.DoubleType()), T.StructField("residual", T.DoubleType())])))


def apply_rates(rated: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """Each row as often as its rate says: the whole part, and one more for the share of ids that the rest is."""
    draw = F.pmod(F.xxhash64(F.lit("rate"), named(id_col)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    copies = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    again = private(rated.columns, "_copy")
    return rated.withColumn(again, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).select(*map(named, columns))
