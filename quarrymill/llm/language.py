"""Language identification by hyperdimensional profiles.

Every letter has a random vector of -1 and 1. A trigram's vector binds its
letters' vectors, permuted by place (rotate twice, once, not at all; multiply).
A text bundles (adds) its trigrams' vectors; a language's prototype bundles all
its learned texts. The predicted language has the largest cosine with the text.

A bundle's inner product with a prototype is the sum of its trigrams' inner
products, so those are tabled once per trigram; the text's own length is common
to all its cosines and cancels in the choice. ``score`` is a softmax over the
mean trigram cosines.

Defined cases: null texts and texts without a letter are ``und`` with score 0.
Rows may repeat. Without a learned language every text is ``und``. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm.labelled import crc_mod
from quarrymill.llm.shared import named, with_text

SYMBOLS, DIMS, WIDE = 64, 1024, 0x20000
TRIGRAMS = SYMBOLS**3


def symbol_table() -> np.ndarray:
    """A symbol for every code point of the first planes: 0 for what is no letter."""
    out = np.zeros(WIDE, dtype=np.int32)
    for c in range(WIDE):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % 37
    return out


def trigrams(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram numbers of all texts, the texts' bounds among them, and which have a letter."""
    parts, bounds, letters = [], [0], []
    for t in texts:
        c = np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        s = np.where(c < WIDE, table[np.minimum(c, WIDE - 1)], np.where(c < 0x40000, 27 + c % 37, 0)).astype(np.int32)
        on = s > 0
        x = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
        x = x[on[1:-1] & (on[:-2] | on[2:])] if on.sum() > 1 else x[on[1:-1]]
        parts.append(x)
        bounds.append(bounds[-1] + len(x))
        letters.append(bool(on.any()))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(bounds), np.array(letters, dtype=bool)


def vectors(ids: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of some trigrams."""
    a, b, c = ids // SYMBOLS**2, ids // SYMBOLS % SYMBOLS, ids % SYMBOLS
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


def letter_vectors(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], dtype=np.float32), (SYMBOLS, DIMS))


def bundle(ids: np.ndarray, counts: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The sum of some trigrams' vectors, each as often as it counts."""
    out = np.zeros(DIMS)
    for at in range(0, len(ids), 4096):
        out += counts[at : at + 4096].astype(np.float64) @ vectors(ids[at : at + 4096], letters)
    return out


def cosine_table(bundles: np.ndarray, seed: int) -> np.ndarray:
    """Each trigram's cosine with each prototype."""
    letters = letter_vectors(seed)
    bundles = bundles / (np.maximum(1e-12, np.linalg.norm(bundles, axis=1, keepdims=True)) * DIMS**0.5)
    table = np.zeros((TRIGRAMS, len(bundles)), dtype=np.float32)
    for at in range(0, TRIGRAMS, 4096):
        table[at : at + 4096] = vectors(np.arange(at, at + 4096), letters) @ bundles.T
    return table


def identify(docs: DataFrame, folds: int = 5, held: int = 0, sharp: float = 60.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with ``held_out``, ``lang_pred`` and ``score``.

    Prototypes bundle every labelled text outside the held-out fold. The number
    of languages is small by definition.
    """
    text = named(text_col).cast("string")
    learn = docs.filter(F.col(lang_col).isNotNull() & F.coalesce(crc_mod(id_col, folds) != held, F.lit(False))).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = symbol_table(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                langs, texts = batch.column(0).slice(at, 200).to_pylist(), batch.column(1).slice(at, 200).to_pylist()
                ids, bounds, _ = trigrams(texts, table)
                of = np.repeat(np.arange(len(texts)), np.diff(bounds))
                names, code = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
                for k, name in enumerate(names.tolist()):
                    total.setdefault(name, np.zeros(TRIGRAMS, np.int64))[:] += np.bincount(ids[code[of] == k], minlength=TRIGRAMS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "trigram", "n"])

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = letter_vectors(seed), {}
        for batch in batches:
            langs, code = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for k, name in enumerate(langs.tolist()):
                ids, n = batch.column(1).to_numpy()[code == k], batch.column(2).to_numpy()[code == k]
                total[name] = total.get(name, 0.0) + bundle(ids, n, letters)
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * DIMS), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(v)], ["lang", "at", "x"])

    grams = learn.mapInArrow(count, "lang string, trigram int, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))
    # Prototypes are summed in the executors: a language sends DIMS numbers to the driver.
    found = grams.mapInArrow(bundles, "lang string, at int, x double").groupBy("lang", "at").agg(F.sum("x").alias("x")).toPandas()
    names = sorted(found["lang"].unique().tolist())
    prototypes = np.zeros((len(names), DIMS))
    prototypes[found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64), found["at"].to_numpy(np.int64)] = found["x"].to_numpy()
    model = docs.sparkSession.sparkContext.broadcast(cosine_table(prototypes, seed) if names else None)
    mine = ["held_out", "lang_pred", "score"]
    base, cols, back = with_text(docs, text_col, keep, mine, held_out=F.coalesce(crc_mod(id_col, folds) == held, F.lit(False)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, table = symbol_table(), model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids, bounds, letters = trigrams(part.column(part.num_columns - 1).to_pylist(), symbols)
                langs, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if table is not None:
                    run = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table[ids], axis=0, dtype=np.float64)])
                    z = sharp * (run[bounds[1:]] - run[bounds[:-1]]) / np.maximum(1, np.diff(bounds))[:, None]
                    p = np.exp(z - z.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    langs = [names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                    score = np.where(letters, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(cols) + 1)), pa.array(langs, pa.string()), pa.array(score)], [*cols, *mine])

    fields = [*base.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return back(base.mapInArrow(predict, T.StructType(fields)))
