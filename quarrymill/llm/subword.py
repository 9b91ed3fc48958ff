"""A text classifier of hashed word and character n-gram vectors.

Each text is the average of learned vectors: of its words, its word pairs, its
byte n-grams, and of marks for words that repeat a near neighbour. A linear
layer and a softmax follow, trained by stochastic gradient descent in numpy.
Scoring uses that the output is linear in the average: each bucket's vector
times the output layer is one number per class, looked up and averaged.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrymill.llm.texthash import lower, mix, powers, segments, text_bytes, words

BUCKETS, DIM, GRAMS, REPEATS = 1 << 17, 12, (2, 4), 4


def features(data: np.ndarray, offsets: np.ndarray, tables: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of features: bucket numbers in text order, and each text's bounds among them."""
    mask = np.uint64(BUCKETS - 1)
    h, at = words(data, offsets, tables)
    out = [(((h >> np.uint64(7)) & mask).astype(np.int32), at)]
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:])
    first = at[:-1].copy()
    out.append(((pair & mask).astype(np.int32), np.stack([np.minimum(first, len(pair)), np.clip(at[1:] - 1, first.clip(max=len(pair)), len(pair))])))
    for k in range(1, REPEATS + 1):  # the word repeats the k-th before it, or not
        same = h[k:] == h[:-k] if len(h) > k else np.zeros(0, bool)
        lo = np.minimum(first, len(same))
        out.append((np.where(same, k, 0).astype(np.int32), np.stack([lo, np.clip(at[1:] - k, lo, len(same))])))
    low = lower(data).astype(np.uint64) + np.uint64(1)
    for g in GRAMS:
        n = max(0, len(low) - g + 1)
        x = np.full(n, g, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(g):
                x = x * np.uint64(0x100000001B3) + low[j : j + n]
            x *= np.uint64(0x9E3779B97F4A7C15)
        lo = np.minimum(offsets[:-1], n)
        out.append(((x >> np.uint64(64 - 17)).astype(np.int32), np.stack([lo, np.clip(offsets[1:] - g + 1, lo, n)])))
    return [(ids, b if b.ndim == 2 else np.stack([b[:-1], b[1:]])) for ids, b in out]


def bags(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct buckets and their weights, which sum to 1."""
    tables = powers()
    for text in texts:
        data, offsets = text_bytes(pa.array([text]))
        found = [ids for d, o, _ in segments(data, offsets) for ids, _ in features(d, o, tables)]
        ids, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0))
        yield ids, (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[str], classes: list[int], prior: np.ndarray, epochs: int = 6, rate: float = 0.3, seed: int = 3) -> np.ndarray:
    """The table ``(BUCKETS + 1, classes)``: each bucket's share in the logits, the bias last."""
    rng, k = np.random.default_rng(seed), len(prior)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    bag, y = list(bags(texts)), np.asarray(classes)
    for epoch in range(epochs):
        for step, i in enumerate(rng.permutation(len(bag)).tolist()):
            ids, w = bag[i]
            now = rate * (1 - (epoch + step / len(bag)) / epochs)
            rows = vectors[ids]
            mean = w @ rows
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= now * np.outer(mean, p)
            bias -= 0.1 * now * p
            vectors[ids] = rows - now * (w / max(1e-6, w @ w))[:, None] * back[None, :]  # the average moves by the rate times its gradient
    seen = np.bincount(y, minlength=k) / max(1, len(y))
    bias += np.log(np.maximum(prior, 1e-9)) - np.log(np.maximum(seen, 1e-9))  # the sample is balanced, the labels are not
    return np.vstack([vectors @ out, bias[None, :]]).astype(np.float32)


def posteriors(column: pa.Array, table: np.ndarray, tables: tuple) -> np.ndarray:
    """Class probabilities of whole texts; an empty text has the prior's."""
    data, offsets = text_bytes(column)
    total, count = np.zeros((len(column), table.shape[1])), np.zeros(len(column))
    for d, o, docs in segments(data, offsets):
        for ids, bounds in features(d, o, tables):
            for c in range(table.shape[1]):
                run = np.concatenate([[0.0], np.cumsum(table[:, c][ids], dtype=np.float64)])
                np.add.at(total[:, c], docs, run[bounds[1]] - run[bounds[0]])
            np.add.at(count, docs, bounds[1] - bounds[0])
    z = total / np.maximum(1, count)[:, None] + table[-1]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(sample: DataFrame, counts: dict) -> tuple[np.ndarray, list]:
    """Train in one task on a bounded sample of ``(id, text, label)``; the table and its classes in order."""
    names = sorted(counts)
    prior = np.array([counts[c] for c in names], dtype=np.float64)
    prior /= prior.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t or "", c) for b in batches for i, t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        model = train([r[1] for r in rows], [names.index(r[2]) for r in rows], prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    if len(names) < 2:  # nothing to tell apart
        return np.zeros((BUCKETS + 1, max(1, len(names))), np.float32), names
    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    if row is None:  # no labelled row has a text: the prior is all there is
        return np.vstack([np.zeros((BUCKETS, len(names))), np.log(prior)[None, :]]).astype(np.float32), names
    return pickle.loads(row["model"]), names
