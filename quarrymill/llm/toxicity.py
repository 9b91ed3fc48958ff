"""Toxicity by compression distance.

Two zstandard dictionaries are built from a bounded labelled sample: one of
ordinary text, one that also holds what marks toxic text. A window of text is a
word with padding; the fewer bytes it takes with the second dictionary than with
the first, the more toxic it is. A document's windows over a calibrated length
difference, as a count and as a share, give its score through a logistic fit on
rows that the dictionaries have not seen.

Defined cases: null, empty and blank texts have no windows and score near 0.
Rows may repeat. Without both labels to learn from every score is 0. An empty
table gives an empty result. ``labels`` may repeat a document: toxic counts.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm.labelled import crc_mod, sample_labelled
from quarrymill.llm.shared import with_text

PAD, LEVEL, CACHE = b" " * 12, 12, 400_000
#: Length differences, in bytes, at which windows are counted.
CUTS = (3, 4, 5, 6)
#: Lengths of word beginnings that are tested as words are.
STEMS = (4, 5, 6)
# ASCII punctuation.
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def split(text: str | None) -> list[bytes]:
    """Lower-cased words without the marks around them."""
    return [w.strip(EDGES) or w for w in (text or "").encode().lower().split()]


def contexts(texts: list[str]) -> tuple[Counter, int]:
    """For each word the number of distinct words before it: copies of a text add nothing."""
    seen: set[tuple[bytes, bytes]] = set()
    for t in texts:
        w = split(t)
        seen.update(zip([b"", *w], w, strict=False))
    return Counter(b for _, b in seen), max(1, len(seen))


def last(words: list[bytes], more: int, most: int) -> list[bytes]:
    """The last words that fit into ``most`` bytes, with ``more`` for each."""
    size, at = 0, len(words)
    while at and size + len(words[at - 1]) + more <= most:
        at -= 1
        size += len(words[at]) + more
    return words[at:]


def dictionaries(toxic: list[str], ordinary: list[str], surprise: float = 16.0, ratio: float = 6.0, most: int = 65536) -> tuple[bytes, bytes]:
    """Content of the ordinary and the toxic dictionary.

    The toxic one has the words that toxic texts use in far more contexts than
    chance allows (a likelihood-ratio test), behind all that the ordinary one has.
    ``most`` bounds each part, as a dictionary's size is bounded: whole words, the
    most telling (ordinary: the most frequent) ones.
    """
    a, n = contexts(toxic)
    b, m = contexts(ordinary)

    def gain(x: int, y: int) -> float:
        e = (x + y) / (n + m)
        part = lambda k, at: k * math.log(k / at) if k else 0.0
        return 2 * (part(x, n * e) + part(y, m * e) + part(n - x, n * (1 - e)) + part(m - y, m * (1 - e)))

    def marked(x: Counter, y: Counter) -> dict[bytes, float]:
        found = {w: gain(k, y[w]) for w, k in x.items() if (k + 0.5) / (n + 1) > ratio * (y[w] + 0.5) / (m + 1)}
        return {w: g for w, g in found.items() if g > surprise}

    strength = marked(a, b)
    for size in STEMS:  # rare words count if many words with their beginning are toxic
        stems = [Counter(), Counter()]
        for to, words in zip(stems, (a, b), strict=True):
            for w, k in words.items():
                if len(w) > size:
                    to[w[:size]] += k
        sure = {w: g for w, g in marked(*stems).items() if g > 3 * surprise}
        strength.update({w: sure[w[:size]] for w in a if w[:size] in sure and not b[w] and w not in strength})
    marks = [w for w, _ in sorted(strength.items(), key=lambda x: (x[1], x[0]))]
    usual = [w for w, _ in sorted(b.items(), key=lambda x: (x[1], x[0]))]
    base = b" ".join(last(usual, 1, most)) + PAD
    return base, base + b"".join(b" " + w + PAD for w in last(marks, 1 + len(PAD), most))  # padded as the windows are: a mark is one match


class Differ:
    """Length differences of windows under the two dictionaries, remembered by window."""

    def __init__(self, base: bytes, marked: bytes):
        self.known: dict[bytes, int] = {}
        self.by = []
        for raw in (base, marked):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def lengths(self, which: int, windows: list[bytes]) -> np.ndarray:
        out = self.by[which].multi_compress_to_buffer(windows)
        return np.fromiter((len(out[i]) for i in range(len(out))), dtype=np.int64, count=len(out))

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        words = [split(t) for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        new = list({w for ws in words for w in ws if w not in known})
        if new:
            windows = [b" " + w + PAD for w in new]
            self.known.update(zip(new, (self.lengths(0, windows) - self.lengths(1, windows)).tolist(), strict=True))
        for ws in words:
            yield np.fromiter(map(self.known.__getitem__, ws), dtype=np.int64, count=len(ws))


def inputs(d: np.ndarray) -> list[float]:
    """How many windows reach each length difference, and what share of all."""
    n = [int((d >= cut).sum()) for cut in CUTS]
    return [1.0, *(math.log1p(x) for x in n), *(math.log1p(1000 * x / max(1, len(d))) for x in n)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 50) -> np.ndarray:
    """Coefficients by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -5, 5)
    return w


def train(toxic: list[str], ordinary: list[str], share: float) -> dict:
    """Threshold and fit from a third of the rows that the dictionaries haven't seen; then dictionaries of all rows."""
    t, o = len(toxic) * 2 // 3, len(ordinary) * 2 // 3
    base, marked = dictionaries(toxic[:t], ordinary[:o])
    differ = Differ(base, marked)
    found = [*differ(toxic[t:]), *differ(ordinary[o:])]
    y = np.array([1.0] * (len(toxic) - t) + [0.0] * (len(ordinary) - o))
    w = logistic(np.array([inputs(d) for d in found]).reshape(len(found), -1), y)
    seen = y.mean() if len(y) else 0.5
    w[0] += math.log(share / (1 - share)) - math.log(seen / (1 - seen))
    base, marked = dictionaries(toxic, ordinary)
    return {"base": base, "marked": marked, "w": w}


def fit(sample: DataFrame, counts: dict) -> dict | None:
    if not (counts.get(0) and counts.get(1)):
        return None
    share = counts[1] / (counts[0] + counts[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t or "", c) for b in batches for i, t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        rng = np.random.default_rng(5)
        rows = [rows[i] for i in rng.permutation(len(rows))]
        if len({c for _, _, c in rows}) < 2:  # the labelled rows' texts are missing
            return
        model = train([t for _, t, c in rows if c == 1], [t for _, t, c in rows if c == 0], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else None


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, folds: int = 3, held: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with ``held_out``, ``score`` and ``predicted``.

    The dictionaries come from about ``per_class`` rows of each label, held-out
    rows excluded; every window of every whole text is compared.
    """
    learn = labels.filter(crc_mod(id_col, folds) != held).select(F.col(id_col), F.col("toxic").cast("int").alias("label"))
    sample, counts = sample_labelled(docs, learn, per_class, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample, counts))
    base, cols, back = with_text(docs, text_col, keep, ["held_out", "score", "predicted"], held_out=F.coalesce(crc_mod(id_col, folds) == held, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        differ = Differ(m["base"], m["marked"]) if m else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            score = np.zeros(len(texts))
            for at in range(0, len(texts) if m else 0, 128):
                for i, d in enumerate(differ(texts.slice(at, 128).to_pylist()), at):
                    score[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(inputs(d), m["w"]))))))
            columns = [batch.column(i) for i in range(len(cols))] + [batch.column(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*cols, "held_out", "score", "predicted"])

    schema = T.StructType([*base.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return back(base.mapInArrow(run, schema))
