"""Hard negatives by one-dimensional distance keys.

Vectors are augmented by one component that gives all the same length, so that
the highest inner product with an anchor is the nearest augmented vector. Each
is keyed by its nearest pivot (spherical k-means on a bounded sample) and its
distance from it, and stored sorted by (pivot, distance), in blocks of about
``block`` rows. A run of keys holds an annulus around its pivot: by the triangle
inequality no row in it is nearer to an anchor than the anchor's distance to the
annulus, nor farther than the pivot's distance plus the outer radius.

An anchor walks a block's runs by growing distance, doubling their number at
each step, and stops when the distance of the nearest run that is left certifies
that no row behind it can be among the best; runs wholly nearer than its window
begins are left out. Scores are integers and exact; the distances only decide
what is read. Positives are found first, then the negatives of all windows of an
anchor in one walk. Blocks of anchors meet blocks of the index, each once, and
the bests of all blocks are merged.

Defined cases: rows with a null label, id or vector, or a null or non-finite
component, take no part. Shorter vectors count as padded with zeros. Rows that
share an id are never each other's positive or negative; of several with an
anchor's id the least vector and label asks. A repeated row answers each time.
Ties go to the smaller id, then to the smaller label. Equal positives (repeated
rows) give one list each. Anchors without positives, or
whose windows are empty, give no rows; so does an empty table. Scores of 2^53
and more raise an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.shared import by_group, list_rows, named, whole_groups
from quarrymill.llm.vectors import centroids, padded, rows_of, usable
from quarrymill.storage import materialize

RUN, SLACK = 256, 1e-7


def unit_vectors(v: np.ndarray, length: float) -> np.ndarray:
    """Vectors with the augmenting component, scaled to length 1."""
    rest = np.sqrt(np.maximum(0.0, length**2 - (v * v).sum(axis=1)))
    return np.concatenate([v, rest[:, None]], axis=1) / max(length, 1e-300)


class Best:
    """The ``k`` highest scores of each of some lists; ties to the smaller id, then label."""

    def __init__(self, lists: int, k: int):
        self.score, self.place, self.label = np.full((lists, k), -np.inf), np.zeros((lists, k), np.int64), np.zeros((lists, k), np.int64)

    @property
    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, of: np.ndarray, score: np.ndarray, place: np.ndarray, label: np.ndarray) -> None:
        if not len(of):
            return
        met = np.unique(of)
        k = self.score.shape[1]
        of, score, place, label = (np.concatenate(x) for x in ((of, np.repeat(met, k)), (score, self.score[met].ravel()), (place, self.place[met].ravel()), (label, self.label[met].ravel())))
        order = np.lexsort((label, place, -score, of))
        nth = np.arange(len(of)) - np.repeat(np.searchsorted(of[order], met), np.diff(np.append(np.searchsorted(of[order], met), len(of))))
        order, nth = order[nth < k], nth[nth < k]
        at = of[order], nth
        self.score[at], self.place[at], self.label[at] = score[order], place[order], label[order]

    def found(self) -> tuple[np.ndarray, ...]:
        """List, score, id's place and label of all that was found."""
        of, nth = np.nonzero(self.score > -np.inf)
        return of, self.score[of, nth], self.place[of, nth], self.label[of, nth]


class Block:
    """A block of the index and its runs of keys."""

    def __init__(self, pivot: np.ndarray, distance: np.ndarray, ids: np.ndarray, label: np.ndarray, v: np.ndarray):
        cut = np.flatnonzero(pivot[1:] != pivot[:-1]) + 1
        edges = np.concatenate([[0], cut, [len(pivot)]])
        starts = np.concatenate([np.arange(a, b, RUN) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        self.starts, self.ends = starts, np.append(starts[1:], len(pivot))
        self.low, self.high, self.of = distance[starts], distance[self.ends - 1], pivot[starts]
        self.place, self.label, self.v = np.unique(ids, return_inverse=True)[1], label, v
        self.ids = ids


def walk(block: Block, q: np.ndarray, own: np.ndarray, label: np.ndarray, near: np.ndarray, length: float, same: bool, most: np.ndarray, least: np.ndarray, k: int) -> Best:
    """The best rows of a block for each anchor and window (``most``, ``least``: scores, a column for each window).

    ``near`` has the anchors' distances to all pivots.
    """
    n, windows = most.shape
    best = Best(n * windows, k)
    norm = np.linalg.norm(q, axis=1)
    here = near[:, block.of]
    nearest = np.maximum(0.0, np.maximum(here - block.high, block.low - here) - SLACK)
    farthest = here + block.high + SLACK
    side = 1.0 + (norm > 0)  # squared lengths: the index's and the anchor's, 0 for an anchor of zeros
    highest, lowest = ((side[:, None] - d**2) / 2 * (length * norm)[:, None] for d in (nearest, farthest))
    highest, lowest = highest + np.abs(highest) * 1e-9 + 1e-6, lowest - np.abs(lowest) * 1e-9 - 1e-6
    order = np.argsort(-highest, axis=1, kind="stable")
    outside = lowest > most.max(axis=1)[:, None]  # nearer than all windows
    active, at, step = np.flatnonzero((most >= least).any(axis=1)), 0, 1
    while len(active) and at < order.shape[1]:
        runs = order[active, at : at + step]
        for r in np.unique(runs):
            who = active[(runs == r).any(axis=1)]
            who = who[~outside[who, r]]
            a, b = block.starts[r], block.ends[r]
            if not len(who):
                continue
            score = q[who] @ block.v[a:b].T
            fits = (block.label[a:b] == label[who][:, None]) == same
            fits &= block.ids[a:b] != own[who][:, None]
            for w in range(windows):
                i, j = np.nonzero(fits & (score <= most[who, w, None]) & (score >= np.maximum(least[who, w], best.kth[who * windows + w])[:, None]))
                best.add(who[i] * windows + w, score[i, j], block.place[a:b][j], block.label[a:b][j])
        at, step = at + step, step * 2
        if at < order.shape[1]:
            left = highest[active, order[active, at]][:, None]
            kth = best.kth.reshape(n, windows)[active]
            active = active[((kth <= left) & (least[active] <= left) & (most[active] >= least[active])).any(axis=1)]
    return best


def mine(table: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: float = 256.0, block: int = 4096, anchor_block: int = 4096, pivots: int = 128, sample_size: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``. A negative's score lies between the two
    percentages (``window``) of its positive's.
    """
    rows = table.select(named(id_col).cast("long").alias("id"), named(label_col).cast("string").alias("label"), named(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter("id is not null and label is not null").filter(usable("v")).select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, width, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    length = float(longest or 0.0) ** 0.5
    if length**2 >= 2.0**53:
        raise ValueError("scores of 2^53 and more are not exact")
    rows = rows.select("id", "label", padded("v", width or 0).alias("v"))
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return table.sparkSession.createDataFrame([], columns)

    # The pivots: fit on a bounded sample; every row is keyed.
    share = min(1.0, sample_size / n)
    drawn = rows.withColumn("key", F.xxhash64("id", "v")).filter(F.pmod("key", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).select("key", "v")

    def augment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit_vectors(rows_of(b.column(1)), length)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]).astype(np.int32)), pa.array(x.ravel()))], ["key", "v"])

    c = centroids(drawn.mapInArrow(augment, "key long, v array<double>"), max(1, min(pivots, n // 64)))
    sent = table.sparkSession.sparkContext.broadcast(c)
    apart = lambda x: np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (sent.value**2).sum(axis=1) - 2 * x @ sent.value.T))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = apart(unit_vectors(rows_of(b.column(2)), length))
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(d[np.arange(len(at)), at]), *b.columns], ["pivot", "distance", "id", "label", "v"])

    keyed = rows.mapInArrow(key, "pivot long, distance double, id long, label string, v array<double>")
    blocks, order = max(1, -(-n // block)), ["pivot", "distance", "id"]
    index = materialize(keyed.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id().cast("long")), "distance-keys")
    anchors = index.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("v", "label")).alias("a")).select("id", "a.label", "a.v")
    count = anchors.count()
    anchor_blocks, index_blocks = max(1, -(-count // anchor_block)), index.agg(F.max("block")).first()[0] + 1
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    unit = lambda a, b: (a * F.lit(index_blocks) + b).alias("unit")
    stored = index.withColumn("other", each(anchor_blocks)).select(unit(F.col("other"), F.col("block")), "pivot", "distance", "id", "label", "v", F.array().cast("array<double>").alias("tops"))

    def search(asks: DataFrame, same: bool, k: int) -> DataFrame:
        """``anchor, top, id, label, score``: the ``k`` best of each block for each anchor and positive score (``tops``)."""
        asking = asks.withColumn("other", each(index_blocks)).select(unit(F.pmod(F.xxhash64("id"), F.lit(anchor_blocks)), F.col("other")), F.lit(-1).cast("long").alias("pivot"), F.lit(0.0).alias("distance"), "id", "label", "v", "tops")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, bounds in whole_groups(batches, "unit"):
                t = t.combine_chunks()
                names = t.column("label").combine_chunks().dictionary_encode()
                names = names.chunk(0) if isinstance(names, pa.ChunkedArray) else names
                order = np.argsort(np.array(names.dictionary.to_pylist(), dtype=object)).argsort()
                label = order[names.indices.to_numpy()]
                back = np.array(names.dictionary.to_pylist(), dtype=object)[np.argsort(order)]
                pivot, distance, ids, v = t.column("pivot").to_numpy(), t.column("distance").to_numpy(), t.column("id").to_numpy(), rows_of(t.column("v"))
                tops, to = list_rows(t.column("tops"))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    who, held = a + np.flatnonzero(pivot[a:b] < 0), a + np.flatnonzero(pivot[a:b] >= 0)
                    if not len(who) or not len(held):
                        continue
                    held = held[np.lexsort((ids[held], distance[held], pivot[held]))]
                    index_part = Block(pivot[held], distance[held], ids[held], label[held], v[held])
                    q = v[who]
                    norm = np.linalg.norm(q, axis=1, keepdims=True)
                    near = apart(np.concatenate([np.divide(q, norm, out=np.zeros_like(q), where=norm > 0), np.zeros((len(q), 1))], axis=1))
                    windows = max(1, int((to[who + 1] - to[who]).max()))
                    top = np.full((len(who), windows), np.nan)
                    for i, x in enumerate(who):
                        top[i, : to[x + 1] - to[x]] = tops[to[x] : to[x + 1]]
                    if same:
                        most, least = np.full((len(who), 1), np.inf), np.full((len(who), 1), -np.inf)
                    else:  # an absent or negative positive score has no window
                        whole = np.nan_to_num(top, nan=-1.0).astype(np.int64)
                        most, least = (window[1] * whole // 100).astype(float), (-(-window[0] * whole // 100)).astype(float)
                        none = (whole < 0) | (most < least)
                        most[none], least[none] = -np.inf, np.inf
                    of, scores, place, named_ = walk(index_part, q, ids[who], label[who], near, length, same, most, least, k).found()
                    known = np.unique(ids[held])
                    score = top.ravel()[of] if not same else np.zeros(len(of))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who][of // windows]), pa.array(score.astype(np.int64)), pa.array(known[place]), pa.array(back[named_].tolist(), pa.string()), pa.array(scores.astype(np.int64))], ["anchor", "top", "id", "label", "score"])

        best = by_group(stored.unionByName(asking), "unit").mapInArrow(run, "anchor long, top long, id long, label string, score long")
        w = Window.partitionBy("anchor", "top").orderBy(F.desc("score"), "id", "label")
        return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    wanted = materialize(search(anchors.withColumn("tops", F.array().cast("array<double>")), True, positives), "positives")
    tops = wanted.groupBy("anchor").agg(F.collect_set(F.col("score").cast("double")).alias("tops"))  # ``positives`` values at most
    asks = anchors.join(tops, F.col("id") == F.col("anchor")).select("id", "label", "v", "tops")
    found = search(asks, False, negatives).select("anchor", F.col("top").alias("score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = wanted.select("anchor", F.col("id").alias("positive_id"), "score")
    out = pairs.join(found, ["anchor", "score"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
