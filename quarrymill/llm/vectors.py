"""Near-duplicate vectors by spherical k-means cells, and exact top-k search.

**Near duplicates.** Equal vectors collapse to one class. Spherical k-means, fit
on a bounded sample, gives cells; every class lives in its nearest cell. Near
cells are joined to blocks of bounded size, and a large cell is cut into several.
A class goes to every block with a cell that a vector within the angle of
``least`` can live in: bounds by the triangle inequality, which drop no pair.
Cosine products compare each two blocks once, so all links are found whatever
the cells are; they only decide how much is compared. Where vectors have no
groups, as in noise, all blocks meet. Components of the links give the groups.

**Exact search.** Components are quantised to integers. Vectors are dealt into
blocks, and each block's impact-ordered index is built and written once: posting
lists of places by component and quantised impact, the power of two that a
component reaches. A block of queries walks a block's segments score at a time, by
descending impact; bounds on what is unseen prove when few vectors can still be
among the best, and those are scored exactly.

Defined cases: a vector that is null, holds a null or non-finite component, or
(near duplicates) has no length takes no part: it is linked with nothing, and
neither asks nor answers. Shorter vectors count as padded with zeros. Repeated
rows are returned each; a query never finds a row of its own id. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.shared import by_group, connected_components, list_rows, named, whole_groups
from quarrymill.storage import materialize


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components, not empty."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(True))


def padded(vector: str, width: int) -> Column:
    return F.concat(F.col(vector), F.array_repeat(F.lit(0.0), F.lit(width) - F.size(vector)))


def rows_of(column: pa.ChunkedArray) -> np.ndarray:
    values, offsets = list_rows(column)
    return values.reshape(len(offsets) - 1, -1)


def centroids(sample: DataFrame, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means in one task over a bounded sample of unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), rows_of(b.column(1))) for b in batches if b.num_rows]
        order = np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")
        x = np.concatenate([p[1] for p in parts])[order]
        c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(rounds):
            near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(c)], pa.binary())], ["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first()["model"])


def tour(c: np.ndarray) -> np.ndarray:
    """An order of the centroids in which each is followed by its nearest that is left."""
    order, left = [0], np.ones(len(c), dtype=bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, c @ c[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return np.array(order)


def layout(c: np.ndarray, sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: runs of the tour of at most ``block`` rows, or one larger cell in several."""
    first, count, at, held = np.zeros(len(c), np.int64), np.ones(len(c), np.int64), 0, 0
    for cell in tour(c):
        if held and held + sizes[cell] > block:
            at, held = at + 1, 0
        first[cell], count[cell] = at, max(1, -(-int(sizes[cell]) // block))
        held += int(sizes[cell])
        if count[cell] > 1:
            at, held = at + int(count[cell]), 0
    return first, count


def reach(near: np.ndarray, c: np.ndarray, gaps: np.ndarray, low: np.ndarray, high: np.ndarray, least: float, probes: int) -> np.ndarray:
    """Which cells (columns) may hold a vector whose cosine with a row is ``least`` or more; ``near`` has cosines with the centroids.

    Angles to a centroid differ by at most the pair's angle. A vector of cell c is
    not nearer to another centroid g, so it lies on c's side of the plane between
    them, and the row lies at most the pair's angle beyond it: tried for the row's
    ``probes`` nearest g.
    """
    turn, slack = np.arccos(np.clip(least, -1, 1)), 1e-6
    angle = np.arccos(np.clip(near, -1, 1))
    may = (angle <= high + turn + slack) & (angle >= low - turn - slack)
    if least > 0:
        p = min(probes, len(c))
        for g in np.argpartition(-near, p - 1, axis=1)[:, :p].T:
            may &= near[np.arange(len(near)), g][:, None] - near <= np.sin(turn) * gaps[g] + slack
    return may


def links_of(x: np.ndarray, y: np.ndarray | None, least: float, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of ``x`` and ``y`` (of two of ``x`` without ``y``) with a cosine of ``least`` or more.

    Short products are trusted where they cannot be wrong about it; the others are done again in double.
    """
    wide, error = x if y is None else y, (x.shape[1] + 8) * 2.0**-22
    short_x, short_y = x.astype(np.float32), wide.astype(np.float32)
    for at in range(0, len(x), rows):
        score = short_x[at : at + rows] @ short_y.T
        i, j = np.nonzero(score >= least - error)
        score = score[i, j]
        i = i + at
        keep = np.ones(len(i), dtype=bool) if y is not None else i < j
        doubt = np.flatnonzero(keep & (score < least + error))
        for k in range(0, len(doubt), 100_000):
            d = doubt[k : k + 100_000]
            keep[d] = np.einsum("ij,ij->i", x[i[d]], wide[j[d]]) >= least
        if keep.any():
            yield i[keep], j[keep]


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest positions of components, after more links."""
    a, b = root[i], root[j]
    apart = a != b
    a, b = a[apart], b[apart]
    label = np.arange(len(root))
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, new[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label[root]


def near_vectors(table: DataFrame, least: float = 0.95, probes: int = 4, cell_size: int = 400, most_cells: int = 2048, sample_size: int = 20_000, block: int = 256, most_block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``.

    ``probes``, ``cell_size``, ``most_cells``, ``sample_size`` and the two bounds of a
    block's rows change what is compared, not the result.
    """
    spark = table.sparkSession
    rows = table.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<double>").alias("v"))
    keyed = rows.withColumn("key", F.when(usable("v") & F.exists("v", lambda x: x != 0), F.transform("v", lambda x: x + F.lit(0.0))))
    some = keyed.filter("key is not null and id is not null")
    found = some.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies")).select("key", F.col("key").alias("v"), "first", "copies", F.monotonically_increasing_id().alias("rep"))
    classes = materialize(found, "classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    full = classes.select("rep", "copies", padded("v", width).alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rows_of(b.column(2)) if b.num_rows else np.zeros((0, width))
            x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["rep", "copies", "v"])

    units = materialize(full.mapInArrow(unit, "rep long, copies long, v array<double>"), "unit-vectors")
    share = min(1.0, sample_size / n)
    draw = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    cells = max(1, min(most_cells, n // cell_size))
    sample = units.filter(draw <= share).select("rep", "v")
    model = spark.sparkContext.broadcast(centroids(sample, cells) if not sample.isEmpty() else np.zeros((1, width)))

    def cosines(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, b.num_rows, 1024):
            yield at, rows_of(b.column(2).slice(at, 1024)) @ model.value.T

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, high = np.zeros(len(model.value), np.int64), np.full(len(model.value), np.inf), np.full(len(model.value), -np.inf)
        for b in batches:
            for _, near in cosines(b):
                home, best = near.argmax(axis=1), near.max(axis=1)
                np.add.at(size, home, 1)
                np.minimum.at(low, home, best)
                np.maximum.at(high, home, best)
        has = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(size[has]), pa.array(low[has]), pa.array(high[has])], ["cell", "size", "low", "high"])

    measured = units.mapInArrow(measure, "cell long, size long, low double, high double").groupBy("cell").agg(F.sum("size"), F.min("low"), F.max("high")).collect()  # at most most_cells rows
    c = model.value
    size, low, high = np.zeros(len(c), np.int64), np.full(len(c), np.inf), np.full(len(c), -np.inf)  # angles: nothing reaches an empty cell
    for r in measured:
        size[r[0]], high[r[0]], low[r[0]] = r[1], np.arccos(np.clip(r[2], -1, 1)), np.arccos(np.clip(r[3], -1, 1))
    first, count = layout(c, size, max(block, min(most_block, n // 24)))  # some hundreds of units at least, where there are rows for them
    n_blocks = int((first + count).max())
    gaps = np.sqrt(np.maximum(0.0, (c * c).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * c @ c.T))
    plan = spark.sparkContext.broadcast((first, count, low, high, gaps))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count, low, high, gaps = plan.value
        cells = np.flatnonzero(low <= high)
        spread = np.repeat(cells, count[cells])  # the cell of each column below
        blocks = first[spread] + np.arange(len(spread)) - np.repeat(np.cumsum(count[cells]) - count[cells], count[cells])
        order = np.argsort(blocks, kind="stable")
        spread, starts = spread[order], np.flatnonzero(np.diff(blocks[order], prepend=-1))
        names = blocks[order][starts]
        for b in batches:
            mixed = b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            for at, near in cosines(b):
                home = near.argmax(axis=1)
                own = first[home] + (mixed[at : at + len(home)] % count[home].astype(np.uint64)).astype(np.int64)
                may = reach(near, model.value, gaps, low, high, least, probes)
                may[np.arange(len(home)), home] = True
                i, k = np.nonzero(np.logical_or.reduceat(may[:, spread], starts, axis=1))
                other = names[k]
                unit = np.minimum(own[i], other) * n_blocks + np.maximum(own[i], other)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(len(home) + 1)).astype(np.int32)), pa.array(unit))
                yield pa.RecordBatch.from_arrays([*(x.slice(at, len(home)) for x in b.columns), pa.array(own), lists], ["rep", "copies", "v", "block", "units"])

    placed = units.mapInArrow(assign, "rep long, copies long, v array<double>, block long, units array<long>")
    pairs = placed.select(F.explode("units").alias("unit"), "rep", "copies", "v", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, "unit"):
            unit, rep, copies, blk = (t.column(c).to_numpy() for c in ("unit", "rep", "copies", "block"))
            x = rows_of(t.column("v"))
            out_a, out_b, out_n = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                one, two = divmod(int(unit[a]), n_blocks)
                p = a + np.flatnonzero(blk[a:b] == one)
                q = p if one == two else a + np.flatnonzero(blk[a:b] == two)
                degree, root = np.zeros(b - a, np.int64), np.arange(b - a)
                for i, j in links_of(x[p], None if one == two else x[q], least):
                    i, j = p[i] - a, q[j] - a
                    degree += (np.bincount(i, copies[a + j], b - a) + np.bincount(j, copies[a + i], b - a)).astype(np.int64)
                    root = join_roots(root, i, j)
                has = np.flatnonzero(degree)
                if len(has):
                    out_a.append(rep[a + has])
                    out_b.append(rep[a + root[has]])
                    out_n.append(degree[has])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in (out_a, out_b, out_n)], ["a", "b", "n"])

    links = materialize(by_group(pairs, "unit").mapInArrow(compare, "a long, b long, n long"), "links")
    degrees = links.groupBy("a").agg(F.sum("n").alias("n"))
    labels = connected_components(links)
    placed = classes.select("key", "rep", "first", "copies").join(degrees, F.col("rep") == F.col("a"), "left").join(labels, F.col("rep") == F.col("node"), "left")
    placed = placed.select("key", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group"))
    least = placed.groupBy("group").agg(F.min("first").alias("component"))
    out = keyed.select("id", "key").join(placed.join(least, "group"), "key", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.when(F.col("id").isNotNull(), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), component).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def postings(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A block's index: rows of component, quantised impact (a power of two), places and components.

    The row of component -1 has the vectors' ids and squared lengths.
    """
    yield -1, 0, ids, (x * x).sum(axis=1)
    size = np.frexp(np.abs(x))[1]  # 2^(e-1) <= |component| < 2^e
    for j in range(x.shape[1]):
        some = np.flatnonzero(x[:, j])
        some = some[np.argsort(-size[some, j], kind="stable")]
        cuts = np.flatnonzero(np.diff(size[some, j])) + 1
        for part in np.split(some, cuts):
            if len(part):
                yield j, int(size[part[0], j]), part, x[part, j]


def impact_search(lists: list[tuple[int, int, np.ndarray, np.ndarray]], ids: np.ndarray, squares: np.ndarray, q: np.ndarray, own: np.ndarray, k: int, few: int = 32, share: float = 0.3) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, ids and scores of the ``k`` best of a block for each query, ties to smaller ids.

    Segments of postings are added by descending impact, each to the scores of the
    queries that have its component. What is unseen of a vector adds at most the
    length that it has left times the query's. The walk ends once that proves that
    few vectors can still be among the best, which are then scored whole, or with
    the last segment. ``own`` holds the queries' ids, left out of their answers.
    """
    n, width = len(ids), q.shape[1]
    peak = max((float(np.abs(v).max()) for _, _, _, v in lists), default=0.0)
    if width * peak * float(np.abs(q).max(initial=0.0)) >= 2.0**53:
        raise ValueError("scores of 2^53 and more are not exact: scale the vectors down")
    length, score, left = np.linalg.norm(q, axis=1), np.zeros((n, len(q))), squares.astype(np.float64)
    score[ids[:, None] == own[None, :]] = -np.inf
    levels = sorted({e for _, e, _, _ in lists}, reverse=True)
    by_level = {e: [x for x in lists if x[1] == e] for e in levels}
    may, seen = score > -np.inf, 0
    for e in levels:
        seen += 1
        for j, _, places, values in by_level[e]:
            asks = np.flatnonzero(q[:, j])
            if len(asks) == len(q):
                score[places] += values[:, None] * q[None, :, j]
            elif len(asks):
                score[np.ix_(places, asks)] += values[:, None] * q[None, asks, j]
            left[places] -= values * values
        rest = np.sqrt(np.maximum(left, 0.0))
        if seen < len(levels) and np.mean(rest <= share * np.sqrt(squares)) < 0.5:
            continue  # nothing can be proven yet
        slack = rest[:, None] * (length * (1 + 1e-9))[None, :]
        bar = np.partition(score - slack, -k, axis=0)[-k] if n > k else np.full(len(q), -np.inf)
        may = (score + slack >= bar[None, :]) & (score > -np.inf)
        if may.sum() <= max(few, k) * len(q):
            break
    i, j = np.nonzero(may)
    exact = score[i, j]
    if seen < len(levels):
        x = np.zeros((n, width))
        for c, _, places, values in lists:
            x[places, c] = values
        exact = np.einsum("ij,ij->i", x[i], q[j])
    order = np.lexsort((ids[i], -exact, j))
    i, j, exact = i[order], j[order], exact[order]
    best = np.arange(len(j)) - np.searchsorted(j, np.arange(len(q)))[j] < k
    yield own[j[best]], ids[i[best]], exact[best]


def exact_topk(table: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, block: int = 4096, query_block: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products for each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``every``; all other rows
    answer. Of several rows with a query's id the least vector asks. The index of
    a block of vectors is built once; its posting lists then go to each block of
    queries.
    """
    rows = table.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<double>").alias("v")).filter("id is not null").filter(usable("v"))
    whole = rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    n, width, asked = whole.agg(F.count("*"), F.max(F.size("v")), F.count_if(F.pmod("id", F.lit(every)) == 0)).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-asked // query_block))
    whole = whole.select("id", padded("v", width or 0).alias("v"))
    spot = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, "block"):
            of, ids, v = t.column("block").to_numpy(), t.column("id").to_numpy(), rows_of(t.column("v"))
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                lists = list(postings(ids[a:b], v[a:b]))
                offsets = np.concatenate([[0], np.cumsum([len(x[2]) for x in lists])]).astype(np.int32)
                columns = [pa.array([int(of[a])] * len(lists)), pa.array([x[0] for x in lists], pa.int32()), pa.array([x[1] for x in lists], pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x[c] for x in lists]).astype(kind))) for c, kind in ((2, np.int64), (3, np.float64)))], ["block", "component", "impact", "places", "parts"])

    index = materialize(by_group(whole.select(spot(blocks).alias("block"), "id", "v"), "block").mapInArrow(build, "block long, component int, impact int, places array<long>, parts array<double>"), "impact-index")
    questions = whole.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v")).select(spot(query_blocks).alias("mine"), "id", "v")
    unit = lambda q, b: (q * F.lit(blocks) + b).alias("unit")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    lists = index.withColumn("other", each(query_blocks)).select(unit(F.col("other"), F.col("block")), "component", "impact", "places", "parts")
    asks = questions.withColumn("other", each(blocks)).select(unit(F.col("mine"), F.col("other")), F.lit(-2).alias("component"), F.lit(0).alias("impact"), F.array("id").alias("places"), F.col("v").alias("parts"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, "unit"):
            kind, impact = t.column("component").to_numpy(), t.column("impact").to_numpy()
            (places, at), (parts, to) = list_rows(t.column("places")), list_rows(t.column("parts"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                asking, head = a + np.flatnonzero(kind[a:b] == -2), a + np.flatnonzero(kind[a:b] == -1)
                if not len(asking) or not len(head):
                    continue
                h, held = int(head[0]), [(int(kind[i]), int(impact[i]), places[at[i] : at[i + 1]], parts[to[i] : to[i + 1]]) for i in range(a, b) if kind[i] >= 0]
                q, own = np.stack([parts[to[i] : to[i + 1]] for i in asking]), np.array([places[at[i]] for i in asking])
                out += impact_search(held, places[at[h] : at[h + 1]], parts[to[h] : to[h + 1]], q, own, k)
            if out:
                columns = [np.concatenate([o[c] for o in out]).astype(np.int64) for c in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    best = by_group(lists.unionByName(asks), "unit").mapInArrow(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
