"""Near-duplicate documents by a chosen-path set-similarity join.

Every document is the set of its distinct word shingles. Equal sets collapse to
one class first, so exact copies never meet in a comparison. Each class carries
a sketch of minwise tokens. Independent trees branch the classes by selected
minwise tokens: two sets of similarity s meet in a child with probability
1 - (1 - s)^2 at each level. A node with few members is compared exhaustively;
a larger one branches again, unless its members are alike (then no token would
part them): it is compared in blocks of bounded size. Candidate pairs are
confirmed on the full sets, and components of the links give the groups.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing (``component_id`` is their own id). A null id takes no part
(``component_id`` is null, ``kept`` is true). Repeated rows are copies: each row
is returned. Rows that share an id but not a text are documents of their own:
classes are keyed by the digest of their set, never by an id. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.bloom import bloom_filter, may_hold
from quarrymill.llm.shared import by_group, connected_components, list_rows, named, private, whole_groups
from quarrymill.llm.texthash import mix, powers, shingles, spans, text_bytes, words
from quarrymill.storage import Scratch

SKETCH = 64
#: Children of a node: it branches by this many minwise tokens.
BRANCHES = 2


def digest_of(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def sketch_sets(k: int, seed: int):
    """Batches of (id, text, text_hash) to (id, text_hash, n_shingles, digest, sketch)."""
    multipliers = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) + np.uint64(seed * 1000)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in spans(offsets):
                h, bounds = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tables)
                sizes, digests, rows = [], [], []
                for x in shingles(h, bounds, k):
                    sizes.append(len(x))
                    digests.append(digest_of(x) if len(x) else None)
                    if len(x):
                        least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
                        for at in range(0, len(x), 512):
                            np.minimum(least, (multipliers[:, None] * x[None, at : at + 512]).min(axis=1), out=least)
                        rows.append((least >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    else:
                        rows.append(np.zeros(SKETCH, np.int32))
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SKETCH), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), sketch], ["id", "text_hash", "n_shingles", "digest", "sketch"])

    return run


def full_sets(k: int, filled: Broadcast):
    """Batches of (id, text) to (digest, set): the sorted shingle hashes as bytes.

    Only ids that the Bloom filter lets through; the join that follows is exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers()
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(filled.value, batch.column(0).to_numpy())))
            data, offsets = text_bytes(batch.column(1))
            for a, b in spans(offsets):
                h, bounds = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tables)
                sets = [x for x in shingles(h, bounds, k) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([digest_of(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["digest", "set"])

    return run


def candidates(least_equal: int, roots: int):
    """Per compared unit, the members that the sketches pair, each with its later partners.

    A pair that an earlier root node of both has compared already is left out:
    bit c of ``mask`` tells that root node c is compared exhaustively.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "unit"):
            reps, blocks, masks = (table.column(c).to_numpy() for c in ("rep", "block", "mask"))
            across, root = table.column("across").to_numpy(zero_copy_only=False), table.column("root").to_numpy()
            values, _ = list_rows(table.column("sketch"))
            sketch = values.reshape(-1, SKETCH)
            units, out = table.column("unit").to_numpy(), []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                s = sketch[a:b]
                earlier = min(roots, int(root[a]))
                done = ((masks[a:b, None] >> np.arange(earlier)) & 1).astype(bool)
                take = np.zeros((b - a, b - a), dtype=bool)
                for at in range(0, b - a, 64):  # bounds the memory of one comparison
                    same = s[at : at + 64, None, :] == s[None, :, :]
                    take[at : at + 64] = (same.sum(axis=2) >= least_equal) & ~(same[:, :, :earlier] & done[at : at + 64, None, :]).any(axis=2)
                take = np.triu(take, 1)
                if across[a]:
                    take &= blocks[a:b, None] != blocks[None, a:b]
                i, j = np.nonzero(take)
                keep = reps[a + i] != reps[a + j]
                i, j = i[keep], j[keep]
                for x in np.unique(np.concatenate([i, j])).tolist():
                    out.append((units[a + x], reps[a + x], reps[a + j[i == x]]))
            if out:
                lists = [x[2] for x in out]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).astype(np.int64)))], ["unit", "rep", "partners"])

    return run


def confirm(percent: int):
    """Links of each unit, confirmed on the full sets: 100 * |A and B| >= percent * |A or B|.

    A pair that links of the same unit already join is not compared again: the
    components stay the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "unit"):
            reps = table.column("rep").to_numpy()
            partners, at = list_rows(table.column("partners"))
            raw = table.column("set")
            found: list[tuple[int, int]] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                place = {r: i for i, r in enumerate(reps[a:b].tolist())}
                sets = [np.frombuffer(raw[i].as_py(), dtype=np.uint64) for i in range(a, b)]
                parent = list(range(b - a))

                def top(i: int, parent: list[int] = parent) -> int:
                    while parent[i] != i:
                        parent[i] = i = parent[parent[i]]
                    return i

                for i in range(b - a):
                    for other in partners[at[a + i] : at[a + i + 1]].tolist():
                        j = place.get(other)
                        if j is None or top(i) == top(j):
                            continue
                        x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                        if 100 * len(x) < percent * len(y):
                            continue
                        spot = np.searchsorted(y, x)
                        spot[spot == len(y)] = 0
                        both = int((y[spot] == x).sum())
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            parent[top(i)] = top(j)
                            found.append((int(reps[a + i]), other))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return run


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    trees: int = 4,
    node_size: int = 128,
    block_size: int = 512,
    least_equal: int = 38,
    max_depth: int = 12,
    seed: int = 1,
) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept, text_hash, group``.

    ``text_hash`` is the text's MD5; ``group`` numbers the groups, also where two hold rows of one id.

    ``trees`` times two minwise tokens start the branching: a pair at exactly 0.8
    shares none of them with probability 0.2^8 = 2.6e-6. ``least_equal`` of 64
    sketch tokens make a candidate: 38 lies four deviations below 0.8, and a pair
    at exactly 0.8 falls below it with probability 4.3e-5. Each further level keeps
    such a pair together with probability 0.96, so a pair whose common nodes all
    branch d times is missed with (1 - 0.96^d)^8: 0.001 for d = 8 (the only loss
    that nodes beyond ``node_size`` that are not alike can bring). Nodes that
    branching does not part, and those ``max_depth`` levels down, are compared
    exhaustively in blocks.
    """
    roots = trees * BRANCHES
    tables = Scratch(docs.sparkSession)
    value = named(text_col).cast("string")
    text = docs.select(named(id_col).cast("long").alias("id"), value.alias("text"))
    hashed = text.select("id", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_hash"))
    sketches = tables.keep(hashed.mapInArrow(sketch_sets(shingle_words, seed), "id long, text_hash string, n_shingles long, digest binary, sketch array<int>"), "sketches")
    some = sketches.filter("digest is not null and id is not null")
    # The number of a class is fixed once its table is written.
    classes = tables.keep(some.groupBy("digest").agg(F.min(F.struct("id", "sketch")).alias("x")).select("digest", F.col("x.id").alias("first"), F.col("x.sketch").alias("sketch"), F.monotonically_increasing_id().alias("rep")), "classes")

    # Root level: a node is (token number, token).
    tokens = F.transform(F.slice("sketch", 1, roots), lambda v, i: F.xxhash64(F.lit(seed), i, v))
    flat = classes.select("rep", F.posexplode(tokens).alias("root", "node"))
    counted = flat.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
    members = tables.keep(flat.join(counted, "node"), "roots")
    sketched = classes.select("rep", "sketch")

    def branch(nodes: DataFrame) -> DataFrame:
        """Large nodes' members in the children, by two tokens that the node selects."""
        token = [F.pmod(F.xxhash64("node", F.lit(i)), F.lit(SKETCH - roots)).cast("int") + roots for i in range(BRANCHES)]
        child = [F.xxhash64("node", t, F.element_at("sketch", t + 1)) for t in token]
        return nodes.select("rep", "mask", "sketch", F.col("node").alias("parent"), F.col("n").alias("parent_n"), F.explode(F.array_distinct(F.array(*child))).alias("node"))

    def child_sizes(nodes: DataFrame, level: int) -> DataFrame:
        n = branch(nodes).groupBy("node").agg(F.count("*").alias("n"), F.first("parent").alias("parent"), F.first("parent_n").alias("parent_n"))
        return tables.keep(n.filter("n > 1"), f"sizes{level}")

    def alike(n: DataFrame) -> DataFrame:
        """Nodes of which a child keeps half or more: branching would not part their members."""
        return n.filter("2 * n >= parent_n").select(F.col("parent").alias("node")).distinct().withColumn("dense", F.lit(True))

    n = child_sizes(members.filter(f"n > {node_size}").join(sketched, "rep").withColumn("mask", F.lit(0).cast("long")), 0)
    members = members.join(alike(n), "node", "left").withColumn("whole", F.col("dense").isNotNull() | (F.col("n") <= node_size))
    packed = members.groupBy("rep").agg(F.collect_list(F.struct("root", "node", "n", "whole", "dense")).alias("nodes"))
    mask = F.aggregate("nodes", F.lit(0).cast("long"), lambda m, x: F.when(x.whole, m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.root))).otherwise(m))
    rows = tables.keep(packed.join(sketched, "rep").select("rep", "sketch", mask.alias("mask"), F.explode("nodes").alias("x")).select("rep", "sketch", "mask", "x.*"), "members")
    compared, frontier = [rows.filter("whole")], rows.filter("not whole")
    for level in range(1, max_depth + 1):
        if frontier.isEmpty():
            break
        rows = tables.keep(branch(frontier).join(n.select("node", "n"), "node").withColumn("root", F.lit(roots)), f"level{level}")
        n = child_sizes(rows.filter(f"n > {node_size}"), level)
        rows = rows.join(alike(n), "node", "left")
        small = F.col("n") <= node_size
        compared.append(rows.filter(small | F.col("dense")))
        frontier = rows.filter(~small & F.col("dense").isNull())
    else:
        compared.append(frontier.withColumn("dense", F.lit(True)))  # in blocks, however large

    cols = ["rep", "root", "mask", "node", "n", "dense", "sketch"]
    nodes = compared[0].select(cols)
    for x in compared[1:]:
        nodes = nodes.unionByName(x.select(cols))
    # Small nodes are one unit; others are cut into blocks, and each pair of blocks is a unit.
    count = F.when(F.col("dense").isNotNull(), F.ceil(F.col("n") / block_size)).otherwise(F.lit(1)).cast("int")
    blocked = nodes.withColumn("count", count).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(seed)), F.col("count")).cast("int"))
    units = blocked.select("rep", "root", "mask", "node", "block", "sketch", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    units = units.select(F.xxhash64("node", low, high, F.lit("unit")).alias("unit"), "rep", "root", "mask", "block", (F.col("block") != F.col("other")).alias("across"), "sketch")
    # A unit of two blocks has rows of both; one row's own mark is the same for all.
    paired = tables.keep(by_group(units, "unit").mapInArrow(candidates(least_equal, roots), "unit long, rep long, partners array<long>"), "paired")

    tables.drop(*(n for n in list(tables.paths) if n not in ("sketches", "classes", "paired")))
    wanted = paired.select("rep").distinct().join(classes.select("rep", "digest", "first"), "rep")
    filled = docs.sparkSession.sparkContext.broadcast(bloom_filter(wanted, "first"))
    sets = text.filter("id is not null").mapInArrow(full_sets(shingle_words, filled), "digest binary, set binary").join(wanted.select("digest", "rep"), "digest").dropDuplicates(["rep"]).select("rep", "set")
    links = by_group(paired.join(sets, "rep").select("unit", "rep", "partners", "set"), "unit").mapInArrow(confirm(percent), "a long, b long")
    labels = connected_components(links)
    tables.drop("paired")

    placed = classes.select("digest", "first", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("digest", "first", F.coalesce("component", "rep").alias("group"))
    least = placed.groupBy("group").agg(F.min("first").alias("component"))
    out = sketches.select("id", "text_hash", "n_shingles", "digest").join(placed.join(least, "group").select("digest", "component", "group"), "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), "text_hash", "group")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one of smallest id, then hash, then columns.

    Rows without an id or without words all stay.
    """
    found = near_dedup(docs, id_col, text_col, **options)
    heads = found.filter(F.col("n_shingles") > 0).filter(named(id_col).isNotNull()).groupBy("group").agg(F.min(F.struct(named(id_col).alias("id"), "text_hash")).alias("head")).select(F.col("head.id").alias("id"), F.col("head.text_hash").alias("hash"))
    wordless = found.filter((F.col("n_shingles") == 0) & named(id_col).isNotNull()).select(named(id_col).alias("id"), F.col("text_hash").alias("hash")).distinct()
    key, mark = private(docs.columns, "_id"), private(docs.columns, "_hash")
    rows = docs.withColumns({key: named(id_col).cast("long"), mark: F.md5(F.coalesce(named(text_col).cast("string"), F.lit("")).cast("binary"))})
    sides = [x.select(F.col("id").alias(private(docs.columns, "_i")), F.col("hash").alias(private(docs.columns, "_h"))) for x in (heads, wordless)]
    meets = (F.col(key) == F.col(private(docs.columns, "_i"))) & (F.col(mark) == F.col(private(docs.columns, "_h")))
    # Maps and variants have no order, so rows are told apart by a digest of what they hold.
    whole = F.min_by(F.struct(*map(named, docs.columns)), F.sha2(F.to_json(F.struct(*map(named, docs.columns)), {"ignoreNullFields": "false"}), 256)).alias("row")
    one = rows.join(sides[0], meets, "left_semi").groupBy(key, mark).agg(whole).select("row.*")
    return one.unionByName(rows.join(sides[1], meets, "left_semi").select(*map(named, docs.columns))).unionByName(docs.filter(named(id_col).isNull()))
