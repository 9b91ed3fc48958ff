"""Alignment of two tokenizers' tokens, and how often each two ids are linked.

A blank is put in front of each text; a byte-level model (side A) encodes it, and
a piece model (side B), which adds that blank itself, encodes the text. Byte
offsets where tokens of both sides end cut them into groups; the two tokens that
end there are linked. (No token is empty, so a group has one link.)

Links are counted in dense matrices striped by B's ids: each task sums its pairs
first, the sums are partitioned by stripe, and a stripe's task adds them to its
block, rows of B's ids by columns of A's; row maxima tell each B id's best
partners. Links are scored beside their counts: of the pairs so frequent that at
most ``heavy`` of them can exist the counts are broadcast; the other links go to
their stripe's partition, in several parts where a stripe has many, and meet the
block there. Blocks are of fixed size, whatever the corpus.

Where both models' configurations show that a blank between two signs that aren't
blanks always begins a token, a text is cut there; what a part gives is
remembered. Else, and where a part's tokens don't give its bytes back, the text
is encoded whole.

Defined cases: texts that are null, empty, or whose tokens on either side don't
spell the blank and the text (as with a blank mark inside a text) have no tokens:
zeros and an empty digest. Repeated rows count each time. An empty table gives an
empty result. Texts of any length are encoded whole. Ties for a B id's highest
count are all best. Other columns are kept, whatever their names, but for those
that this operator writes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm.shared import by_group, list_rows, named
from quarrymill.storage import materialize

MARK, CACHE, LONG = "▁", 240_000, 100
#: A blank between two signs that no notion of white space takes for blanks.
CUT = re.compile(r"(?<=\S) (?=\S)")
MINE = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones are their own, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both models, and what their tokens mean."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        if not all(self.a_bytes[i] for i in vocabulary.values()) or not all(self.b_bytes):
            raise ValueError("a token without bytes ends nowhere")
        m, proto = json.loads(a_json), sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(b_model)
        split, normal = m.get("pre_tokenizer") or {}, proto.normalizer_spec
        self.parts = (
            m.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not any(" " in t["content"] for t in m.get("added_tokens", []))
            and not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and normal.add_dummy_prefix and normal.escape_whitespaces
            and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type in (1, 4))
        )
        lengths = lambda tokens: np.array([len(t) for t in tokens])
        self.a_size, self.b_size = lengths(self.a_bytes), lengths(self.b_bytes)
        written = lambda n, end: np.array([f"{i}{end}" for i in range(n)], dtype=object)
        n = max(len(self.a_bytes), len(self.b_bytes))
        self.inside, self.turn, self.close = written(n, ","), written(n, "|"), written(n, ";")
        self.digits = lengths(self.inside)
        self.forget()

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def forget(self) -> None:
        """Keep the parts that were met again, up to half of the memory."""
        known, text, stats, codes, used = getattr(self, "known", {}), getattr(self, "text", []), *getattr(self, "arrays", (np.zeros((4, 0), np.int64), np.zeros(0, np.int64))), getattr(self, "used", np.zeros(0, np.int64))
        bar = max(2, int(np.sort(used)[-CACHE // 2])) if len(used) > CACHE // 2 else 2
        stay = [(t, i) for t, i in known.items() if used[i] > bar or (bar == 2 and used[i] == 2)]
        stay = [(t, i) for t, i in stay if len(t) <= LONG]
        at = np.array([i for _, i in stay], np.int64)
        n = np.maximum(stats[2, at], 0)
        starts = np.cumsum(n) - n
        flat = np.arange(n.sum()) - np.repeat(starts, n) + np.repeat(stats[3, at], n)
        self.known, self.text = {t: k for k, (t, _) in enumerate(stay)}, [text[i] for i in at.tolist()]
        self.arrays, self.used = (np.concatenate([stats[:3, at], starts[None]]), codes[flat]), used[at] // 2
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def learn(self, texts: list[str]) -> None:
        """Align texts that aren't known yet, many at once."""
        new = list(set(texts).difference(self.known))
        for at in range(0, len(new), 4000):
            part = new[at : at + 4000]
            a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in part], add_special_tokens=False)]
            stats, codes, said = self.align(part, a, self.b.encode(part, num_threads=1))
            begun = len(self.text)
            self.known.update(zip(part, range(begun, begun + len(part)), strict=True))
            self.text += said
            self.new.append((stats, codes))
        if self.new:
            base = len(self.arrays[1])
            for stats, codes in self.new:
                stats[3] += base
                base += len(codes)
            self.arrays = np.concatenate([self.arrays[0], *(x for x, _ in self.new)], axis=1), np.concatenate([self.arrays[1], *(x for _, x in self.new)])
            self.used, self.new = np.append(self.used, np.zeros(len(self.text) - len(self.used), np.int64)), []

    def align(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For each text: tokens of both sides, groups (-1 if the bytes differ) and where its pairs begin; all pairs; all groups as text."""
        whole = [(" " + t).encode() for t in texts]
        count = np.array([[len(x) for x in a], [len(x) for x in b]])
        flat = [np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b)]
        sums = [np.diff(np.append(0, np.cumsum(size[x]))[np.append(0, np.cumsum(n))]) for size, x, n in zip((self.a_size, self.b_size), flat, count, strict=True)]
        size = np.array([len(w) for w in whole])
        good = (sums[0] == size) & (sums[1] == size)

        def kept() -> list[np.ndarray]:
            return [x[np.repeat(good, n)] for x, n in zip(flat, count, strict=True)]

        spelt = lambda tokens, ids: b"".join(map(tokens.__getitem__, ids))
        x, y = kept()
        want = b"".join(w for w, ok in zip(whole, good.tolist(), strict=True) if ok)
        if spelt(self.a_bytes, x.tolist()) != want or spelt(self.b_bytes, y.tolist()) != want:
            good &= np.array([spelt(self.a_bytes, i) == w == spelt(self.b_bytes, j) for i, j, w in zip(a, b, whole, strict=True)])
            x, y = kept()
        # Ends over all good texts together: each text ends with tokens of both sides.
        end_x, end_y = np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y])
        cut_x, cut_y = np.isin(end_x, end_y, assume_unique=True), np.isin(end_y, end_x, assume_unique=True)
        codes = y[cut_y] * len(self.a_bytes) + x[cut_x]
        upto_x, upto_y = np.append(0, np.flatnonzero(cut_x) + 1), np.append(0, np.flatnonzero(cut_y) + 1)  # tokens in the first groups
        of_x, of_y = np.cumsum(cut_x) - cut_x, np.cumsum(cut_y) - cut_y
        at_x, at_y = np.arange(len(x)) + upto_y[of_x], np.arange(len(y)) + upto_x[of_y + 1] if len(y) else np.empty(0, np.int64)
        words, digits = np.empty(len(x) + len(y), object), np.empty(len(x) + len(y), np.int64)
        words[at_x], words[at_y] = np.where(cut_x, self.turn[x], self.inside[x]), np.where(cut_y, self.close[y], self.inside[y])
        digits[at_x], digits[at_y] = self.digits[x], self.digits[y]
        line, n = "".join(words.tolist()), np.where(good, count, 0)
        upto = np.append(0, np.cumsum(digits))[np.append(0, np.cumsum(n.sum(axis=0)))].tolist()
        said = [line[i : j - 1] if j > i else "" for i, j in zip(upto[:-1], upto[1:], strict=True)]
        groups = np.diff(np.append(0, np.cumsum(cut_x))[np.append(0, np.cumsum(n[0]))])
        return np.stack([*count, np.where(good, groups, -1), np.cumsum(groups) - groups]), codes, said

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, tuple[np.ndarray, ...]]:
        """Groups of each text; tokens of both sides and groups; and the distinct pairs of each text, texts in order: text, pair, times."""
        if len(self.known) > CACHE:
            self.forget()
        cut = [(CUT.split(t) if self.parts else [t]) if t else [] for t in texts]
        self.learn(list(chain.from_iterable(cut)))
        found = [list(map(self.known.__getitem__, parts)) for parts in cut]
        odd = [i for i, f in enumerate(found) if (self.arrays[0][2, f] < 0).any()]
        if odd:
            self.learn([texts[i] for i in odd])
            for i in odd:
                e = self.known[texts[i]]
                found[i] = [] if self.arrays[0][2, e] < 0 else [e]
        stats, codes = self.arrays
        length = np.array([len(f) for f in found])
        flat = np.fromiter(chain.from_iterable(found), np.int64, length.sum())
        np.add.at(self.used, flat, 1)
        groups = [";".join(map(self.text.__getitem__, f)) for f in found]
        bounds = np.append(0, np.cumsum(length))
        totals = np.diff(np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(stats[:3, flat], axis=1)], axis=1)[:, bounds], axis=1)
        n = stats[2, flat]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(stats[3, flat], n)
        size = len(self.a_bytes) * len(self.b_bytes)
        key, times = np.unique(np.repeat(np.repeat(np.arange(len(found)), length), n) * size + codes[at], return_counts=True)
        return groups, totals, (key // size, key % size, times)


def runs(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Value, begin and end of each run of equal keys."""
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]).tolist() if len(key) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True) if cuts else ():
        yield int(key[a]), a, b


def count_pairs(links: DataFrame, width: int, stripe: int) -> DataFrame:
    """``stripe, code, count, best`` of all linked pairs; a code is B's id times ``width`` plus A's id."""
    cells = stripe * width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times, held = [], [], 0

        def flush() -> tuple[np.ndarray, np.ndarray]:
            code, back = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, back, np.concatenate(times))
            return code, n

        for batch in batches:
            codes.append(list_rows(batch.column(0))[0])
            times.append(list_rows(batch.column(1))[0])
            held += len(codes[-1])
            if held > 4_000_000:
                code, n = flush()
                codes, times, held = [code], [n], 0
        if codes:
            code, n = flush()
            for at in range(0, len(code), 100_000):
                c = code[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(c // cells), pa.array(c), pa.array(n[at : at + 100_000])], ["stripe", "code", "n"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, of = np.zeros((stripe, width), np.int64), None

        def result() -> Iterator[pa.RecordBatch]:
            code = np.flatnonzero(block)
            count, best = block.ravel()[code], block.max(axis=1)[code // width]
            for at in range(0, len(code), 100_000):
                c, n = code[at : at + 100_000], count[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), of)), pa.array(c + of * cells), pa.array(n), pa.array(n == best[at : at + 100_000])], ["stripe", "code", "count", "best"])

        for batch in batches:
            code, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for s, a, b in runs(batch.column(0).to_numpy()):
                if s != of:
                    if of is not None:
                        yield from result()
                    block[:], of = 0, s
                np.add.at(block.ravel(), code[a:b] - s * cells, n[a:b])
        if of is not None:
            yield from result()

    partial = links.select("codes", "times").mapInArrow(sums, "stripe long, code long, n long")
    return by_group(partial, "stripe").mapInArrow(tally, "stripe long, code long, count long, best boolean")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, stripe: int = 64, heavy: int = 100_000, part: int = 2_000_000, text_col: str = "text", keep: list[str] | None = None, with_groups: bool = False) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with ``n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, if asked, ``groups``.

    ``a_path`` is a byte-level model of the tokenizers library, ``b_path`` a piece
    model. ``stripe`` is the number of B ids in a block, ``part`` the number of
    links that one task scores.
    """
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        models = (f.read(), g.read())
    width = len(Pair(*models).a_bytes)
    cells, sent = stripe * width, spark.sparkContext.broadcast(models)
    cols = [c for c in (keep or docs.columns) if c.lower() not in MINE]
    names = [f"c{i}" for i in range(len(cols))]
    base = docs.select(*(named(c).alias(n) for c, n in zip(cols, names, strict=True)), named(text_col).cast("string").alias("text"))
    mine = ["n_a", "n_b", "n_groups", "groups_sha256", *(["groups"] if with_groups else []), "codes", "times"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                groups, totals, (of, code, times) = pair(rows.column(len(cols)).to_pylist())
                offsets = pa.array(np.searchsorted(of, np.arange(len(groups) + 1)).astype(np.int32))
                counts = [pa.array(x, pa.int64()) for x in totals]
                digest = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (code, times)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *counts, digest, *([pa.array(groups, pa.string())] if with_groups else []), *lists], [*names, *mine])

    kinds = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "groups_sha256": T.StringType(), "groups": T.StringType(), "codes": T.ArrayType(T.LongType()), "times": T.ArrayType(T.LongType())}
    fields = [*base.schema.fields[:-1], *(T.StructField(n, kinds[n]) for n in mine)]
    links = materialize(base.mapInArrow(encode, T.StructType(fields)).withColumn("row", F.monotonically_increasing_id()), "token-links")

    scored = materialize(count_pairs(links, width, stripe), "pair-counts")
    total = scored.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") >= F.lit(max(1, -(-total // heavy)))  # at most ``heavy`` pairs
    top = scored.filter(often).select("code", "count", "best").toArrow().sort_by("code")
    frequent = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("code", "count", "best")))
    # One row for each stripe: as many as the vocabulary has, whatever the corpus.
    parts = {r["stripe"]: -(-r["n"] // part) for r in scored.filter(~often).groupBy("stripe").agg(F.sum("count").alias("n")).collect()}
    most, dealt = max(parts.values(), default=1), spark.sparkContext.broadcast(parts)

    def split(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Row, code and times of a batch's links, where the frequent pairs have them, and whether they do."""
        code, offsets = list_rows(batch.column("codes"))
        row = np.repeat(batch.column("row").to_numpy(), np.diff(offsets))
        keys = frequent.value[0]
        place = np.minimum(np.searchsorted(keys, code), max(0, len(keys) - 1))
        return row, code, list_rows(batch.column("times"))[0], place, keys[place] == code if len(keys) else np.zeros(len(code), bool)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, count, best = frequent.value
        for batch in batches:
            row, _, times, place, hit = split(batch)
            ids = batch.column("row").to_numpy()
            order = np.argsort(ids)
            n = np.zeros((2, len(ids)), np.int64)
            slot, place, times = order[np.searchsorted(ids[order], row[hit])], place[hit], times[hit]
            np.add.at(n[0], slot, times * best[place])
            np.add.at(n[1], slot, times * count[place])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n[0]), pa.array(n[1])], ["row", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = np.ones(max(dealt.value, default=0) + 1, np.int64)
        for s, n in dealt.value.items():
            share[s] = n
        for batch in batches:
            row, code, times, _, hit = split(batch)
            row, code, times = row[~hit], code[~hit], times[~hit]
            s = code // cells
            for at in range(0, len(row), 100_000):
                cut = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(s[cut] * most + row[cut] % share[s[cut]]), pa.array(row[cut]), pa.array(code[cut]), pa.array(times[cut])], ["unit", "row", "code", "n"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A unit's counts come first (row -1), then its links."""
        count, best, of = np.zeros(cells, np.int64), np.zeros(cells, bool), None
        for batch in batches:
            row, code, n, is_best = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            out: list[np.ndarray] = []
            for u, a, b in runs(batch.column(0).to_numpy()):
                if u != of:
                    count[:], best[:], of = 0, False, u
                place, mine = code[a:b] - (u // most) * cells, row[a:b] < 0
                count[place[mine]], best[place[mine]] = n[a:b][mine], is_best[a:b][mine]
                place, times = place[~mine], n[a:b][~mine]
                out.append(np.stack([row[a:b][~mine], times * best[place], times * count[place]]))
            if out and (all_ := np.concatenate(out, axis=1)).shape[1]:
                rows, back = np.unique(all_[0], return_inverse=True)
                sums = np.zeros((2, len(rows)), np.int64)
                np.add.at(sums[0], back, all_[1])
                np.add.at(sums[1], back, all_[2])
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(sums[0]), pa.array(sums[1])], ["row", "n_best", "count_sum"])

    sums = "row long, n_best long, count_sum long"
    near = links.select("row", "codes", "times")
    asked = near.mapInArrow(others, "unit long, row long, code long, n long").withColumn("best", F.lit(False))
    copies = spark.createDataFrame([(int(s), int(n)) for s, n in parts.items()], "stripe long, parts long")
    known = scored.filter(~often).join(F.broadcast(copies), "stripe").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    known = known.select((F.col("stripe") * most + F.col("part")).alias("unit"), F.lit(-1).cast("long").alias("row"), "code", F.col("count").alias("n"), "best")
    rest = by_group(known.unionByName(asked), "unit", "row").mapInArrow(score, sums)
    rest = rest.groupBy("row").agg(F.sum("n_best").alias("more_best"), F.sum("count_sum").alias("more_sum"))
    both = near.mapInArrow(at_once, sums).join(rest, "row", "left").select("row", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))
    out = links.drop("codes", "times").join(both, "row")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, cols, strict=True)), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))
