"""SentencePiece encoding and decoding as a shortest path through a transducer.

The model compiles to a weighted transducer, once, on the driver:

- the normaliser: an arc that puts the blank mark in front of a text, arcs that
  read a blank and write the mark, and arcs that copy every other character;
- the pieces: a trie whose arcs read normalised characters; where a piece ends,
  an arc leads back to the root, writes the piece and has its weight;
- byte fallback: for a character that no piece is, an arc from the root back to
  it that writes the bytes' pieces.

Composed with a text it is a lattice whose states are the text's positions. The
encoding is the shortest path in the tropical semiring (min, +). For a unigram
model an arc's weight is the piece's negative score. For a merge-built model it
is 0 or infinite by the arc before it: infinite where the merges would have
joined something across the two pieces' border earlier (the tables of each
piece's last merge tell). One path of finite weight is left, the library's.

No arc crosses from another character into a blank mark, so a text is the
concatenation of its words' lattices; new words are composed and searched
together, position by position, and their paths are remembered.

Defined cases: null and empty texts have no pieces and decode to the empty
text. Rows may repeat; an empty table gives an empty result. Columns of any name
are kept but for those that this operator writes. Models with a character map,
with blanks that are dropped or with merges of equal score (but for runs of one
character, which grow from the left) are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm.shared import named, with_text

MARK, CACHE, PAIRS = "▁", 300_000, 1 << 20
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
MERGES, UNIGRAM = 2, 1


def read_model(path: str) -> dict:
    """What encoding needs of a model file: its pieces, scores and kinds."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models whose normaliser keeps the text are supported")
    return {"pieces": [(p.piece, p.score, p.type) for p in model.pieces], "kind": model.trainer_spec.model_type, "prefix": model.normalizer_spec.add_dummy_prefix}


def merged(text: str, score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The merge procedure (best score first, leftmost of equals) and its last merge: for compiling and tests only."""
    parts, last = list(text), None
    while True:
        best, at = -float("inf"), -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and s > best:
                best, at = s, i
        if at < 0:
            return parts, last
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys; -1 for others."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], -1)


def sorted_table(entries: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(sorted(entries), dtype=np.int64)
    return keys, np.array([entries[k] for k in keys.tolist()], dtype=np.int64)


def compile_model(model: dict) -> dict:
    """States, arcs, outputs and weights as arrays."""
    pieces, kind = model["pieces"], model["kind"]
    score = {p: s for p, s, t in pieces if t in (NORMAL, USER)}
    ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a piece crosses a blank: words cannot be taken apart")
    n, rank = len(pieces), np.zeros(len(pieces), np.int64)
    left, right, joins = np.arange(n), np.arange(n), {}
    usable = dict(ids)
    if kind == MERGES:
        long = sorted((p for p in ids if len(p) > 1), key=lambda p: -score[p])
        ranks = {s: r for r, s in enumerate(sorted({score[p] for p in long}, reverse=True), 1)}
        if any(score[a] == score[b] and len(set(a + b)) > 1 for a, b in zip(long, long[1:], strict=False)):
            raise ValueError("merges of equal score are only known to be ordered for runs of one character")
        for p in long:
            rank[ids[p]] = r = ranks[score[p]]
            parts, last = merged(p, score)
            if len(parts) == 1 and last[0] in ids and last[1] in ids:
                left[ids[p]], right[ids[p]] = ids[last[0]], ids[last[1]]
            else:  # the merges never make it
                usable.pop(p)
            for i in range(1, len(p)):
                if p[:i] in ids and p[i:] in ids:
                    joins[ids[p[:i]] * n + ids[p[i:]]] = r
    letters = {c: i for i, c in enumerate(sorted({c for p in usable for c in p} | {MARK}), 1)}
    arcs, ends = {}, [-1]
    for p, i in usable.items():
        state = 0
        for c in p:
            key = state * (len(letters) + 1) + letters[c]
            if key not in arcs:
                arcs[key] = len(ends)
                ends.append(-1)
            state = arcs[key]
        ends[state] = i
    symbols = {ord(c): i for c, i in letters.items()}
    symbols[ord(" ")] = letters[MARK]  # the normaliser's arc
    floor = min((s for s in score.values() if s > -1e8), default=0.0) - 10
    return {
        "kind": kind, "prefix": model["prefix"], "n": n, "width": len(letters) + 1, "symbols": sorted_table(symbols), "arcs": sorted_table(arcs), "ends": np.array(ends), "joins": sorted_table(joins),
        "rank": rank, "left": left, "right": right, "weight": np.array([-score.get(p, 0.0) for p, _, _ in pieces]), "unknown_weight": -floor,
        "lengths": np.array([len(p) for p, _, _ in pieces]), "newline": any("\n" in p and len(p) > 1 for p in ids),
        "bytes": {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}, "unknown": next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0),
        "output": [bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t in (NORMAL, USER) else b"" for p, _, t in pieces],
    }


class Transducer:
    """A compiled model at work: composition with words, shortest paths, decoding."""

    def __init__(self, compiled: dict):
        self.m = compiled
        self.cut = re.compile(rf"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+" if compiled["newline"] else rf"\n|[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+")
        self.paths: dict[str, bytes] = {}
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave each border between pieces ``a`` and ``b``: both are taken apart, latest merge first, and nothing may join across earlier."""
        m, n = self.m, self.m["n"]
        out, live = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            joint = lookup(*m["joins"], a * n + b)
            bad = (joint >= 0) & (joint < limit)
            out[live[bad]] = False
            first = m["rank"][a] > m["rank"][b]
            can_a, can_b = m["right"][a] != a, m["left"][b] != b
            undo_a = np.where(first, can_a, ~can_b & can_a)
            undo_b = ~undo_a & can_b
            limit = np.where(undo_a, m["rank"][a], np.where(undo_b, m["rank"][b] + 1, limit))
            a, b = np.where(undo_a, m["right"][a], a), np.where(undo_b, m["left"][b], b)
            go = ~bad & (undo_a | undo_b)
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stable`` with a memory of fixed size; a word's begin and unknown characters (outside the pieces) fit all."""
        n, out = self.m["n"], np.ones(len(a), bool)
        some = np.flatnonzero((a >= 0) & (a < n) & (b < n))
        key = a[some] * n + b[some]
        slot = ((key * 0x9E3779B97F4A7C1) >> 20) & (PAIRS - 1)
        new = np.flatnonzero(self.pair_keys[slot] != key)
        fit = self.pair_fits[slot]
        if len(new):
            distinct, back = np.unique(key[new], return_inverse=True)
            fit[new] = self.stable(distinct // n, distinct % n)[back]
            self.pair_keys[slot[new]], self.pair_fits[slot[new]] = key[new], fit[new]
            agree = self.pair_keys[slot[new]] == key[new]  # of two keys in one slot the last stays
            self.pair_fits[slot[new[agree]]] = fit[new[agree]]
        out[some] = fit
        return out

    def lattice(self, points: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Composition: begins, ends and pieces of all arcs over the words' characters (``to``: each one's word's end).

        A character without a piece has one arc, numbered behind the pieces by its place.
        """
        m = self.m
        symbol = lookup(*m["symbols"], points)
        at, state, found = np.arange(len(points)), np.zeros(len(points), np.int64), []
        step = 0
        while len(at):
            ok = at + step < to[at]
            at, state = at[ok], state[ok]
            s = symbol[at + step]
            state = lookup(*m["arcs"], np.where(s > 0, state * m["width"] + s, -1))
            at, state = at[state >= 0], state[state >= 0]
            piece = m["ends"][state]
            has = piece >= 0
            found.append((at[has], at[has] + step + 1, piece[has]))
            step += 1
        single = np.zeros(len(points), bool)
        if found:
            single[found[0][0]] = True
        lone = np.flatnonzero(~single)
        found.append((lone, lone + 1, m["n"] + lone))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def search(self, words: list[str]) -> list[bytes]:
        """Piece numbers of each word's shortest path."""
        m, n = self.m, self.m["n"]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        word = np.repeat(np.arange(len(words)), sizes)
        begin, end, piece = self.lattice(points, first[1:][word])
        place = begin - first[word[begin]]  # arcs by the place in the word at which they begin
        order = np.argsort(place, kind="stable")
        begin, end, piece = begin[order], end[order], piece[order]
        bounds = np.searchsorted(place[order], np.arange(int(sizes.max(initial=0)) + 1))
        # A word has a state more than characters; state i of word w is first[w] + w + i.
        a, b = begin + word[begin], end + word[begin]
        cost, last = np.full(len(points) + len(words), np.inf), np.full(len(points) + len(words), -1)
        cost[first[:-1] + np.arange(len(words))] = 0.0
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            x = lo + np.flatnonzero(cost[a[lo:hi]] < np.inf)
            if m["kind"] == MERGES:
                x, weight = x[self.fits(last[a[x]], piece[x])], 0.0
            else:
                weight = np.where(piece[x] < n, m["weight"][np.minimum(piece[x], n - 1)], m["unknown_weight"])
            total = cost[a[x]] + weight
            better = total < cost[b[x]]  # arcs of one step end at different states of a word
            cost[b[x[better]]], last[b[x[better]]] = total[better] if m["kind"] != MERGES else 0.0, piece[x[better]]
        state, todo, steps = first[1:] + np.arange(len(words)), np.flatnonzero(sizes), []
        if not np.isfinite(cost[state]).all():
            raise AssertionError("a word has no path of finite weight")
        while len(todo):
            p = last[state[todo]]
            steps.append((todo, p))
            state[todo] -= np.where(p < n, m["lengths"][np.minimum(p, n - 1)], 1)
            todo = todo[state[todo] > first[todo] + todo]
        of = np.concatenate([s[0] for s in steps]) if steps else np.zeros(0, np.int64)
        ids = np.concatenate([s[1] for s in steps]) if steps else np.zeros(0, np.int64)
        back = np.argsort(of[::-1], kind="stable")
        of, ids = of[::-1][back], ids[::-1][back]
        if (ids >= n).any():  # the byte arcs' outputs
            lone, unit = ids >= n, np.ones(len(ids), np.int64)
            raw = [[m["bytes"].get(x, m["unknown"]) for x in chr(points[i - n]).encode("utf-8", "surrogatepass")] for i in ids[lone].tolist()]
            unit[lone] = [len(r) for r in raw]
            spread = np.repeat(ids, unit)
            spread[np.repeat(lone, unit)] = [x for r in raw for x in r]
            of, ids = np.repeat(of, unit), spread
        cuts = np.searchsorted(of, np.arange(len(words) + 1)) * 4
        data = ids.astype("<i4").tobytes()
        return [data[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Piece numbers of each text as little-endian 32-bit integers."""
        front = " " if self.m["prefix"] else ""
        words = [self.cut.findall(front + t) if t else [] for t in texts]
        if len(self.paths) > CACHE:
            self.paths = {}
        paths = self.paths
        new = list({w for ws in words for w in ws if w not in paths})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            paths.update(zip(part, self.search(part), strict=True))
        return [b"".join(map(paths.__getitem__, ws)) for ws in words]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 bytes of the text of some pieces."""
        text = b"".join(map(self.m["output"].__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))
        return text[1:] if self.m["prefix"] and text[:1] == b" " else text


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with ``n_tokens``, ``ids_sha1``, ``round_trip`` and, if asked, ``ids``.

    ``round_trip`` tells that decoding the pieces gives the text back.
    """
    model = docs.sparkSession.sparkContext.broadcast(compile_model(read_model(model_path)))
    mine = ["n_tokens", "ids_sha1", "round_trip", "ids"]
    base, cols, back = with_text(docs, text_col, keep, mine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = Transducer(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(part.num_columns - 1).to_pylist()
                ids = fst.encode_all(texts)
                same = [fst.decode(x) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]
                columns = [*(part.column(i) for i in range(len(cols))), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha1(x).hexdigest() for x in ids], pa.string()), pa.array(same, pa.bool_())]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(columns, [*cols, *mine[: 4 if with_ids else 3]])

    fields = [*base.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha1", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    return back(base.mapInArrow(run, T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))))


def decode_pieces(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its piece numbers; null for null."""
    model = encoded.sparkSession.sparkContext.broadcast(compile_model(read_model(model_path)))
    base, cols, back = with_text(encoded, ids_col, None, [text_col], named(ids_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = Transducer(model.value)
        for batch in batches:
            texts = [None if x is None else fst.decode(np.array(x, dtype="<i4").tobytes()).decode("utf-8", "replace") for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), pa.array(texts, pa.string())], [*cols, "_decoded"])

    return back(base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], T.StructField("_decoded", T.StringType())]))).withColumnRenamed("_decoded", text_col)
