"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A huge text is encoded in overlapping chunks with offsets. Two
neighbours are spliced at a boundary inside their overlap that is proven stable:
a blank of the text, which no token spans and across which neither normaliser,
word splitter nor merges act, with both chunks giving the same tokens from there
to the next such blank. Where an overlap has no such boundary it is widened, at
worst to the text's end. No chunk begins before the last boundary, so no token is
counted twice.

Shorter texts go to the library whole, or, if the model's own configuration shows
that blanks always part its tokens and belong to none, by words between blanks:
a word's count is asked of the library once and remembered. A word of printable
ASCII needs no normaliser but lower case: the model's splitter pattern and the
library's merges are asked of it alone.

Defined cases: null and empty texts have no tokens. Rows may repeat; an empty
table gives an empty result. Strings of special tokens inside texts are handled
as is the library's default. Columns of any name are kept but for those that
this operator writes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrymill.llm.shared import with_text

BLANKS, CACHE = " \t\n", 500_000


def blank_splitter(model: str) -> str | None:
    """The splitter's pattern, if a model's configuration shows that blanks part its tokens and belong to none.

    Its normaliser only composes, lowers, or makes blanks of blanks; its first
    splitter drops all that its pattern doesn't match; and neither the pattern nor a
    special token takes a blank.
    """
    m = json.loads(model)
    steps = lambda x, inner: (x or {}).get(inner, [x] if x else [])
    normal = steps(m.get("normalizer"), "normalizers")
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if any(n["type"] not in ("NFC", "Lowercase") and n != blank for n in normal):
        return None
    split, *others = steps(m.get("pre_tokenizer"), "pretokenizers") or [{}]
    pattern = split.get("pattern", {}).get("Regex")
    if split.get("type") != "Split" or split.get("behavior") != "Removed" or not split.get("invert") or not pattern:
        return None
    if any(o["type"] != "ByteLevel" or o["add_prefix_space"] or o["use_regex"] for o in others) or any(set(t["content"]) & set(BLANKS) for t in m.get("added_tokens", [])):
        return None
    # Classes, literals and repeats of them: a blank can only be met by a negated class that does not exclude blanks, a dot, an escape or itself.
    rest = re.sub(r"\[\^\\s[^\]]*\]|\\p\{[LN]\}", "", pattern)
    return pattern if not re.search(r"\[\^|\.|\\|\s|\(\?", rest) and {"type": "Lowercase"}.items() <= (normal or [{}])[-1].items() and m["model"]["type"] == "BPE" else None


class Counter:
    def __init__(self, model: str, chunk: int, overlap: int, huge: int | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.chunk, self.overlap, self.huge = Tokenizer.from_str(model), chunk, overlap, max(huge or 0, chunk + overlap)
        self.library.no_padding()
        self.library.no_truncation()
        pattern = blank_splitter(model)
        self.pattern, self.known, self.parts = regex.compile(pattern) if pattern else None, {}, {}
        self.special = [t["content"] for t in json.loads(model).get("added_tokens", [])]

    def encode(self, text: str, at: int, to: int):
        return self.library.encode(text[at:to], add_special_tokens=False)

    @staticmethod
    def first(e, at: int, place: int) -> int:
        """The number of a chunk's tokens that begin before a place of the text."""
        t = e.char_to_token(place - at) if place > at else 0
        return sum(o[0] + at < place for o in e.offsets) if t is None else t

    @staticmethod
    def splice(text: str, left, at: int, right, following: int, end: int) -> tuple[int, int, int] | None:
        """A proven stable boundary in the overlap ``[following, end)`` with its token number in both chunks, or None."""
        blanks = [i for i in range(following + 1, end - 1) if text[i] in BLANKS]
        for c, after in pairwise(blanks[len(blanks) // 4 :]):
            places = [e.char_to_token(i - begin) if after > c + 1 else None for e, begin in ((left, at), (right, following)) for i in (c + 1, after - 1)]
            if None in places:
                continue
            a, b, x, y = places
            spans = [[(left.token_to_chars(i)[0] + at, left.token_to_chars(i)[1] + at) for i in range(a, b + 1)], [(right.token_to_chars(i)[0] + following, right.token_to_chars(i)[1] + following) for i in range(x, y + 1)]]
            if spans[0] == spans[1] and spans[0][0][0] >= c and left.ids[a : b + 1] == right.ids[x : y + 1]:
                return c, a, x
        return None

    def long(self, text: str) -> int:
        n, total, begin, at, overlap, counted = len(text), 0, 0, 0, self.overlap, 0
        seen = min(n, self.chunk + overlap)
        left = self.encode(text, 0, seen)
        while True:
            following = max(at + self.chunk, begin)  # a widened overlap may have led past the next chunk's start
            end = min(n, following + overlap)
            if seen < end:
                left, seen = self.encode(text, at, end), end
                counted = self.first(left, at, begin + 1) if begin > at else 0
            if end == n:
                return total + len(left) - counted
            to = min(n, following + self.chunk + overlap)
            right = self.encode(text, following, to)
            found = self.splice(text, left, at, right, following, end)
            if found is None:  # widen, and encode the left chunk anew
                overlap *= 2
                continue
            begin, a, x = found
            total += a - counted
            at, left, seen, overlap, counted = following, right, to, self.overlap, x

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def merges(self, part: str) -> int:
        n = self.parts.get(part)
        if n is None:
            n = self.parts[part] = len(self.library.model.tokenize(part))
        return n

    def words(self, texts: list[str]) -> list[int]:
        split = [t.replace("\t", " ").replace("\n", " ").split(" ") for t in texts]
        if max(len(self.known), len(self.parts)) > CACHE:
            self.known, self.parts = {}, {}
        known = self.known
        new = {w for ws in split for w in ws if w not in known}
        plain = {w for w in new if w.isascii() and w.isprintable() and not any(s in w for s in self.special)}
        for w in plain:
            known[w] = sum(map(self.merges, self.pattern.findall(w.lower())))
        new = list(new - plain)
        known.update(zip(new, self.whole(new), strict=True))
        return [sum(map(known.__getitem__, ws)) for ws in split]

    def __call__(self, texts: list[str]) -> list[int]:
        short = [i for i, t in enumerate(texts) if len(t) <= self.huge]
        out = [0] * len(texts)
        for i, k in zip(short, (self.words if self.pattern else self.whole)([texts[i] for i in short]), strict=True):
            out[i] = k
        for i in set(range(len(texts))) - set(short):
            out[i] = self.long(texts[i])
        return out


def count_tokens(docs: DataFrame, model_path: str, limit: int = 2048, huge: int = 16384, chunk: int = 2048, overlap: int = 128, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or ``keep``) with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    Texts of more than ``huge`` characters are counted in overlapping chunks.
    """
    with open(model_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    mine = ["n_bytes", "n_tokens", "over_limit"]
    base, cols, back = with_text(docs, text_col, keep, mine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model.value, chunk, overlap, huge)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                n = counter(texts)
                columns = [*(part.column(i) for i in range(len(cols))), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*cols, *mine])

    fields = [*base.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return back(base.mapInArrow(run, T.StructType(fields)))
