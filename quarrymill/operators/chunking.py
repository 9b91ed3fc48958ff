"""Sections to chunks: code with its context, splitting, packing with overlap.

All native: one section is one row, its blocks are an array, and every step is an
expression over that array. No shuffle is needed, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill import config as C
from quarrymill.functions import text as X

GAP = "\n\n"
FENCED = r"(?s)```.*?(?:```|\z)|~~~.*?(?:~~~|\z)|(?:(?!```|~~~).)+"


def join(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda x: x != ""), GAP)


def cleaned(parts: Column) -> Column:
    """Clean texts that aren't blank."""
    return F.filter(F.transform(parts, X.clean), lambda x: x != "")


def paragraphs(c: Column) -> Column:
    return cleaned(F.split(c, r"(?U)\n\s*\n"))


def blocks(c: Column) -> Column:
    """A section's text as ``array<struct<code, text>>``: fenced parts and paragraphs."""
    block = lambda code: lambda t: F.struct(F.lit(code).alias("code"), t.alias("text"))
    fenced = lambda p: F.startswith(p, F.lit("```")) | F.startswith(p, F.lit("~~~"))
    parts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(FENCED), F.lit(0))
    return F.flatten(F.transform(parts, lambda p: F.when(fenced(p), F.transform(F.array(F.trim(p)), block(True))).otherwise(F.transform(paragraphs(p), block(False)))))


def code_units(found: Column, near: int = C.CODE_CONTEXT) -> Column:
    """Blocks as units: code takes in the unit before it and the paragraph behind it if they are short."""
    none = F.array().cast("array<string>")
    short = lambda t: X.estimate_tokens(t) <= near

    def step(a: Column, b: Column) -> Column:
        last = F.try_element_at(a.units, F.lit(-1))
        takes_last = F.coalesce(short(last) & last.isNotNull(), F.lit(False))
        takes_next = F.coalesce(~b.next.code & short(b.next.text), F.lit(False))
        kept = F.when(takes_last, F.slice(a.units, 1, F.size(a.units) - 1)).otherwise(a.units)
        before, after = F.when(takes_last, last).otherwise(""), F.when(takes_next, b.next.text).otherwise("")
        state = lambda units, taken: F.struct(units.alias("units"), taken.alias("taken"))
        code = state(F.array_append(kept, join(F.array(before, b.text, after))), takes_next)
        return F.when(a.taken, state(a.units, F.lit(False))).when(b.code, code).otherwise(state(F.array_append(a.units, b.text), F.lit(False)))

    ahead = lambda all_: F.transform(all_, lambda b, i: F.struct(b.code.alias("code"), b.text.alias("text"), F.get(all_, i + 1).alias("next")))
    return cleaned(F.aggregate(X.let(found, ahead), F.struct(none.alias("units"), F.lit(False).alias("taken")), step, lambda a: a.units))


def windows(c: Column, most: int) -> Column:
    """Runs of words that are about ``most`` tokens long."""
    step = max(1, int(most / C.TOKENS_PER_WORD))
    starts = lambda words: F.sequence(F.lit(0), F.floor((F.size(words) - 1) / step).cast("int"))
    return X.let(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0)), lambda words: F.transform(starts(words), lambda i: F.array_join(F.slice(words, i * step + 1, step), " ")))


def split(c: Column, most: int = C.CHUNK_MOST) -> Column:
    """A text in parts of at most ``most`` tokens where it can be: paragraphs, else sentences, else words."""
    return F.transform(sized_split(c, most), lambda u: u.text)


def sized(text: Column, n: Column) -> Column:
    return F.struct(text.alias("text"), n.alias("n"))


def sized_split(c: Column, most: int = C.CHUNK_MOST) -> Column:
    """``split`` as ``array<struct<text, n>>``, with tokens counted once."""
    counted = lambda texts: F.transform(texts, lambda u: sized(u, X.estimate_tokens(u)))
    sentences = lambda p: cleaned(F.split(p, r"(?U)(?<=[.!?])\s+"))
    fitting = lambda t, n, larger: F.when(n <= most, F.array(sized(t, n))).otherwise(larger)
    by_sentence = lambda p: F.flatten(F.transform(sentences(p), lambda s: X.let(X.estimate_tokens(s), lambda n: fitting(s, n, counted(windows(s, most))))))
    larger = lambda p: F.when(F.contains(p, F.lit("```")), counted(windows(p, most))).otherwise(by_sentence(p))
    part = lambda p: X.let(X.estimate_tokens(p), lambda n: fitting(p, n, larger(p)))
    parts = lambda whole: F.flatten(F.transform(paragraphs(whole), part))
    return X.let(X.clean(c), lambda whole: X.let(X.estimate_tokens(whole), lambda n: F.when(whole == "", F.slice(F.array(sized(whole, n)), 1, 0)).otherwise(fitting(whole, n, parts(whole)))))


def pack(units: Column, least: int = C.CHUNK_LEAST, most: int = C.CHUNK_MOST, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """Units in order to chunks; each begins with the last ``overlap`` words before it.

    A rest that is too short to stand alone goes to the chunk before it.
    """
    return pack_sized(F.transform(units, lambda u: sized(u, X.estimate_tokens(u))), least, most, overlap)


def pack_sized(units: Column, least: int, most: int, overlap: int) -> Column:
    """``pack`` of ``array<struct<text, n>>``."""
    if overlap < 1:
        raise ValueError("chunks overlap by at least one word")
    none = F.array().cast("array<string>")

    def step(a: Column, u: Column) -> Column:
        full = (F.size(a.now) > 0) & (a.n + u.n > most) & (a.n >= least)
        begun = lambda now: lambda tail: F.struct(F.array_append(a.done, now).alias("done"), F.array(tail, u.text).alias("now"), (X.estimate_tokens(tail) + u.n).alias("n"))
        flushed = X.let(F.array_join(a.now, GAP), lambda now: X.let(X.overlap_tail(now, overlap), begun(now)))
        return F.when(full, flushed).otherwise(F.struct(a.done.alias("done"), F.array_append(a.now, u.text).alias("now"), (a.n + u.n).alias("n")))

    def finish(a: Column) -> Column:
        rest, last = F.array_join(a.now, GAP), F.try_element_at(a.done, F.lit(-1))
        joined = F.array_append(F.slice(a.done, 1, F.size(a.done) - 1), F.concat(last, F.lit(GAP), rest))
        small = (F.size(a.done) > 0) & (X.estimate_tokens(rest) < max(80, least // 2))
        return F.when(F.size(a.now) == 0, a.done).when(small, joined).otherwise(F.array_append(a.done, rest))

    start = F.struct(none.alias("done"), none.alias("now"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(units, start, step, finish)


def chunks(c: Column, least: int = C.CHUNK_LEAST, most: int = C.CHUNK_MOST, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """A section's text to the array of its chunks; null and blank texts have none.

    A text without code that fits into one chunk, whatever its paragraphs' sizes are rounded to, is one: most are.
    """
    fenced = c.contains("```") | c.contains("~~~")
    units = F.when(fenced, code_units(blocks(c))).otherwise(paragraphs(F.coalesce(c, F.lit(""))))
    packed = pack_sized(F.flatten(F.transform(units, lambda u: sized_split(u, most))), least, most, overlap)
    small = c.isNotNull() & ~fenced & (X.estimate_tokens(c) + F.size(F.split(c, r"(?U)\n\s*\n")) <= most)
    one = X.let(paragraphs(c), lambda parts: F.when(F.size(parts) > 0, F.array(F.array_join(parts, GAP))).otherwise(F.array().cast("array<string>")))
    return F.when(small, one).otherwise(packed)


def heading_path(title: Column, path: Column) -> Column:
    """Clean headings; the first goes if it is the title."""
    found = cleaned(path)
    return F.when(F.lower(F.get(found, F.lit(0))) == F.lower(X.clean(title)), F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))).otherwise(found)


def chunk_text(title: Column, path: Column, body: Column) -> Column:
    """What is embedded: title, heading path and body."""
    label = F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise(title)
    return X.clean(F.concat(F.lit("Document Title: "), title, F.lit("\nHeading Path: "), label, F.lit(GAP), body))
