"""Column builders for text: all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill import config as C


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once: within a lambda, what is written twice is done for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words_in(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def tokens(c: Column) -> Column:
    """Lower-cased search tokens; null gives an empty array."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"(?i){C.TOKEN}"), F.lit(0)), F.lower)


def inner_tokens(c: Column) -> Column:
    """Tokens that every text containing this one has: all but those at its two ends, which may be parts of longer ones."""
    found = tokens(c)
    return F.when(F.size(found) > 2, F.slice(found, 2, F.size(found) - 2)).otherwise(F.array().cast("array<string>"))


def split_tokens(c: Column) -> Column:
    """Each token, and behind it its parts if it is a compound."""
    part = lambda t: F.when(t.rlike(r"[_\-+.]"), F.concat(F.array(t), F.filter(F.split(t, r"[_\-+.]+"), lambda x: x != ""))).otherwise(F.array(t))
    return F.flatten(F.transform(tokens(c), part))


def without(toks: Column, stop: list[str]) -> Column:
    return F.filter(toks, lambda x: ~x.isin(stop))


def ngrams(toks: Column, n: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " "))
    return F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>"))


def estimate_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?U)\w+|\S"), F.lit(0))
    return F.ceil(F.size(found) * F.lit(C.TOKENS_PER_WORD)).cast("long")


def clean(c: Column) -> Column:
    """Line ends, runs of blanks and of empty lines made one, ends trimmed. A clean text is only looked at."""

    def cleaned(t: Column) -> Column:
        t = F.regexp_replace(t, r"\r\n?", "\n")
        t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
        return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")

    blank = lambda x: F.rlike(x, F.lit(r"(?U)\s"))
    has = lambda t, x: F.contains(t, F.lit(x))
    unclean = lambda t: has(t, "\r") | has(t, "\t") | has(t, "  ") | has(t, "\n\n\n") | blank(F.substring(t, 1, 1)) | blank(F.right(t, F.lit(1)))
    return let(F.coalesce(c, F.lit("")), lambda t: F.when(unclean(t), cleaned(t)).otherwise(t))


def overlap_tail(c: Column, n: int) -> Column:
    """The last ``n`` words, or the text itself if it has no more."""
    return let(F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0)), lambda w: F.when(F.size(w) <= n, c).otherwise(F.array_join(F.slice(w, -n, n), " ")))


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def strip_frontmatter(c: Column) -> Column:
    c = F.regexp_replace(c, "^﻿", "")
    end = F.locate("\n---", c, 4)
    cut = F.regexp_replace(F.substring(c, end + 4, F.length(c)), r"(?U)^\s+", "")
    return F.when(c.startswith("---") & (end > 0), cut).otherwise(c)


def is_boilerplate(c: Column) -> Column:
    line = F.trim(c)
    known = "|".join(f"(?:{p})" for p in C.BOILERPLATE)
    return (line != "") & (line.rlike(r"^©\s*\d{4}") | line.rlike(r"^\d+\s*/\s*\d+$") | line.rlike(r"^\d+$") | line.rlike(f"(?i){known}"))


def shouted_heading(c: Column) -> Column:
    """The heading rule: short, no sentence end, all capitals or every word with a capital and small letters."""
    short = (F.length(c) <= 120) & (F.size(F.filter(F.split(c, r"\s+"), lambda x: x != "")) <= 12)
    titled = ~c.rlike(r"(?:^|[^\p{L}])\p{Ll}") & ~c.rlike(r"\p{L}\p{Lu}")
    return short & ~c.rlike(r"[.!?:]$") & ((F.upper(c) == c) | titled)


def version_of(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)\b(v?\d+(?:\.\d+){0,2})\b", 1)


def keyword_list(c: Column, title: Column) -> Column:
    """Split on ``;`` and ``,``, trimmed, no blanks; the title is added if absent."""
    found = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.array_contains(found, title), found).otherwise(F.array_append(found, title))


def format_keywords(words: Column) -> Column:
    return F.lower(F.array_join(F.transform(words, lambda x: F.trim(x)), ", "))


def search_text(*fields: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(f, F.lit("")) for f in fields))


def redact(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]")
    return F.regexp_replace(c, r"/[^\s:]+\.pem", "[REDACTED_KEY_PATH]")


def denies_support(c: Column) -> Column:
    """Each pattern has the word that a text is looked through for first."""
    return F.lower(c).contains(C.DENIED) & c.rlike("(?i)" + "|".join(C.NEGATIVE_SUPPORT))


def match_count(q: Column, d: Column) -> Column:
    """Query tokens in the document; a capability prefix also matches its numbered forms."""
    numbered = lambda d, t: t.isin(C.CAPABILITY_PREFIXES) & F.exists(d, lambda x: x.rlike("^[a-z]+[0-9]+$") & (F.regexp_replace(x, "[0-9]+$", "") == t))
    return let(d, lambda d: F.size(F.filter(q, lambda t: F.array_contains(d, t) | numbered(d, t)))).cast("long")


def numbered_prefixes(d: Column) -> Column:
    """The capability prefixes that an array of tokens has in a numbered form."""
    return F.filter(words_in(C.CAPABILITY_PREFIXES), lambda p: F.exists(d, lambda x: x.startswith(p) & x.rlike(r"^[a-z]+[0-9]+$") & (F.regexp_replace(x, "[0-9]+$", "") == p)))


def share(q: Column, d: Column) -> Column:
    """The share of an array's distinct tokens that a document's array has."""
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)).cast("double") / F.size(q)).otherwise(F.lit(0.0))


def held(phrases: Column, text: Column) -> Column:
    """How many of the phrases a text contains."""
    return F.size(F.filter(phrases, lambda p: text.contains(p)))


def phrase_hits(terms: Column, n: int, text: Column) -> Column:
    return held(ngrams(terms, n), text)


def phrase_bonus(terms: Column, text: Column) -> Column:
    """For pairs and triples of neighbouring terms that the lower-cased text holds."""
    return F.least(F.lit(0.40), 0.10 * phrase_hits(terms, 2, text) + 0.16 * phrase_hits(terms, 3, text))


def support_score(q: Column, d: Column, text: Column) -> Column:
    """Evidence that a document speaks of support for the asked capability."""
    capability = F.filter(q, lambda t: t.rlike("^(sme|sve)[0-9]*$"))
    found = match_count(capability, d)
    asks = F.arrays_overlap(q, words_in(C.SUPPORT)) & (F.size(capability) > 0) & (found > 0) & F.arrays_overlap(d, words_in(C.SUPPORT))
    return F.when(asks, support_parts(q, d, found, denies_support(text))).otherwise(F.lit(0.0))


def support_parts(q: Column, d: Column, found: Column, denied: Column) -> Column:
    """The parts of the evidence, where query and document speak of support."""
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    both = lambda names: F.arrays_overlap(q, words_in(names)) & F.arrays_overlap(d, words_in(names))
    said = F.arrays_overlap(d, words_in(C.SUPPORT_WORDS))
    return 0.12 * found + flag(both(C.DEVICES), 0.20) + flag(both(C.SERVERS), 0.10) + flag(said, 0.15) + flag(denied, 0.25)


def html_text(c: Column) -> Column:
    """Tags to text: minor headings go, code becomes quoted, headings end a line."""
    c = F.regexp_replace(c, r"(?s)<h4[^>]*>.*?</h4>", "")
    c = F.regexp_replace(c, r"(?s)<pre[^>]*>(.*?)</pre>", "`$1`")
    c = F.regexp_replace(c, r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>", "$1\n")
    return F.regexp_replace(c, r"<[^>]+>", "")
