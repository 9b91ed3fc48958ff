"""Chunks against a plain version, and the parts of a section."""

import math
import re

from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators import chunking as K
from quarrymill.sources import sections as S


def size(t):
    return math.ceil(len(re.findall(r"\w+|[^\w\s]", t)) * 0.85)


def plain(text, least, most, overlap):
    """Chunks of a text without fences, step by step."""
    clean = lambda t: re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", t))).strip()
    units = []
    for p in filter(None, map(clean, re.split(r"\n\s*\n", text or ""))):
        for s in [p] if size(p) <= most else filter(None, map(clean, re.split(r"(?<=[.!?])\s+", p))):
            words, n = s.split(), int(most / 0.85)
            units += [s] if size(s) <= most else [" ".join(words[i : i + n]) for i in range(0, len(words), n)]
    done, now, n = [], [], 0
    for u in units:
        if now and n + size(u) > most and n >= least:
            whole = "\n\n".join(now)
            done.append(whole)
            tail = whole if len(whole.split()) <= overlap else " ".join(whole.split()[-overlap:])
            now, n = [tail], size(tail)
        now.append(u)
        n += size(u)
    rest = "\n\n".join(now)
    if done and size(rest) < max(80, least // 2):
        done[-1] += "\n\n" + rest
    elif now:
        done.append(rest)
    return done


def test_chunks_equal_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text not like '%```%' and text not like '%~~~%'")
    odd = spark.createDataFrame([("a b c.  d e f! g\n\n\nh " * 90,), ("word " * 3000,), ("",), (None,), (" \n ",), ("x\r\n\r\ny",)], "text string")
    rows = docs.select("text").unionByName(odd).select("text", K.chunks(F.col("text"), 60, 120, 10).alias("c"), K.chunks(F.col("text")).alias("d")).collect()
    assert len(rows) > 100 and max(len(r["c"]) for r in rows) > 5
    for r in rows:
        assert r["c"] == plain(r["text"], 60, 120, 10)
        assert r["d"] == plain(r["text"], 300, 600, 50)


def test_code_takes_its_context(spark):
    long = "w " * 300
    texts = ["before\n\n```\nx = 1\n\ny = 2\n```\nafter\n\nmore", f"{long}\n\n~~~\nc\n~~~\n\n{long}", "```\na\n```\n```\nb\n```", "```\nopen", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = [r["u"] for r in df.select("k", K.code_units(K.blocks(F.col("t"))).alias("u")).orderBy("k").collect()]
    assert got == [["before\n\n```\nx = 1\n\ny = 2\n```\n\nafter", "more"], [long.strip(), "~~~\nc\n~~~", long.strip()], ["```\na\n```\n\n```\nb\n```"], ["```\nopen"], []]


def test_chunk_text(spark):
    df = spark.createDataFrame([("T", ["t", " A ", ""]), ("T", []), ("T", ["B", "T"])], "title string, path array<string>")
    path = K.heading_path(F.col("title"), F.col("path"))
    got = [tuple(r) for r in df.select(path, K.chunk_text(F.col("title"), path, F.lit("b"))).collect()]
    assert got == [(["A"], "Document Title: T\nHeading Path: A\n\nb"), ([], "Document Title: T\nHeading Path: T\n\nb"), (["B", "T"], "Document Title: T\nHeading Path: B > T\n\nb")]


def test_tables_and_code_of_pages():
    page = "<body><h1>A</h1><table><tr><th>x</th><th>y z</th></tr><tr><td>1</td><td></td><td>2 <b>3</b></td></tr></table><pre>a\n b</pre></body>"
    assert S.html_sections(page) == [(["A"], "x | y z\n1 | 2 3\n\n```\na\n b\n```")]


def test_a_section_is_cut_into_blocks_once(spark):
    """Within a lambda, blocks that were written out again were cut again for every block of a section."""
    plan = spark.createDataFrame([("a",)], "t string").select(K.chunks(F.col("t")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(K.FENCED) == 1
    texts = ["a  b\r\n\r\n\r\n\r\nc\t d ", "\u00a0x\u2028", "a\n\nb", "", None, "a\x85", "\n\n\n", "x \n y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda t: re.sub(r"^\s+|\s+$", "", re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", t or ""))))
    assert [r[0] for r in rows.select(X.clean(F.col("t"))).collect()] == [plain(t) for t in texts]
