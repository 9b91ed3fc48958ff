"""Command output, rendered tables, query registries and logs, as DataFrame operations over texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import text as X

# Terminal escape sequences, and how much of an output is kept.
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
KEPT = 50_000


def plain_output(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), ANSI, "")


def tail(c: Column, most: int = KEPT) -> Column:
    return F.coalesce(F.right(c, F.lit(most)), F.lit(""))


def both_outputs(out: Column, err: Column) -> Column:
    """Output, and errors behind a mark where there are both."""
    a, b = F.coalesce(out, F.lit("")), F.coalesce(err, F.lit(""))
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("\n[stderr]\n"), b)).when(a != "", a).otherwise(b)


def redact_argument(c: Column) -> Column:
    """An argument ``user@host:port:key.pem`` keeps all but its key; others are redacted as texts are."""
    return F.when(c.rlike(r"@[^\s:]+:\d+:[^\s]+\.pem$"), F.concat(F.regexp_extract(c, r"(?s)^(.*):", 1), F.lit(":[REDACTED_KEY_PATH]"))).otherwise(X.redact(c))


def mounts(lines: DataFrame, prefix: str) -> DataFrame:
    """``(k, line)`` of a mount table to each mount point under a prefix once, blanks unescaped, with its first line."""
    point = F.get(F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""), F.lit(1))
    for code, sign in ((r"\\040", " "), (r"\\011", "\t"), (r"\\012", "\n"), (r"\\134", r"\\")):
        point = F.regexp_replace(point, code, sign)
    return lines.select("k", point.alias("mount")).filter(F.col("mount").startswith(prefix)).groupBy("mount").agg(F.min("k").alias("k"))


def first_json(c: Column, path: str) -> Column:
    """A value of a JSON text, or of its first line that is an object and has it."""
    of = lambda x: F.try_variant_get(F.try_parse_json(x), path, "string")
    lines = F.transform(F.filter(F.split(c, "\n"), lambda x: F.trim(x).startswith("{")), of)
    return F.coalesce(of(c), F.get(F.filter(lines, lambda x: x.isNotNull()), F.lit(0)))


def table_cells(reports: DataFrame) -> DataFrame:
    """``(k, s)`` texts with rendered tables to cells: ``k, row, pos, header, text, whole, fraction``.

    The first row of two cells or more is the header; blank headers are named by
    their place, repeated ones numbered. Short rows are filled up, long ones cut.
    """
    lines = reports.select("k", F.posexplode(F.split(plain_output(F.col("s")), r"\r?\n")).alias("n", "l")).withColumn("l", F.trim("l"))
    lines = lines.filter(F.col("l").startswith("┃") & F.col("l").endswith("┃") & (F.length("l") > 1))
    cells = F.transform(F.split(F.expr("substr(l, 2, length(l) - 2)"), "┃"), lambda x: F.trim(x))
    rows = lines.select("k", "n", cells.alias("cells")).filter((F.size("cells") > 1) & F.exists("cells", lambda x: x != ""))
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("k").orderBy("n")) - 1)
    heads = rows.filter("row = 0").select("k", F.posexplode("cells").alias("pos", "h"))
    base = F.when(F.col("h") == "", F.concat(F.lit("column_"), F.col("pos") + 1)).otherwise(F.col("h"))
    nth = F.row_number().over(Window.partitionBy("k", "base").orderBy("pos"))
    heads = heads.withColumn("base", base).withColumn("nth", nth).select("k", "pos", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "nth")).alias("header"))
    text = F.coalesce(F.get("cells", "pos"), F.lit(""))
    body = rows.filter("row > 0").join(heads, "k").select("k", "row", "pos", "header", text.alias("text"))
    number = F.regexp_replace("text", ",", "")
    whole, fraction = number.rlike(r"^[-+]?\d+$"), number.rlike(r"^[-+]?\d*\.\d+$")
    return body.withColumns({"whole": F.when(whole, number.try_cast("long")), "fraction": F.when(fraction, number.try_cast("double"))})


def query_registry(files: DataFrame) -> DataFrame:
    """``(k, s)`` texts of ``-- name: recipe.query`` blocks to ``recipe, query, sql``; of repeated names the last stays, empty blocks go.

    A name without a dot, or with an empty part, raises an error.
    """
    mark = r"(?m)^\s*--\s*name\s*:\s*(.+?)\s*$"
    names, bodies = F.regexp_extract_all("s", F.lit(mark), F.lit(1)), F.split("s", mark)
    blocks = files.select("k", F.posexplode(F.transform(names, lambda x, i: F.struct(x.alias("name"), F.regexp_replace(F.get(bodies, i + 1), r"(?U)^\s+|\s+$", "").alias("sql")))).alias("n", "b")).select("k", "n", "b.*").filter("sql <> ''")
    recipe, query = F.trim(F.regexp_extract("name", r"^([^.]*)\.", 1)), F.trim(F.regexp_extract("name", r"^[^.]*\.(.*)$", 1))
    checked = F.when((recipe == "") | (query == ""), F.raise_error(F.concat(F.lit("invalid block name "), "name"))).otherwise(recipe)
    return blocks.select(checked.alias("recipe"), query.alias("query"), "k", "n", "sql").groupBy("recipe", "query").agg(F.max_by("sql", F.struct("k", "n")).alias("sql"))


def recipe_sql(registry: dict[tuple[str, str], str], recipe: str, table: str, query: str = "default") -> str:
    """A recipe's statement as ``spark.sql`` takes it, or all rows of a table."""
    if found := registry.get((recipe, query)):
        return found.strip().rstrip(";")
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", table):
        raise ValueError(f"{table!r} is no table's name")
    return f"SELECT * FROM {table}"


def append_log(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines behind those that a log has; also the sink of ``foreachBatch``."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)
