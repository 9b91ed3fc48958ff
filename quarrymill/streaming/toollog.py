"""The tool log as a running stream: JSON lines in, call/result pairs and error lines out.

The log is a folder of files to which runs append. A stream reads what is new,
lines that don't parse go to their own sink, calls meet their results in a join of
two streams with watermarks, and each micro-batch replaces a folder of its own
number: a batch that is played again after a failure writes the same rows to the
same place. A run ends when it has read all there is, and the next one goes on
from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.storage import shared_dir
from quarrymill.streaming import traffic

LOG = "id string, kind string, ts timestamp, conv_id long, turn long, text string"
BROKEN = "broken string"
CALL, RESULT = "call", "result"


def append(rows: DataFrame, path: str) -> None:
    """Log lines of ``LOG``'s columns, behind those that the folder has."""
    rows.select(F.to_json(F.struct("id", "kind", "ts", "conv_id", "turn", "text")).alias("value")).write.mode("append").text(path)


def close(spark: SparkSession, log: str, out: str, at: str) -> None:
    """Give up the calls that have no result by ``at``: a mark for each side moves the watermark, and the marks' next run acts on it."""
    for _ in range(2):
        marks = spark.createDataFrame([(CALL,), (RESULT,)], "kind string").select(F.concat(F.lit("closed "), "kind").alias("id"), "kind", F.lit(at).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("text"))
        append(marks, log)
        run(spark, log, out)


def parsed(lines: DataFrame) -> DataFrame:
    """Lines to the log's columns, and ``broken``: the line itself where it is no record of the log."""
    row = F.from_json("value", f"{LOG}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = lines.select("value", row.alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | F.col("r.kind").isNull() | F.col("r.ts").isNull()
    return out.select(*(F.col(f"r.{c.split()[0]}") for c in LOG.split(", ")), F.when(bad, F.col("value")).alias("broken"))


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink in which a batch replaces what an earlier run of it has written."""

    def write(rows: DataFrame, batch: int) -> None:
        if "conv_id" in rows.columns:  # a mark has none; a filter in the stream would act below the watermark, which the mark is for
            rows = rows.filter("conv_id IS NOT NULL")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def run(spark: SparkSession, log: str, out: str, patience: str = "1 hour", files: int = 1000) -> None:
    """Read what is new in ``log``: pairs go to ``out/pairs``, broken lines to ``out/errors``; ``files`` bounds a micro-batch."""
    log, out = (p if "://" in p or p.startswith("/") else f"{shared_dir(spark)}/{p}" for p in (log, out))
    source = lambda: parsed(spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(log))
    calls = source().filter(f"broken IS NULL AND kind = '{CALL}'").select("id", "ts", "conv_id", "turn", F.length("text").cast("long").alias("call_chars"))
    results = source().filter(f"broken IS NULL AND kind = '{RESULT}'").select("id", "ts", F.length("text").cast("long").alias("result_chars"))
    joined = traffic.pairs(calls, results, patience).select(F.col("c.id").alias("id"), "conv_id", "turn", "call_chars", "result_chars")
    started = [
        rows.writeStream.foreachBatch(by_batch(f"{out}/{name}")).option("checkpointLocation", f"{out}/checkpoints/{name}").trigger(availableNow=True).start()
        for name, rows in (("pairs", joined), ("errors", source().filter("broken IS NOT NULL").select("broken")))
    ]
    for q in started:
        q.awaitTermination()


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """What the runs so far have written."""
    schema = {"pairs": "id string, conv_id long, turn long, call_chars long, result_chars long", "errors": BROKEN}[name]
    return spark.read.schema(f"{schema}, batch long").parquet(f"{out}/{name}").drop("batch")
