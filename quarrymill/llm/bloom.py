"""A Bloom filter of fixed size, filled by a distributed aggregation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.texthash import mix

#: 64-bit words of the filter: 8 MB at any input size. A fuller filter lets more through and stays right.
WORDS, HASHES = 1 << 20, 3


def bloom_filter(df: DataFrame, key: str) -> np.ndarray:
    """The filter's words over all values of ``key``; at most ``WORDS`` rows reach the driver."""

    def bits(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.unique(batch.column(0).to_numpy()).astype(np.int64).view(np.uint64)
            at = np.concatenate([mix(x + np.uint64(i)) for i in range(1, HASHES + 1)])
            word, bit = (at % np.uint64(WORDS)).astype(np.int64), np.uint64(1) << (at >> np.uint64(58))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], ["word", "bit"])

    rows = df.select(F.col(key).cast("long")).mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(WORDS, dtype=np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key whether the filter may hold it; false is certain."""
    x = keys.astype(np.int64).view(np.uint64)
    ok = np.ones(len(x), dtype=bool)
    for i in range(1, HASHES + 1):
        at = mix(x + np.uint64(i))
        ok &= (words[(at % np.uint64(WORDS)).astype(np.int64)] >> (at >> np.uint64(58))) & np.uint64(1) != 0
    return ok
