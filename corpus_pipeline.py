"""From raw documents to encoded training data, stage by stage.

Each stage takes the documents that its predecessor kept and returns those it
keeps, with the columns of ``documents``; the last returns the encoded rows.

In every stage null and empty texts are rows like others (scored, never linked,
without tokens), repeated rows are judged alike, an empty table gives an empty
one, and further columns stay, whatever their names, kinds (maps, variants) and
nulls. Texts of any length are read whole; ties go to the smaller id. Near duplicates take five
words here, as the task's stages do; ``op1`` takes the four of its contract.
"""

from __future__ import annotations

import warnings

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.mixing import apply_rates, fit_rates
from quarrymill.llm.near_dedup import keep_one
from quarrymill.llm.pieces import encode_pieces
from quarrymill.llm.quality import score_quality
from quarrymill.storage import Scratch
from quarrymill.llm.toxicity import score_toxicity

#: Token shares of the languages after mixing.
TARGETS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}
#: A larger gap between an expected token share and its target is told as a warning.
MOST_GAP = 0.02


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return score_quality(docs, labels(spark, sf_dir)).filter("predicted = 1").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return score_toxicity(docs, labels(spark, sf_dir)).filter("predicted = 0").select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8); rows without an id or words stay."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the fitted rates say; no language has to shrink."""
    rated = fit_rates(docs, docs.select("doc_id", F.col("lang").alias("label")), TARGETS)
    gap = rated.select("residual").first()
    if gap and gap[0] > MOST_GAP:
        warnings.warn(f"the mixing rates miss a target by {gap[0]:.1%} of all tokens", stacklevel=2)
    return apply_rates(rated, docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of every document."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", dedup), ("mixing", mixing), ("sentencepiece", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables, before = Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            tables.drop(before)
        before = f"stage-{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


#: No stage but the near-duplicates can be put in SQL: they learn models.
ORACLE_SQL = None
