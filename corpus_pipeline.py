"""The corpus pipeline: stages over ``documents``, each reading what the one before it wrote."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wordloom.llm import decontamination, language_id, line_dedup, mixing, simhash  # noqa: E402
from wordloom.llm.queries import MIX_TARGETS  # noqa: E402
from wordloom.llm.tables import shared, table  # noqa: E402

#: Corrected share of a text's n-grams that its best language must hold.
MIN_LANGUAGE_SCORE = 0.25

#: A document that line dedup would leave with less of its text than this keeps all of it.
MIN_TEXT_LEFT = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters or in no learned language. Learned from the rows that name a language."""
    own = language_id.predict(docs, language_id.learn(docs), pred="pred__", score="score__")
    good = (F.col("pred__") != "und") & (F.col("score__") >= MIN_LANGUAGE_SCORE)
    return own.where(good).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take boilerplate lines out of the texts; ``n_chars`` follows.

    Near copies are still there in this stage and vote each other's lines out, so texts that would lose most stay whole.
    """
    out = line_dedup.drop_boilerplate(docs, min_left=MIN_TEXT_LEFT)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, the one with the smallest id; also of repeated rows and without ids."""
    return simhash.one_row_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their tokens, domain posteriors, rate and number of copies."""
    mixed = mixing.mix_documents(docs, docs, MIX_TARGETS, domain="lang", keep=tuple(docs.columns))
    return mixed


STAGES: list[tuple[str, Stage]] = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_boilerplate_lines),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_to_targets),
]

#: Learned stages are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
