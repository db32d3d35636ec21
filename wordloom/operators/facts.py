"""Facts: what a sentence says about a word."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import morph
from wordloom.functions.counting import count_words
from wordloom.functions.text import is_ascii, is_blank, to_hiragana, unicode_trim
from wordloom.operators.tokens import SPACED_TOKEN, STARTS_AS_WORD, analyser_udf


def vocabulary_tokens(tokens: DataFrame, drop_ascii: bool = True) -> DataFrame:
    """Tokens that count as vocabulary, with their canonical ``word``."""
    word = unicode_trim(morph.canonical_word(F.col("surface"), F.col("base_form")))
    return tokens.where(
        morph.is_vocabulary(
            F.col("surface"), F.col("pos"), F.col("primary_pos"), drop_ascii=drop_ascii
        )
    ).withColumn("word", word)


def sentence_words(words: DataFrame, readings: bool = True) -> DataFrame:
    """One row per sentence and word: count, first position, first non-empty reading.

    All groups are small and evenly spread, since a sentence is part of the key.
    Choosing a reading needs a string in the aggregation buffer, which makes Spark
    sort; pass ``readings=False`` where the tokeniser gives none, and the
    aggregation stays a hash aggregation.
    """
    keys = [c for c in ("source_id", "sentence_idx", "sentence_id", "language", "word") if c in words.columns]
    measures = [F.count(F.lit(1)).alias("n"), F.min("token_idx").alias("first_token_idx")]
    if not readings:
        return words.groupBy(*keys).agg(*measures).withColumn("reading", F.lit(""))
    kana = to_hiragana(F.col("reading"))
    first = F.min_by(F.col("kana"), F.when(F.col("kana") != "", F.col("token_idx")))
    return (
        words.withColumn("kana", kana)
        .groupBy(*keys)
        .agg(*measures, F.coalesce(first, F.lit("")).alias("reading"))
    )


def counted_facts(sentences: DataFrame, words: Column, readings: bool = True) -> DataFrame:
    """Facts of sentences whose vocabulary tokens are an array of structs in the same row.

    A sentence is one row, so its words are counted inside it and nothing is shuffled:
    grouping token rows would move some ten times the volume of the text. ``words`` is
    as in ``count_words``.
    """
    rest = [c for c in sentences.columns if c != "sentence"]
    reading = F.coalesce("f.reading", F.lit("")) if readings else F.lit("")
    return sentences.select(*rest, F.explode(count_words(words, readings)).alias("f")).select(
        *rest,
        "f.first.word",
        "f.n",
        F.col("f.first.token_idx").cast("bigint").alias("first_token_idx"),
        reading.alias("reading"),
    )


def spaced_facts(sentences: DataFrame, drop_ascii: bool = True) -> DataFrame:
    """What ``sentence_words`` gives for the tokens of ``tokenize_spaced``, without a shuffle."""
    found = F.regexp_extract_all(F.col("sentence"), F.lit(SPACED_TOKEN), F.lit(0))
    placed = F.transform(
        found, lambda s, i: F.struct(s.alias("surface"), i.alias("token_idx"))
    )

    def keep(token: Column) -> Column:
        is_word = token["surface"].rlike(STARTS_AS_WORD)
        return is_word & ~is_ascii(token["surface"]) if drop_ascii else is_word

    words = F.transform(
        F.filter(placed, keep),
        lambda t: F.struct(F.lower(t["surface"]).alias("word"), t["token_idx"]),
    )
    return counted_facts(sentences, words, readings=False)


def analysed_facts(
    sentences: DataFrame,
    analyse: Callable[[pd.Series], pd.Series],
    drop_ascii: bool = True,
) -> DataFrame:
    """What ``sentence_words`` gives for the tokens of an analyser, without a shuffle.

    ``analyse`` is as in ``tokenize_with``.
    """
    found = sentences.withColumn("found", analyser_udf(analyse)(F.col("sentence")))
    placed = F.transform(
        F.col("found"), lambda m, i: F.struct(m.alias("m"), i.alias("token_idx"))
    )

    def keep(token: Column) -> Column:
        surface, features = token["m"]["surface"], token["m"]["features"]
        return ~is_blank(surface) & morph.is_vocabulary(
            surface, features, morph.primary_pos(features), drop_ascii
        )

    def word(token: Column) -> Column:
        surface, features = token["m"]["surface"], token["m"]["features"]
        base = morph.base_form(surface, features)
        return F.struct(
            unicode_trim(morph.canonical_word(surface, base)).alias("word"),
            token["token_idx"].alias("token_idx"),
            to_hiragana(morph.reading(features)).alias("reading"),
        )

    words = F.transform(F.filter(placed, keep), word)
    return counted_facts(found, words).drop("found")


#: Checks in the order in which they are made.
def _problem(df: DataFrame) -> Column:
    checks = {
        "source_type": (is_blank, "source_type must be non-empty"),
        "word": (is_blank, "word must be non-empty"),
        "word_id": (lambda c: F.coalesce(c, F.lit(0)) <= 0, "word_id must be positive"),
        "source_id": (lambda c: F.coalesce(c, F.lit(0)) <= 0, "source_id must be positive"),
        "n": (lambda c: F.coalesce(c, F.lit(0)) < 1, "increment must be positive"),
    }
    problem = F.lit(None).cast("string")
    for name, (fails, message) in reversed(checks.items()):
        if name in df.columns:
            problem = F.when(fails(F.col(name)), F.lit(message)).otherwise(problem)
    return problem


def validate(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``reason``: NULL for a good row, else the first check it fails.

    Checks apply to the columns that are there. With ``strict`` the first bad row
    fails the job and the column is left out.
    """
    problem = _problem(df)
    if strict:
        return df.where(F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem)))
    return df.withColumn("reason", problem)
