"""Sentence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import sentence_pieces, text_id, unicode_trim

#: Sentence indexes of part p of a source start at p * PART_STRIDE, which keeps
#: their order without counting the sentences of the parts before.
PART_STRIDE = 1 << 32


def sentence_list(text: Column) -> Column:
    """The trimmed, non-blank sentences of a text."""
    return F.filter(F.transform(sentence_pieces(text), unicode_trim), lambda s: s != "")


def split_sentences(
    texts: DataFrame,
    source_id: str = "source_id",
    text: str = "text",
    part: str | None = None,
    trimmed: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """``(source_id, sentence_idx, sentence)`` of all non-blank sentences.

    Blank pieces go before the index is given, so indexes have no gaps. A source
    that spans several rows (the turns of a conversation) names its ordering
    column as ``part``. With ``trimmed=False`` a sentence keeps the white space
    around it. ``keep`` names further columns to carry along.
    """
    if trimmed:
        kept = sentence_list(F.col(text))
    else:
        kept = F.filter(sentence_pieces(F.col(text)), lambda s: unicode_trim(s) != "")
    index: Column = F.col("pos").cast("bigint")
    if part is not None:
        index = index + F.col(part).cast("bigint") * F.lit(PART_STRIDE)
    more = list(keep or [])
    ids = [F.col(source_id).alias("source_id"), *more] + ([part] if part else [])
    return texts.select(*ids, F.posexplode(kept).alias("pos", "sentence")).select(
        "source_id", index.alias("sentence_idx"), "sentence", *more
    )


def with_sentence_id(sentences: DataFrame) -> DataFrame:
    return sentences.withColumn("sentence_id", text_id(F.col("sentence")))


def after_progress(sentences: DataFrame, progress: DataFrame) -> DataFrame:
    """Sentences past the last processed index of their source.

    ``progress`` has ``source_id`` and ``last_processed``; a source without a row,
    or with a NULL, starts at its first sentence.
    """
    last = F.coalesce(F.col("last_processed"), F.lit(-1))
    return (
        sentences.join(progress.select("source_id", "last_processed"), "source_id", "left")
        .where(F.col("sentence_idx") > last)
        .drop("last_processed")
    )


def distinct_sentences(sentences: DataFrame) -> DataFrame:
    """``(sentence_id, sentence)``: each trimmed, non-blank text once.

    The text itself is the grouping key, so repeats are folded before the shuffle
    and equal digests of different texts would not merge.
    """
    text = unicode_trim(F.col("sentence"))
    return (
        sentences.select(text.alias("sentence"))
        .where(F.col("sentence") != "")
        .distinct()
        .select(text_id(F.col("sentence")).alias("sentence_id"), "sentence")
    )
