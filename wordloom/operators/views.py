"""Views over the facts: words, sources, links between them, contexts, progress.

Order is always a column. Where a later or an earlier row wins, the aggregation names
the order it goes by, so the result does not depend on partitioning or retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import (
    empty_if_null,
    null_if_empty,
    text_id,
    unicode_trim,
)

#: Contexts kept for a word in a source.
CONTEXTS = 5
#: Sentences per bucket when words of one source are numbered.
ORDER_BUCKET = 1024


def occurrence_counts(rows: DataFrame) -> DataFrame:
    """Occurrences of a word in a source, from facts (which have ``n``) or bare tokens.

    The partial aggregation folds a hot pair to one row per task before the shuffle.
    """
    n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    return rows.groupBy("source_id", "word").agg(n.alias("occurrence_count"))


def total_links(facts: DataFrame) -> DataFrame:
    return facts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"))


def source_progress(sentences: DataFrame) -> DataFrame:
    """Last index per source, over all sentences, also those that hold no vocabulary."""
    return sentences.groupBy("source_id").agg(F.max("sentence_idx").alias("last_processed"))


def word_sources(facts: DataFrame, contexts: bool = False) -> DataFrame:
    """One row per word and source: count, first and latest sentence index.

    All buffers are numbers, so both sides of the shuffle are hash aggregations. With
    ``contexts`` the id of the latest sentence comes along, which makes Spark sort; that
    is still cheaper than a shuffle of the links to fetch it.
    """
    measures = [
        F.sum("n").alias("occurrence_count"),
        F.min("sentence_idx").alias("first_sentence_idx"),
        F.max("sentence_idx").alias("last_sentence_idx"),
    ]
    if contexts:
        latest = F.max_by("sentence_id", "sentence_idx")
        measures.append(latest.alias("context_sentence_id"))
    if "ingested_at" in facts.columns:
        measures.append(F.min("ingested_at").alias("first_seen_at"))
    keys = [c for c in ("source_id", "word", "language", "word_id") if c in facts.columns]
    return facts.groupBy(*keys).agg(*measures)


def latest_context(facts: DataFrame) -> DataFrame:
    """The sentence a word was last seen in, per source."""
    return facts.groupBy("source_id", "word").agg(
        F.max_by("sentence_id", "sentence_idx").alias("context_sentence_id")
    )


def top_contexts(facts: DataFrame, limit: int = CONTEXTS) -> DataFrame:
    """The first ``limit`` different sentences of a word in a source, numbered from 1.

    Repeats of a sentence are folded first, keyed by the sentence too, which spreads a
    hot pair over all tasks. Each task then keeps at most ``limit`` rows per pair before
    the second shuffle.
    """
    firsts = facts.groupBy("source_id", "word", "sentence_id").agg(
        F.min("sentence_idx").alias("sentence_idx")
    )
    order = Window.partitionBy("source_id", "word").orderBy("sentence_idx")
    return firsts.withColumn("context_no", F.row_number().over(order).cast("bigint")).where(
        F.col("context_no") <= limit
    )


def words_in_order(facts: DataFrame) -> DataFrame:
    """Words of a source numbered from 1 by first appearance.

    Numbering a source in one window would put all its words in one task. They are
    numbered within stretches of sentences instead, and the stretches, which are
    few, are summed up.
    """
    placed = (
        facts.groupBy("source_id", "word")
        .agg(
            F.min("sentence_idx").alias("first_idx"),
            F.min_by("first_token_idx", "sentence_idx").alias("token_idx"),
        )
        .withColumn("bucket", F.expr(f"first_idx div {ORDER_BUCKET}"))
        .where("source_id IS NOT NULL AND bucket IS NOT NULL")
    )
    # Both uses below read the same columns and rows of this layout, so Spark shuffles it once:
    # the NULL checks are those the join would otherwise add to one side only.
    within = Window.partitionBy("source_id", "bucket").orderBy("first_idx", "token_idx", "word")
    numbered = placed.repartition("source_id", "bucket").withColumn(
        "no", F.row_number().over(within)
    )
    before = (
        Window.partitionBy("source_id")
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        numbered.groupBy("source_id", "bucket")
        .agg(F.max("no").alias("words"))
        .select(
            "source_id",
            "bucket",
            F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"),
        )
    )
    return numbered.join(offsets, ["source_id", "bucket"]).select(
        "source_id", "word", (F.col("no") + F.col("offset")).alias("word_no")
    )


def upsert_words(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per (word, lemma, language); the last non-empty pronunciation and definitions win.

    ``rows`` has ``word``, ``lemma``, ``language``, ``pronunciation`` and the columns of
    ``order``, and may have ``definitions``. Blank words are left out; ``validate`` reports them.
    """
    keys = ["word", "lemma", "language"]
    values = [c for c in ("pronunciation", "definitions") if c in rows.columns]
    clean = rows.select(
        unicode_trim(F.col("word")).alias("word"),
        unicode_trim(empty_if_null(F.col("lemma"))).alias("lemma"),
        F.coalesce(F.col("language"), F.lit("und")).alias("language"),
        *[null_if_empty(F.col(v)).alias(v) for v in values],
        F.struct(*order).alias("ord"),
    ).where(F.col("word") != "")
    merged = clean.groupBy(*keys).agg(
        *[
            empty_if_null(F.max_by(v, F.when(F.col(v).isNotNull(), F.col("ord")))).alias(v)
            for v in values
        ]
    )
    return merged.select(text_id(*[F.col(k) for k in keys]).alias("word_id"), *keys, *values)


SOURCE_KEY = ("url", "title", "author")


def dedup_keys(rows: DataFrame) -> DataFrame:
    """Add ``source_key``, the same for rows of one source."""
    return rows.withColumn("source_key", text_id(*[F.col(k) for k in SOURCE_KEY]))


def dedup_sources(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per (url, title, author), NULL and ``''`` being the same; the first row's rest wins.

    Rows with a blank ``source_type`` are left out; ``validate`` reports them.
    """
    keys = list(SOURCE_KEY)
    kept = F.struct(
        unicode_trim(F.col("source_type")).alias("source_type"),
        empty_if_null(F.col("website")).alias("website"),
        empty_if_null(F.col("meta")).alias("meta"),
    )
    return (
        rows.where(unicode_trim(F.col("source_type")) != "")
        .select(
            *[empty_if_null(F.col(k)).alias(k) for k in keys],
            kept.alias("kept"),
            F.struct(*order).alias("ord"),
        )
        .groupBy(*keys)
        .agg(F.min_by("kept", "ord").alias("kept"))
        .select(*keys, "kept.*")
        .transform(dedup_keys)
    )


def words_by_source(
    words: DataFrame, links: DataFrame, source_id: int | None = None
) -> DataFrame:
    """Words linked to a source (or, without one, to every source); NULL text reads as ``''``.

    A link names the word by ``word_id``: two words may be written alike.
    """
    wanted = links if source_id is None else links.where(F.col("source_id") == source_id)
    text = [f.name for f in words.schema.fields if f.dataType.simpleString() == "string"]
    shaped = words.select(*[empty_if_null(F.col(c)).alias(c) if c in text else c for c in words.columns])
    return shaped.join(wanted.select("source_id", "word_id"), "word_id")
