"""Texts to facts, and batches of texts into a store."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import text_id
from wordloom.operators.articles import main_text, page_blocks, page_metadata
from wordloom.operators.facts import analysed_facts, sentence_words, spaced_facts, vocabulary_tokens
from wordloom.operators.layout import is_small, spread
from wordloom.operators.sentences import sentence_list, split_sentences, with_sentence_id
from wordloom.operators.views import dedup_keys
from wordloom.plans.store import JOBS, VocabularyStore
from wordloom.schemas import FACTS, SENTENCES, SOURCES
from wordloom.session import shuffles_dropped, work_folder
from wordloom.sources.raw_pages import decoded_pages
from wordloom.sources.readers import accepted_pages, rejected_pages

Tokenizer = Callable[[DataFrame], DataFrame]
log = logging.getLogger(__name__)


def sentence_rows(texts: DataFrame, part: str | None = None) -> DataFrame:
    """``(source_id, sentence_idx, sentence, sentence_id)`` of ``(source_id[, part], text)``."""
    columns = ["source_id", "text"] + ([part] if part else [])
    keys = ["source_id"] + ([part] if part else [])
    return with_sentence_id(split_sentences(spread(texts.select(*columns), *keys), part=part))


def fact_rows(
    sentences: DataFrame, tokenizer: Tokenizer | None = None, drop_ascii: bool = True
) -> DataFrame:
    """Facts of sentences: of spaced text, or of what another tokeniser makes of them.

    Spaced text is counted inside the row. A tokeniser returns token rows, which are grouped.
    """
    if tokenizer is None:
        return spaced_facts(sentences, drop_ascii)
    return sentence_words(vocabulary_tokens(tokenizer(sentences), drop_ascii))


def page_texts(pages: DataFrame, stage: str | None = None) -> DataFrame:
    """``(source_id, text)`` of the article text of all pages within the size limit.

    The blocks are written to ``stage``, by default a folder of their own in the shared
    work folder, so that the markup is parsed once and text is read only where needed.
    """
    spark = pages.sparkSession
    stage = stage or work_folder(spark, "blocks")
    blocks = page_blocks(spread(accepted_pages(pages), "page_id"))
    blocks.write.mode("overwrite").parquet(stage)
    return main_text(spark.read.schema(blocks.schema).parquet(stage)).select(
        F.col("page_id").alias("source_id"), "text"
    )


def _continued(texts: DataFrame) -> DataFrame:
    """Sentences of texts that are new, given what is known of each source.

    ``texts`` has the list ``found`` of a text's sentences, and ``last_processed``, ``text_sentences`` and
    ``known_id`` of its source's latest text. A text that begins with all sentences of the latest goes on
    behind them; any other one was edited and is taken in whole. Indexes go on in either case.
    """
    begins = F.slice("found", 1, F.col("text_sentences").cast("int"))
    same = (F.size(begins) == F.col("text_sentences")) & (_content_id(begins) == F.col("known_id"))
    start = F.when(same, F.col("text_sentences")).otherwise(0).cast("bigint")
    base = F.coalesce("last_processed", F.lit(-1)) + 1
    return texts.withColumn("start", start).withColumn("base", base)


def _content_id(sentences: Column) -> Column:
    return text_id(F.array_join(sentences, "\n"))


def _exploded(texts: DataFrame) -> DataFrame:
    rows = texts.select(
        "source_id", "language", "start", "base",
        F.size("found").cast("bigint").alias("text_sentences"),
        _content_id(F.col("found")).alias("content_id"),
        F.posexplode("found").alias("at", "sentence"),
    )
    index = F.col("base") + F.col("at") - F.col("start")
    new = rows.where("at >= start").withColumn("sentence_idx", index)
    return with_sentence_id(new).select(*SENTENCES.fieldNames())


def fresh_sentences(texts: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """Sentences of ``(source_id, language, arrival, text)`` beyond the progress of their source.

    One pass over the ids finds the sources that need care: known ones, and those that come more than once.
    They are few or many; either way the others, which are most, go straight
    through, and every text is split once. Texts of one source follow each other by ``arrival``.
    """
    counted = texts.groupBy("source_id").agg(F.count(F.lit(1)).alias("times"))
    known = counted.select("source_id").limit(0) if progress is None else progress
    if progress is None:
        for c, kind in (("last_processed", "bigint"), ("text_sentences", "bigint"), ("content_id", "string")):
            known = known.withColumn(c, F.lit(None).cast(kind))
    special = counted.join(known.withColumnRenamed("content_id", "known_id"), "source_id", "left")
    special = special.where("times > 1 OR last_processed IS NOT NULL")
    path = work_folder(texts.sparkSession, "special")
    with shuffles_dropped(texts.sparkSession):
        special.write.parquet(path)
    special = texts.sparkSession.read.schema(special.schema).parquet(path)
    # Many of them are dealt to where the texts of their sources lie; texts are neither moved again nor sorted.
    special = F.broadcast(special) if is_small(special) else special.hint("shuffle_hash")
    repeated = special.where("times > 1")
    has_repeated = not repeated.isEmpty()
    once = texts.join(repeated.select("source_id"), "source_id", "left_anti") if has_repeated else texts
    split = spread(once, "source_id").withColumn("found", sentence_list(F.col("text"))).drop("text")
    single = _exploded(_continued(split.join(special, "source_id", "left")))
    if not has_repeated:
        return single
    # Several texts of a source: each is compared with the one before it.
    order = Window.partitionBy("source_id").orderBy("arrival", "own_id")
    several = texts.join(repeated, "source_id").withColumn("found", sentence_list(F.col("text"))).drop("text")
    several = several.withColumn("own_id", _content_id(F.col("found")))
    before, size = F.lag("own_id").over(order), F.lag(F.size("found").cast("bigint")).over(order)
    several = _continued(
        several.withColumn("known_id", F.coalesce(before, "known_id")).withColumn(
            "text_sentences", F.coalesce(size, "text_sentences"))
    )
    added = F.sum(F.size("found") - F.col("start")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    several = several.withColumn("base", F.col("base") + F.coalesce(added, F.lit(0)))
    return single.unionByName(_exploded(several))


def ingest_batch(
    store: VocabularyStore,
    texts: DataFrame,
    batch_id: int | None = None,
    stream: str = JOBS,
    tokenizer: Tokenizer | None = None,
    analyse: Callable[[pd.Series], pd.Series] | None = None,
    drop_ascii: bool = True,
    resume: bool = True,
    language: str = "und",
    on_batch: Callable[[int, int, int], None] | None = None,
    on_progress: Callable[[str, int, int], None] | None = None,
    on_error: Callable[[int, Exception], None] | None = None,
    extra_write: Callable[[DataFrame, int], None] | None = None,
    new_sources: DataFrame | None = None,
    rejected: DataFrame | None = None,
) -> int:
    """Add the sentences of ``texts`` that the store has not seen; return the links made.

    ``texts`` has ``source_id`` and ``text``, and may have ``language`` (else it is ``language``)
    and ``arrival``, the order of several texts of one source. Texts without a source are rejected.

    A committed batch is not written again: its links are returned. Known sentences are dropped before
    anything is tokenised; sentences are written once and read back, so text is split and
    tokenised once. An error at any point leaves the batch uncommitted, is told to
    ``on_error`` and raised. ``on_progress`` hears the step, sentences done and sentences of
    the batch. ``extra_write`` runs before the commit and again if the batch is retried: it
    must be idempotent, with the batch id as its key.
    """
    if batch_id is None:
        batch_id = store.next_batch_id(stream)
    if (done := store.committed(batch_id, stream)) is not None:
        return done["links"]
    try:
        return _write_batch(
            store, texts, batch_id, stream, tokenizer, analyse, drop_ascii, resume, language, on_batch,
            on_progress, extra_write, new_sources, rejected,
        )
    except Exception as error:
        log.error("batch %s of %s failed: %s", batch_id, stream, error)
        if on_error is not None:
            on_error(batch_id, error)
        raise


def _write_batch(
    store, texts, batch_id, stream, tokenizer, analyse, drop_ascii, resume, language, on_batch,
    on_progress, extra_write, new_sources, rejected,
):
    def put(table: str, rows: DataFrame) -> DataFrame:
        return store.write_part(table, batch_id, rows, stream)

    named = texts.select(
        F.col("source_id").cast("string").alias("source_id"),
        (F.col("language") if "language" in texts.columns else F.lit(language)).alias("language"),
        (F.col("arrival") if "arrival" in texts.columns else F.lit(0)).cast("bigint").alias("arrival"),
        "text",
    )
    nameless = named.where("source_id IS NULL").select("source_id", F.lit("no source").alias("reason"))
    put("rejected", nameless if rejected is None else nameless.unionByName(rejected))
    good = named.where("source_id IS NOT NULL")
    fresh = fresh_sentences(good, store.progress() if resume else None)
    sentences, total = store.write_counted("sentences", batch_id, fresh, F.count(F.lit(1)), stream)
    log.info("batch %s of %s: %s sentences", batch_id, stream, total)
    tell = on_progress or (lambda *_: None)
    tell("sentences", 0, total)
    if analyse is not None:
        facts = analysed_facts(sentences, analyse, drop_ascii)
    else:
        facts = fact_rows(sentences, tokenizer, drop_ascii)
    facts, links = store.write_counted("facts", batch_id, facts.select(*FACTS.fieldNames()), F.sum("n"), stream)
    tell("facts", total, total)
    latest = F.max_by(F.struct("text_sentences", "content_id"), "sentence_idx").alias("p")
    progress = sentences.groupBy("source_id").agg(F.max("sentence_idx").alias("last_processed"), latest)
    put("progress", progress.select("source_id", "last_processed", "p.*"))
    if new_sources is not None:
        put("sources", new_sources.select(*SOURCES.fieldNames()))
    if extra_write is not None:
        extra_write(facts, batch_id)
    summary = store.commit(batch_id, total, links, stream)
    log.info("batch %s of %s: committed %s links as %s", batch_id, stream, links, summary["seq"])
    tell("committed", total, total)
    if on_batch is not None:
        on_batch(batch_id, summary["sentences"], summary["links"])
    return summary["links"]


def ingest_pages(
    store: VocabularyStore,
    pages: DataFrame,
    batch_id: int | None = None,
    stream: str = JOBS,
    rejected: DataFrame | None = None,
    **options,
) -> int:
    """Add pages: metadata to sources, article text to sentences and facts; return the links.

    A source is known by (url, title, author), whose hash is its id, so page ids may be used again
    by the next crawl. A page of a known source goes on where that source ended, or is
    taken in whole if it was edited. Pages over the size limit are kept in ``rejected``, as are the
    ``(source_id, reason)`` that the caller has rejected before.
    """
    if batch_id is None:
        batch_id = store.next_batch_id(stream)
    if (done := store.committed(batch_id, stream)) is not None:
        return done["links"]
    spark, stage = pages.sparkSession, work_folder(pages.sparkSession, "pages")

    def staged(rows: DataFrame, name: str) -> DataFrame:
        """Both inputs are used several times; as tables they are computed once."""
        rows.write.parquet(f"{stage}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{stage}/{name}")

    # Page ids name rows of this batch only; a repeated one would mix the blocks of two pages.
    own = text_id(F.col("url"), F.col("html"))
    pages = staged(pages.select(F.col("page_id").alias("arrival"), own.alias("page_id"), "url", "html"), "rows")
    one = [F.min("arrival").alias("arrival"), F.first("url").alias("url"), F.first("html").alias("html")]
    pages = staged(pages.groupBy("page_id").agg(*one), "pages")
    good = spread(accepted_pages(pages), "page_id")
    arrivals = pages.select(F.col("page_id").alias("source_id"), "arrival")
    described = staged(dedup_keys(page_metadata(good)), "described").join(arrivals, "source_id")
    row = F.struct(*SOURCES.fieldNames()[1:])
    created = (
        described.groupBy("source_key")
        .agg(F.min_by(row, F.struct("arrival", "source_id")).alias("row"))
        .select(F.col("source_key").alias("source_id"), "row.*")
        .join(store.known_sources().select("source_id"), "source_id", "left_anti")
    )
    ids = described.select("source_key", "arrival", F.col("source_id").alias("page_id"))
    texts = (
        page_texts(pages, f"{stage}/blocks")
        .withColumnRenamed("source_id", "page_id")
        .join(ids, "page_id")
        .select(F.col("source_key").alias("source_id"), "arrival", "text")
    )
    too_large = rejected_pages(pages).select(F.col("url").alias("source_id"), F.lit("too large").alias("reason"))
    refused = too_large if rejected is None else too_large.unionByName(rejected)
    return ingest_batch(
        store, staged(texts, "texts"), batch_id, stream, new_sources=created, rejected=refused, **options)


def ingest_raw_pages(
    store: VocabularyStore,
    raw: DataFrame,
    batch_id: int | None = None,
    stream: str = JOBS,
    codecs: dict[str, str] | None = None,
    **options,
) -> int:
    """Gate and decode fetched pages, add the good ones as ``ingest_pages`` does and keep why others were refused."""
    if batch_id is None:
        batch_id = store.next_batch_id(stream)
    if (done := store.committed(batch_id, stream)) is not None:
        return done["links"]
    path = work_folder(raw.sparkSession, "decoded")
    decoded = decoded_pages(raw, codecs=codecs)
    decoded.write.parquet(path)
    decoded = raw.sparkSession.read.schema(decoded.schema).parquet(path)
    refused = decoded.where("reason IS NOT NULL").select(F.col("url").alias("source_id"), "reason")
    good = decoded.where("reason IS NULL").select("page_id", "url", "html")
    return ingest_pages(store, good, batch_id, stream, rejected=refused, **options)
