"""Dictionary index, lookups, enrichment and definition back-fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import definitions as D
from wordloom.functions.text import empty_if_null, to_hiragana
from wordloom.operators.layout import broadcast_if, is_small
from wordloom.operators.sieve import build_sieve, sift

_MATCH = (
    "array<struct<entry_id:string,readings:array<string>,primary_reading:string,"
    "senses:array<string>,pos:array<string>>>"
)


def dictionary_terms(entries: DataFrame) -> DataFrame:
    """``(term, entry_id)``: an entry under each of its spellings once."""
    terms = D.entry_terms(F.col("kanji"), F.col("kana"))
    return entries.select(F.explode(terms).alias("term"), F.col("id").alias("entry_id"))


def term_matches(entries: DataFrame) -> DataFrame:
    """One row per term with all its entries, sorted by entry id as text.

    A term's entries are what every definition of that term lists, so they end up in one
    row in any case. The table is built from the dictionary alone.
    """
    match = F.struct(
        F.col("id").alias("entry_id"),
        D.entry_readings(F.col("kana")).alias("readings"),
        D.primary_kana(F.col("kana")).alias("primary_reading"),
        D.entry_senses(F.col("sense")).alias("senses"),
        D.entry_pos(F.col("sense")).alias("pos"),
    )
    terms = D.entry_terms(F.col("kanji"), F.col("kana"))
    return (
        entries.select(terms.alias("terms"), match.alias("match"))
        .select(F.explode("terms").alias("term"), "match")
        .groupBy("term")
        .agg(F.array_sort(F.collect_list("match")).alias("matches"))
    )


def lookup(
    words: DataFrame,
    matches: DataFrame,
    match_reading: bool = False,
    where: Column | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Add ``matches``: the entries found under the word or under the lemma.

    The OR is two equi-joins against a table with one row per term, united inside the
    row, so words are neither multiplied nor grouped again. With ``match_reading``
    an entry must also have the pronunciation among its kana, unless the
    pronunciation is empty. ``words`` needs ``word``, may have ``lemma`` and, for
    ``match_reading``, ``pronunciation``. Rows that fail ``where`` get no entries.
    ``small`` says whether to broadcast the dictionary where that is known.
    """
    side = broadcast_if(is_small(matches) if small is None else small, matches)
    word, wanted = F.col("word"), F.lit(True) if where is None else where
    # Rows that need no lookup are spread by their word: under NULL they would all meet in a shuffle.
    lemma, other = F.coalesce(F.col("lemma"), word), F.col("lemma") != word
    found = words.join(
        side.select(F.col("term").alias("_term"), F.col("matches").alias("_by_word")),
        (word == F.col("_term")) & wanted,
        "left",
    ).drop("_term")
    hits: Column = F.coalesce(F.col("_by_word"), F.array().cast(_MATCH))
    if "lemma" in words.columns:
        found = found.join(
            side.select(F.col("term").alias("_term"), F.col("matches").alias("_by_lemma")),
            (lemma == F.col("_term")) & other & wanted,
            "left",
        ).drop("_term")
        by_lemma = F.coalesce(F.col("_by_lemma"), F.array().cast(_MATCH))
        hits = F.array_sort(F.array_union(hits, by_lemma))
    if match_reading:
        spoken = to_hiragana(empty_if_null(F.col("pronunciation")))
        hits = F.when(spoken == "", hits).otherwise(
            F.filter(hits, lambda m: F.array_contains(m["readings"], spoken))
        )
    return found.withColumn("matches", hits).drop("_by_word", "_by_lemma")


def sifted_lookup(words: DataFrame, matches: DataFrame, match_reading: bool = False) -> DataFrame:
    """``lookup`` in a dictionary too large to broadcast, moving only words that may be in it.

    Words and lemmas are held against a Bloom filter of the terms. Rows that fail it have no entries and
    stay where they are; the rest is joined by shuffle. ``words`` is read once for either kind of
    row, so it should be a stored table or end in a shuffle, which both then read.
    """
    sieve = build_sieve(matches, "term")
    own = sift(words, sieve, F.col("word"), "_maybe")
    if "lemma" in words.columns:
        own = sift(own, sieve, F.col("lemma"), "_maybe_lemma")
        own = own.withColumn("_maybe", F.col("_maybe") | F.col("_maybe_lemma")).drop("_maybe_lemma")
    found = lookup(own.where("_maybe").drop("_maybe"), matches, match_reading, small=False)
    none = own.where("not _maybe").drop("_maybe")
    return found.unionByName(none.withColumn("matches", F.array().cast(found.schema["matches"].dataType)))


def lookup_rows(words: DataFrame, matches: DataFrame, match_reading: bool = False) -> DataFrame:
    """Lookups as rows: a row of ``words`` per entry found, with its ``match_no`` from 1."""
    found = lookup(words, matches, match_reading)
    return found.select(
        *words.columns, F.posexplode("matches").alias("_at", "_match")
    ).select(
        *words.columns,
        F.col("_match.entry_id").alias("entry_id"),
        (F.col("_at") + 1).cast("bigint").alias("match_no"),
    )


def with_definitions(
    words: DataFrame, matches: DataFrame, match_reading: bool = False
) -> DataFrame:
    """Add ``definitions`` (array, empty if nothing was found)."""
    found = lookup(words, matches, match_reading)
    return found.withColumn("definitions", D.definitions_of(F.col("matches"))).drop("matches")


def enrich_words(words: DataFrame, matches: DataFrame | None) -> DataFrame:
    """Definitions and primary reading of words that are about to be stored.

    ``words`` holds each word once, with its token ``reading``. The pronunciation is
    the reading of the first entry found, or the token reading if that entry has no
    kana or there is none. Readings do not narrow the lookup here.
    """
    if matches is None:
        return words.select(
            *[c for c in words.columns if c != "reading"],
            F.col("reading").alias("pronunciation"),
            F.array().cast("array<struct<senses:array<string>,pos:array<string>>>").alias(
                "definitions"
            ),
        )
    small = is_small(matches)
    found = lookup(words, matches, small=True) if small else sifted_lookup(words, matches)
    first = F.get(F.col("matches"), F.lit(0))
    return found.select(
        *[c for c in words.columns if c != "reading"],
        F.coalesce(first["primary_reading"], F.col("reading")).alias("pronunciation"),
        D.definitions_of(F.col("matches")).alias("definitions"),
    )


def backfill_definitions(words: DataFrame, matches: DataFrame) -> DataFrame:
    """Fill ``definitions`` (JSON text, or an array as the store has it) where absent; add ``updated``.

    The lookup goes by word or lemma and demands the reading. Words that have definitions
    take no part in the join: with a broadcast dictionary they pass it by in the same
    scan, else they are kept out of its shuffle.
    """
    if isinstance(words.schema["definitions"].dataType, T.ArrayType):
        missing = F.coalesce(F.size("definitions"), F.lit(0)) <= 0
    else:
        missing = F.coalesce(F.col("definitions"), F.lit("")) == ""
    if is_small(matches):
        return _filled(lookup(words, matches, True, where=missing, small=True), missing)
    filled = _filled(sifted_lookup(words.where(missing), matches, True), F.lit(True))
    return words.where(~missing).withColumn("updated", F.lit(False)).unionByName(filled)


def _filled(found: DataFrame, missing: Column) -> DataFrame:
    text = D.definitions_of(F.col("matches"))
    if not isinstance(found.schema["definitions"].dataType, T.ArrayType):
        text = D.definitions_json(text)
    return (
        found.withColumn("updated", missing & (F.size("matches") > 0))
        .withColumn("definitions", F.when(missing, text).otherwise(F.col("definitions")))
        .drop("matches")
    )
