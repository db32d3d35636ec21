"""The given tables as inputs of the operators.

The corpus is written in Latin script, without ruby, kana or a dictionary. What the
operators for Japanese text need is derived from it by Spark, row by row: letters are
written as katakana, long words get ruby, words get parts of speech by their length,
and every item of ``benchmark`` becomes a dictionary entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.facts import vocabulary_tokens
from wordloom.operators.layout import spread
from wordloom.operators.sentences import split_sentences, with_sentence_id
from wordloom.operators.tokens import tokenize_spaced

LETTERS = "abcdefghijklmnopqrstuvwxyz"
KANA_OF_LETTERS = "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"
#: Two words with punctuation between them.
WORD_PAIR = r"\p{L}+[.,;:] \p{L}+"
RUBY_WORD = r"(\p{L}{5,})"
WITH_RUBY = '<ruby>{0}<rp>(</rp><rt class="r">{0}</rt><rp>)</rp></ruby>'


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return spread(docs, "source_id")


def document_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return with_sentence_id(split_sentences(documents(spark, folder)))


def document_words(spark: SparkSession, folder: str, drop_ascii: bool = True) -> DataFrame:
    tokens = tokenize_spaced(document_sentences(spark, folder))
    return vocabulary_tokens(tokens, drop_ascii)


def turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return spread(rows.withColumnRenamed("conv_id", "source_id"), "source_id", "turn")


def turn_sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = turns(spark, folder).select("source_id", "turn", "text")
    return with_sentence_id(split_sentences(rows, part="turn"))


def kana(text: Column) -> Column:
    return F.translate(F.lower(text), LETTERS, KANA_OF_LETTERS)


def ruby_html(text: Column) -> Column:
    return F.regexp_replace(text, RUBY_WORD, WITH_RUBY.format("$1"))


def morphemes(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the conversations with analyser features made up from their length."""
    tokens = tokenize_spaced(turn_sentences(spark, folder)).drop("base_form", "reading", "pos")
    surface = F.col("surface")
    size = F.length(surface)
    is_word = surface.rlike(r"\A[\p{L}\p{M}]")
    first = (
        F.when(surface.rlike(r"\A\p{N}"), "名詞")
        .when(surface == ".", "記号")
        .when(~is_word, "補助記号")
        .when(size <= 2, "助詞")
        .when(size == 3, "助動詞")
        .when(size == 5, "動詞")
        .otherwise("名詞")
    )
    second = (
        F.when(surface.rlike(r"\A\p{N}") | (is_word & (size == 4)), "数")
        .when(is_word & (size == 5), "自立")
        .otherwise("一般")
    )
    base = F.when(size >= 10, "*").when(size == 9, "").otherwise(F.lower(surface))
    spoken = F.when(surface != F.lower(surface), "*").otherwise(kana(surface))
    none = F.lit("*")
    features = F.when(
        is_word, F.array(first, second, none, none, none, none, base, spoken)
    ).otherwise(F.array(first, second))
    return tokens.select(
        "source_id", "sentence_idx", "sentence_id", "token_idx", "surface",
        features.alias("features"),
    )


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """``benchmark`` as a dictionary.

    An item is found under its words, if it is long, and under their kana; a kana of even
    length is common. Each line is a sense, each stretch up to a full stop a gloss.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    no_tags = F.array().cast("array<string>").alias("tags")
    kanji = F.transform(
        words, lambda w: F.struct(w.alias("text"), F.lit(True).alias("common"), no_tags)
    )
    spellings = F.transform(
        words,
        lambda w: F.struct(
            kana(w).alias("text"), (F.length(w) % 2 == 0).alias("common"), no_tags
        ),
    )
    long_line = F.array(F.lit("n"), F.lit("vs"))
    sense = F.transform(
        F.split("text", "\n"),
        lambda line: F.struct(
            F.when(F.length(line) > 100, long_line)
            .otherwise(F.array(F.lit("n")))
            .alias("partOfSpeech"),
            F.transform(
                F.split(line, "[.] *"),
                lambda g: F.struct(g.alias("text"), F.lit("eng").alias("lang")),
            ).alias("gloss"),
        ),
    )
    return table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("id"),
        F.when(F.length("text") >= 150, kanji).alias("kanji"),
        spellings.alias("kana"),
        sense.alias("sense"),
    )


def word_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``term``: neighbours in ``benchmark`` with the punctuation between them, without space."""
    pairs = F.regexp_extract_all(F.lower("text"), F.lit(WORD_PAIR), F.lit(0))
    found = table(spark, folder, "benchmark").select(F.explode(pairs).alias("pair"))
    return found.select(F.regexp_replace("pair", r"\s+", "").alias("term"))


def corpus_words(spark: SparkSession, folder: str) -> DataFrame:
    """Each word of the documents once, some in kana, with lemma, pronunciation and reading."""
    plain = document_words(spark, folder, drop_ascii=False).select("word").distinct()
    word = F.col("plain")
    size = F.length(word)
    return plain.withColumnRenamed("word", "plain").select(
        F.when(size % 5 == 0, kana(word)).otherwise(word).alias("word"),
        F.regexp_replace(word, "(s|ed|ing)$", "").alias("lemma"),
        F.when(size % 3 == 0, "")
        .when(size % 3 == 1, kana(word))
        .otherwise(kana(F.reverse(word)))
        .alias("pronunciation"),
        F.when(size % 2 == 0, kana(word)).otherwise("").alias("reading"),
    )
