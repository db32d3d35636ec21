"""Row shapes of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

ELEMENT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("common", T.BooleanType()),
        T.StructField("tags", STRINGS),
    ]
)
GLOSS = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
SENSE = T.StructType(
    [T.StructField("partOfSpeech", STRINGS), T.StructField("gloss", T.ArrayType(GLOSS))]
)
#: One dictionary entry as published in the JSON dictionary files.
ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kanji", T.ArrayType(ELEMENT)),
        T.StructField("kana", T.ArrayType(ELEMENT)),
        T.StructField("sense", T.ArrayType(SENSE)),
    ]
)
#: A file may also wrap its entries as ``{"words": [...]}``.
ENTRY_OR_WRAPPER = T.StructType([T.StructField("words", T.ArrayType(ENTRY)), *ENTRY.fields])

DEFINITION = T.StructType([T.StructField("senses", STRINGS), T.StructField("pos", STRINGS)])
DEFINITIONS = T.ArrayType(DEFINITION)

#: What an analyser returns for one sentence.
MORPHEME = T.StructType(
    [T.StructField("surface", T.StringType()), T.StructField("features", STRINGS)]
)

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

#: A source's id is the hash of its url, title and author, or the name its text came under.
SOURCES = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("website", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("meta", T.StringType()),
    ]
)
#: Every non-blank sentence of a source, with the size and the hash of the text it came in.
SENTENCES = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("sentence_idx", T.LongType()),
        T.StructField("sentence", T.StringType()),
        T.StructField("sentence_id", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("text_sentences", T.LongType()),
        T.StructField("content_id", T.StringType()),
    ]
)
#: One row per sentence and word.
FACTS = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("sentence_idx", T.LongType()),
        T.StructField("sentence_id", T.StringType()),
        T.StructField("word", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("first_token_idx", T.LongType()),
        T.StructField("reading", T.StringType()),
    ]
)
