"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import definitions as D
from wordloom.functions import morph
from wordloom.functions.text import (
    empty_if_null,
    is_ascii,
    sentence_pieces,
    strip_ruby,
    text_id,
    to_hiragana,
    unicode_trim,
)
from wordloom.operators import articles, dictionary, integrity, views
from wordloom.operators.facts import (
    analysed_facts,
    sentence_words,
    validate,
    vocabulary_tokens,
)
from wordloom.operators.layout import broadcast_if_small, spread
from wordloom.operators.sentences import after_progress, distinct_sentences, split_sentences
from wordloom.operators.tokens import (
    project_features,
    tokenize_lexicon,
    tokenize_spaced,
    tokenize_with,
)
from wordloom.plans import corpus
from wordloom.plans.ingest import fact_rows, ingest_batch, ingest_pages, page_texts, sentence_rows
from wordloom.plans.store import VocabularyStore
from wordloom.session import work_folder
from wordloom.sources.entry_list import read_entry_list
from wordloom.sources.raw_pages import decoded_pages
from wordloom.sources.readers import (
    accepted_pages,
    page_bytes,
    read_dictionary,
    read_documents,
    rejected_pages,
)
from wordloom.streaming.ingest import start_ingest, stream_documents, stream_name
from wordloom.streaming.running import latest_counts, running_counts, start_running_counts
from wordloom.streaming.vocabulary import (
    first_contexts,
    latest_vocabulary,
    running_vocabulary,
    start_running_vocabulary,
)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(run: Query) -> Query:
    """Register a query under its name; a trailing underscore keeps it apart from its operator."""
    _QUERIES[run.__name__.rstrip("_")] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _facts(spark, folder, drop_ascii=True):
    return fact_rows(corpus.document_sentences(spark, folder), drop_ascii=drop_ascii)


def _tagged(spark, folder):
    return project_features(corpus.morphemes(spark, folder))


def _tagged_facts(spark, folder):
    return sentence_words(vocabulary_tokens(_tagged(spark, folder), drop_ascii=False))


def _matches(spark, folder):
    return dictionary.term_matches(corpus.entries(spark, folder))


# -- sources and sinks -----------------------------------------------------------


@_query
def src_pages_gate(spark, folder):
    pages = corpus.table(spark, folder, "pages")
    good = accepted_pages(pages).withColumn("status", F.lit("accepted"))
    bad = rejected_pages(pages).withColumn("status", F.lit("rejected"))
    return good.unionByName(bad).select(
        "page_id", page_bytes().cast("bigint").alias("html_bytes"), "status"
    )


@_query
def src_raw_pages(spark, folder):
    """Pages as bytes in several charsets, some of them refused or broken, and what decoding makes of them."""
    html, kind = F.coalesce("html", F.lit("")), F.col("page_id") % 6
    narrow = ~html.rlike("[^\\x00-\\xFF]")
    tagged = F.concat(F.lit('<meta charset="iso-8859-1">'), html)
    raw = corpus.table(spark, folder, "pages").select(
        "page_id", "url",
        F.when(F.col("page_id") % 7 == 3, 404).otherwise(200).alias("status"),
        F.when(kind == 0, "text/html; charset=UTF-8")
        .when(kind == 3, "text/html; charset=x-unheard-of")
        .when(kind == 4, "text/html;charset=utf-16be")
        .alias("content_type"),
        F.when((kind == 1) & narrow, F.encode(tagged, "ISO-8859-1"))
        .when(kind == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(html, "UTF-16LE")))
        .when(kind == 4, F.concat(F.encode(html, "UTF-16BE"), F.unhex(F.lit("41"))))
        .when(kind == 5, F.concat(F.encode(html, "UTF-8"), F.unhex(F.lit("FF"))))
        .otherwise(F.encode(html, "UTF-8"))
        .alias("body"),
    )
    return decoded_pages(raw).select(
        "page_id", "charset", F.coalesce("reason", F.lit("accepted")).alias("status"), F.md5("html").alias("html_id"))


@_query
def src_documents(spark, folder):
    docs = read_documents(spark, f"{folder}/documents.parquet")
    return docs.select(
        "source_id",
        F.length("text").cast("bigint").alias("n_chars"),
        text_id(F.col("text")).alias("content_id"),
    )


@_query
def dict_load(spark, folder):
    """Entries written as JSON, in chunks of either form, and read back."""
    path = work_folder(spark, "dictionary")
    entries = corpus.entries(spark, folder)
    chunks = entries.groupBy(F.expr("cast(id as bigint) div 16").alias("chunk")).agg(
        F.collect_list(F.struct(*entries.columns)).alias("words")
    )
    bare = F.to_json("words")
    wrapped = F.concat(F.lit('{"words":'), bare, F.lit("}"))
    chunks.select(F.when(F.col("chunk") % 2 == 0, wrapped).otherwise(bare)).write.text(path)
    return _loaded(read_dictionary(spark, path, multi_line=False))


@_query
def dict_load_split(spark, folder):
    """Entries written as one JSON document, and read back by byte ranges."""
    path = work_folder(spark, "dictionary")
    entries = corpus.entries(spark, folder)
    line = F.to_json(F.struct(*entries.columns))
    own = entries.select(F.lit(1).alias("at"), F.col("id"), F.concat(line, F.lit(",")).alias("value"))
    # The last entry has no comma behind it; it has no id and is left out again.
    ends = spark.createDataFrame([(0, "", '{"words":['), (2, "", '{"id":""}]}')], own.schema)
    own.unionByName(ends).repartition(1).sortWithinPartitions("at", "id").select("value").write.text(path)
    return _loaded(read_entry_list(spark, path).where("id <> ''"))


def _loaded(entries):
    return entries.select(
        F.col("id").alias("entry_id"),
        F.coalesce(F.size("kanji"), F.lit(0)).cast("bigint").alias("n_kanji"),
        F.array_join("kana.text", " ").alias("kana"),
        F.size(F.filter("kana", lambda k: k["common"])).cast("bigint").alias("n_common"),
        F.array_join(D.entry_senses(F.col("sense")), "|").alias("senses"),
        F.array_join(D.entry_pos(F.col("sense")), "|").alias("pos"),
    )


def _texts(spark, folder):
    return corpus.table(spark, folder, "documents").select(
        F.col("doc_id").alias("source_id"), "text", F.col("lang").alias("language")
    )


def _document_stream(spark, folder):
    """The table as a stream, be it one file or a folder of them; a stream takes a file only by a pattern."""
    return stream_documents(spark, f"{folder}/[d]ocuments.parquet")


def _two_batches(spark, folder):
    """A store that took the documents in two batches, with all words."""
    store = VocabularyStore(spark, work_folder(spark, "store"))
    for part in (0, 1):
        ingest_batch(store, _texts(spark, folder).where(F.col("source_id") % 2 == part), drop_ascii=False)
    return store


def _by_document(rows):
    return rows.withColumn("source_id", F.col("source_id").cast("bigint"))


@_query
def sink_roundtrip(spark, folder):
    store = VocabularyStore(spark, work_folder(spark, "store"))
    ingest_batch(store, _texts(spark, folder), drop_ascii=False)
    links = store.write_view("word_sources", store.view("word_sources"), ["source_id", "word"])
    return _by_document(links).select(
        "word_id", "source_id", "word", "occurrence_count",
        "context_sentence_id", "example_sentence_id",
    )


@_query
def view_words(spark, folder):
    store = _two_batches(spark, folder)
    return store.write_view("words", store.view("words"), ["word"]).select(
        "word_id", "word", "lemma", "language", "pronunciation"
    )


@_query
def view_contexts(spark, folder):
    store = _two_batches(spark, folder)
    return _by_document(store.write_view("word_contexts", store.view("word_contexts")))


@_query
def view_sentences(spark, folder):
    store = _two_batches(spark, folder)
    return store.write_view("sentences", store.view("sentences"))


@_query
def view_sources(spark, folder):
    store = VocabularyStore(spark, work_folder(spark, "store"))
    ingest_pages(store, corpus.table(spark, folder, "pages"), drop_ascii=False)
    return store.write_view("sources", store.view("sources")).drop("last_processed_sentence")


@_query
def pages_ingest(spark, folder):
    """Words of pages in a store that also holds documents, and saw all page ids twice."""
    store = VocabularyStore(spark, work_folder(spark, "store"))
    pages = corpus.table(spark, folder, "pages")
    ingest_batch(store, _texts(spark, folder))
    ingest_pages(store, pages, drop_ascii=False)
    moved = pages.withColumn("url", F.concat("url", F.lit("#again")))
    ingest_pages(store, moved, drop_ascii=False)
    sources = store.known_sources().select("source_id")
    words = store.facts().join(sources, "source_id", "left_semi")
    return words.groupBy("word").agg(
        F.sum("n").alias("occurrences"), F.count_distinct("source_id").alias("sources")
    )


def _refreshed(spark, folder, view):
    """A view kept up through three commits, each of which adds a third of the lines of every document."""
    store = VocabularyStore(spark, work_folder(spark, "store"))
    lines = F.split("text", "\n")
    for part in (1, 2, 3):
        some = F.slice(lines, 1, F.ceil(F.size(lines) * part / 3).cast("int"))
        ingest_batch(store, _texts(spark, folder).withColumn("text", F.array_join(some, "\n")), drop_ascii=False)
        rows = store.refresh_view(view)
    return rows


@_query
def view_refreshed_links(spark, folder):
    return _by_document(_refreshed(spark, folder, "word_sources")).select(
        "word_id", "source_id", "word", "occurrence_count",
        "context_sentence_id", "example_sentence_id",
    )


@_query
def view_refreshed_contexts(spark, folder):
    return _by_document(_refreshed(spark, folder, "word_contexts"))


@_query
def view_refreshed_words(spark, folder):
    return _refreshed(spark, folder, "words").select("word_id", "word", "lemma", "language", "pronunciation")


@_query
def view_refreshed_sentences(spark, folder):
    return _refreshed(spark, folder, "sentences")


@_query
def stream_replay(spark, folder):
    """Counts after a committed batch came again, by its key, by a new stream and by a batch job."""
    store = VocabularyStore(spark, work_folder(spark, "store"))
    first, second = (work_folder(spark, "checkpoint") for _ in range(2))
    for checkpoint in (first, second):
        texts = _document_stream(spark, folder)
        start_ingest(store, texts, checkpoint, drop_ascii=False).awaitTermination()
    ingest_batch(store, _texts(spark, folder), 0, stream_name(spark, first), drop_ascii=False)
    ingest_batch(store, _texts(spark, folder), drop_ascii=False)
    return _by_document(views.occurrence_counts(store.facts()))


@_query
def resume_edited(spark, folder):
    """French texts grew by a sentence, German ones got a new beginning: those are taken in whole."""
    store = VocabularyStore(spark, work_folder(spark, "store"))
    texts = _texts(spark, folder)
    ingest_batch(store, texts, drop_ascii=False)
    text = F.when(F.col("language") == "fr", F.concat("text", F.lit("\nétrange ajout")))
    text = text.when(F.col("language") == "de", F.concat(F.lit("Ünd.\n"), "text")).otherwise(F.col("text"))
    ingest_batch(store, texts.withColumn("text", text), drop_ascii=False)
    return _by_document(views.occurrence_counts(store.facts()))


@_query
def retract_store(spark, folder):
    """Rows of all five views after toxic documents were taken back, and some of them taken in again."""
    store = _two_batches(spark, folder)
    toxic = corpus.table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias("source_id"))
    store.retract(toxic)
    again = toxic.where("source_id % 2 = 0").select("source_id")
    ingest_batch(store, _texts(spark, folder).join(again, "source_id", "left_semi"), drop_ascii=False)
    store.write_views()

    def size(name, *columns):
        rows = store.read_view(name)
        total = F.sum("occurrence_count") if name == "word_sources" else F.count(F.lit(1))
        return rows.agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("n"), total.alias("total"))

    out = size("words")
    for name in ("word_sources", "word_contexts", "sentences", "sources"):
        out = out.unionAll(size(name))
    return out


@_query
def store_backfill(spark, folder):
    """Definitions found for stored words; they outlive the next writing of the views."""
    store = _two_batches(spark, folder)
    store.backfill(_matches(spark, folder))
    for _ in range(2):
        words = store.write_view("words", store.view("words"), ["word"])
    return words.where("definitions IS NOT NULL").select(
        "word_id", "word", D.definitions_json(F.col("definitions")).alias("definitions")
    )


# -- text ------------------------------------------------------------------------


@_query
def strip_ruby_(spark, folder):
    docs = corpus.documents(spark, folder)
    return docs.select("source_id", strip_ruby(corpus.ruby_html(F.col("text"))).alias("html"))


@_query
def main_text_blocks(spark, folder):
    pages = spread(accepted_pages(corpus.table(spark, folder, "pages")), "page_id")
    path = work_folder(spark, "blocks")
    articles.page_blocks(pages).write.parquet(path)
    return articles.main_text(spark.read.parquet(path))


@_query
def page_metadata(spark, folder):
    return articles.page_metadata(spread(corpus.table(spark, folder, "pages"), "page_id"))


@_query
def split_sentences_raw(spark, folder):
    """Sentences as cut, with the white space around them."""
    return split_sentences(corpus.documents(spark, folder), trimmed=False)


@_query
def split_sentences_(spark, folder):
    return split_sentences(corpus.documents(spark, folder))


@_query
def to_hiragana_(spark, folder):
    docs = corpus.documents(spark, folder)
    return docs.select("source_id", to_hiragana(corpus.kana(F.col("text"))).alias("text"))


@_query
def unicode_trim_(spark, folder):
    """Pieces of text wrapped in white space of several kinds, trimmed again."""
    pieces = corpus.documents(spark, folder).select(
        "source_id", F.posexplode(sentence_pieces(F.col("text"))).alias("piece_no", "piece")
    )
    padded = F.concat(F.lit("　\t "), F.col("piece"), F.lit(" \r\n\u0085"))
    return pieces.where("piece <> ''").select(
        "source_id",
        F.col("piece_no").cast("bigint").alias("piece_no"),
        unicode_trim(padded).alias("text"),
        F.length(padded).cast("bigint").alias("padded_chars"),
    )


# -- tokens ----------------------------------------------------------------------


@_query
def tokenize_spaced_(spark, folder):
    return tokenize_spaced(split_sentences(corpus.documents(spark, folder))).select(
        "source_id", "sentence_idx", "token_idx", "surface", "base_form", "primary_pos"
    )


@_query
def tokenize_lexicon_(spark, folder):
    """Conversations without spaces, cut by the dictionary's words and pairs with punctuation."""
    words = dictionary.dictionary_terms(corpus.entries(spark, folder)).select("term")
    lexicon = words.unionAll(corpus.word_pairs(spark, folder)).select(
        "term",
        F.array(*[F.lit("名詞")] + [F.lit("*")] * 5, F.col("term"), corpus.kana(F.col("term")))
        .alias("features"),
    )
    sentences = corpus.turn_sentences(spark, folder).drop("sentence_id")
    unspaced = sentences.withColumn(
        "sentence", F.regexp_replace(F.lower("sentence"), r"\s+", "")
    )
    return tokenize_lexicon(unspaced, lexicon).select(
        "source_id", "sentence_idx", "token_idx", "surface", "in_lexicon", "reading"
    )


def _white_space_analyser() -> Callable[[pd.Series], pd.Series]:
    """An analyser made here travels to the workers by value; they need not import this package."""

    def analyse(sentences: pd.Series) -> pd.Series:
        return sentences.map(
            lambda text: [
                {"surface": t, "features": ["名詞", "一般", "*", "*", "*", "*", t.lower()]}
                for t in text.split()
            ]
        )

    return analyse


@_query
def tokenize_plugged(spark, folder):
    sentences = split_sentences(corpus.turns(spark, folder), part="turn")
    tokens = tokenize_with(sentences, _white_space_analyser())
    return views.occurrence_counts(vocabulary_tokens(tokens, drop_ascii=False))


@_query
def token_features(spark, folder):
    return _tagged(spark, folder).select(
        "source_id", "sentence_idx", "token_idx", "surface", "base_form", "reading",
        "primary_pos", F.size("pos").cast("bigint").alias("n_features"),
    )


@_query
def canonical_word(spark, folder):
    word = morph.canonical_word(F.col("surface"), F.col("base_form"))
    return _tagged(spark, folder).select(
        "source_id", "sentence_idx", "token_idx", word.alias("word")
    )


@_query
def pos_filter(spark, folder):
    keep = morph.has_vocabulary_pos(F.col("primary_pos")) & ~morph.is_numeral(F.col("pos"))
    return _tagged(spark, folder).where(keep).select(
        "source_id", "sentence_idx", "token_idx", "surface"
    )


@_query
def ascii_filter(spark, folder):
    tokens = tokenize_spaced(split_sentences(corpus.documents(spark, folder)))
    return tokens.where(~is_ascii(F.col("surface"))).select(
        "source_id", "sentence_idx", "token_idx", "surface"
    )


# -- facts -----------------------------------------------------------------------


@_query
def sentence_word_counts(spark, folder):
    """Token rows, grouped."""
    words = corpus.document_words(spark, folder)
    return sentence_words(words, readings=False).select(
        "source_id", "sentence_idx", "word", "n", "first_token_idx"
    )


@_query
def sentence_word_counts_all(spark, folder):
    """Words in ASCII too, counted inside the row."""
    return _facts(spark, folder, drop_ascii=False).select(
        "source_id", "sentence_idx", "word", "n", "first_token_idx"
    )


@_query
def analysed_word_counts(spark, folder):
    """An analyser's tokens, counted inside the row."""
    facts = analysed_facts(
        corpus.turn_sentences(spark, folder), _white_space_analyser(), drop_ascii=False
    )
    return facts.select("source_id", "sentence_idx", "word", "n", "first_token_idx", "reading")


@_query
def first_reading(spark, folder):
    return _tagged_facts(spark, folder).select(
        "source_id", "sentence_idx", "word", "n", "first_token_idx", "reading"
    )


@_query
def resume_filter(spark, folder):
    """Sentences still to do where each source is half done, not started, or unreadable."""
    langs = corpus.table(spark, folder, "documents").select(
        F.col("doc_id").alias("source_id"), "lang"
    )
    sentences = split_sentences(corpus.documents(spark, folder))
    half = (
        views.source_progress(sentences)
        .join(langs, "source_id")
        .where("lang <> 'de'")
        .select(
            "source_id",
            F.when(F.col("lang") != "fr", F.expr("last_processed div 2")).alias(
                "last_processed"
            ),
        )
    )
    return after_progress(sentences, half).select("source_id", "sentence_idx")


@_query
def validate_facts(spark, folder):
    rows = corpus.turns(spark, folder).select(
        "source_id",
        F.col("turn").alias("n"),
        F.when(F.col("role") == "system", " 　").otherwise(F.col("role")).alias("source_type"),
        F.explode(F.split("text", r"[^\p{L}]")).alias("word"),
    )
    return validate(rows).groupBy(
        "source_id", "n", "word", empty_if_null(F.col("reason")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("times"))


# -- views -----------------------------------------------------------------------


@_query
def occurrence_counts(spark, folder):
    return views.occurrence_counts(corpus.document_words(spark, folder))


@_query
def occurrence_counts_all(spark, folder):
    return views.occurrence_counts(corpus.document_words(spark, folder, drop_ascii=False))


@_query
def total_links(spark, folder):
    return views.total_links(_facts(spark, folder))


@_query
def total_links_all(spark, folder):
    return views.total_links(_facts(spark, folder, drop_ascii=False))


@_query
def source_progress(spark, folder):
    docs = views.source_progress(split_sentences(corpus.documents(spark, folder)))
    talks = views.source_progress(split_sentences(corpus.turns(spark, folder), part="turn"))
    return docs.withColumn("kind", F.lit("document")).unionByName(
        talks.withColumn("kind", F.lit("conversation"))
    )


@_query
def word_sources(spark, folder):
    return views.word_sources(_facts(spark, folder))


@_query
def word_sources_all(spark, folder):
    return views.word_sources(_facts(spark, folder, drop_ascii=False))


@_query
def latest_context(spark, folder):
    return views.latest_context(_facts(spark, folder))


@_query
def latest_context_all(spark, folder):
    return views.latest_context(_facts(spark, folder, drop_ascii=False))


@_query
def top_contexts(spark, folder):
    return views.top_contexts(_facts(spark, folder))


@_query
def top_contexts_all(spark, folder):
    return views.top_contexts(_facts(spark, folder, drop_ascii=False))


@_query
def top_contexts_turns(spark, folder):
    """Contexts in sources that span many rows, with all words."""
    return views.top_contexts(
        fact_rows(corpus.turn_sentences(spark, folder), drop_ascii=False)
    )


@_query
def words_in_order(spark, folder):
    return views.words_in_order(_facts(spark, folder))


@_query
def words_in_order_all(spark, folder):
    return views.words_in_order(_facts(spark, folder, drop_ascii=False))


@_query
def words_in_order_turns(spark, folder):
    return views.words_in_order(
        fact_rows(corpus.turn_sentences(spark, folder), drop_ascii=False)
    )


def _upserts(spark, folder):
    rows = _tagged_facts(spark, folder).select(
        "word",
        F.col("word").alias("lemma"),
        F.lit("ja").alias("language"),
        F.col("reading").alias("pronunciation"),
        F.when(F.length("reading") > 6, F.concat(F.lit("["), "reading", F.lit("]")))
        .otherwise("")
        .alias("definitions"),
        "source_id", "sentence_idx", "first_token_idx",
    )
    return views.upsert_words(rows, ["source_id", "sentence_idx", "first_token_idx"])


@_query
def words_upsert(spark, folder):
    return _upserts(spark, folder)


@_query
def words_by_source(spark, folder):
    words = _upserts(spark, folder).withColumn("image_url", F.lit(None).cast("string"))
    word_id = text_id(F.col("word"), F.col("word"), F.lit("ja"))
    links = views.occurrence_counts(_tagged_facts(spark, folder)).withColumn("word_id", word_id)
    return views.words_by_source(words, links)


@_query
def sources_dedup(spark, folder):
    rows = corpus.table(spark, folder, "documents").select(
        "doc_id",
        F.when(F.col("n_chars") <= 1000, "").alias("url"),
        F.col("source").alias("title"),
        F.col("lang").alias("author"),
        F.when(F.col("lang") == "es", "　").otherwise(" document ").alias("source_type"),
        F.concat(F.lit("https://"), "source").alias("website"),
        F.col("n_chars").cast("string").alias("meta"),
    )
    return views.dedup_sources(rows, ["doc_id"])


@_query
def page_sources(spark, folder):
    rows = articles.page_metadata(spread(corpus.table(spark, folder, "pages"), "page_id"))
    return views.dedup_sources(rows, ["source_id"])


@_query
def sentences_distinct(spark, folder):
    docs = split_sentences(corpus.documents(spark, folder)).select("sentence")
    talks = split_sentences(corpus.turns(spark, folder), part="turn").select("sentence")
    return distinct_sentences(docs.unionByName(talks))


@_query
def insert_ignore(spark, folder):
    """Words of the conversations put into those of the documents; the first mention counts."""
    known = (
        corpus.document_words(spark, folder, drop_ascii=False)
        .groupBy("word")
        .agg(F.min("source_id").alias("first_source"))
        .withColumn("origin", F.lit("document"))
    )
    tokens = tokenize_spaced(corpus.turn_sentences(spark, folder))
    new = vocabulary_tokens(tokens, drop_ascii=False).select(
        "word",
        F.col("source_id").alias("first_source"),
        F.lit("conversation").alias("origin"),
        "sentence_idx",
        "token_idx",
    )
    return integrity.insert_ignore(
        known, new, ["word"], ["first_source", "sentence_idx", "token_idx"]
    )


@_query
def orphan_check(spark, folder):
    """Links to documents that have no label."""
    links = views.occurrence_counts(corpus.document_words(spark, folder))
    labelled = corpus.table(spark, folder, "labels").select(F.col("doc_id").alias("source_id"))
    return integrity.orphans(links, broadcast_if_small(labelled), ["source_id"])


@_query
def retract_source(spark, folder):
    """Counts per word after the documents labelled toxic are taken back."""
    toxic = corpus.table(spark, folder, "labels").where("toxic = 1").select(
        F.col("doc_id").alias("source_id")
    )
    left = integrity.retract(_facts(spark, folder), broadcast_if_small(toxic))
    return left.groupBy("word").agg(
        F.sum("n").alias("occurrences"), F.count_distinct("source_id").alias("sources")
    )


# -- dictionary ------------------------------------------------------------------


@_query
def dict_index(spark, folder):
    return dictionary.dictionary_terms(corpus.entries(spark, folder))


@_query
def format_definitions(spark, folder):
    one = F.array(
        F.struct(
            D.entry_senses(F.col("sense")).alias("senses"), D.entry_pos(F.col("sense")).alias("pos")
        )
    )
    return corpus.entries(spark, folder).select(
        F.col("id").alias("entry_id"), D.definitions_json(one).alias("definitions")
    )


@_query
def primary_reading(spark, folder):
    return corpus.entries(spark, folder).select(
        F.col("id").alias("entry_id"), D.primary_kana(F.col("kana")).alias("reading")
    )


@_query
def dict_lookup(spark, folder):
    words = corpus.corpus_words(spark, folder).select("word", "lemma")
    return dictionary.lookup_rows(words, _matches(spark, folder))


@_query
def dict_lookup_reading(spark, folder):
    words = corpus.corpus_words(spark, folder).select("word", "lemma", "pronunciation")
    return dictionary.lookup_rows(words, _matches(spark, folder), match_reading=True)


@_query
def definitions_json(spark, folder):
    words = corpus.corpus_words(spark, folder).select("word", "lemma", "pronunciation")
    found = dictionary.with_definitions(words, _matches(spark, folder), match_reading=True)
    return found.withColumn("definitions", D.definitions_json(F.col("definitions")))


@_query
def enrich_words(spark, folder):
    words = corpus.corpus_words(spark, folder).select("word", "reading")
    return dictionary.enrich_words(words, _matches(spark, folder)).withColumn(
        "definitions", D.definitions_json(F.col("definitions"))
    )


def _to_backfill(spark, folder):
    size = F.length("word")
    return corpus.corpus_words(spark, folder).select(
        "word",
        "lemma",
        "pronunciation",
        F.when(size % 4 == 0, '[{"senses":["kept"],"pos":null}]')
        .when(size % 4 == 1, F.lit(None))
        .otherwise("")
        .alias("definitions"),
    )


@_query
def enrich_words_sifted(spark, folder):
    """As ``enrich_words``, with the dictionary taken as too large to broadcast."""
    words = corpus.corpus_words(spark, folder).select("word", "reading")
    found = dictionary.sifted_lookup(words, _matches(spark, folder))
    first = F.get(F.col("matches"), F.lit(0))
    return found.select(
        "word",
        F.coalesce(first["primary_reading"], F.col("reading")).alias("pronunciation"),
        D.definitions_json(D.definitions_of(F.col("matches"))).alias("definitions"),
    )


@_query
def backfill_definitions(spark, folder):
    return dictionary.backfill_definitions(
        _to_backfill(spark, folder), _matches(spark, folder)
    ).withColumn("updated", F.col("updated").cast("bigint"))


@_query
def backfill_count(spark, folder):
    done = dictionary.backfill_definitions(
        _to_backfill(spark, folder), _matches(spark, folder)
    )
    return done.agg(F.count_if("updated").alias("updated"))


# -- whole jobs ------------------------------------------------------------------


@_query
def page_vocabulary(spark, folder):
    """Pages to article text, sentences, tokens and counts."""
    texts = page_texts(corpus.table(spark, folder, "pages"))
    return views.occurrence_counts(fact_rows(sentence_rows(texts), drop_ascii=False))


@_query
def stream_ingest(spark, folder):
    """Documents taken in as a stream; counts read from the committed log."""
    store = VocabularyStore(spark, work_folder(spark, "store"))
    texts = _document_stream(spark, folder)
    start_ingest(store, texts, work_folder(spark, "checkpoint")).awaitTermination()
    return _by_document(views.occurrence_counts(store.facts()))


@_query
def stream_running_counts(spark, folder):
    path = work_folder(spark, "counts")
    counts = running_counts(_document_stream(spark, folder))
    start_running_counts(counts, path, work_folder(spark, "checkpoint")).awaitTermination()
    return latest_counts(spark, path)


@_query
def stream_running_vocabulary(spark, folder):
    """Counts, latest and first contexts kept in state over the turns of the conversations.

    Even turns arrive first; the query then ends and starts again on its checkpoint, and odd turns arrive
    together with the even ones once more.
    """
    inbox, out, checkpoint = (work_folder(spark, name) for name in ("inbox", "vocabulary", "checkpoint"))
    turns = corpus.table(spark, folder, "conversations").select(F.col("conv_id").alias("source_id"), "turn", "text")
    for arriving in (turns.where("turn % 2 = 0"), turns):
        arriving.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 2).parquet(inbox)
        rows = running_vocabulary(stream, part="turn", drop_ascii=False)
        start_running_vocabulary(rows, out, checkpoint).awaitTermination()
    return first_contexts(latest_vocabulary(spark, out))
