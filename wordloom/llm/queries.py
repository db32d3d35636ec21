"""Each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import (
    centroids,
    chat_format,
    decontamination,
    language_id,
    line_dedup,
    mixing,
    quality_classifier,
    quality_rules,
    simhash,
    suffix_dedup,
    token_alignment,
    topk_search,
    url_filters,
)
from wordloom.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Shares of all tokens that each language's documents are to have.
MIX_TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def _query(run: Query) -> Query:
    _QUERIES[run.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@_query
def op1_line_dedup(spark, folder):
    """Every row is a page, as in the SQL it is checked against; the pipeline counts copies once."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, each_row=True).select("doc_id", "text", "n_lines", "n_dropped")


@_query
def op2_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = decontamination.mark_contaminated(docs, table(spark, folder, "benchmark"))
    return decontamination.summary(marked, "doc_id")


@_query
def op3_quality_rules(spark, folder):
    judged = quality_rules.apply_rules(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", F.array_join("reasons", ",").alias("reasons"),
    )


@_query
def op6_chat_formatting(spark, folder):
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(spark, folder, "conversations").select(*more.columns).unionAll(more)
    parts = rows.withColumn("parts", chat_format.text_parts(F.col("text")))
    return chat_format.digests(chat_format.format_chats(parts))


@_query
def op9_url_filters(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, folder, "pages"), rules)


@_query
def op4_suffix_array_dedup(spark, folder):
    return suffix_dedup.dedup_strings(table(spark, folder, "documents").select("doc_id", "text"))


@_query
def op5_source_mixing(spark, folder):
    """The domain of a document is its language, learned from the rows that name one."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    mixed = mixing.mix_documents(docs, docs, MIX_TARGETS, domain="lang")
    return mixed.select("doc_id", "n_tokens", "posterior", "rate", "copies", "residual")


@_query
def op7_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.learn(docs.where(~held_out & F.col("doc_id").isNotNull()))
    own = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language_id.predict(own, model).select("doc_id", "held_out", "lang_pred", "score")


@_query
def op8_quality_classifier(spark, folder):
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality_classifier.learn(docs, labels.where(~held_out))
    own = docs.select("doc_id", held_out.alias("held_out"), "text")
    scored = quality_classifier.score(own, model).select("doc_id", "held_out", "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@_query
def op10_simhash_near_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@_query
def op11_centroid_clustering(spark, folder):
    found = centroids.cluster(table(spark, folder, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@_query
def op12_exact_top_k(spark, folder):
    return topk_search.top_k(table(spark, folder, "embeddings"))


@_query
def op13_cross_tokenizer_alignment(spark, folder):
    return token_alignment.summary(table(spark, folder, "documents"))
