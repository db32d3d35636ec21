"""Near copies in line dedup, aliases by any tag, kinds named like markers, rows of any type, whole bags."""

import numpy as np
from pyspark.sql import functions as F

from wordloom.llm import chat_format, graph, line_dedup, quality_classifier, simhash, url_filters


def test_near_copies_do_not_vote_a_text_away(spark):
    near = [(i, f"first line of the clean text\nsecond line of the clean text\ncopy number {i} of it\nMenu", "a") for i in range(13)]
    more = [(100 + i, f"a text of its own with number {i}\nMenu", "a") for i in range(27)]
    gone = [(200, "Menu\nMenu", "a"), (201, None, "a"), (202, "", "a")]
    docs = spark.createDataFrame(near + more + gone, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs, min_left=0.5).collect()}
    assert all(got[i]["text"] == t and got[i]["n_dropped"] == 0 for i, t, _ in near)
    assert all(got[i]["text"] == t.removesuffix("\nMenu") and got[i]["n_dropped"] == 1 for i, t, _ in more)
    assert (got[200]["text"], got[201]["text"], got[202]["text"]) == ("Menu\nMenu", None, "")
    plain = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(docs).collect()}
    assert plain[3] == "copy number 3 of it"


def test_the_pipeline_keeps_texts_that_near_copies_share(spark):
    import corpus_pipeline

    rows = [(i, f"first line of the clean text\nsecond line of the clean text\ncopy {i}", "en", "a", 9) for i in range(10)]
    rows += [(100 + i, f"a text of its own with number {i}", "en", "a", 9) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_boilerplate_lines(spark, docs, "")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {r[0]: r[1] for r in rows}


def test_all_canonical_tags_and_encoded_references(spark):
    tag = '<link rel="canonical" href="{}">'
    rows = [
        (0, "http://a.org/1", tag.format("http://a.org/x") + tag.format("http://b.net/y")),
        (1, "http://a.org/2", tag.format("/p?a=1&amp;b=2")),
        (2, "http://a.org/p?a=1&b=2", '<meta http-equiv=refresh content="0;url=http://c.net/?q=1&#38;r=2">'),
        (3, "http://a.org/x", None),
        (4, "http://a.org/free", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("own"))
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    got = url_filters.judge(pages, rules, keep=("page_id", "host"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "blocked_alias"]
    assert {r["page_id"]: (r["host"], r["verdict"]) for r in got.collect()} == {
        **{i: ("a.org", "block") for i in range(4)}, 4: ("a.org", "allow")}
    sent = pages.withColumn("to", F.when(F.col("page_id") == 4, "http://b.net/"))
    assert url_filters.judge(sent, rules, redirect="to").where("verdict = 'block'").count() == 5


def test_kinds_named_like_markers(spark):
    parts = [("turn", None, "t", 1), ("text", "said", None, None), ("body", None, "b", 1)]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    chat = chat_format.format_chats(df).first()
    assert chat_format.parse_chat(chat["formatted"]) == [("user", "<|part_turn|>said<|part_body|>")]
    assert [a["kind"] for a in chat["attachments"]] == ["turn", "body"]


def test_near_dedup_of_rows_with_maps_and_clashing_names(spark):
    a = " ".join(f"w{i}" for i in range(100))
    rows = [(1, a, {"k": 1, "l": 2}, 5), (1, a, {"l": 2, "k": 1}, 5), (1, a, None, 5), (2, "other words", {}, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, row_a__ long")
    got = simhash.one_row_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2]


def test_edges_are_worked_out_once(spark):
    counted = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    edges = spark.range(50).select(F.col("id").alias("u"), (F.col("id") + F.col("id") % 2).alias("v"))
    found = graph.components(edges.mapInArrow(run, "u long, v long"))
    assert found.count() == 51 and counted.value == 50


def test_learning_reads_every_passage_of_whole_bags(spark, monkeypatch):
    seen = {}

    def fit(features, before, labels):
        seen.update(n=len(features), bags=np.diff(before).tolist(), labels=labels.tolist())
        return quality_classifier.AttentionModel(np.zeros(1), np.ones(1), {})

    monkeypatch.setattr(quality_classifier, "fit", fit)
    long = " ".join(f"w{i}" for i in range(64 * 300))
    docs = spark.createDataFrame([(1, long), (2, "few words"), (3, None), (4, "x"), (4, "x"), (4, long)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (9, 1)], "doc_id long, quality int")
    quality_classifier.learn(docs, marks)
    assert seen == {"n": 303, "bags": [300, 1, 1, 1], "labels": [1, 0, 1, 0]}
    quality_classifier.learn(docs, marks, max_passages=10)
    assert seen == {"n": 3, "bags": [1, 1, 1], "labels": [0, 1, 0]}
    quality_classifier.learn(docs.limit(0), marks)
    assert seen["n"] == 0
