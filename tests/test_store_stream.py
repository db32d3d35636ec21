import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F

from wordloom.operators import views
from wordloom.operators.tokens import tokenize_spaced
from wordloom.plans.ingest import ingest_batch, ingest_pages, page_texts
from wordloom.plans.store import VocabularyStore
from wordloom.schemas import DOCUMENTS
from wordloom.session import work_folder
from wordloom.streaming.ingest import start_ingest, start_page_ingest, stream_documents, stream_pages
from wordloom.streaming.running import latest_counts, running_counts, start_running_counts


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id long, text string")


@pytest.fixture
def store(spark):
    return VocabularyStore(spark, work_folder(spark, "store"))


def counts(store):
    return {(int(r["source_id"]), r["word"]): r["occurrence_count"]
            for r in views.occurrence_counts(store.facts()).collect()}


def failing(sentences):
    tokens = tokenize_spaced(sentences)
    base = F.col("base_form")
    return tokens.withColumn(
        "base_form", F.when(base != "bad", base).otherwise(F.raise_error(F.lit("bad word"))))


def test_ingest_and_resume(spark, store):
    seen = []
    first = ingest_batch(store, texts(spark, (1, "un un\ndeux")), drop_ascii=False,
                         on_batch=lambda *a: seen.append(a))
    again = ingest_batch(store, texts(spark, (1, "un un\ndeux")), drop_ascii=False)
    more = ingest_batch(store, texts(spark, (1, "un un\ndeux\ntrois un"), (2, "!\n?")), drop_ascii=False,
                        on_batch=lambda *a: seen.append(a))
    assert (first, again, more) == (3, 0, 2)
    assert seen == [(0, 2, 3), (2, 3, 2)]
    assert counts(store) == {(1, "un"): 3, (1, "deux"): 1, (1, "trois"): 1}
    progress = {r["source_id"]: r["last_processed"] for r in store.progress().collect()}
    assert progress == {"1": 2, "2": 1}  # source 2 has no word at all
    assert store.next_batch_id() == 3


def test_a_failing_batch_leaves_nothing(spark, store):
    ingest_batch(store, texts(spark, (1, "un")), drop_ascii=False)
    with pytest.raises(PySparkException, match="bad word"):
        ingest_batch(store, texts(spark, (2, "good\nbad")), tokenizer=failing, drop_ascii=False)
    assert counts(store) == {(1, "un"): 1}
    assert store.sentences().count() == 1
    assert store.progress().count() == 1
    # The retry takes the same id and overwrites what the failed try left.
    assert ingest_batch(store, texts(spark, (2, "good\nbad")), drop_ascii=False) == 2
    assert counts(store) == {(1, "un"): 1, (2, "good"): 1, (2, "bad"): 1}


def test_user_write_that_fails_fails_the_batch(spark, store):
    def write(facts, batch_id):
        raise RuntimeError("no room")

    with pytest.raises(RuntimeError, match="no room"):
        ingest_batch(store, texts(spark, (1, "un")), drop_ascii=False, extra_write=write)
    assert store.facts().count() == 0


def test_views(spark, store, rows):
    ingest_batch(store, texts(spark, (1, "a b\nb c\nb"), (2, "b")), drop_ascii=False, language="en")
    links = store.write_view("word_sources", store.view("word_sources"))
    assert sorted(rows(links, "source_id", "word", "occurrence_count")) == [
        ("1", "a", 1), ("1", "b", 3), ("1", "c", 1), ("2", "b", 1)]
    assert links.where("first_seen_at is null").count() == 0
    sentence = store.view("sentences")
    joined = links.join(sentence, F.col("context_sentence_id") == F.col("sentence_id"))
    assert ("b", "b") in rows(joined.where("source_id = 1"), "word", "sentence")
    assert sorted(rows(store.view("words"), "word", "lemma", "language")) == [
        ("a", "a", "en"), ("b", "b", "en"), ("c", "c", "en")]
    assert store.view("word_contexts").count() == 6
    store.write_views()
    before = store.read_view("words")
    store.retract(texts(spark, (1, "")))
    assert rows(store.view("words"), "word") == [("b",)]
    assert rows(store.view("sentences"), "sentence") == [("b",)]
    store.write_views()
    assert before.count() == 3 and store.read_view("words").count() == 1
    assert ingest_batch(store, texts(spark, (1, "a\nd")), drop_ascii=False) == 2
    assert counts(store) == {(1, "a"): 1, (1, "d"): 1, (2, "b"): 1}


def write_documents(spark, folder, name, *docs):
    data = [(i, text, "xx", "s", len(text)) for i, text in docs]
    path = f"{folder}/{name}"
    spark.createDataFrame(data, DOCUMENTS).coalesce(1).write.parquet(path)
    return path


def add_file(spark, tmp_path, name, *docs):
    source = write_documents(spark, str(tmp_path), name + "-tmp", *docs)
    part = next(p for p in (tmp_path / (name + "-tmp")).iterdir() if p.suffix == ".parquet")
    inbox = tmp_path / "inbox"
    inbox.mkdir(exist_ok=True)
    (inbox / f"{name}.parquet").write_bytes(part.read_bytes())
    assert source


def run_ingest(spark, store, tmp_path, **options):
    stream = stream_documents(spark, str(tmp_path / "inbox"), files_per_batch=1)
    start_ingest(store, stream, str(tmp_path / "cp"), drop_ascii=False, **options).awaitTermination()


def test_stream_takes_each_file_once(spark, store, tmp_path):
    add_file(spark, tmp_path, "one", (1, "un deux"), (2, "un"))
    run_ingest(spark, store, tmp_path)
    run_ingest(spark, store, tmp_path)
    assert sum(counts(store).values()) == 3
    add_file(spark, tmp_path, "two", (3, "trois"), (1, "un deux"))  # source 1 comes again
    run_ingest(spark, store, tmp_path)
    assert counts(store) == {(1, "un"): 1, (1, "deux"): 1, (2, "un"): 1, (3, "trois"): 1}
    assert store.batches().count() == 2


def test_stream_stops_at_a_bad_batch_and_repeats_it(spark, store, tmp_path):
    add_file(spark, tmp_path, "one", (1, "un"))
    run_ingest(spark, store, tmp_path)
    add_file(spark, tmp_path, "two", (2, "bad"))
    with pytest.raises(StreamingQueryException):
        run_ingest(spark, store, tmp_path, tokenizer=failing)
    assert counts(store) == {(1, "un"): 1}
    run_ingest(spark, store, tmp_path)
    assert counts(store) == {(1, "un"): 1, (2, "bad"): 1}
    assert sorted(r["batch_id"] for r in store.batches().collect()) == [0, 1]


def test_running_counts(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = stream_documents(spark, str(tmp_path / "inbox"), files_per_batch=1)
        start_running_counts(running_counts(stream, drop_ascii=False), out, checkpoint).awaitTermination()
        return {(r["source_id"], r["word"]): r["occurrence_count"]
                for r in latest_counts(spark, out).collect()}

    add_file(spark, tmp_path, "one", (1, "un un\ndeux"))
    assert run() == {(1, "un"): 2, (1, "deux"): 1}
    add_file(spark, tmp_path, "two", (1, "un un\ndeux\nun"), (2, "deux"))
    assert run() == {(1, "un"): 3, (1, "deux"): 1, (2, "deux"): 1}


def test_pages_to_store(spark, store):
    html = "<html><body><article><p>Où est le chat?</p><p>Là.</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a.example/1", html)], "page_id long, url string, html string")
    assert ingest_batch(store, page_texts(pages)) == 2
    assert set(counts(store)) == {(1, "où"), (1, "là")}


def test_texts_of_a_source_follow_each_other(spark, store):
    rows = [(1, 1, "one\ntwo"), (1, 0, "one"), (1, 2, "other\ntwo"), (2, 0, "x"), (1, 3, "other\ntwo")]
    df = spark.createDataFrame(rows, "source_id long, arrival long, text string")
    assert ingest_batch(store, df, drop_ascii=False) == 5  # the third text was edited, the fourth repeats it
    assert counts(store) == {(1, "one"): 1, (1, "two"): 2, (1, "other"): 1, (2, "x"): 1}
    idx = sorted(r["sentence_idx"] for r in store.sentences().where("source_id = 1").collect())
    assert idx == [0, 1, 2, 3]
    assert ingest_batch(store, texts(spark, (1, "other\ntwo\nmore")), drop_ascii=False) == 1


def test_edited_text_is_taken_in_whole(spark, store):
    ingest_batch(store, texts(spark, (1, "a\nb\nc")), drop_ascii=False)
    assert ingest_batch(store, texts(spark, (1, "new\na\nb\nc")), drop_ascii=False) == 4
    assert ingest_batch(store, texts(spark, (1, "new\na\nb\nc\nd")), drop_ascii=False) == 1
    assert store.progress().first()["last_processed"] == 7


def test_a_committed_batch_is_final(spark, store):
    data = texts(spark, (1, "un un"))
    assert ingest_batch(store, data, 0, "s", drop_ascii=False) == 2
    assert ingest_batch(store, data, 0, "s", drop_ascii=False) == 2
    assert ingest_batch(store, texts(spark, (2, "x")), 0, "other", drop_ascii=False) == 1
    assert ingest_batch(store, texts(spark, (3, "y")), drop_ascii=False) == 1
    assert counts(store) == {(1, "un"): 2, (2, "x"): 1, (3, "y"): 1}
    assert sorted(r["seq"] for r in store.batches().collect()) == [0, 1, 2]


def test_the_later_commit_wins(spark, store):
    def reading(text):
        return lambda s: tokenize_spaced(s).withColumn("reading", F.lit(text))

    ingest_batch(store, texts(spark, (9, "word")), tokenizer=reading("フルイ"), drop_ascii=False)
    ingest_batch(store, texts(spark, (1, "word")), tokenizer=reading("アタラシイ"), drop_ascii=False)
    assert store.view("words").first()["pronunciation"] == "あたらしい"


def test_rejects_and_hooks(spark, store, rows):
    heard, errors = [], []
    ingest_batch(store, texts(spark, (None, "lost"), (1, "un")), drop_ascii=False, on_progress=lambda *a: heard.append(a))
    assert heard == [("sentences", 0, 1), ("facts", 1, 1), ("committed", 1, 1)]
    assert rows(store.rejected()) == [(None, "no source")]
    with pytest.raises(PySparkException):
        ingest_batch(store, texts(spark, (2, "bad")), tokenizer=failing, drop_ascii=False,
                     on_error=lambda i, e: errors.append(i))
    assert errors == [1]
    analyse = lambda s: s.map(lambda t: [{"surface": w, "features": ["名詞"]} for w in t.split()])
    assert ingest_batch(store, texts(spark, (3, "deux deux")), analyse=analyse, drop_ascii=False) == 2


def test_two_streams_and_a_job_share_a_store(spark, store, tmp_path):
    add_file(spark, tmp_path, "one", (1, "un"))
    ingest_batch(store, texts(spark, (7, "sept")), drop_ascii=False)
    run_ingest(spark, store, tmp_path)
    stream = stream_documents(spark, str(tmp_path / "inbox"))
    start_ingest(store, stream, str(tmp_path / "cp2"), drop_ascii=False).awaitTermination()
    assert counts(store) == {(7, "sept"): 1, (1, "un"): 1}
    assert store.batches().count() == 3


HTML = "<html><head><title>{0}</title></head><body><article>{1}</article></body></html>"


def pages_of(spark, *specs):
    data = [(i, url, HTML.format(title, "".join(f"<p>{p}</p>" for p in ps))) for i, url, title, *ps in specs]
    return spark.createDataFrame(data, "page_id long, url string, html string")


def words_of(store):
    facts = store.facts().join(store.known_sources().select("source_id", "url"), "source_id")
    return {(r["url"], r["word"]): r["occurrence_count"]
            for r in facts.groupBy("url", "word").agg(F.sum("n").alias("occurrence_count")).collect()}


def test_pages_with_sources(spark, store, rows):
    first = pages_of(spark, (5, "http://a.example/1", "T", "un", "deux"), (3, "http://a.example/1", "T", "un"),
                     (9, "http://b.example/2", "U", "trois"))
    assert ingest_pages(store, first, drop_ascii=False) == 3
    assert words_of(store) == {
        ("http://a.example/1", "un"): 1, ("http://a.example/1", "deux"): 1, ("http://b.example/2", "trois"): 1}
    # Page ids come again, for other pages.
    again = pages_of(spark, (9, "http://a.example/1", "T", "un", "deux", "quatre"), (9, "http://c.example", "V", "un"))
    assert ingest_pages(store, again, drop_ascii=False, language="fr") == 2
    assert ingest_batch(store, texts(spark, (9, "neuf")), drop_ascii=False) == 1
    assert words_of(store)[("http://a.example/1", "quatre")] == 1
    got = sorted(rows(store.view("sources"), "url", "title", "last_processed_sentence"))
    assert got == [("http://a.example/1", "T", 2), ("http://b.example/2", "U", 0), ("http://c.example", "V", 0)]
    store.write_views()
    assert {r["language"] for r in store.read_view("words").collect()} == {"fr", "und"}
    assert store.read_view("sources").count() == 3


def test_pages_as_a_stream(spark, store, tmp_path):
    inbox = str(tmp_path / "pages")
    pages_of(spark, (1, "http://a.example/1", "T", "un")).coalesce(1).write.parquet(inbox)
    for _ in range(2):
        start_page_ingest(store, stream_pages(spark, inbox), str(tmp_path / "cp"), drop_ascii=False).awaitTermination()
    assert words_of(store) == {("http://a.example/1", "un"): 1}


def test_backfill_lasts(spark, store, rows):
    from wordloom.operators.dictionary import term_matches
    from wordloom.schemas import ENTRY

    entry = ("1", [], [("un", True, [])], [(["n"], [("one", "eng")])])
    ingest_batch(store, texts(spark, (1, "un deux")), drop_ascii=False)
    matches = term_matches(spark.createDataFrame([entry], ENTRY))
    assert store.backfill(matches) == 1 and store.backfill(matches) == 0
    store.write_views()
    store.write_views()
    found = {r["word"]: r["definitions"] for r in store.read_view("words").collect()}
    assert found["deux"] is None and found["un"][0]["senses"] == ["one"]
