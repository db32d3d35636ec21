"""What a store leaves on disk: shuffles, versions, dictionaries, slices; results stay as they are without."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wordloom.operators import layout
from wordloom.plans import ingest, store as stores
from wordloom.plans.ingest import ingest_batch
from wordloom.plans.store import VIEWS, VocabularyStore
from wordloom.session import DROP_SHUFFLES, shuffles_dropped, work_folder

WORDS = "un deux trois quatre cinq six sept huit neuf dix onze douze"


@pytest.fixture
def store(spark):
    return VocabularyStore(spark, work_folder(spark, "store"))


def texts(spark, sources, lines):
    rows = [(n, "\n".join(f"{w} {n % 7} un" for w in WORDS.split()[:lines]), "fr") for n in sources]
    return spark.createDataFrame(rows, "source_id long, text string, language string")


def plain(path):
    return path.removeprefix("file:")


def test_shuffles_of_a_write_are_dropped_and_the_setting_comes_back(spark, store):
    before = spark.conf.get(DROP_SHUFFLES, None)
    seen = []
    with shuffles_dropped(spark):
        seen.append(spark.conf.get(DROP_SHUFFLES))
    with pytest.raises(ZeroDivisionError), shuffles_dropped(spark):
        1 / 0
    assert seen == ["true"] and spark.conf.get(DROP_SHUFFLES, None) == before


def test_each_write_of_the_store_drops_its_shuffles(spark, store, monkeypatch):
    settings = []
    real = stores._write

    class Rows:
        def __init__(self, rows):
            self.rows, self.sparkSession = rows, rows.sparkSession

        @property
        def write(self):
            settings.append(spark.conf.get(DROP_SHUFFLES))
            return self.rows.write

    monkeypatch.setattr(stores, "_write", lambda rows, *a: real(Rows(rows), *a))
    ingest_batch(store, texts(spark, range(4), 3), drop_ascii=False)
    store.write_views()
    assert len(settings) >= 5 + len(VIEWS) and set(settings) == {"true"}


def test_words_and_ids_of_a_file_are_in_its_dictionary(spark, store):
    """A column of 50,000 different ids: over the usual dictionary, written once each, not once a row."""
    path = work_folder(spark, "ids")
    ids = spark.range(300_000, numPartitions=1).select(
        F.md5(F.pmod(F.hash("id"), F.lit(50_000)).cast("string")).alias("word_id"))
    stores._write(ids, path)
    files = [f for f in os.listdir(plain(path)) if f.endswith(".parquet")]
    column = [pq.ParquetFile(f"{plain(path)}/{f}").metadata.row_group(0).column(0) for f in files]
    assert sum(c.total_compressed_size for c in column) < 300_000 * 6
    assert not any("PLAIN" == e for c in column for e in c.encodings)


@pytest.mark.parametrize("name", ["word_sources", "word_contexts"])
def test_slices_make_the_same_view_in_the_same_ranges(spark, store, rows, monkeypatch, name):
    ingest_batch(store, texts(spark, range(30), 5), drop_ascii=False)
    store.refresh_view(name)
    monkeypatch.setattr(stores, "SLICE_BYTES", 1)
    written = []
    real = stores._write
    monkeypatch.setattr(stores, "_write", lambda rows, path, *a: (written.append((path, *a)), real(rows, path, *a)))
    ingest_batch(store, texts(spark, range(15, 45), 12), drop_ascii=False)
    written.clear()
    got = store.refresh_view(name)  # out of the last version and what is new
    modes = ["overwrite"] + ["append"] * (stores.SLICES - 1)
    assert [mode for _, mode in written] == (modes if name == "word_sources" else modes[:1])
    whole = store.view(name)
    assert rows(got, *whole.columns) == rows(whole) and got.count() > 0
    written.clear()
    again = store.write_view(name, store.view(name), VIEWS[name])
    assert [mode for _, mode in written] == modes
    assert rows(again, *whole.columns) == rows(whole)
    # A source lies in one slice: its pairs are in files of one write.
    writes = again.select("source_id", F.regexp_extract(F.input_file_name(), "part-[0-9]+-([0-9a-f-]+)-c", 1).alias("w"))
    assert writes.distinct().groupBy("source_id").count().where("count > 1").isEmpty()


def test_cuts_are_in_order_and_a_source_is_never_cut(spark, store, monkeypatch):
    assert store._cuts(4) == []
    ingest_batch(store, texts(spark, range(100, 140), 6), drop_ascii=False)
    cuts = store._cuts(4)
    assert len(cuts) == 3 and cuts == sorted(set(cuts))
    ingest_batch(store, texts(spark, range(100, 140), 8), drop_ascii=False)
    assert store._cuts(4) == sorted(set(store._cuts(4)))
    one = VocabularyStore(spark, work_folder(spark, "store"))
    ingest_batch(one, texts(spark, [7], 6), drop_ascii=False)
    monkeypatch.setattr(stores, "SLICE_BYTES", 1)
    assert one._cuts(4) == []
    assert one.write_view("word_sources", one.view("word_sources"), VIEWS["word_sources"]).count() > 0


def test_a_refresh_keeps_the_version_before_and_removes_older_ones(spark, store, rows):
    def versions():
        return sorted(d for d in os.listdir(f"{plain(store.root)}/views/word_sources") if d.startswith("version="))

    read = []
    for lines in (2, 4, 6):
        ingest_batch(store, texts(spark, range(6), lines), drop_ascii=False)
        read.append(store.refresh_view("word_sources"))
    assert versions() == ["version=1", "version=2"]
    assert read[1].count() > 0  # readers of the version before are not disturbed
    store.write_view("word_sources", store.view("word_sources"))
    assert versions() == ["version=1", "version=2", "version=3"]  # only a refresh removes


def test_texts_of_many_known_sources_move_once(spark, store, rows, monkeypatch):
    ingest_batch(store, texts(spark, range(40), 4), drop_ascii=False)
    once = VocabularyStore(spark, work_folder(spark, "store"))
    ingest_batch(once, texts(spark, range(40), 9), drop_ascii=False)
    monkeypatch.setattr(layout, "BROADCAST_BYTES", 0)  # as if they were many
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        more = texts(spark, range(40), 9).withColumn("arrival", F.lit(0))
        more = more.withColumn("source_id", F.col("source_id").cast("string"))
        plan = ingest.fresh_sentences(more, store.progress())._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan, plan[:3000]
        assert plan.count("Exchange hashpartitioning(source_id") == 2, plan[:3000]  # texts, and what is known of them
        ingest_batch(store, texts(spark, range(40), 9), drop_ascii=False)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    columns = ["source_id", "sentence_idx", "word", "n"]
    assert rows(store.facts(), *columns) == rows(once.facts(), *columns)
