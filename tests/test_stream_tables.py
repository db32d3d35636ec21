"""Streams over tables that are one file, or a folder of files."""

from wordloom.plans import queries
from wordloom.schemas import DOCUMENTS


def test_a_table_may_be_a_folder(spark, tmp_path, rows):
    data = [(1, "é un\nun", "fr", "s", 7), (2, "é é", "fr", "s", 3), (3, None, "fr", "s", 0)]
    spark.createDataFrame(data, DOCUMENTS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(1, "é", 1), (2, "é", 2)]
    for name in ("stream_running_counts", "stream_ingest"):
        got = queries.queries()[name](spark, str(tmp_path))
        assert rows(got, "source_id", "word", "occurrence_count") == want, name
