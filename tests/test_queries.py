"""Every query against its SQL on the smallest tables, and the regression anchors."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wordloom.plans import oracle, queries

FOLDER = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(SQL) == set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, db, name):
    got = queries.queries()[name](spark, FOLDER)
    result = db.execute(SQL[name])
    names = [d[0] for d in result.description]
    columns = sorted(names)
    assert sorted(got.columns) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(row[i] for i in at) for row in result.fetchall()), key=repr)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == want
    assert want


@pytest.mark.parametrize(
    "folder, sentences, links, pairs, contexts, index_sum",
    [("sf0.001", 1829, 8696, 7641, 8323, 88437), ("sf0.01", 9344, 50067, 43330, 47744, 466013)],
)
def test_anchors(spark, folder, sentences, links, pairs, contexts, index_sum):
    path, run = f"/root/testdata/{folder}", queries.queries()
    assert run["split_sentences"](spark, path).count() == sentences
    assert run["total_links"](spark, path).first()["links"] == links
    assert run["occurrence_counts"](spark, path).count() == pairs
    top = run["top_contexts"](spark, path).agg(F.count(F.lit(1)), F.sum("sentence_idx")).first()
    assert tuple(top) == (contexts, index_sum)


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "source_id", "word", "sentence_id", "sentence_idx", "context_no"]
