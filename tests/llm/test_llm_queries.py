"""Queries against their SQL, and the pipeline stage by stage."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from wordloom.llm import oracle, queries, simhash
from wordloom.llm.tables import shared, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = queries.queries()[name](spark, FOLDER)
    result = db.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(result.fetchall(), key=repr)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == want


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op5_source_mixing", "op7_language_id", "op8_quality_classifier"])
def test_learned_queries_cover_their_table(spark, name):
    got = queries.queries()[name](spark, FOLDER)
    docs = table(spark, FOLDER, "documents")
    assert got.count() == docs.count()
    assert got.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0


def staged(spark, docs, folder):
    """Documents after each stage."""
    out = [shared(docs, "docs")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(shared(stage(spark, out[-1], folder), name.replace(" ", "-")))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_pipeline_equals_brute_force(spark):
    from test_dedup_operators import contamination, groups, plain_fingerprint
    from test_line_quality_chat_url import cleaned
    from wordloom.llm.line_dedup import MIN_PAGES, RATIO

    docs = table(spark, FOLDER, "documents")
    extra = spark.createDataFrame(
        [(10_001, "1234 !!", "en", "src1", 7), (10_002, None, None, None, None), (None, "The and of that", "en", "src2", 15)], docs.schema)
    start, known, lines, single, clean, mixed = staged(spark, docs.unionAll(extra), FOLDER)
    assert ids(start) - ids(known) == {10_001, 10_002}
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in known.collect()]
    want = [(i, t) for i, t, _, _ in cleaned(rows, RATIO, MIN_PAGES)]
    assert sorted(((r["doc_id"], r["text"]) for r in lines.collect()), key=repr) == want
    kept, fps = {}, [plain_fingerprint(t) for _, t in want]
    for (i, t), part in zip(want, groups(fps), strict=True):
        if i is None:
            kept[None] = t
        elif part not in kept or i < kept[part][0]:
            kept[part] = (i, t)
    left = [(None, x) if k is None else x for k, x in kept.items()]
    assert sorted(((r["doc_id"], r["text"]) for r in single.collect()), key=repr) == sorted(left, key=repr)
    items = [(r["item_id"], r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]
    good = {i for i, *_, bad in contamination(left, items) if not bad}
    assert ids(clean) == good and ids(mixed) == good
    for df in (known, lines, single, clean):
        assert df.columns == docs.columns
    assert {"rate", "copies", "posterior"} <= set(mixed.columns)
    run = corpus_pipeline.run(spark, FOLDER)
    assert ids(run) == {i for i in good if i is not None and i < 10_000}


def test_pipeline_with_an_empty_table_and_more_columns(spark):
    docs = table(spark, FOLDER, "documents").limit(0).withColumn("rate", F.lit("x"))
    assert [d.count() for d in staged(spark, docs, FOLDER)] == [0] * 6
    few = table(spark, FOLDER, "documents").where("doc_id < 30").withColumn("component_id", F.lit("x"))
    last = staged(spark, few.withColumn("fp", F.lit(1)), FOLDER)[-1]
    assert {"component_id", "fp"} <= set(last.columns) and last.count() > 0


def test_one_task_never_holds_a_hot_group(spark):
    """The plans of the shuffles: no window over all rows, no cross join."""
    docs = table(spark, FOLDER, "documents")
    plan = simhash.links(simhash.fingerprints(docs).select("fp").distinct())._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Window" not in plan
