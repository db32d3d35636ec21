import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wordloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "wordloom-tests",
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Rows of a DataFrame as sorted tuples."""

    def take(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted(map(tuple, picked.collect()), key=repr)

    return take


TOKEN_SCHEMA = (
    "source_id long, sentence_idx long, sentence_id string, token_idx long,"
    " surface string, base_form string, reading string, pos array<string>, primary_pos string"
)


@pytest.fixture
def tokens(spark):
    """Tokens of sentences given as ``[(source, idx, text, [(surface, base, reading, pos), ...])]``."""

    def build(sentences):
        data = [
            (source, idx, text, at, surface, base, reading, [pos], pos)
            for source, idx, text, found in sentences
            for at, (surface, base, reading, pos) in enumerate(found)
        ]
        return spark.createDataFrame(data, TOKEN_SCHEMA)

    return build
