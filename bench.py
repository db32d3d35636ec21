"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` (optional,
comma-separated) other queries. Every result is computed in full and thrown away by
Spark's ``noop`` sink. The time of a query is the better of two runs, planning included.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wordloom.plans.queries import queries  # noqa: E402
from wordloom.session import build_session  # noqa: E402

HEADLINE = [
    "strip_ruby",
    "main_text_blocks",
    "split_sentences",
    "tokenize_spaced",
    "tokenize_lexicon",
    "pos_filter",
    "sentence_word_counts_all",
    "first_reading",
    "occurrence_counts_all",
    "word_sources",
    "latest_context",
    "top_contexts",
    "words_in_order",
    "total_links_all",
    "top_contexts_all",
    "words_in_order_all",
    "words_upsert",
    "sentences_distinct",
    "insert_ignore",
    "dict_lookup_reading",
    "enrich_words",
    "backfill_definitions",
    "page_vocabulary",
    "sink_roundtrip",
    "stream_ingest",
    "stream_running_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "wordloom-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(cpus)),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wordloom-bench-"))
    known, seconds = queries(), {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name}: {best:.2f} s", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
