"""Line dedup by site-relative frequency.

A line is boilerplate of its host if the pages of the host that hold it are more than
``ratio`` of the host's pages, and at least ``min_pages``: on a host of a few pages a share says
nothing. Rows of a host with equal texts are one page, so copies of a document do not vote its lines into
boilerplate; with ``each_row`` every row is a page. Near copies still vote as pages of their own; so a page
that would keep less than ``min_left`` of its characters keeps its whole text (0: no such guard). A line counts once per page. Lines are compared without the
spaces around them; blank lines are neither counted nor dropped.

Lines and pages are counted under 128 bits of hash, so no line travels; a hot host, page or line is folded in
each task before the shuffle. The lines of one host above the ratio are at most
(distinct lines per page / ratio), however many pages it has, so each host's list fits a row.
The lists are stored and measured: small ones are broadcast and texts stay where they lie; else
texts meet them in a shuffle join on the host, whose hot hosts AQE splits. Only DataFrame functions.

Defined results: null text stays null and is a page without lines; null hosts are one host; an
empty text stays empty; a text all of whose lines go becomes ''; null texts
of a host are one page; an empty table gives an empty table; columns named like the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.tables import broadcast_if_small, shared, without

RATIO, MIN_PAGES = 0.1, 5


def _hashes(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"))


def _key(line: Column) -> Column:
    return _hashes(F.trim(line))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text",
    ratio: float = RATIO, min_pages: int = MIN_PAGES, each_row: bool = False,
) -> DataFrame:
    """``host``, ``lines``: the keys of its boilerplate lines."""
    filled = F.filter(_lines(text), lambda x: F.trim(x) != "")
    page = F.lit(None) if each_row else _hashes(F.col(text))
    lines = docs.select(
        F.col(host).alias("host"), page.alias("page"),
        F.explode(F.array_distinct(F.transform(filled, _key))).alias("line"),
    )
    pages = docs.select(F.col(host).alias("host"), page.alias("page"))
    if not each_row:
        lines, pages = lines.distinct(), pages.distinct()
    pages = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    counted = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    counted = counted.where(F.col("pages") >= min_pages)
    joined = counted.alias("l").join(pages.alias("p"), F.expr("l.host <=> p.host"))
    frequent = joined.where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))
    return frequent.groupBy(F.col("l.host").alias("host")).agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text",
    ratio: float = RATIO, min_pages: int = MIN_PAGES, each_row: bool = False, min_left: float = 0.0,
) -> DataFrame:
    """``docs`` with boilerplate taken out of ``text``, and ``n_lines``, ``n_dropped``."""
    docs = without(docs, "n_lines", "n_dropped", "boilerplate__", "kept__", "host__")
    found = boilerplate(docs, host, text, ratio, min_pages, each_row).select(
        F.col("host").alias("host__"), F.col("lines").alias("boilerplate__")
    )
    found = broadcast_if_small(shared(found, "boilerplate"))
    joined = docs.join(found, docs[host].eqNullSafe(found["host__"]), "left")
    flagged = F.col("boilerplate__")
    kept = F.when(
        flagged.isNotNull() & F.col(text).isNotNull(),
        F.filter(_lines(text), lambda x: ~F.array_contains(flagged, _key(x))),
    )
    n_lines = F.coalesce(F.size(_lines(text)), F.lit(0)).cast("bigint")
    lines = F.when(F.col(text).isNull(), F.lit(0).cast("bigint")).otherwise(n_lines)
    out = joined.withColumn("kept__", kept)
    if min_left > 0:
        left = F.aggregate("kept__", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))
        out = out.withColumn("kept__", F.when(left >= F.lit(min_left) * F.length(text), F.col("kept__")))
    out = out.withColumn("n_lines", lines)
    out = out.withColumn(
        "n_dropped",
        F.when(F.col("kept__").isNull(), F.lit(0).cast("bigint")).otherwise(
            F.col("n_lines") - F.size("kept__")
        ),
    )
    text_left = F.when(F.col("n_dropped") == 0, F.col(text)).otherwise(F.array_join("kept__", "\n"))
    return out.withColumn(text, text_left).select(*docs.columns, "n_lines", "n_dropped")
