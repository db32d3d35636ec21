"""Fetched pages as they came: a status, headers and bytes, to be gated and decoded.

Every page gets its text or the reason why not, in one scan of column expressions. The charset is what the first
bytes mark, else what the ``Content-Type`` header declares, else what a ``meta`` tag in the first 1,024 bytes
declares (which, being readable as ASCII, cannot be UTF-16: such a tag means UTF-8), else UTF-8. Bytes
that are not valid in their charset make the page undecodable; nothing is guessed or replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.sources.readers import MAX_PAGE_BYTES

RAW_PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.BinaryType()),
    ]
)
# Fixed value: the only status whose body is a page.
OK = 200
META_BYTES = 1024
# Names that pages give the charsets that Spark decodes.
LABELS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "UTF-8", "ascii": "UTF-8",
    "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1",
    "utf-16": "UTF-16LE", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE",
}
# Names of Japanese charsets and the Python codecs for them.
JAPANESE = {"shift_jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "euc-jp": "euc_jp",
            "iso-2022-jp": "iso2022_jp"}
_DECLARED = r"""charset\s*=\s*["']?\s*([^\s;"'/>]+)"""
_META = r"<meta\b[^>]*?\b" + _DECLARED
#: Hexadecimal digits of a UTF-16 unit that stands alone, or of a pair; what they leave over is no UTF-16.
_UNITS = {
    "UTF-16BE": "(?:[0-9A-CEF][0-9A-F]|D[0-7])[0-9A-F]{2}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2}",
    "UTF-16LE": "[0-9A-F]{2}(?:[0-9A-CEF][0-9A-F]|D[0-7])|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F]",
}


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*RAW_PAGES.fieldNames())


def read_page_files(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """Files as pages that were fetched well; the url is the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.lit(OK).alias("status"),
        F.lit(None).cast("string").alias("content_type"), F.col("content").alias("body"))


def declared_charset(content_type: Column, body: Column) -> Column:
    """The charset a page goes by, in lower case, as it is written there."""
    start = F.hex(F.substring(body, 1, 3))
    marked = (
        F.when(start == "EFBBBF", "utf-8")
        .when(start.startswith("FFFE"), "utf-16le")
        .when(start.startswith("FEFF"), "utf-16be")
    )
    head = F.lower(F.decode(F.substring(body, 1, META_BYTES), "ISO-8859-1"))
    header = F.nullif(F.regexp_extract(F.lower(content_type), _DECLARED, 1), F.lit(""))
    meta = F.nullif(F.regexp_extract(head, _META, 1), F.lit(""))
    meta = F.when(meta.startswith("utf-16"), "utf-8").otherwise(meta)
    return F.coalesce(marked, header, meta, F.lit("utf-8"))


def _codec(codecs: dict[str, str]):
    @F.pandas_udf("string")
    def decoded(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(body, label):
            try:
                return None if body is None or label not in codecs else bytes(body).decode(codecs[label])
            except UnicodeDecodeError:
                return None

        for bodies, labels in parts:
            yield pd.Series([one(b, x) for b, x in zip(bodies, labels, strict=True)], dtype=object)

    return decoded


def decoded_pages(
    raw: DataFrame, max_bytes: int = MAX_PAGE_BYTES, codecs: dict[str, str] | None = None
) -> DataFrame:
    """``page_id``, ``url``, ``charset``, ``html``, ``reason``: the text of each page, or why it has none.

    Reasons, the first that holds: ``status``, ``no body``, ``too large``, ``unknown charset``,
    ``undecodable``. ``codecs`` adds charsets by Python codec (as ``JAPANESE``); only then does a
    Python worker take part, and only with bodies in these charsets.
    """
    codecs = codecs or {}
    body, label = F.col("body"), F.col("charset")
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    charset = declared_charset(F.col("content_type"), body).alias("charset")
    named = raw.select("page_id", "url", "status", "body", charset)
    early = (
        F.when(F.coalesce(F.col("status"), F.lit(0)) != OK, "status")
        .when(body.isNull(), "no body")
        .when(F.octet_length("body") >= max_bytes, "too large")
        .when(~label.isin(*LABELS, *codecs), "unknown charset")
    )
    rows = named.withColumn("early", early).withColumn("by", known[label])
    text = F.when(F.col("by") == "UTF-8", F.try_validate_utf8(body.cast("string")))
    text = text.when(F.col("by") == "ISO-8859-1", F.decode(body, "ISO-8859-1"))
    for name, units in _UNITS.items():
        whole = (F.octet_length("body") % 2 == 0) & (F.regexp_replace(F.hex("body"), units, "") == "")
        text = text.when((F.col("by") == name) & whole, F.decode(body, name))
    if codecs:
        other = F.when(F.col("early").isNull() & F.col("by").isNull(), body)
        rows = rows.withColumn("other", _codec(codecs)(other, label))
        text = text.when(F.col("by").isNull(), F.col("other"))
    html = F.when(F.col("early").isNull(), F.regexp_replace(text, "^﻿", ""))
    rows = rows.withColumn("html", html)
    reason = F.coalesce("early", F.when(F.col("html").isNull(), F.lit("undecodable")))
    return rows.select("page_id", "url", "charset", "html", reason.alias("reason"))
