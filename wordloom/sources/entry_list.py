"""One large JSON dictionary, read by as many tasks as it has splits.

The document is ``{"words": [entry, …]}``, a bare ``[entry, …]`` or entries one behind the other. It is read as text
whose lines end where an entry begins, so Spark cuts the file into byte ranges and moves each range to
the next entry by itself. An entry begins with its id: ``{"id":`` with the white space that the
file has there, found at the first entry. Within a JSON string those quotes would be
escaped, so the mark cannot lie inside a text. Entries written with other white space stay in the piece
before them and are parsed with it.

What a piece ends with tells whether it was cut rightly: a comma behind an entry, or the end
of the document. Anything else fails the read: an id that opens an inner object, a second list of
entries, an entry list that is not ``words``. So nothing is lost in silence. A document in
which ids do not come first is for ``read_dictionary``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.schemas import ENTRY

#: What a document has before its first entry: an open list, a list with nothing in it, or the entry itself.
_HEAD = r'(?s)\A(\s*(\{.*"words"\s*:\s*)?\[\s*|\s*\[\s*\]\s*|)\z'
_OPENS = r"\A\s*(\[|\{|\z)"


def entry_mark(spark: SparkSession, path: str) -> str:
    """The text every entry of the document begins with."""
    pieces = [r.value for r in spark.read.option("lineSep", '"id"').text(path).head(2)]
    before = re.search(r"\{\s*\Z", pieces[0]) if pieces else None
    behind = re.match(r"\s*:", pieces[1]) if len(pieces) > 1 else None
    return f'{before[0]}"id"{behind[0]}' if before and behind else '{"id":'


def read_entry_list(spark: SparkSession, path: str, mark: str | None = None) -> DataFrame:
    """Entries of large JSON documents that share one ``mark`` (found at the first entry if not given).

    An empty list and an empty file give no rows; an object without entries fails. An id is a text or a number.
    """
    mark = entry_mark(spark, path) if mark is None else mark
    piece = F.regexp_replace("value", r"\A\x{FEFF}", "")
    rest = F.regexp_replace(piece, r",\s*\z", "")
    bad = F.raise_error(F.concat(F.lit("not a list of entries that begin with their id: …"), F.right(piece, F.lit(80))))
    # One expression, as filters that the optimizer adds may look at any piece.
    text = (
        F.when(piece.rlike(_OPENS), F.when(piece.rlike(_HEAD), F.lit("[]")).otherwise(bad))
        .when(piece.rlike(r"[\[:]\s*\z"), bad)
        .otherwise(F.concat(F.lit('[{"id":'), rest, F.lit("]")))
    )
    entries = F.from_json(text, T.ArrayType(ENTRY), {"mode": "FAILFAST"})
    raw = spark.read.option("lineSep", mark).text(path)
    return raw.select(F.explode(entries).alias("e")).select("e.*")
