"""Counting words inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_words(tokens: Column, readings: bool = True) -> Column:
    """Words of one sentence: an array of structs ``first`` (its first token), ``n``, ``reading``.

    ``tokens`` is an array of structs that start with ``word`` and ``token_idx`` and have
    ``reading`` if ``readings`` are wanted, the first non-empty one of a word. Sorted by
    word and position, a word is a run of neighbours; the places where runs start give its
    count and first token. All steps but the sort are linear in the number of tokens.
    """

    def runs(ordered: Column) -> Column:
        starts = F.transform(
            ordered,
            lambda t, i: F.when(
                F.coalesce(F.get(ordered, i - 1)["word"] != t["word"], F.lit(True)), i
            ),
        )
        return _let(F.array_compact(starts), lambda begins: words(ordered, begins))

    def words(ordered: Column, begins: Column) -> Column:
        def word(begin: Column, k: Column) -> Column:
            n = F.coalesce(F.get(begins, k + 1), F.size(ordered)) - begin
            fields = [F.get(ordered, begin).alias("first"), n.cast("bigint").alias("n")]
            if readings:
                read = F.filter(F.slice(ordered, begin + 1, n), lambda t: t["reading"] != "")
                fields.append(F.get(read, F.lit(0))["reading"].alias("reading"))
            return F.struct(*fields)

        return F.transform(begins, word)

    return _let(F.sort_array(tokens), runs)
