"""Nested dictionary columns: terms, readings, definitions and their JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.text import null_if_empty, to_hiragana

_NO_STRINGS = "array<string>"


def _strings(values: Column) -> Column:
    return F.coalesce(values, F.array().cast(_NO_STRINGS))


def entry_terms(kanji: Column, kana: Column) -> Column:
    """Every spelling an entry is found under, each once, blank ones left out."""
    terms = F.array_union(_strings(kanji["text"]), _strings(kana["text"]))
    return F.filter(terms, lambda t: F.coalesce(t, F.lit("")) != "")


def entry_readings(kana: Column) -> Column:
    return F.array_distinct(F.transform(_strings(kana["text"]), to_hiragana))


def primary_kana(kana: Column) -> Column:
    """First kana marked common, else the first kana, as hiragana; NULL without any kana."""
    common = F.filter(kana, lambda k: F.coalesce(k["common"], F.lit(False)))
    first_common = null_if_empty(F.get(common, F.lit(0))["text"])
    return to_hiragana(F.coalesce(first_common, F.get(kana, F.lit(0))["text"]))


def entry_senses(sense: Column) -> Column:
    """All glosses of all senses in order, repeats kept."""
    return _strings(F.flatten(F.transform(sense, lambda s: _strings(s["gloss"]["text"]))))


def entry_pos(sense: Column) -> Column:
    """All parts of speech of all senses in order, repeats kept."""
    return _strings(F.flatten(F.transform(sense, lambda s: _strings(s["partOfSpeech"]))))


def definitions_of(entries: Column) -> Column:
    """Definitions of an array of structs that have ``senses`` and ``pos``."""
    return F.transform(
        entries, lambda e: F.struct(e["senses"].alias("senses"), e["pos"].alias("pos"))
    )


def definitions_json(definitions: Column) -> Column:
    """JSON text of a definitions array; ``''`` when there are none.

    An empty list is written ``null``, and ``<``, ``>``, ``&`` and the two Unicode line
    separators are escaped, so that the text equals what existing stores hold.
    """

    def null_if_none(values: Column) -> Column:
        return F.when(F.size(values) > 0, values)

    shaped = F.transform(
        definitions,
        lambda d: F.struct(
            null_if_none(d["senses"]).alias("senses"), null_if_none(d["pos"]).alias("pos")
        ),
    )
    text = F.to_json(shaped, {"ignoreNullFields": "false"})
    for char in "<>&\u2028\u2029":
        text = F.replace(text, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return F.when(F.coalesce(F.size(definitions), F.lit(0)) > 0, text).otherwise("")
