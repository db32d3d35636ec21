"""Morphology columns: features to base form, reading and part of speech; token filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.functions.text import is_ascii

# Fixed values -----------------------------------------------------------------
#: Primary parts of speech that carry no vocabulary: symbol, supplementary symbol,
#: particle, auxiliary verb.
DROPPED_POS = ("記号", "補助記号", "助詞", "助動詞")
#: Second part of speech of a numeral.
NUMERAL_POS = "数"
#: Where an analyser puts the base form and the reading, and how it writes "none".
BASE_FORM_AT = 6
READING_AT = 7
NO_FEATURE = "*"
# ------------------------------------------------------------------------------


def _feature(features: Column, at: int) -> Column:
    return F.nullif(F.get(features, F.lit(at)), F.lit(NO_FEATURE))


def base_form(surface: Column, features: Column) -> Column:
    return F.coalesce(_feature(features, BASE_FORM_AT), surface)


def reading(features: Column) -> Column:
    return F.coalesce(_feature(features, READING_AT), F.lit(""))


def primary_pos(features: Column) -> Column:
    return F.coalesce(F.get(features, F.lit(0)), F.lit(""))


def canonical_word(surface: Column, base: Column) -> Column:
    """The base form where there is one, else the text as written."""
    return F.when(F.coalesce(base, F.lit("")).isin("", NO_FEATURE), surface).otherwise(base)


def has_vocabulary_pos(primary: Column) -> Column:
    return primary.isNull() | ~primary.isin(*DROPPED_POS)


def is_numeral(pos: Column) -> Column:
    return F.coalesce(F.get(pos, F.lit(1)), F.lit("")) == NUMERAL_POS


def is_vocabulary(
    surface: Column, pos: Column, primary: Column, drop_ascii: bool = True
) -> Column:
    """All token filters in one predicate. The ASCII test looks at the surface, not the base."""
    keep = has_vocabulary_pos(primary) & ~is_numeral(pos)
    return keep & ~is_ascii(surface) if drop_ascii else keep
