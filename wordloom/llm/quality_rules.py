"""Quality rules with adaptive thresholds.

Base counts of every whole text are worked out inside the row. The rates made of them
are summed up per language and source in mergeable quantile sketches, from which each group gets
fences of its own in place of fixed cutoffs; a join of texts with the fences of their
group filters them. Only DataFrame functions.

Sketch: a value goes to a bucket named by its seven leading bits, so the bucket is off by
less than 1/64, and a sketch is the count of each bucket: at most some 3,700 numbers per rate,
merged by adding, the same whatever the order of merging. Tasks fold their rows into it
before the shuffle, so a hot group costs no more than another.

Fences: upper quartile + ``REACH`` times the spread of the quartiles, and for the mean word length also
the lower quartile less as much. The spread is at least the rate's ``least`` so that a group
of equal texts does not reject everything else.

Defined results: null or empty texts have no words and fail the base rule; null languages and
sources form groups of their own; repeated rows count each; a group without a text
that passes the base rules has no fences and rejects nothing more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wordloom.llm.tables import shared

#: Rate name -> (scale, counted column, per column, least spread, whether the low side is fenced too).
RATES = {
    "word_length": (100, "word_chars", "n_words", 60, True),
    "symbol_rate": (10_000, "n_symbols", "n_words", 300, False),
    "dup_line_rate": (10_000, "n_dup_lines", "n_lines", 800, False),
    "repeat_rate": (10_000, "n_repeat_words", "n_words", 600, False),
    "upper_rate": (10_000, "n_upper", "word_chars", 300, False),
}
REACH = 3
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once per row."""
    return F.transform(F.array(value), body)[0]


def _taken_out(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows found more than once, each word once.

    Window hashes with the position in their low bits are sorted; neighbours with equal high bits
    are candidates, and these few are compared by their full hashes.
    """

    def full(w: Column, i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def beside(items: Column, same: Callable[[Column, Column], Column]) -> Column:
        """Items that are the same as the one before or the one after."""
        return F.filter(
            items,
            lambda x, j: F.coalesce(same(x, F.get(items, j - 1)), F.lit(False))
            | F.coalesce(same(x, F.get(items, j + 1)), F.lit(False)),
        )

    def count(w: Column) -> Column:
        # As many low bits as the position takes.
        low = F.pow(F.lit(2.0), F.length(F.bin(F.size(w).cast("bigint"))).cast("double"))
        return let(low.cast("bigint"), lambda space: windows(w, space))

    def windows(w: Column, space: Column) -> Column:
        def packed(i: Column) -> Column:
            return full(w, i).bitwiseAND(-space).bitwiseOR(i.cast("bigint"))

        at = F.sequence(F.lit(0), F.size(w) - 3)
        ordered = F.sort_array(F.transform(at, packed))
        return let(ordered, lambda s: marked(w, space, s))

    def marked(w: Column, space: Column, s: Column) -> Column:
        near = beside(s, lambda x, y: x.bitwiseAND(-space) == y.bitwiseAND(-space))
        found = F.transform(
            near,
            lambda x: F.struct(
                full(w, x.bitwiseAND(space - 1).cast("int")).alias("h"),
                x.bitwiseAND(space - 1).alias("at"),
            ),
        )
        return let(F.sort_array(found), covered)

    def covered(c: Column) -> Column:
        same = beside(c, lambda x, y: x["h"] == y["h"])
        return let(F.sort_array(F.transform(same, lambda x: x["at"])), union)

    def union(at: Column) -> Column:
        three = F.lit(3).cast("bigint")
        return F.aggregate(
            F.transform(at, lambda p, j: F.least(three, F.coalesce(F.get(at, j + 1) - p, three))),
            F.lit(0).cast("bigint"),
            lambda a, x: a + x,
        )

    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(let(words, count))


def base_counts(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """``keep`` and the counts of each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(body, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, r"[\x20\x09-\x0D]+")
    )
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    per_row = docs.select(
        *keep,
        F.length(F.translate(body, SPACES, "")).cast("bigint").alias("word_chars"),
        _taken_out(body, "#*$%&|<>").alias("n_symbols"),
        _taken_out(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("bigint").alias("n"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"),
            ),
        ).alias("lines"),
        let(
            words,
            lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeated_words(w).alias("rep")),
        ).alias("words"),
    )
    return per_row.select(
        *keep,
        F.col("words.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lines.dup").alias("n_dup_lines"),
        F.col("words.rep").alias("n_repeat_words"),
        "n_upper",
        F.col("lines.n").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rate(name: str) -> Column:
    scale, of, per, _, _ = RATES[name]
    return F.coalesce(F.expr(f"({scale}L * {of}) div nullif({per}, 0)"), F.lit(0).cast("bigint"))


def bucket(value: Column) -> Column:
    """The value with all but its seven leading bits set to zero."""
    bits = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    unit = F.pow(F.lit(2.0), bits.cast("double")).cast("bigint")
    return value - F.pmod(value, unit)


def sketches(counts: DataFrame, *group: str) -> DataFrame:
    """``group``, ``rate``, ``bucket``, ``n``: add ``n`` to merge."""
    each = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rate"), bucket(rate(r)).alias("bucket")) for r in RATES])
    )
    rows = counts.where(~base_failed()).select(*group, each.alias("x"))
    return rows.groupBy(*group, F.col("x.rate").alias("rate"), F.col("x.bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def fences(sketch: DataFrame, *group: str) -> DataFrame:
    """``group`` and ``<rate>_low``, ``<rate>_high`` for each rate."""
    own = Window.partitionBy(*group, "rate")
    up_to = F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketch.select("*", up_to.alias("rank"), F.sum("n").over(own).alias("total"))

    def quartile(k: int) -> Column:
        return F.min(F.when(4 * F.col("rank") >= k * F.col("total"), F.col("bucket")))

    quartiles = ranked.groupBy(*group, "rate").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    columns = []
    for name, (_, _, _, least, low_too) in RATES.items():
        reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        low = F.col("q1") - reach if low_too else F.lit(None).cast("bigint")
        own_rate = F.col("rate") == name
        columns += [
            F.max(F.when(own_rate, low)).alias(f"{name}_low"),
            F.max(F.when(own_rate, F.col("q3") + reach)).alias(f"{name}_high"),
        ]
    return quartiles.groupBy(*group).agg(*columns)


def apply_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept``, and ``reasons``: the rates beyond their fences."""
    named = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        F.col(text).alias("text"),
    )
    # Worked out once, then read twice: a few numbers per text.
    counts = shared(base_counts(named, "doc_id", "lang", "source"), "quality-counts")
    limits = fences(sketches(counts, "lang", "source"), "lang", "source")
    limits = limits.withColumnsRenamed({"lang": "lang__", "source": "source__"})
    same = F.col("lang").eqNullSafe(F.col("lang__")) & F.col("source").eqNullSafe(F.col("source__"))
    reasons = F.filter(
        F.array(
            *[
                F.when((rate(r) > F.col(f"{r}_high")) | (rate(r) < F.col(f"{r}_low")), F.lit(r))
                for r in RATES
            ]
        ),
        lambda x: x.isNotNull(),
    )
    out = counts.join(limits, same, "left").select(
        *counts.columns, base_failed().alias("base_failed"), reasons.alias("reasons")
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop("lang", "source")
