"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: each slot is a bitmask with a bit per
language, and the AND of an n-gram's slots is the set of languages that contain it. A text's
n-grams are looked up at once; the bits are counted per language, and each count is
corrected by the false positives its filter gives at its fill. The largest count decides.

An n-gram is four bytes of the lower-cased text, the second of them part of a letter; ASCII bytes that are
no letters read as spaces. A language contains an n-gram that is in at least ``min_share``
of its training texts, and in at least ``relative`` times the share that another language
has, so stray foreign lines do not enter its filter.

Copies of a text in a language are one training text. Learning takes about ``max_rows`` of them, chosen by a
hash of the text, counts n-grams on the executors and
brings the filter, whose size is fixed, to the driver. Prediction reads texts where they lie:
no shuffle. Only text and label are learned from, only text is predicted from.

Defined results: a text that is null or has no letter is ``und`` with score 0; letters that no filter
knows give the most frequent training language with score 0; ties go to the language first
in order; rows without a label are not learned from; with nothing to learn from all
is ``und``. Repeated rows are learned from once and predicted each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.arrays import BASE, U64, mix, pieces, utf8
from wordloom.llm.tables import broadcast_if_small, shared

SLOT_BITS, HASHES = 20, 3
MAX_ROWS = 50_000
MIN_SHARE, RELATIVE = 0.001, 0.2
WORD = 62  # languages per 64-bit number of a mask, clear of the sign

_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128] = 32
_LETTER[97:123] = np.arange(97, 123)


@dataclass
class LanguageFilter:
    """``slots[w][s]``: bitmask w of slot s; ``fill``: share of slots set, per language."""

    languages: list[str]
    slots: list[np.ndarray]
    fill: np.ndarray
    usual: int


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of padded texts, and the n-grams before each text."""
    low = _LETTER[data]
    if len(low) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(low[1:-2] != 32)
    codes = np.ndarray((len(low) - 3,), "<u4", low, 0, (1,))[at]
    return codes, np.searchsorted(at, offsets)


def slots_of(codes: np.ndarray) -> list[np.ndarray]:
    hashed = mix(codes.astype(U64) * U64(BASE) + U64(BASE))
    space = U64((1 << SLOT_BITS) - 1)
    return [((hashed >> U64(k * (SLOT_BITS + 1))) & space).astype(np.int64) for k in range(HASHES)]


def _padded(column: pa.Array) -> pa.Array:
    return utf8(column, lower=True, pad=(b" ", b"   "))


def _gram_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``docs``: the number of texts of a language that hold the n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_numpy()
            for rows, data, offsets in pieces(_padded(batch.column(1))):
                codes, firsts = grams(data, offsets)
                text = np.repeat(np.arange(len(firsts) - 1, dtype=U64), np.diff(firsts))
                each = np.unique((text << U64(32)) | codes)
                of = lang[rows][(each >> U64(32)).astype(np.int64)].astype(U64)
                keys, docs = np.unique((of << U64(32)) | (each & U64(0xFFFFFFFF)), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((keys >> U64(32)).astype(np.int32)),
                        pa.array((keys & U64(0xFFFFFFFF)).astype(np.int64)),
                        pa.array(docs),
                    ],
                    names=["lang", "gram", "docs"],
                )

    counted = texts.select("lang", "text").mapInArrow(run, "lang int, gram long, docs long")
    return counted.groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))


def _filter_slots(contained: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot in slots_of(batch.column(0).to_numpy().astype(U64)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot.astype(np.int32)), batch.column(1), batch.column(2)],
                    names=["slot", "word", "mask"],
                )

    rows = contained.mapInArrow(run, "slot int, word int, mask long")
    return rows.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))


def learn(
    labelled: DataFrame, lang: str = "lang", text: str = "text", max_rows: int = MAX_ROWS,
    min_share: float = MIN_SHARE, relative: float = RELATIVE,
) -> LanguageFilter:
    """The filter of all languages; ``max_rows`` bounds the expected number of different texts learned from."""
    rows = labelled.select(F.col(lang).cast("string").alias("name"), F.col(text).alias("text"))
    rows = rows.where("name is not null and text is not null")
    key = ["name", "draw", "hash"]
    rows = rows.withColumns({"draw": F.xxhash64("text", F.lit("learn")), "hash": F.xxhash64("text")})
    different = shared(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "training-texts")
    share = min(1.0, max_rows / max(different.count(), 1))
    if share < 1:
        drawn = F.pmod(F.col("draw"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))
        rows, different = rows.where(drawn), different.where(drawn)
    # Only texts that come again are moved, to be folded; of the sample they are at most some max_rows keys.
    again = broadcast_if_small(shared(different.where("n > 1").select(*key), "repeated-texts"))
    once = rows.join(again, key, "left_semi").dropDuplicates(key)
    rows = rows.join(again, key, "left_anti").unionByName(once)
    sizes = {r["name"]: r["n"] for r in different.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    slots = [np.zeros(1 << SLOT_BITS, np.int64) for _ in range(-(-len(names) // WORD))]
    if not names:
        return LanguageFilter([], slots, np.zeros(0), 0)
    number = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)])
    size = F.array(*[F.lit(float(sizes[n])) for n in names])
    counts = _gram_counts(rows.select(number[F.col("name")].alias("lang"), "text"))
    held = F.struct("lang", (F.col("docs") / F.get(size, F.col("lang"))).alias("share"))
    per_gram = counts.groupBy("gram").agg(F.collect_list(held).alias("held"), F.max(held["share"]).alias("most"))
    kept = F.filter("held", lambda x: (x["share"] >= min_share) & (x["share"] >= relative * F.col("most")))

    def mask(w: int):
        own = F.filter(kept, lambda x: F.floor(x["lang"] / WORD) == w)
        one = F.lit(1).cast("bigint")
        bits = F.transform(own, lambda x: F.call_function("shiftleft", one, x["lang"] % WORD))
        both = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
        return F.struct(F.lit(w).alias("word"), both.alias("mask"))

    masks = [mask(w) for w in range(len(slots))]
    contained = per_gram.select("gram", F.explode(F.array(*masks)).alias("m")).select("gram", "m.word", "m.mask")
    found = _filter_slots(contained.where("mask <> 0")).toArrow()
    at, word, mask = (found[k].to_numpy() for k in ("slot", "word", "mask"))
    for w, own in enumerate(slots):
        own[at[word == w]] = mask[word == w]
    fill = np.array([((slots[k // WORD] >> (k % WORD)) & 1).mean() for k in range(len(names))])
    small = [s.astype(np.uint8) if len(names) <= 8 else s for s in slots]
    return LanguageFilter(names, small, fill, names.index(max(names, key=lambda n: (sizes[n], n))))


def text_scores(model: LanguageFilter, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected share of each text's n-grams in each language, and whether it has letters' bytes."""
    codes, firsts = grams(data, offsets)
    n = np.diff(firsts)
    shares = np.zeros((len(n), len(model.languages)))
    at = slots_of(codes)
    for w, own in enumerate(model.slots):
        mask = own[at[0]]
        for more in at[1:]:
            mask &= own[more]
        for k in range(w * WORD, min(len(model.languages), (w + 1) * WORD)):
            bit = (mask >> mask.dtype.type(k % WORD)) & mask.dtype.type(1)
            sums = np.zeros(len(bit) + 1, np.int64)
            np.cumsum(bit, out=sums[1:])
            found = sums[firsts[1:]] - sums[firsts[:-1]]
            false = model.fill[k] ** HASHES
            shares[:, k] = np.maximum(0, found - false * n) / (max(1 - false, 1e-9) * np.maximum(n, 1))
    return np.minimum(shares, 1), n > 0


def predict(
    docs: DataFrame, model: LanguageFilter, text: str = "text", pred: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """All columns of ``docs`` but for ones named like the two new ones: language and score."""
    taken = {pred.lower(), score.lower()}
    own = docs.select(*[c for c in docs.columns if c.lower() not in taken])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            best = np.full(len(batch), len(names) - 1)
            scores = np.zeros(len(batch))
            for rows, data, offsets in pieces(_padded(column)):
                if not model.languages:
                    break
                shares, some = text_scores(model, data, offsets)
                own = shares.argmax(axis=1)
                top = shares[np.arange(len(own)), own]
                own[top == 0] = model.usual
                ascii_letter = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
                plain = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                for k in np.flatnonzero(some & ~plain):  # letters of other scripts, or other signs
                    some[k] = any(c.isalpha() for c in column[rows.start + int(k)].as_py())
                best[rows] = np.where(some, own, len(names) - 1)
                scores[rows] = np.where(some, top, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(scores)],
                names=[*batch.schema.names, pred, score],
            )

    schema = T.StructType([*own.schema.fields]).add(pred, "string").add(score, "double")
    return own.mapInArrow(run, schema)
