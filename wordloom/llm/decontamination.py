"""Benchmark decontamination by winnowing.

Words are stretches of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. Of
every ``width`` consecutive word k-grams the one with the smallest hash is kept, in texts and
in benchmark items alike. With ``gram + width - 1 <= window`` every shared span of ``window``
words holds a kept k-gram on both sides. A k-gram that both sides keep is extended on both of its
sides to the windows of the text that hold it; those that an item has too, word by word, are
contamination. Items with fewer words than a window are one window: they are looked up by the
hash of the whole item at every position. Work is linear in the text, however often a k-gram
repeats in it or in the items: a window is looked up once and stands for all items that hold it.

The benchmark is taken in blocks of bounded size. One block goes to the tasks as a broadcast, texts are
read where they lie, and nothing is shuffled. Of a benchmark of several blocks only a Bloom filter of
its k-grams (bounded, built by an aggregation) meets all texts; the different texts that pass it are written
once and meet the blocks one after the other, so a task never holds more than one block, and what is found
is joined back by the hash of the text (broadcast if measured small, else by a join that AQE splits).
Many identical items are looked up as one.

Defined results: null and empty texts have no words; an item without words occurs nowhere;
a null item id is kept as null in ``items``; repeated rows are marked row by row; an empty
benchmark marks nothing; an empty table of documents gives an empty one; very long texts are read
whole; k-grams that tie for the smallest hash are all kept; columns of the input named like the new
column are replaced, others are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.arrays import (
    BYTE_CODES, U64, mix, pieces, prefix_sums, sliding_min, stretch_hashes, utf8, word_spans,
)
from wordloom.llm.tables import broadcast_if_small, shared, without

WINDOW, GRAM, WIDTH = 13, 8, 6
#: Text of one benchmark block. Its hashes take a few times as much in each task.
BLOCK_BYTES = 4 << 20
FILTER_BITS = 22
#: Largest Bloom filter of a benchmark of several blocks, as a power of two of bits: 16 MB.
SIEVE_BITS = 27
#: Pairs of a text and an item that are made at a time.
PAIRS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _kind(item_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", SPANS),
            T.StructField("items", T.ArrayType(item_type)),
        ]
    )


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the number of words before each text."""
    low = _LOWER[data]
    starts, ends, firsts = word_spans(_IS_WORD[low], offsets)
    return stretch_hashes(prefix_sums(BYTE_CODES[low]), starts, ends), firsts


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of ``size`` words, also of those that run over a text's end."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    out = words[:n].copy()
    for j in range(1, size):
        out *= U64(0x100000001B3)
        out += words[j : j + n]
    return mix(out)


def within(firsts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of the first ``n`` stretches of ``size`` words lie in one text."""
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    return text[:n] == text[size - 1 : size - 1 + n]


def winnow(words: np.ndarray, firsts: np.ndarray, gram: int = GRAM, width: int = WIDTH):
    """Positions and hashes of the k-grams that are the minimum of some window (all, if tied)."""
    hashes = gram_hashes(words, gram)
    least = sliding_min(hashes, width)
    kept = np.zeros(len(hashes), bool)
    if len(least):
        whole = within(firsts, len(least), gram + width - 1)
        for d in range(width):
            kept[d : d + len(least)] |= (hashes[d : d + len(least)] == least) & whole
    at = np.flatnonzero(kept)
    return at, hashes[at]


def hashes_at(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """``gram_hashes`` of the stretches that begin at ``starts``."""
    out = words[starts]
    for j in range(1, size):
        out = out * U64(0x100000001B3) + words[starts + j]
    return mix(out)


class _Known:
    """Different hashes in order, behind a bitmap that turns most others away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(self.hashes >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``hashes`` that are known, and their places."""
        maybe = np.flatnonzero(self.bits[(hashes >> U64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return maybe[:0], maybe[:0]
        place = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        same = self.hashes[place] == hashes[maybe]
        return maybe[same], place[same]


class _Windows:
    """The different windows of one length: where the block has them, and which items hold them."""

    def __init__(self, size: int, words: np.ndarray, starts: np.ndarray, item: np.ndarray):
        self.size = size
        hashes = hashes_at(words, starts, size)
        self.known = _Known(hashes)
        place = np.searchsorted(self.known.hashes, hashes)
        self.at = np.zeros(len(self.known.hashes), np.int64)
        self.at[place] = starts
        pairs = np.unique(np.stack([place, item]), axis=1)
        self.items = pairs[1]
        self.firsts = np.searchsorted(pairs[0], np.arange(len(self.known.hashes) + 1))

    def find(self, words: np.ndarray, starts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``starts`` where ``words`` have a known window, and its place; ``own`` are the block's words."""
        found, place = self.known.find(hashes_at(words, starts, self.size))
        starts = starts[found]
        same = np.ones(len(starts), bool)
        for j in range(self.size):
            same &= words[starts + j] == own[self.at[place] + j]
        return starts[same], place[same]

    def expand(self, text: np.ndarray, place: np.ndarray, n_items: int) -> np.ndarray:
        """``text * n_items + item`` of all items with these windows, each once; not many are made at a time."""
        pairs = np.unique(text * len(self.at) + place)
        text, place = pairs // len(self.at), pairs % len(self.at)
        low, counts = self.firsts[place], np.diff(self.firsts)[place]
        ends, out, a = np.cumsum(counts), np.zeros(0, np.int64), 0
        while a < len(pairs):
            before = ends[a] - counts[a]
            b = max(a + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            n = counts[a:b]
            at = np.repeat(low[a:b], n) + np.arange(n.sum()) - np.repeat(ends[a:b] - n - before, n)
            out = np.union1d(out, np.repeat(text[a:b], n) * n_items + self.items[at])
            a = b
        return out


class _Block:
    """The items of one block: their words, kept k-grams of long ones, and all their windows by length."""

    def __init__(self, ids: list, texts: pa.Array, window: int, gram: int, width: int):
        self.window, self.gram, self.width = window, gram, width
        self.ids: list[list] = []
        known: dict[bytes, int] = {}
        all_words, grams, n_words = [np.zeros(0, U64)], [np.zeros(0, U64)], 0
        starts: dict[int, list[np.ndarray]] = {}
        items: dict[int, list[np.ndarray]] = {}
        for row, (rows, data, offsets) in ((r.start, (r, d, o)) for r, d, o in pieces(texts)):
            words, firsts = word_hashes(data, offsets)
            for k in range(rows.stop - rows.start):
                own = words[firsts[k] : firsts[k + 1]]
                if not len(own):
                    continue
                item = known.setdefault(own.tobytes(), len(self.ids))
                if item < len(self.ids):
                    self.ids[item].append(ids[row + k])
                    continue
                self.ids.append([ids[row + k]])
                size = min(window, len(own))
                starts.setdefault(size, []).append(n_words + np.arange(len(own) - size + 1))
                items.setdefault(size, []).append(np.full(len(own) - size + 1, item))
                if size == window:
                    grams.append(winnow(own, np.array([0, len(own)]), gram, width)[1])
                all_words.append(own)
                n_words += len(own)
        self.words = np.concatenate(all_words)
        self.grams = _Known(np.concatenate(grams))
        self.windows = [
            _Windows(n, self.words, np.concatenate(starts[n]), np.concatenate(items[n])) for n in sorted(starts)
        ]

    def starts(self, words: np.ndarray, firsts: np.ndarray, size: int) -> np.ndarray:
        """Where a window of ``size`` words may begin that the block has too."""
        if size < self.window:
            return np.flatnonzero(within(firsts, max(0, len(words) - size + 1), size))
        at, hashes = winnow(words, firsts, self.gram, self.width)
        at = at[self.grams.find(hashes)[0]]
        text = np.searchsorted(firsts, at, "right") - 1
        around = at[:, None] - np.arange(size - self.gram + 1)
        inside = (around >= firsts[text][:, None]) & (around + size <= firsts[text + 1][:, None])
        return np.unique(around[inside])

    def hits(self, words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and ends of the merged shared spans (counted in ``words``), and ``text * items + item``."""
        begins, ends, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(0, np.int64)
        for windows in self.windows:
            starts = self.starts(words, firsts, windows.size)
            if len(starts):
                starts, place = windows.find(words, starts, self.words)
                text = np.searchsorted(firsts, starts, "right") - 1
                pairs = np.union1d(pairs, windows.expand(text, place, len(self.ids)))
                begins.append(starts)
                ends.append(starts + windows.size)
        return *merged(np.concatenate(begins), np.concatenate(ends), firsts), pairs


def merged(begins: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch as one, none over a text's end."""
    if not len(begins):
        return begins, ends
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    text = np.searchsorted(firsts, begins, "right")
    new = np.concatenate([[True], (begins[1:] > ends[:-1]) | (text[1:] != text[:-1])])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(begins) - 1]])
    return begins[new], ends[last]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def mark_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    into: str = "contamination",
    window: int = WINDOW,
    gram: int = GRAM,
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns and ``into``: number of words, merged hit spans (in words), ids of the items found."""
    if gram + width - 1 > window:
        raise ValueError("gram + width - 1 must not exceed the window, or shared spans are missed")
    items = items.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("text"))
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(n_bytes / block_bytes))
    kind = _kind(items.schema["id"].dataType)
    sizes = (window, gram, width)
    docs = without(docs, into)
    if blocks == 1:
        return _marked(docs, items, text, into, kind, sizes)

    suspects = _suspects(docs.select(F.col(text).cast("string").alias("text")), items, n_bytes, sizes)
    suspects = suspects.withColumn("key", F.sha2("text", 256)).dropDuplicates(["key"])
    found = shared(suspects, "suspects").withColumn("found", F.lit(None).cast(kind))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        # Written before the next block is sent, so that no stage and no task holds two of them.
        found = shared(_marked(found, own, "text", "found", kind, sizes), "suspects")
    found = found.where(F.size("found.spans") > 0).select(
        F.col("key").alias("key__"), F.col("found.spans").alias("spans__"), F.col("found.items").alias("items__"))
    plain = _marked(docs, items.limit(0), text, into, kind, sizes)
    # Under the names of the input's own columns nothing of the other side is looked up.
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    whole = F.struct(
        F.col(f"d.`{into}`")["n_words"].alias("n_words"),
        F.coalesce(F.col("f.spans__"), F.col(f"d.`{into}`")["spans"]).alias("spans"),
        F.coalesce(F.col("f.items__"), F.col(f"d.`{into}`")["items"]).alias("items"),
    )
    same = F.sha2(F.col(f"d.`{text}`").cast("string"), 256) == F.col("f.key__")
    joined = plain.alias("d").join(broadcast_if_small(shared(found, "found")).alias("f"), same, "left")
    return joined.select(*columns, whole.cast(kind).alias(into))


def _marked(docs: DataFrame, items: DataFrame, text: str, into: str, kind: T.StructType, sizes) -> DataFrame:
    """``into`` of all rows with what one block of items adds; rows that have none yet start with nothing."""
    own = items.toArrow()
    block = _Block(own["id"].to_pylist(), utf8(own["text"].combine_chunks()), *sizes)
    sent = docs.sparkSession.sparkContext.broadcast(block)
    if into not in docs.columns:
        docs = docs.withColumn(into, F.lit(None).cast(kind))
    return docs.mapInArrow(_marker(sent, text, into), docs.schema)


def _suspects(texts: DataFrame, items: DataFrame, n_bytes: int, sizes: tuple[int, int, int]) -> DataFrame:
    """The texts that hold a hash which some item may have: all that are contaminated, and few others."""
    window, gram, width = sizes
    bits = min(SIEVE_BITS, max(FILTER_BITS, 2 + int(n_bytes).bit_length()))

    def item_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in pieces(utf8(batch.column(0))):
                words, firsts = word_hashes(data, offsets)
                n = np.diff(firsts)
                found = {0: [winnow(words, firsts, gram, width)[1]]}
                for size in range(1, window):
                    found[size] = [hashes_at(words, firsts[:-1][n == size], size)] if (n == size).any() else []
                for size, hashes in found.items():
                    places = np.unique(np.concatenate([np.zeros(0, U64), *hashes]) >> U64(64 - bits)).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({
                        "size": np.full(len(places), size, np.int32),
                        "slot": places >> 6,
                        "bits": np.left_shift(np.int64(1), places & 63),
                    })

    slots = items.select("text").mapInArrow(item_hashes, "size int, slot long, bits long")
    held = slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    sieve = np.zeros(1 << (bits - 6), np.int64)
    sieve[held["slot"].to_numpy()] = held["bits"].to_numpy()
    short = sorted(r["size"] for r in slots.select("size").where("size > 0").distinct().collect())  # 12 at most
    sent = texts.sparkSession.sparkContext.broadcast((sieve, short))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, short = sent.value
        for batch in batches:
            passed = np.zeros(len(batch), bool)
            for rows, data, offsets in pieces(utf8(batch.column(0))):
                words, firsts = word_hashes(data, offsets)
                at, hashes = winnow(words, firsts, gram, width)
                tests = [(at, hashes)]
                for size in short:
                    hashes = gram_hashes(words, size)
                    whole = np.flatnonzero(within(firsts, len(hashes), size))
                    tests.append((whole, hashes[whole]))
                for at, hashes in tests:
                    places = (hashes >> U64(64 - bits)).astype(np.int64)
                    held = (sieve[places >> 6] >> (places & 63)) & 1
                    passed[rows.start + np.searchsorted(firsts, at[held == 1], "right") - 1] = True
            yield batch.filter(pa.array(passed))

    return texts.where(F.col("text").isNotNull()).mapInArrow(passing, texts.schema)


def _marker(sent, text: str, into: str):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = sent.value
        for batch in batches:
            at = batch.schema.get_field_index(into)
            kind = batch.column(at).type
            before = batch.column(at).to_pylist()
            spans = [list(x["spans"]) if x else [] for x in before]
            items = [list(x["items"]) if x else [] for x in before]
            n_words = np.zeros(len(batch), np.int64)
            new = set()
            for rows, data, offsets in pieces(utf8(batch.column(batch.schema.get_field_index(text)))):
                words, firsts = word_hashes(data, offsets)
                n_words[rows] = np.diff(firsts)
                begins, ends, pairs = block.hits(words, firsts)
                owner = np.searchsorted(firsts, begins, "right") - 1
                low = firsts[owner]
                for row, a, b in zip(owner.tolist(), (begins - low).tolist(), (ends - low).tolist(), strict=True):
                    spans[rows.start + row].append({"start": a, "end": b})
                    new.add(rows.start + row)
                for pair in pairs.tolist():
                    items[rows.start + pair // len(block.ids)].extend(block.ids[pair % len(block.ids)])
            for k in new:
                own = _merged([(x["start"], x["end"]) for x in spans[k]])
                spans[k] = [{"start": a, "end": b} for a, b in own]
                items[k] = sorted(set(items[k]), key=lambda x: (x is None, x))
            column = pa.StructArray.from_arrays(
                [
                    pa.array(n_words),
                    pa.array(spans, kind.field("spans").type),
                    pa.array(items, kind.field("items").type),
                ],
                fields=[kind.field(k) for k in range(3)],
            )
            columns = batch.columns
            columns[at] = column
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return mark


def _n_hit(into: str):
    return F.aggregate(
        F.col(into)["spans"], F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]
    )


def _verdict(into: str, share: int):
    return (_n_hit(into) > 0) & (F.lit(share) * _n_hit(into) >= F.col(into)["n_words"])


def summary(marked: DataFrame, *keep: str, into: str = "contamination", share: int = 20) -> DataFrame:
    """``keep`` and the digest: counts, hash of the items, verdict (a ``share``-th of the words hit)."""
    found = F.transform(F.col(into)["items"], lambda i: F.coalesce(i.cast("string"), F.lit("null")))
    ids = F.array_sort(found)
    return marked.select(
        *keep,
        F.col(into)["n_words"].alias("n_words"),
        _n_hit(into).alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        _verdict(into, share).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, share: int = 20, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    into = "contamination__"
    marked = mark_contaminated(docs, items, into=into, **options)
    return marked.where(~_verdict(into, share)).select(*docs.columns)
