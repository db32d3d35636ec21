"""Suffix-array dedup of repeated byte strings.

Texts are UTF-8 bytes in the order of their ids. A byte is removed if it lies in a string of ``length``
bytes that also starts earlier: in a text before, or earlier in the same one.

Sharding. Every string of ``length`` bytes has a minimizer, its gram of ``GRAM`` bytes with the
smallest hash (the first one, if tied); neighbouring strings mostly share it. A text is cut into
stretches of strings with one minimizer, and equal strings lie in stretches under equal
minimizers. So texts shard by minimizer, and no string has to be looked for in two shards.
Equal stretches fold into their earliest one before they move; later ones are repeats as they stand. A
minimizer with one stretch is done. What is left, different stretches under one minimizer, goes to
the shards with its bytes.

A shard's stretches are sorted by induced sorting (SA-IS): suffixes are classed as S or L, leftmost S
suffixes are put in order by induction and named, the string of names is sorted by recursion, and the whole
array is induced from them in two linear sweeps, bucket by bucket. Permuted common prefixes follow
from the irreducible ones. Neighbours with a common prefix of ``length`` bytes or more hold
the same string; all but the earliest start of each such class are repeats.

Defined results: null is an empty text; texts shorter than ``length`` are kept; rows with equal ids, or
without one, go in order of their text's hash, null ids first; rows that repeat another
in id and text are one text: it is looked through once and what is found holds for each of them, so a row's
repetition takes nothing from it; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.arrays import (
    BASE, BYTE_CODES, U64, mix, pieces, prefix_sums, sliding_min, stretch_hashes, utf8,
)
from wordloom.llm.tables import shared

LENGTH, GRAM = 100, 32
#: Bytes of a shard's string; a shard is one call of the sorter.
SHARD_BYTES = 2 << 20
#: A minimizer with more different stretches is cut into its single strings.
HOT = 10_000


# -- sorting ----------------------------------------------------------------------

#: Suffixes a bucket has on average, below which a sweep by buckets costs more than one by suffixes.
FEW = 256


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return ends - sizes, ends


class _Sorter:
    """Induced sorting of one string whose last symbol is smaller than all others and occurs once."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.s, self.n = s, len(s)
        step = np.sign(np.diff(s.astype(np.int64)))
        # The class of a suffix is that of the next different symbol's direction.
        at = np.flatnonzero(step)
        following = np.searchsorted(at, np.arange(self.n - 1))
        self.is_s = np.ones(self.n, bool)
        self.is_s[:-1] = step[at[following]] > 0
        self.lms = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1
        self.sizes = np.bincount(s, minlength=symbols)
        self.starts, self.ends = _spread(self.sizes)
        #: 16-bit symbols are sorted by radix.
        self.keys = s.astype(np.uint16) if symbols <= 1 << 16 else s

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """The suffix array from leftmost S suffixes in this order."""
        if self.n < FEW * np.count_nonzero(self.sizes):
            return self._induce_singly(lms)
        array = np.full(self.n, -1, np.int64)
        own = self.s[lms]
        ordered = lms[np.argsort(own, kind="stable")]
        low, high = _spread(np.bincount(own, minlength=len(self.sizes)))
        # L suffixes, bucket by bucket from the left: a bucket's L part is filled by then, but for what
        # runs of its own symbol add, round by round.
        l_fill = self.starts.copy()
        used = np.flatnonzero(self.sizes)
        for c in used:
            done = self.starts[c]
            while done < l_fill[c]:
                upto = l_fill[c]
                self._push(array[done:upto], array, l_fill, False)
                done = upto
            self._push(ordered[low[c] : high[c]], array, l_fill, False)
        # S suffixes, from the right; the places of L suffixes stay.
        s_fill = self.ends.copy()
        for c in used[::-1]:
            done = self.ends[c]
            while done > s_fill[c]:
                upto = s_fill[c]
                self._push(array[upto:done][::-1], array, s_fill, True)
                done = upto
            self._push(array[self.starts[c] : l_fill[c]][::-1], array, s_fill, True)
        array[0] = self.n - 1
        return array

    def _induce_singly(self, lms: np.ndarray) -> np.ndarray:
        """The same, one suffix after the other: cheaper where a bucket holds a handful of them."""
        s, is_s, array = self.s.tolist(), self.is_s.tolist(), [-1] * self.n
        fill = self.ends.tolist()
        for i in reversed(lms.tolist()):
            fill[s[i]] -= 1
            array[fill[s[i]]] = i
        fill = self.starts.tolist()
        for k in range(self.n):
            i = array[k] - 1
            if i >= 0 and not is_s[i]:
                array[fill[s[i]]] = i
                fill[s[i]] += 1
        fill = self.ends.tolist()
        for k in range(self.n - 1, -1, -1):
            i = array[k] - 1
            if i >= 0 and is_s[i]:
                fill[s[i]] -= 1
                array[fill[s[i]]] = i
        array[0] = self.n - 1
        return np.array(array, np.int64)

    def _push(self, suffixes: np.ndarray, array: np.ndarray, fill: np.ndarray, want_s: bool) -> None:
        """Put what comes before these suffixes, if of the class wanted, next in its bucket."""
        before = suffixes - 1
        before = before[before >= 0]
        before = before[self.is_s[before] == want_s]
        if not len(before):
            return
        symbol = self.keys[before]
        order = np.argsort(symbol, kind="stable")
        symbol, before = symbol[order], before[order]
        firsts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        sizes = np.diff(np.concatenate([firsts, [len(symbol)]]))
        rank = np.arange(len(symbol)) - np.repeat(firsts, sizes)
        if want_s:
            array[fill[symbol] - 1 - rank] = before
            fill[symbol[firsts]] -= sizes
        else:
            array[fill[symbol] + rank] = before
            fill[symbol[firsts]] += sizes


def _doubling(s: np.ndarray) -> np.ndarray:
    """Suffix array by ranks of doubled length: the end of the recursion, where buckets are tiny."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        key = (rank + 1) * (len(s) + 2)
        key[:-width or None] += rank[width:] + 1 if width < len(s) else 0
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty_like(fresh)
        rank[order] = fresh
        if fresh[-1] == len(s) - 1:
            return order
        width *= 2


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of symbols 0 .. ``symbols`` - 1; the last symbol must be a 0 that is the only one."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1].copy()
    if 8 * symbols > n:  # hardly more rows than buckets: a sweep by buckets has nothing to sweep
        return _doubling(s)
    sorter = _Sorter(s, symbols)
    lms = sorter.lms
    if len(lms) < 2:
        return sorter.induce(lms)
    # Order the leftmost S substrings by induction, and name equal ones alike.
    rough = sorter.induce(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    after = np.full(n + 1, n - 1)
    after[lms[:-1]] = lms[1:]
    lengths = after[ordered] - ordered + 1
    lengths[ordered == n - 1] = 1
    sums = prefix_sums(mix((s + 1).astype(U64) * U64(BASE)))
    hashes = stretch_hashes(sums, ordered, np.minimum(ordered + lengths, n))
    new = np.concatenate([[0], np.cumsum((hashes[1:] != hashes[:-1]) | (lengths[1:] != lengths[:-1]))])
    names = np.empty(n, np.int64)
    names[ordered] = new
    reduced = names[lms]
    if new[-1] + 1 == len(lms):
        order = np.empty(len(lms), np.int64)
        order[reduced] = np.arange(len(lms))
    else:
        order = suffix_array(reduced, int(new[-1]) + 1)
    return sorter.induce(lms[order])


def permuted_common_prefixes(s: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: the suffix before it in order (-1: none) and the length of their common prefix.

    Where the symbols before both are equal, the length is one less than at the position before; only
    the other, irreducible ones are compared, all at once, in growing steps.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    i = np.arange(n)
    reducible = (before > 0) & (i > 0)
    reducible[1:] &= s[i[:-1]] == s[before[1:] - 1]
    at = np.flatnonzero(~reducible & (before >= 0))
    common = np.zeros(n, np.int64)
    a, b, own = at.copy(), before[at], at
    padded = np.concatenate([s, np.zeros(1, s.dtype)])
    while len(own):
        inside = np.maximum(a, b) < n
        equal = inside & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
        own, a, b = own[equal], a[equal] + 1, b[equal] + 1
        common[own] += 1
    base = np.where(reducible, np.iinfo(np.int64).min, common + i)
    base[before < 0] = i[before < 0]
    return before, np.maximum.accumulate(base) - i


def repeats(
    parts: list[np.ndarray], starts: np.ndarray, length: int = LENGTH
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal strings in a shard.

    ``starts`` is how many strings of ``length`` bytes begin in each part; a part is ``length`` - 1 bytes longer.
    Returns, for every such string: its part, its place in the part, and a number that equal strings share.
    """
    sizes = np.array([len(p) for p in parts])
    s = np.zeros(sizes.sum() + 1, np.int64)
    s[:-1] = np.concatenate(parts)
    s[:-1] += 1
    array = suffix_array(s, 257)
    _, common = permuted_common_prefixes(s, array)
    classes = np.empty(len(s), np.int64)
    classes[array] = np.cumsum(common[array] < length)
    part = np.repeat(np.arange(len(parts)), starts)
    place = np.arange(len(part)) - np.repeat(np.cumsum(starts) - starts, starts)
    return part, place, classes[(np.cumsum(sizes) - sizes)[part] + place]


# -- stretches --------------------------------------------------------------------


def stretches(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Text, first start, number of starts, minimizer and hash of the bytes of every stretch."""
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64), none.astype(U64)
    codes = BYTE_CODES[data]
    hashes, width = codes, 1
    while width < gram:
        hashes = hashes[:-width] * U64(2 * width + BASE % 2**40) + hashes[width:]
        width *= 2
    hashes = mix(hashes)
    low = U64(0xFFFFFFFF)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=U64)  # the first of equal ones is the least
    at = (sliding_min(keys, length - gram + 1) & low).astype(np.int64)
    valid = np.ones(n, bool)
    over = (offsets[1:-1, None] - np.arange(1, length)).ravel()  # strings that run over a text's end
    valid[over[(over >= 0) & (over < n)]] = False
    own = np.flatnonzero(valid)
    if not len(own):
        return stretches(data[:0], offsets[:1])
    turn = (at[own[1:]] != at[own[:-1]]) | (own[1:] != own[:-1] + 1)
    first = own[np.concatenate([[True], turn])]
    count = own[np.concatenate([turn, [True]])] - first + 1
    text = np.searchsorted(offsets, first, "right") - 1
    return text, first, count, hashes[at[first]], stretch_hashes(prefix_sums(codes), first, first + count + length - 1)


ROW = "later boolean, minimizer long, stretch long, id long, tie long, at int, n int"
_ROW = pa.schema(
    [("later", pa.bool_()), ("minimizer", pa.int64()), ("stretch", pa.int64()), ("id", pa.int64()),
     ("tie", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]
)


def _cut(length: int, gram: int):
    """Stretches of the texts; of equal ones in a batch all but the earliest are marked as later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for rows, data, offsets in pieces(utf8(batch.column(2))):
                text, first, count, minimizer, stretch = stretches(data, offsets, length, gram)
                row = text + rows.start
                found.append((minimizer.view(np.int64), stretch.view(np.int64), ids[row], ties[row],
                              (first - offsets[text]).astype(np.int32), count.astype(np.int32)))
            if not found:
                continue
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            key = columns[0].view(U64) * U64(BASE) + columns[1].view(U64)
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            later = np.zeros(len(key), bool)
            if len(twice):
                m, h, i, t, a = (c[twice] for c in columns[:5])
                twice = twice[np.lexsort((a, t, i, h, m))]
                m, h = columns[0][twice], columns[1][twice]
                later[twice[1:]] = (m[1:] == m[:-1]) & (h[1:] == h[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(later), *map(pa.array, columns)], schema=_ROW)

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted stretches: later copies, and first ones under a minimizer that has several.

    Whatever the size of a group, one row is held at most: a first one that may yet be alone.
    """
    held = pa.RecordBatch.from_pylist([], schema=_ROW)
    minimizer = stretch = None
    several = False
    for batch in batches:
        known = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), bool)
        if known.any():
            yield batch.filter(pa.array(known))
        batch = batch.filter(pa.array(~known))
        if not len(batch):
            continue
        m, h = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        group = np.concatenate([[minimizer is None or m[0] != minimizer], m[1:] != m[:-1]])
        fresh = group | np.concatenate([[stretch is None or h[0] != stretch], h[1:] != h[:-1]])
        number = np.cumsum(group)  # 0: the group that the batch before ended with
        firsts = np.bincount(number[fresh], minlength=number[-1] + 1)
        firsts[0] += 2 if several else len(held)
        if firsts[0] > 1 or number[-1] > 0:
            if len(held) and firsts[0] > 1:
                yield held
            held = held.slice(0, 0)
        shard = fresh & (firsts[number] > 1)
        yield batch.filter(pa.array(shard))
        copies = batch.filter(pa.array(~fresh))
        yield copies.set_column(0, "later", pa.array(np.ones(len(copies), bool)))
        minimizer, stretch, several = m[-1], h[-1], bool(firsts[number[-1]] > 1)
        alone = np.flatnonzero(fresh & (number == number[-1]) & (firsts[number] == 1))
        if len(alone):
            held = batch.slice(int(alone[-1]), 1)
        if several:
            held = held.slice(0, 0)


# -- shards -----------------------------------------------------------------------


def _with_bytes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, texts = batch.column(0), batch.column(1), utf8(batch.column(2))
            cuts = batch.column(3)
            counts = np.diff(np.asarray(cuts.offsets))
            flat = cuts.flatten()
            minimizer, at, n = (flat.field(k).to_numpy() for k in range(3))
            row = np.repeat(np.arange(len(batch)), counts)
            low = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)[row] + at
            body = texts.buffers()[2]
            step = 20_000
            for k in range(0, len(row), step):
                own = slice(k, k + step)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(minimizer[own]), ids.take(pa.array(row[own])), ties.take(pa.array(row[own])),
                        pa.array(at[own]), pa.array(n[own]),
                        pa.array([body[a : a + c + length - 1].to_pybytes()
                                  for a, c in zip(low[own].tolist(), n[own].tolist(), strict=True)], pa.binary()),
                    ],
                    names=["minimizer", "id", "tie", "at", "n", "bytes"],
                )

    return run


FOUND = "first boolean, a long, b long, id long, tie long, at int, n int"


def _sort_shards(length: int, shard_bytes: int):
    """Repeated starts of each shard; of shards that are part of a hot minimizer also what is first there."""

    def work(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        ids, ties, at, n, hot = (table[k].to_numpy() for k in ("id", "tie", "at", "n", "blocks"))
        parts = [np.frombuffer(b, np.uint8) for b in table["bytes"].to_pylist()]
        part, place, classes = repeats(parts, n, length)
        start = at[part] + place
        order = np.lexsort((start, ties[part], ids[part], classes))
        first = np.ones(len(order), bool)
        first[1:] = classes[order][1:] != classes[order][:-1]
        heads = np.sort(order[first & (hot[part[order]] > 1)])
        again = np.sort(order[~first])
        for own, is_first in ((again, False), (heads, True)):
            if not len(own):
                continue
            a = b = np.zeros(len(own), np.int64)
            size = np.ones(len(own), np.int32)
            if is_first:
                strings = [parts[p][q : q + length].tobytes() for p, q in zip(part[own], place[own], strict=True)]
                pairs = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in strings), np.int64)
                a, b = pairs[::2], pairs[1::2]
            else:  # neighbouring starts are one span
                turn = np.concatenate([[True], (part[own][1:] != part[own][:-1]) | (place[own][1:] != place[own][:-1] + 1)])
                begin = np.flatnonzero(turn)
                size = np.diff(np.concatenate([begin, [len(own)]])).astype(np.int32)
                own, a, b = own[begin], a[begin], b[begin]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(own), is_first)), pa.array(a), pa.array(b), pa.array(ids[part[own]]),
                    pa.array(ties[part[own]]), pa.array(start[own].astype(np.int32)), pa.array(size),
                ],
                names=["first", "a", "b", "id", "tie", "at", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            rows.append(batch)
            size += batch.nbytes
            if size < shard_bytes:
                continue
            # All groups but the last, which may go on, are a shard.
            table = pa.Table.from_batches(rows).combine_chunks()
            m, k = table["minimizer"].to_numpy(), table["block"].to_numpy()
            turns = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1])) + 1
            if len(turns):
                yield from work(table.slice(0, int(turns[-1])).to_batches())
                rows = table.slice(int(turns[-1])).to_batches()
                size = sum(r.nbytes for r in rows)
        if rows:
            yield from work(rows)

    return run


# -- the operator -----------------------------------------------------------------


def _judged(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = utf8(batch.column(1)), batch.column(2).to_pylist()
            out = []
            for text, found in zip(texts, spans, strict=True):
                body = np.frombuffer(text.as_buffer(), np.uint8) if len(text.as_py()) else np.zeros(0, np.uint8)
                edge = np.zeros(len(body) + 1, np.int64)
                for x in found or ():
                    edge[x["at"]] += 1
                    edge[x["at"] + x["n"] + length - 1] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                kept = hashlib.sha256(body[~gone].tobytes()).hexdigest()
                out.append((len(body), int(gone.sum()), runs, kept))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
                names=[batch.schema.names[0], "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def repeated_spans(
    texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``id``, ``tie``, ``at``, ``n``: ``n`` strings from byte ``at`` on that also start earlier.

    ``texts`` has ``id`` and ``tie``, which give the order and name a text, and ``text``; each pair once.
    """
    rows = texts.select("id", "tie", "text").mapInArrow(_cut(length, gram), ROW)
    # Copies already known go anywhere; a minimizer's stretches meet.
    meet = F.when(F.col("later"), F.xxhash64("id", "at")).otherwise(F.col("minimizer"))
    dealt = rows.repartition(meet).sortWithinPartitions("minimizer", "stretch", "id", "tie", "at")
    folded = shared(dealt.mapInArrow(_fold, ROW), "stretches")
    later = folded.where("later").select("id", "tie", "at", "n")
    first = folded.where("not later").select("minimizer", "id", "tie", "at", "n")
    cuts = first.groupBy("id", "tie").agg(F.collect_list(F.struct("minimizer", "at", "n")).alias("cuts"))
    joined = texts.join(cuts, ["id", "tie"]).select("id", "tie", "text", "cuts")
    loaded = joined.mapInArrow(
        _with_bytes(length), "minimizer long, id long, tie long, at int, n int, bytes binary")
    large = first.groupBy("minimizer").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > hot)
    large = large.select("minimizer", F.ceil(F.col("rows") / hot).cast("int").alias("blocks"))
    loaded = loaded.join(large, "minimizer", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    loaded = loaded.withColumn("block", F.pmod(F.xxhash64("bytes"), F.col("blocks")))
    shards = loaded.repartition("minimizer", "block").sortWithinPartitions("minimizer", "block")
    found = shared(shards.mapInArrow(_sort_shards(length, shard_bytes), FOUND), "repeats")
    spans = found.where("not first").select("id", "tie", "at", "n")
    # Strings first in a block of a hot minimizer may be later than those of another block.
    heads = found.where("first").drop("first", "n")
    start = F.struct("id", "tie", "at")
    earliest = heads.groupBy("a", "b").agg(F.min(start).alias("earliest"))
    beaten = heads.join(earliest, ["a", "b"]).where(start != F.col("earliest"))
    return later.unionAll(spans).unionAll(beaten.select("id", "tie", "at", F.lit(1).alias("n")))


def dedup_strings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **options
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` per row of ``docs``."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ids = plain.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    twice = ids.where("n > 1 or doc_id is null").limit(1).count()
    tie = F.xxhash64("text") if twice else F.lit(0).cast("bigint")
    least = F.lit(-(1 << 63)).cast("bigint")
    texts = plain.select("doc_id", F.coalesce("doc_id", least).alias("id"), tie.alias("tie"), "text")
    # A row that comes again would be a later copy of itself.
    once = shared(texts.select("id", "tie", "text").distinct(), "distinct-texts") if twice else texts
    spans = repeated_spans(once, length, **options)
    gone = spans.groupBy("id", "tie").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    joined = texts.join(gone, ["id", "tie"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        _judged(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
