"""SimHash near-duplicates by segment-popcount embedding.

Fingerprint: words are what white space leaves, A-Z in lower case; each shingle of four words, joined by
single spaces, is hashed by XXH64 with seed 42, and a bit is set if it is set in more than half of the hashes.

Links: fingerprints that differ in at most ``bits`` bits. A fingerprint is embedded as the bit counts of
its 32 segments of two bits; the Manhattan distance of two embeddings is at most the
number of differing bits. The embedding is a grid: its segments are cut into six blocks, and two
embeddings at a distance of four or less agree on two blocks or more, so they meet in one of the 15 grids
spanned by two blocks. Within a cell the Manhattan distance rules out most pairs and the rest
are compared bit by bit. Nothing is approximate: every link lies in some cell.

Scale: copies fold into one row per fingerprint first. A cell yields a forest of links that
connects just what its links connect, at most one edge per row, never all pairs. A cell of
more than ``cell_rows`` fingerprints is cut into blocks, and each pair of blocks is worked on its own,
so no task holds more than two blocks of a cell. Components of all forests are found by
distributed stars; fingerprints and links never reach the driver.

Defined results: null and empty texts have fingerprint zero and are linked like others; texts of
fewer words than a shingle are one shingle; repeated rows are copies of each other; a row
without an id takes its component's smallest id; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.arrays import U64, utf8
from wordloom.llm.graph import components
from wordloom.llm.tables import broadcast_if_small, shared

SHINGLE, SEED, BITS = 4, 42, 4
CELL_ROWS = 20_000
_ODD = U64(0x5555555555555555)
_EVEN = U64(0xAAAAAAAAAAAAAAAA)


def text_fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text in UTF-8. ``bytes.lower`` and ``bytes.split`` know ASCII only."""
    joined = b" ".join(text.lower().split())
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts, ends = [0, *(s + 1 for s in spaces)], [*spaces, len(joined)]
    if len(starts) > shingle:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = [0], [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), U64, len(starts))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``doc_id``, ``keep``, ``fp``: the fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.columns[-1])
            found = np.fromiter((text_fingerprint(t.as_py()) for t in texts), U64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, T.StructType(rows.schema.fields[:-1]).add("fp", "long"))


def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 segments, two bits each."""
    return (fps & _ODD) + ((fps >> U64(1)) & _ODD)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of embeddings; a segment's counts are 0 to 2."""
    x = a ^ b
    both = x & (x >> U64(1)) & _ODD  # counts 1 and 2, which differ by one
    x ^= both << U64(1)
    return np.bitwise_count(x & _ODD) + 2 * np.bitwise_count(x & _EVEN)


def grids(bits: int = BITS, agree: int = 2) -> list[int]:
    """Masks over embeddings: any two within ``bits`` agree under one of them."""
    n, masks = bits + agree, []
    cut = [round(k * 32 / n) for k in range(n + 1)]
    blocks = [sum(3 << (2 * s) for s in range(cut[k], cut[k + 1])) for k in range(n)]
    for chosen in combinations(blocks, agree):
        masks.append(sum(chosen))
    return masks


def _linked(fps: np.ndarray, own: np.ndarray, i, j, bits: int) -> np.ndarray:
    """Which pairs are links: the lower bound first, the exact count for what it leaves."""
    near = np.flatnonzero(manhattan(own[i], own[j]) <= bits)
    i, j = (np.broadcast_to(x, (max(np.size(i), np.size(j)),))[near] for x in (i, j))
    return near[np.bitwise_count(fps[i] ^ fps[j]) <= bits]


def _grown(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Forest of one large cell: each row is compared with the rows no tree has reached yet."""
    own, edges = embed(fps), []
    left = np.arange(len(fps))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            at = reached.pop()
            hit = _linked(fps, own, left, np.array([at]), bits)
            if len(hit):
                new = left[hit].tolist()
                edges += [(at, x) for x in new]
                reached += new
                left = np.delete(left, hit)
    return edges


def forest(cells: np.ndarray, fps: np.ndarray, bits: int = BITS, small: int = 48) -> np.ndarray:
    """Edges (rows of fingerprints) that connect what is linked within each run of equal cells."""
    edges: list[np.ndarray] = []
    n = len(fps)
    if n < 2:
        return np.zeros((0, 2), U64)
    bounds = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [n]])
    sizes = np.diff(bounds)
    for k in np.flatnonzero(sizes > small):
        part = fps[bounds[k] : bounds[k + 1]]
        if found := _grown(part, bits):
            edges.append(part[np.array(found)])
    many = np.repeat((sizes > 1) & (sizes <= small), sizes)
    rows = np.flatnonzero(many)
    last = np.repeat(bounds[1:], sizes)[rows]
    own, pairs, d = embed(fps), [], 1
    while len(rows):
        keep = rows + d < last
        rows, last = rows[keep], last[keep]
        hit = _linked(fps, own, rows, rows + d, bits)
        if len(hit):
            pairs.append(np.stack([rows[hit], rows[hit] + d], axis=1))
        d += 1
    if pairs:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        joined = []
        for a, b in np.concatenate(pairs).tolist():
            a_root, b_root = find(a), find(b)
            if a_root != b_root:
                root[b_root] = a_root
                joined.append((a, b))
        edges.append(fps[np.array(joined)])
    return np.concatenate(edges) if edges else np.zeros((0, 2), U64)


def links(distinct: DataFrame, bits: int = BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``u``, ``v``: links between the distinct fingerprints ``fp`` that connect all that is linked."""
    odd = F.lit(_ODD.view(np.int64).item())
    fp = F.col("fp")
    one = F.shiftrightunsigned(fp, 1)
    low, high = fp.bitwiseXOR(one).bitwiseAND(odd), fp.bitwiseAND(one).bitwiseAND(odd)
    own = low.bitwiseOR(F.shiftleft(high, 1))
    signed = [int(np.array(m, U64).view(np.int64)) for m in grids(bits)]
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias("grid"), own.bitwiseAND(F.lit(m)).alias("cell"))
                               for k, m in enumerate(signed)]))
    rows = distinct.select("fp", each.alias("c")).select("fp", "c.grid", "c.cell")
    sizes = rows.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > cell_rows).select(
        "grid", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks"))
    rows = rows.join(large, ["grid", "cell"], "left")
    block = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("block", block)
    others = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)).alias("other")
    units = rows.select("grid", "cell", "fp", "block", others).select(
        "grid", "cell", "fp", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    keys = ["grid", "cell", "a", "b"]
    dealt = units.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 2

        def out(cells, fps):
            found = forest(cells, fps.view(U64), bits)
            return pa.RecordBatch.from_arrays(
                [pa.array(found[:, k].astype(U64).view(np.int64)) for k in range(2)], names=["u", "v"])

        number, before = 0, None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
            turn = np.zeros(len(batch), bool)
            for k, column in enumerate(columns):
                turn[1:] |= column[1:] != column[:-1]
                turn[0] |= before is None or column[0] != before[k]
            before = [column[-1] for column in columns]
            cells = number + np.cumsum(turn)
            number = int(cells[-1])
            cells = np.concatenate([held[0], cells])
            fps = np.concatenate([held[1], batch.column(2).to_numpy()])
            last = int(np.searchsorted(cells, number))  # the last cell may go on in the next batch
            held = [cells[last:], fps[last:]]
            yield out(cells[:last], fps[:last])
        yield out(*held)

    return dealt.mapInArrow(run, "u long, v long")


def _rooted(distinct: DataFrame, bits: int) -> DataFrame:
    """The stored table of distinct ``fp`` with ``root``, a number that linked fingerprints share."""
    groups = components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    rooted = distinct.join(groups, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    return shared(rooted.drop("component"), "rooted-fingerprints")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id``: the smallest id that links reach, the own one included."""
    marked = shared(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = shared(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    rooted = _rooted(distinct, bits)
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("fp", "root").join(firsts, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group; rows without an id stay."""
    found = near_duplicates(docs, doc_id, text, bits)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone__"))
    return docs.join(gone.distinct(), docs[doc_id] == F.col("gone__"), "left_anti")


def one_row_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row of each group of ``docs``: the smallest id, none after all ids, then by a hash of the row.

    Rows are told apart by 128 bits of hash over all their columns; of rows equal in all of them one stays. They are
    folded in each task before they meet, and only winners that come again are moved to be folded.
    """
    key = ["row_a__", "row_b__"]
    while {c.lower() for c in docs.columns} & set(key):
        key = [f"{k}_" for k in key]
    # A hash skips nulls and takes no maps; as text their entries go by key.
    plain = {f.name: F.to_json(F.struct(f.name), {"sortKeys": "true"}) if "map<" in f.dataType.simpleString() else F.col(f.name)
             for f in docs.schema.fields}
    own = [x for c in docs.columns for x in (plain[c], F.col(c).isNull())]
    keyed = docs.withColumns({key[0]: F.xxhash64(*own), key[1]: F.xxhash64(F.lit(1), *own)})
    marked = fingerprints(keyed, doc_id, text, tuple(key))
    rows = shared(marked.groupBy("doc_id", *key, "fp").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *key)
    distinct = shared(rows.groupBy("fp").agg(F.min(order).alias("first")), "distinct-fingerprints")
    firsts = _rooted(distinct, bits).groupBy("root").agg(F.min("first").alias("first"))
    best = firsts.select(*[F.col("first")[k].alias(k) for k in key])
    left = keyed.join(rows.join(best, key, "left_anti").select(*key), key, "left_anti")
    again = shared(rows.where("n > 1").join(best, key, "left_semi").select(*key), "repeated-rows")
    if not again.isEmpty():
        again = broadcast_if_small(again)
        once = left.join(again, key, "left_semi").dropDuplicates(key)
        left = left.join(again, key, "left_anti").unionByName(once)
    return left.select(*docs.columns)
