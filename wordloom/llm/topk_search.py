"""Exact top-k search by inner product with a paged M-tree and best-first search.

Metric: components become integers, ``floor(scale * x)``. A vector ``x`` gets one more component,
``sqrt(M^2 - |x|^2)`` with ``M`` the largest length of all, a query gets zero; then the squared Euclidean distance of
query and vector is ``|q|^2 + M^2 - 2 q.x``, so the nearest vectors are those of the highest inner product, and the
triangle inequality holds between all of them.

Index: routing objects are drawn by hash, at most ``MAX_ROUTES``; every vector goes to its nearest one, and the vectors of a
route are dealt by hash into nodes of a bounded number of rows, so a route with a third of
all vectors is many nodes. A node is one stored row: its leaf pages, each with a centre (one of its vectors), a
covering radius and the distance of its centre to the routing object; in a page the entries stand in
the order of their distance to its centre, which is stored with them. A directory holds
route, radius and nearest and farthest entry of each node, in pages of bounded size.

Search: queries travel in blocks of one route. Each block first meets a node of its own route, which
gives every query a k-th best score and with it a reach: no farther vector can matter. Directory pages then
name the nodes that some query of a block still reaches. A node takes its blocks one by one; what
``|d(q, route) - d(centre, route)| - radius`` or ``d(q, centre) - radius`` puts out of reach is not visited, pages
are visited in the order of these bounds, and in a page only the entries with
``|d(q, centre) - d(x, centre)|`` within reach are multiplied. Scores are whole numbers computed exactly; only bounds are in
floating point, widened by more than their rounding error, and equal scores are kept for the tie by id. So
recall is 1 whatever the data; bad pruning costs time, not rows.

Scale: blocks x nodes that survive are cut into units of a bounded number of blocks, each unit with a copy of
its node, sorted so that a task holds one node and one block at a time. A unit sends only rows that enter some
query's top k. Nothing but ``MAX_ROUTES`` vectors, the number of nodes per route and totals reaches the driver.

Defined results: a vector that is null or has a null or non-finite component takes no part; vectors of
different lengths are compared as if padded with zeros; rows that repeat, or share an id, are rows of their own: each
is a candidate of the others and a query of its own; a null id is no query, and as a
candidate stands behind other ids of the same score; fewer than ``k`` candidates are all returned; an empty
table gives an empty table. Only id and vector are read, so other columns do not matter. Lengths of
2^31 and more end the job with a message.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.tables import shared
from wordloom.llm.vectors import whole_vectors

K, SCALE, EVERY = 20, 64, 20
MAX_ROUTES = 256
#: Rows of a node (at least and at most, by the size of the table), of a leaf page and of a query block.
NODE_ROWS, PAGE_ROWS, BLOCK_ROWS = (1024, 8192), 256, 512
#: Nodes listed in a directory page, and blocks that meet one copy of a node.
DIRECTORY_ROWS, UNIT_BLOCKS = 4096, 64
_LARGEST = 1 << 31
_LAST = np.iinfo(np.int64).max

PACKED = "n int, ids binary, known binary, rows binary, v binary, norm2 binary"


class Space:
    """What every task needs to know of the metric: number of components and largest squared length."""

    def __init__(self, dims: int, m2: int):
        if m2 >= _LARGEST * _LARGEST:
            raise ValueError(f"a vector is longer than {_LARGEST}: no exact 64-bit score")
        self.dims, self.m2 = dims, m2
        #: A type in which all partial sums of an inner product are whole numbers without rounding.
        self.exact = np.float32 if m2 < 1 << 24 else np.float64 if m2 < 1 << 53 else np.int64
        self.slack = 1e-6 * (1 + math.sqrt(m2))  # roots of differences lose half of the 53 bits

    def vectors(self, packed: bytes, n: int) -> np.ndarray:
        return np.frombuffer(packed, "<i4").reshape(n, self.dims).astype(self.exact)

    def from_query(self, dots: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        """Distances of queries (rows of squared length ``norm2``) to vectors, from inner products."""
        return np.sqrt(np.maximum(norm2[:, None].astype(float) + float(self.m2) - 2.0 * dots, 0))

    def between(self, dots: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
        """Distances between vectors with their added components, from inner products."""
        rest = np.sqrt(np.maximum(float(self.m2) - a2.astype(float), 0))[:, None] * np.sqrt(
            np.maximum(float(self.m2) - b2.astype(float), 0))[None, :]
        return np.sqrt(np.maximum(2.0 * self.m2 - 2.0 * dots - 2.0 * rest, 0))

    def reach(self, norm2: np.ndarray, lowest: np.ndarray, full: np.ndarray) -> np.ndarray:
        """How far a vector may be that still scores ``lowest``; without end where the top k is not full."""
        d2 = np.maximum(norm2.astype(float) + float(self.m2) - 2.0 * lowest.astype(float), 0) + 0.5
        return np.where(full, np.sqrt(d2) + self.slack, np.inf)


def prepared(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``vec_id``, ``v`` (32-bit integers), ``size``, ``norm2``, ``row``: the usable rows, numbered in a stored table."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, lengths, whole = whole_vectors(batch.column(1), scale, _LARGEST - 1)
            ends = np.cumsum(lengths)
            square = np.concatenate([[0.0], np.cumsum(whole.astype(float) ** 2)])
            if len(ends) and (square[ends] - square[ends - lengths]).max() >= 2.0**61:
                raise ValueError(f"a vector is longer than {_LARGEST}: no exact 64-bit score")
            square = np.concatenate([[0], np.cumsum(whole * whole)])  # differences are right even if sums wrap
            data = whole.astype("<i4").tobytes()
            cut = [data[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(good)), pa.array(cut, pa.binary()),
                 pa.array(lengths.astype(np.int32)), pa.array(square[ends] - square[ends - lengths])],
                names=["vec_id", "v", "size", "norm2"])

    made = rows.mapInArrow(run, "vec_id long, v binary, size int, norm2 long")
    return shared(made.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _rows(batch: pa.RecordBatch, space: Space) -> tuple[np.ndarray, ...]:
    """Ids (null as the last), whether known, row numbers, padded vectors and squared lengths of a batch."""
    ids = batch.column("vec_id")
    known = np.asarray(ids.is_valid())
    filled = ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = 4 * space.dims
    data = b"".join(v.ljust(wide, b"\0") for v in batch.column("v").to_pylist())
    v = np.frombuffer(data, "<i4").reshape(len(batch), space.dims)
    return filled, known, batch.column("row").to_numpy(), v, batch.column("norm2").to_numpy()


def _routed(rows: DataFrame, space: Space, routes: np.ndarray, query: bool) -> DataFrame:
    """Rows with the number of their nearest route."""
    square = (routes.astype(np.int64) ** 2).sum(axis=1)
    held = routes.astype(space.exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            route = np.zeros(len(batch), np.int32)
            for at in range(0, len(batch), 2048):
                _, _, _, v, norm2 = _rows(batch.slice(at, 2048), space)
                dots = v.astype(space.exact) @ held.T
                far = space.from_query(dots, norm2) if query else space.between(dots, norm2, square)
                route[at : at + 2048] = far.argmin(axis=1)
            yield batch.append_column("route", pa.array(route))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("route", T.IntegerType())]))


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of equal keys of sorted batches, each as one batch."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and keys[a] != now:
                yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            now = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _dealt(rows: DataFrame, counts: dict[int, int], most: int) -> DataFrame:
    """``part``: rows of a route in as many parts, by hash, as keep a part near ``most`` rows."""
    parts = {r: max(1, math.ceil(n / most)) for r, n in counts.items()}
    table = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else None
    many = F.coalesce(table[F.col("route")], F.lit(1)) if parts else F.lit(1)
    part = F.pmod(F.xxhash64("row"), many.cast("long"))
    return rows.withColumn("part", F.col("route").cast("long") * (1 << 40) + part)


def _packed(ids, known, row, v, norm2) -> dict:
    return {"n": len(ids), "ids": ids.astype("<i8").tobytes(), "known": known.astype(np.uint8).tobytes(),
            "rows": row.astype("<i8").tobytes(), "v": v.astype("<i4").tobytes(),
            "norm2": norm2.astype("<i8").tobytes()}


def leaf_pages(v: np.ndarray, norm2: np.ndarray, space: Space, page_rows: int) -> tuple[np.ndarray, ...]:
    """An order of the rows by page and distance to its centre; page ends, centres and the distances."""
    n = len(v)
    many = max(1, math.ceil(n / page_rows))
    data = v.astype(space.exact)
    first = space.between(data @ data[:1].T, norm2, norm2[:1])[:, 0]
    centres = np.argsort(first, kind="stable")[np.arange(many) * n // many]
    far = space.between(data @ data[centres].T, norm2, norm2[centres])
    page = far.argmin(axis=1)
    own = far[np.arange(n), page]
    order = np.lexsort((own, page))
    sizes = np.bincount(page, minlength=many)
    kept = np.flatnonzero(sizes)
    return order, np.cumsum(sizes[kept]), centres[kept], own[order]


NODE = (f"part long, route int, {PACKED}, near double, far double, page_ends binary, page_v binary,"
        " page_norm2 binary, page_parent binary, page_radius binary, entry_far binary")  # fmt: skip
BLOCK = f"part long, route int, {PACKED}"


def nodes(rows: DataFrame, space: Space, routes: np.ndarray, page_rows: int) -> DataFrame:
    """One row per part of a route: its M-tree node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in _groups(batches, "part"):
            ids, known, row, v, norm2 = _rows(batch, space)
            route = int(batch.column("route")[0].as_py())
            held = routes[route : route + 1]
            order, ends, centres, far = leaf_pages(v, norm2, space, page_rows)
            to_route = space.between(
                v.astype(space.exact) @ held.T.astype(space.exact), norm2, (held.astype(np.int64) ** 2).sum(axis=1))[:, 0]
            begins = np.concatenate([[0], ends[:-1]])
            node = {"part": int(part), "route": route, **_packed(*(x[order] for x in (ids, known, row, v, norm2))),
                    "near": float(to_route.min()), "far": float(to_route.max()),
                    "page_ends": ends.astype("<i8").tobytes(), "page_v": v[centres].astype("<i4").tobytes(),
                    "page_norm2": norm2[centres].astype("<i8").tobytes(),
                    "page_parent": to_route[centres].astype("<f8").tobytes(),
                    "page_radius": far[ends - 1].astype("<f8").tobytes() if len(begins) else b"",
                    "entry_far": far.astype("<f8").tobytes()}
            yield pa.RecordBatch.from_pylist([node], schema=schema)

    made, schema = _kind(NODE)
    return _by_part(rows).mapInArrow(run, made)


def blocks(rows: DataFrame, space: Space) -> DataFrame:
    """One row per part of a route: a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in _groups(batches, "part"):
            route = int(batch.column("route")[0].as_py())
            packed = _packed(*_rows(batch, space))
            yield pa.RecordBatch.from_pylist([{"part": int(part), "route": route, **packed}], schema=schema)

    made, schema = _kind(BLOCK)
    return _by_part(rows).mapInArrow(run, made)


def _by_part(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "part").sortWithinPartitions("part", "row")


def _kind(ddl: str) -> tuple[str, pa.Schema]:
    """A schema for Spark and for Arrow."""
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(),
             "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    pairs = [x.split() for x in ddl.split(", ")]
    return ddl, pa.schema([(name, arrow[kind]) for name, kind in pairs])


class Block:
    """Queries with the best rows found for them so far."""

    def __init__(self, row: dict, space: Space, k: int):
        self.n, self.k = row["n"], k
        self.ids, self.rows = (np.frombuffer(row[c], "<i8") for c in ("ids", "rows"))
        self.norm2 = np.frombuffer(row["norm2"], "<i8")
        self.v = space.vectors(row["v"], self.n)
        self.low, self.full = np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        self.hits = tuple(np.zeros(0, np.int64) for _ in range(4))  # query, score, id, flags
        if row.get("low") is not None:
            self.low, self.full = np.frombuffer(row["low"], "<i8"), np.frombuffer(row["full"], np.uint8).astype(bool)
        #: Scores that earlier visits found; a row that only equals the last of them may still win by its id.
        self.first = self.low, self.full

    def take(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Keep the k best of what was held and what is new."""
        q, s, i, f = (np.concatenate(x) for x in zip(self.hits, (query, score, ids, known), strict=True))
        order = np.lexsort((i, 1 - f, -s, q))
        q, s, i, f = (x[order] for x in (q, s, i, f))
        starts = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - starts[q] < self.k
        last = starts + self.k - 1
        full = (last < len(q)) & (q[np.minimum(last, max(len(q) - 1, 0))] == np.arange(self.n)) if len(q) else self.full
        low = np.where(full, s[np.minimum(last, max(len(q) - 1, 0))], 0) if len(q) else self.low
        old_low, old_full = self.first
        self.full = full | old_full
        self.low = np.where(full & old_full, np.maximum(low, old_low), np.where(full, low, old_low))
        self.hits = tuple(x[keep] for x in (q, s, i, f))


class Node:
    """A node of the tree, unpacked."""

    def __init__(self, row: dict, space: Space, routes: np.ndarray):
        self.n = row["n"]
        self.ids, self.rows = (np.frombuffer(row[c], "<i8") for c in ("ids", "rows"))
        self.known = np.frombuffer(row["known"], np.uint8).astype(np.int64)
        self.v = space.vectors(row["v"], self.n)
        self.route = routes[row["route"]].astype(space.exact)
        self.ends = np.frombuffer(row["page_ends"], "<i8")
        self.centres = space.vectors(row["page_v"], len(self.ends))
        self.parent, self.radius = (np.frombuffer(row[c], "<f8") for c in ("page_parent", "page_radius"))
        self.entry_far = np.frombuffer(row["entry_far"], "<f8")


def search(block: Block, node: Node, space: Space) -> int:
    """Best-first through the pages of a node; the number of inner products with entries that were computed."""
    to_route = space.from_query((block.v @ node.route)[:, None], block.norm2)
    stored = np.abs(to_route - node.parent[None, :]) - node.radius[None, :]
    reach = space.reach(block.norm2, block.low, block.full)
    near = np.flatnonzero((stored <= reach[:, None]).any(axis=0))  # other centres are not even multiplied
    to_centre = space.from_query(block.v @ node.centres[near].T, block.norm2)
    bound = np.maximum(stored[:, near], to_centre - node.radius[near][None, :])
    done = 0
    for p in np.argsort(bound.min(axis=0), kind="stable") if len(near) else []:
        reach = space.reach(block.norm2, block.low, block.full)
        asking = np.flatnonzero(bound[:, p] <= reach)
        if not len(asking):
            continue
        page = near[p]
        begin, end = (int(node.ends[page - 1]) if page else 0), int(node.ends[page])
        far, at, wide = node.entry_far[begin:end], to_centre[asking, p], reach[asking]
        a = begin + int(np.searchsorted(far, at - wide - space.slack).min())
        b = begin + int(np.searchsorted(far, at + wide + space.slack, "right").max())
        if a >= b:
            continue
        score = block.v[asking] @ node.v[a:b].T
        done += score.size
        good = (score >= block.low[asking][:, None]) | ~block.full[asking][:, None]
        good &= block.rows[asking][:, None] != node.rows[a:b][None, :]
        q, x = np.nonzero(good)
        if len(q):
            block.take(asking[q], score[q, x].astype(np.int64), node.ids[a + x], node.known[a + x])
    return done


HITS = "query_row long, query_id long, vec_id long, score long"


def _hits(block: Block) -> pa.RecordBatch:
    q, s, i, f = block.hits
    return pa.RecordBatch.from_arrays(
        [pa.array(block.rows[q]), pa.array(block.ids[q]), pa.array(i, mask=f == 0), pa.array(s)],
        names=["query_row", "query_id", "vec_id", "score"])


def _seeded(pairs: DataFrame, space: Space, routes: np.ndarray, k: int) -> DataFrame:
    """Blocks after their first node: the same row with ``low``, ``full`` and the hits as arrays."""
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                block = Block(row, space, k)
                if row["node"] is not None:
                    search(block, Node(row["node"], space, routes), space)
                hits = _hits(block)
                out = {c: row[c] for c in names} | {
                    "home": row["home"], "low": block.low.astype("<i8").tobytes(),
                    "full": block.full.astype(np.uint8).tobytes()}
                out |= {f"hit_{c}": hits.column(c).to_pylist() for c in hits.schema.names}
                yield pa.RecordBatch.from_pylist([out], schema=schema)

    made, schema = _kind(
        f"{BLOCK}, home long, low binary, full binary, " + ", ".join(f"hit_{x.split()[0]} array<long>" for x in HITS.split(", ")))
    return pairs.mapInArrow(run, made)


def _reached(pairs: DataFrame, space: Space, routes: np.ndarray, k: int) -> DataFrame:
    """``block``, ``node``: the nodes of a directory page that some query of a block still reaches."""
    held = routes.astype(space.exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                block = Block(row, space, k)
                d = space.from_query(block.v @ held.T, block.norm2)
                reach = space.reach(block.norm2, block.low, block.full)[:, None]
                part, route = np.array(row["d_part"], np.int64), np.array(row["d_route"], np.int64)
                near, far = np.array(row["d_near"]), np.array(row["d_far"])
                found = np.zeros(len(part), bool)
                for a in range(0, len(part), 512):
                    to = d[:, route[a : a + 512]]
                    found[a : a + 512] = ((to - far[a : a + 512] <= reach) & (near[a : a + 512] - to <= reach)).any(axis=0)
                found &= part != row["home"]
                part = part[found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), row["part"], np.int64)), pa.array(part)], names=["block", "node"])

    return pairs.mapInArrow(run, "block long, node long")


def _visited(stream: DataFrame, space: Space, routes: np.ndarray, k: int) -> DataFrame:
    """Hits of sorted units: a node, then the blocks that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = None
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["kind"] == 0:
                    node = Node(row["node_row"], space, routes)
                    continue
                block = Block(row["block_row"], space, k)
                search(block, node, space)
                if len(block.hits[0]):
                    yield _hits(block)

    return stream.mapInArrow(run, HITS)


def top_k(
    vectors: DataFrame,
    k: int = K,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
    is_query: Column | None = None,
    node_rows: int | None = None,
    page_rows: int = PAGE_ROWS,
    block_rows: int = BLOCK_ROWS,
    directory_rows: int = DIRECTORY_ROWS,
    unit_blocks: int = UNIT_BLOCKS,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k highest inner products of each query with other rows.

    ``is_query`` is a condition on ``vec_id``; by default its divisibility by 20.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors, vec_id, vector, scale)
    n, dims, m2 = rows.agg(F.count(F.lit(1)), F.max("size"), F.max("norm2")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = Space(max(1, dims), m2)
    node_rows = node_rows or min(NODE_ROWS[1], max(NODE_ROWS[0], math.isqrt(n)))
    asked = F.col("vec_id") % EVERY == 0 if is_query is None else is_query

    many = min(MAX_ROUTES, math.ceil(n / node_rows))
    drawn = rows.orderBy(F.xxhash64("row", "v"), "row").limit(many).select("v").collect()
    routes = np.array([np.frombuffer(r["v"].ljust(4 * space.dims, b"\0"), "<i4") for r in drawn], np.int64)
    routes = np.unique(routes, axis=0)

    def by_route(df: DataFrame, most: int) -> DataFrame:
        counts = {r["route"]: r["count"] for r in df.groupBy("route").count().collect()}  # a row per route
        return _dealt(df, counts, most)

    routed = shared(_routed(rows, space, routes, query=False), "routed")
    tree = shared(nodes(by_route(routed, node_rows), space, routes, page_rows), "nodes")
    queries = shared(_routed(rows.where(asked), space, routes, query=True), "queries")
    asking = blocks(by_route(queries, block_rows), space)

    # Each block meets one node of its own route, another one for each block of a route.
    parts = tree.groupBy("route").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    homes = tree.select(F.col("part").alias("home"), F.struct(*tree.columns).alias("node"))
    pairs = asking.join(parts, "route", "left").withColumn(
        "home", F.element_at("parts", (F.pmod("part", F.size("parts").cast("long")) + 1).cast("int"))).drop("parts")
    names = [x.split()[0] for x in BLOCK.split(", ")]
    home = F.coalesce("home", F.lit(-1).cast("long")).alias("home")  # a route that is no vector's nearest has no node
    seeded = shared(_seeded(pairs.join(homes, "home", "left").select(*names, home, "node"), space, routes, k), "blocks")

    # Directory pages name the nodes in reach.
    n_nodes = tree.count()
    n_pages = math.ceil(n_nodes / directory_rows)
    entry = F.struct("part", "route", "near", "far")
    pages = tree.groupBy(F.pmod(F.xxhash64("part"), F.lit(n_pages).cast("long")).alias("page")).agg(
        F.collect_list(entry).alias("d")).select("page", *[F.col(f"d.{c}").alias(f"d_{c}") for c in ("part", "route", "near", "far")])
    lean = seeded.select(*names, "home", "low", "full")
    asked_pages = lean.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pages - 1).cast("long"))))
    visits = shared(_reached(asked_pages.join(pages, "page"), space, routes, k), "visits")

    # Units: a copy of a node and at most so many blocks.
    unit = F.pmod(F.xxhash64("block"), F.ceil(F.col("blocks") / unit_blocks).cast("long"))
    sizes = visits.groupBy("node").agg(F.count(F.lit(1)).alias("blocks"))
    placed = visits.join(sizes, "node").select("node", "block", unit.alias("unit"))
    block_rows_ = lean.select(F.col("part").alias("block"), F.struct(*lean.columns).alias("block_row"))
    node_rows_ = tree.select(F.col("part").alias("node"), F.struct(*tree.columns).alias("node_row"))
    units = placed.select("node", "unit").distinct()
    left = units.join(node_rows_, "node").select(
        "node", "unit", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "node_row",
        F.lit(None).cast(lean.schema).alias("block_row"))
    right = placed.join(block_rows_, "block").select(
        "node", "unit", F.lit(1).alias("kind"), "block", F.lit(None).cast(tree.schema).alias("node_row"), "block_row")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = left.unionByName(right).repartition(n_parts, "node", "unit").sortWithinPartitions("node", "unit", "kind", "block")
    found = _visited(stream, space, routes, k)

    zipped = F.arrays_zip(*[F.col(f"hit_{x.split()[0]}").alias(x.split()[0]) for x in HITS.split(", ")])
    first = seeded.select(F.inline(zipped))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.unionByName(first).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

