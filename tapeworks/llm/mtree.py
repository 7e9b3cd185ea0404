"""Exact top-k search with a paged M-tree and best-first search.

Inner products become a metric by one more component: with M the longest norm, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the
nearest are the highest. The tree has routing objects at its root, chosen from a bounded sample; below them pages of at most PAGE vectors, each one row of a
table with its own routing object; in a page leaves, and in leaves entries. Every node is stored with its covering radius and its distance to its parent's routing
object, every entry with its distance to its leaf's.

A search visits pages by their least possible distance. Pages' routing objects and radii, without their vectors, meet blocks of queries first; each query so gets its FIRST pages of
the smallest bounds. What they hold gives the k-th best distance so far, and only pages whose bound it doesn't exceed are visited after that. In a page leaves are visited by their bounds.
The stored distances and the triangle inequality spare nodes and entries without computing anything for them. Scores are exact integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm.scratch import Scratch
from tapeworks.llm.vectors import best, fewest_copies, usable

K, EVERY, SCALE = 10, 100, 1024
#: Routing objects at the root and the sample that they come from; vectors of a page and of a leaf; queries of a block, pages of a block of them; pages that a query visits first.
ROUTES, SAMPLE, PAGE, LEAF, QUERIES, HEADS, FIRST = 64, 4096, 2048, 64, 256, 512, 4
#: What rounding may add to a squared distance, relative to the squares it comes from, and to a difference of distances.
SQUARED, SLACK = 1e-12, 1e-11
EXACT, LONGEST = float(1 << 53), (1 << 63) - 1
PAGES = "dim int, page long, route int, up double, radius double, centre binary, ids binary, vectors binary, heads binary, starts binary, radii binary, parents binary, gaps binary"


def whole(rows: DataFrame, scale: int) -> DataFrame:
    """Components floor(scale * x), as doubles that hold integers; what passes the largest double becomes that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                out = [np.nan_to_num(np.floor(scale * np.frombuffer(v, "<f8"))).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "dim", "vector"])

    return rows.mapInArrow(run, "vec_id long, dim int, vector binary")


def matrix(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(len(packed), dim)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can pass 2**53, else in Python's integers; beyond 64 bits the nearest number of 64 bits."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    if x.shape[1] * float(np.abs(x).max()) * float(np.abs(q).max()) < EXACT:
        return (x @ q).astype(np.int64)
    y = [int(c) for c in q.tolist()]
    return np.array([max(-LONGEST - 1, min(LONGEST, sum(int(a) * b for a, b in zip(row, y, strict=True)))) for row in x.tolist()], np.int64)


class Space:
    """The metric of vectors of one length: they are scaled by a power of two to components of at most 1, and lifted to one norm."""

    def __init__(self, power: int, norm: float, routes: np.ndarray):
        self.power, self.norm, self.routes = power, norm, routes

    def lifted(self, x: np.ndarray) -> np.ndarray:
        u = np.ldexp(x, -self.power)
        return np.hstack([u, np.sqrt(np.maximum(0.0, self.norm - (u * u).sum(axis=1)))[:, None]])

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([np.ldexp(q, -self.power), np.zeros((len(q), 1))])

    def reach(self, length: float, score: int | None) -> float:
        """The distance that a vector may have at most to reach a score, for a query of this squared norm."""
        if score is None or score <= -LONGEST:
            return math.inf
        square = length + self.norm
        return math.sqrt(max(0.0, square - 2.0 * math.ldexp(float(score), -2 * self.power)) + SQUARED * (1 + square)) + SLACK * (1 + math.sqrt(square))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.sqrt((d * d).sum(axis=-1))


def across(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distances of all x to all y, in parts of bounded size."""
    return np.concatenate([distances(x[k : k + 64, None, :], y[None, :, :]) for k in range(0, len(x), 64)]) if len(x) else np.zeros((0, len(y)))


def routed(batches: Iterator[pa.RecordBatch], spaces: dict[int, Space]) -> Iterator[pa.RecordBatch]:
    """Adds the nearest routing object of the root and the distance to it."""
    for batch in batches:
        dims, vectors = batch.column(1).to_numpy(), batch.column(2).to_pylist()
        route, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            x, to = spaces[dim].lifted(matrix([vectors[k] for k in rows], dim)), spaces[dim].routes
            for b in range(0, len(rows), 512):
                d = (x[b : b + 512] ** 2).sum(1)[:, None] + (to**2).sum(1) - 2 * x[b : b + 512] @ to.T
                route[rows[b : b + 512]] = d.argmin(1)
                far[rows[b : b + 512]] = np.sqrt(np.maximum(0, d.min(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(route), pa.array(far)], names=["vec_id", "dim", "vector", "route", "far"])


def page_row(dim: int, route: int, ids: list[int], vectors: list[bytes], space: Space) -> pa.RecordBatch:
    """A page as it is stored: its routing object, radius and distance to its root's; its leaves' routing objects, where they begin, radii and distances; its entries by leaf with theirs."""
    x = space.lifted(matrix(vectors, dim))
    centre = x[len(x) // 2]
    heads = x[np.linspace(0, len(x) - 1, max(1, -(-len(x) // LEAF))).astype(int)]
    leaf = ((x * x).sum(1)[:, None] + (heads * heads).sum(1) - 2 * x @ heads.T).argmin(1)
    order = np.argsort(leaf, kind="stable")
    used, starts = np.unique(leaf[order], return_index=True)
    gaps = distances(x[order], heads[leaf[order]])
    radii = np.maximum.reduceat(gaps, starts)
    data = [centre, np.array(ids, "<i8")[order], matrix(vectors, dim)[order], heads[used], starts.astype("<i8"), radii, distances(heads[used], centre), gaps]
    numbers = [pa.array([dim], pa.int32()), pa.array([ids[0]], pa.int64()), pa.array([route], pa.int32()), pa.array([float(distances(centre, space.routes[route]))]), pa.array([float(distances(x, centre).max())])]
    return pa.RecordBatch.from_arrays([*numbers, *(pa.array([np.ascontiguousarray(d).tobytes()], pa.binary()) for d in data)], names=[c.split()[0] for c in PAGES.split(", ")])


def pages(batches: Iterator[pa.RecordBatch], spaces: dict[int, Space]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by dimension, route and distance; each run of at most PAGE rows of one route is a page."""
    dim, route, ids, vectors = None, None, [], []
    for batch in batches:
        for i, d, v, r in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if ids and (d != dim or r != route or len(ids) >= PAGE):
                yield page_row(dim, route, ids, vectors, spaces[dim])
                ids, vectors = [], []
            dim, route = d, r
            ids.append(i)
            vectors.append(v)
    if ids:
        yield page_row(dim, route, ids, vectors, spaces[dim])


class Page:
    """One stored page. Nothing of it is computed again."""

    def __init__(self, dim: int, centre: bytes, radius: float, ids: bytes, vectors: bytes, heads: bytes, starts: bytes, radii: bytes, parents: bytes, gaps: bytes):
        self.centre, self.radius = np.frombuffer(centre, "<f8"), radius
        self.ids, self.starts = np.frombuffer(ids, "<i8"), np.frombuffer(starts, "<i8")
        self.vectors, self.heads = np.frombuffer(vectors, "<f8").reshape(len(self.ids), dim), np.frombuffer(heads, "<f8").reshape(len(self.starts), dim + 1)
        self.radii, self.parents, self.gaps = (np.frombuffer(b, "<f8") for b in (radii, parents, gaps))
        self.ends = np.append(self.starts[1:], len(self.ids))

    def search(self, q: np.ndarray, own: int, k: int, space: Space, least: int | None = None) -> list[tuple[int, int]]:
        """(score, -id) of the at most k best entries for query q with id own, of those that reach the score least."""
        q1 = space.asked(q[None, :])[0]
        length, top = float(q1 @ q1), []

        def reach() -> float:
            return space.reach(length, least if len(top) < k else max(top[0][0], least if least is not None else top[0][0]))

        limit = reach()
        to_centre = float(distances(q1, self.centre))
        if to_centre - self.radius > limit:
            return top
        # from stored distances alone: |d(q, parent) - d(leaf, parent)| - radius
        maybe = np.flatnonzero(np.abs(to_centre - self.parents) - self.radii <= limit)
        to_head = distances(self.heads[maybe], q1)
        queue = list(zip((to_head - self.radii[maybe]).tolist(), maybe.tolist(), to_head.tolist(), strict=True))
        heapq.heapify(queue)
        while queue:
            bound, leaf, gap = heapq.heappop(queue)
            if bound > limit:
                break
            a, b = self.starts[leaf], self.ends[leaf]
            rows = a + np.flatnonzero(np.abs(gap - self.gaps[a:b]) <= limit)
            scores = products(self.vectors[rows], q)
            floor_ = top[0][0] if len(top) == k else least
            if floor_ is not None:
                good = scores >= floor_
                rows, scores = rows[good], scores[good]
            for score, i in zip(scores.tolist(), self.ids[rows].tolist(), strict=True):
                if i == own:
                    continue
                if len(top) < k:
                    heapq.heappush(top, (score, -i))
                elif (score, -i) > top[0]:
                    heapq.heapreplace(top, (score, -i))
            limit = reach()
        return top


ASKS = "array<struct<query_id:bigint,vector:binary,least:bigint>>"


def bounds(dim: int, asks: list[dict], heads: list[dict], space: Space, looked_at: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, pages, their least distances) for each query of a block, of the pages that may hold something that reaches the query's score so far.

    The distances of queries and pages to the root's routing objects bound what they have to one another; a distance to a page's own routing object is computed only where that bound isn't enough,
    and, with looked_at, for so many of the pages of the smallest bounds only.
    """
    q = space.asked(matrix([a["vector"] for a in asks], dim))
    limits = np.array([space.reach(float(x @ x), a["least"]) for x, a in zip(q, asks, strict=True)])
    route, up, radius = (np.array([h[c] for h in heads]) for c in ("route", "up", "radius"))
    centres = matrix([h["centre"] for h in heads], dim + 1)
    to_roots = across(q, space.routes)
    for n in range(len(asks)):
        least = np.abs(to_roots[n][route] - up) - radius
        near = np.flatnonzero(least <= limits[n])
        if looked_at is not None:
            near = near[np.argsort(least[near], kind="stable")[:looked_at]]
        least[near] = np.maximum(least[near], distances(centres[near], q[n]) - radius[near])
        near = near[least[near] <= limits[n]]
        yield n, near, least[near]


def promising(batches: Iterator[pa.RecordBatch], spaces: dict[int, Space], first: int) -> Iterator[pa.RecordBatch]:
    """Rows (dim, queries of a block, pages of a block): the pages of the smallest bounds for each query."""
    for batch in batches:
        for dim, asks, heads in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            out = []
            for n, near, least in bounds(dim, asks, heads, spaces[dim], 4 * first):
                out += [(asks[n]["query_id"], heads[h]["page"], float(b)) for b, h in sorted(zip(least.tolist(), near.tolist(), strict=True))[:first]]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "page", "bound"])


def wanted(batches: Iterator[pa.RecordBatch], spaces: dict[int, Space]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, queries of a block, pages of a block): for each page the queries that must visit it and haven't; pages that none must are left out."""
    for batch in batches:
        for dim, asks, heads in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            visits: dict[int, list[dict]] = {}
            for n, near, _ in bounds(dim, asks, heads, spaces[dim]):
                met = set(asks[n]["met"] or ())
                for h in near.tolist():
                    if heads[h]["page"] not in met:
                        visits.setdefault(heads[h]["page"], []).append({c: asks[n][c] for c in ("query_id", "vector", "least")})
            for page, its in visits.items():
                yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([its], pa.list_(pa.struct([("query_id", pa.int64()), ("vector", pa.binary()), ("least", pa.int64())])))], names=["to", "asks"])


def searched(batches: Iterator[pa.RecordBatch], k: int, spaces: dict[int, Space]) -> Iterator[pa.RecordBatch]:
    """Rows (dim, a page, queries that visit it): (query_id, vec_id, score)."""
    for batch in batches:
        at = {n: k for k, n in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            get = lambda n, r=r: batch.column(at[n])[r].as_py()
            dim, out = get("dim"), []
            page = Page(dim, *(get(n) for n in ("centre", "radius", "ids", "vectors", "heads", "starts", "radii", "parents", "gaps")))
            for a in get("asks"):
                out += [(a["query_id"], -i, s) for s, i in page.search(np.frombuffer(a["vector"], "<f8"), a["query_id"], k, spaces[dim], a["least"])]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score long"


def space_of(few: DataFrame) -> dict[int, Space]:
    """The metric for each length of vectors; the root's routing objects come from a sample of about SAMPLE vectors."""

    def largest(batches):
        for batch in batches:
            tops = [np.frexp(np.abs(np.frombuffer(v, "<f8")).max(initial=0.0))[1] for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(tops, pa.int32())], names=["dim", "power"])

    # one row for each length of vectors
    powers = {r["dim"]: (int(r["power"]), r["n"]) for r in few.mapInArrow(largest, "dim int, power int").groupBy("dim").agg(F.max("power").alias("power"), F.count("*").alias("n")).collect()}

    def squares(batches):
        for batch in batches:
            out = [float((np.ldexp(np.frombuffer(v, "<f8"), -powers[d][0]) ** 2).sum()) for d, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.float64())], names=["dim", "norm"])

    norms = {r["dim"]: r["norm"] for r in few.mapInArrow(squares, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("norm")).collect()}
    spaces = {}
    for dim, (power, n) in powers.items():
        pick = few.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30)) + 1))
        found = sorted(r[0] for r in pick.select("vector").orderBy(F.xxhash64(F.lit(9), "vec_id")).limit(ROUTES).collect())
        spaces[dim] = Space(power, norms[dim], np.zeros((1, dim + 1)))
        if found:
            spaces[dim].routes = spaces[dim].lifted(matrix(found, dim))
    return spaces


def top_k(rows: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding", report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k highest integer inner products with other ids' rows.

    Rows without an id, and vectors null or with null or non-finite components take no part. Vectors meet those of their own length only. Of rows that
    share an id one takes part. Ties go to smaller ids. A score beyond 64 bits is the nearest number of 64 bits, and ranks as that. Other columns are ignored. ``report``, if given,
    gets how many pages there are, and how many (query, page) visits of all possible ones were made.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "mtree")
    data = scratch.keep(whole(usable(rows, key, vector, False), scale), "vectors")
    # a query can name k copies of one vector, and its own may be one more
    few = scratch.keep(fewest_copies(data, k + 1), "few")
    spaces = space_of(few)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tree = few.mapInArrow(lambda it: routed(it, spaces), "vec_id long, dim int, vector binary, route int, far double")
    tree = tree.repartitionByRange(parts, "dim", "route", "far", "vec_id").sortWithinPartitions("dim", "route", "far", "vec_id")
    tree = scratch.keep(tree.mapInArrow(lambda it: pages(it, spaces), PAGES), "pages")
    n_pages = tree.count()
    n_heads = max(1, -(-n_pages // HEADS))
    heads = tree.select("dim", F.pmod(F.xxhash64("page"), F.lit(n_heads)).alias("heads"), F.struct("page", "route", "up", "radius", "centre").alias("h")).groupBy("dim", "heads").agg(F.collect_list("h").alias("its"))
    heads = scratch.keep(heads, "heads").select(F.col("dim").alias("hdim"), F.col("heads").alias("hblock"), "its")
    asked = data.where(F.pmod("vec_id", F.lit(every)) == 0).select("dim", F.col("vec_id").alias("query_id"), "vector")
    n_asked = asked.count()
    n_blocks = max(1, -(-n_asked // QUERIES))

    def against_heads(asks: DataFrame, *columns) -> DataFrame:
        """Blocks of queries with blocks of pages' routing objects: (dim, asks, heads)."""
        blocks = asks.groupBy("dim", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct(*columns)).alias("asks"))
        blocks = blocks.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_heads - 1).cast("long"))))
        return blocks.join(heads, (F.col("dim") == F.col("hdim")) & (F.col("to") == F.col("hblock"))).select("dim", "asks", F.col("its").alias("heads"))

    none = F.lit(None).cast("long").alias("least")
    first = against_heads(asked.withColumn("least", F.lit(None).cast("long")), "query_id", "vector", "least").mapInArrow(lambda it: promising(it, spaces, FIRST), "query_id long, page long, bound double")
    first = first.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("bound", "page"))), 1, FIRST).alias("p"))
    first = scratch.keep(first.select(F.col("query_id").alias("q"), F.col("p.page").alias("met")), "first")
    # the queries that visit a page come in groups of at most about QUERIES
    goes = first.select("q", F.explode("met").alias("to"))
    groups = goes.groupBy("to").agg(F.ceil(F.count("*") / QUERIES).alias("groups"))
    goes = goes.join(groups, "to").join(asked, F.col("q") == F.col("query_id")).groupBy("to", F.pmod(F.xxhash64("query_id"), F.col("groups")).alias("group")).agg(F.collect_list(F.struct("query_id", "vector", none)).alias("asks"))
    found = scratch.keep(tree.join(goes, F.col("page") == F.col("to")).mapInArrow(lambda it: searched(it, k, spaces), FOUND), "found")
    least = best(found, k).groupBy(F.col("query_id").alias("_q")).agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    again = asked.join(least, F.col("query_id") == F.col("_q"), "left").join(first, F.col("query_id") == F.col("q"), "left")
    rest = scratch.keep(against_heads(again, "query_id", "vector", "least", "met").mapInArrow(lambda it: wanted(it, spaces), f"to long, asks {ASKS}"), "rest")
    if report is not None:
        visits = sum(r[0] or 0 for r in (rest.agg(F.sum(F.size("asks"))).first(), first.agg(F.sum(F.size("met"))).first()))
        report |= {"pages": n_pages, "visits": visits, "possible": n_pages * n_asked}
    more = tree.join(rest, F.col("page") == F.col("to")).mapInArrow(lambda it: searched(it, k, spaces), FOUND)
    return best(found.unionByName(more), k)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest of all embeddings for every vec_id divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score FROM e q JOIN e x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
