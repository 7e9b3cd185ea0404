"""Approximate nearest neighbours by shifted space-filling curves.

A curve projects the vectors on a few random directions, shifts them by a random offset, and orders them along the Hilbert curve of the projected space. Each
of several curves, with directions and offset of its own, orders vectors of one place by a further direction of its own, is range-partitioned and cut into chunks. On each curve a query's
window reaches from its own chunk over neighbouring chunks on either side; what the windows hold is merged and ranked by the exact inner product.

How far windows must reach depends on the vectors. It is fitted: for a bounded sample of queries the exact nearest are found among all vectors, and windows are as wide as brings together
the wanted share of these pairs on some curve. Where vectors lie in clusters that is a small part of the table; where they have no structure it is most of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.scratch import Scratch
from tapeworks.llm.vectors import best, fewest_copies, usable

K, EVERY = 20, 20
#: Curves, directions of each, bits of each direction; chunks that a curve is cut into at least, and the fewest and most vectors of one.
CURVES, DIRECTIONS, BITS, CUTS, FEWEST, MOST = 8, 3, 10, 96, 32, 2048
#: Vectors that means and spreads come from; queries that windows are fitted to, for each length of vectors; the share of their nearest that windows must bring together.
SAMPLE, ASKED, RECALL = 4096, 256, 0.95
FOUND = "query_id long, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The positions of cells (rows of coordinates below 2**bits) on the Hilbert curve, by Gray-code rotation of the coordinates' bits."""
    x = cells.astype(np.uint64).T.copy()
    d, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit = np.uint64(1 << b)
        below = bit - one
        for i in range(d):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] = np.where(turned, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        bit = np.uint64(1 << b)
        flip = np.where((x[-1] & bit) != 0, flip ^ (bit - one), flip)
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def curve(dim: int, number: int, directions: int) -> tuple[np.ndarray, np.ndarray]:
    """A curve's directions and offset; they depend on its number alone."""
    rng = np.random.default_rng([dim, number])
    return rng.normal(size=(dim, directions)), rng.uniform(-0.5, 0.5, directions)


def tie_direction(dim: int, number: int) -> np.ndarray:
    """The direction by which a curve orders vectors of one place, so that the curves order near copies differently."""
    return np.random.default_rng([dim, number, 1]).normal(size=dim)


def placed(batches: Iterator[pa.RecordBatch], scales: dict, curves: int, directions: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Each vector once for each curve: (dim, curve, place, tie, vec_id, vector)."""
    for batch in batches:
        dims, vectors = batch.column(1).to_numpy(), batch.column(2).to_pylist()
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            x = np.frombuffer(b"".join(vectors[k] for k in rows), "<f8").reshape(len(rows), dim)
            for c in range(curves):
                ways, offset = curve(dim, c, directions)
                mean, spread = scales[dim]
                y = ((x - mean) @ ways) / (spread * np.sqrt((ways * ways).sum(0)) + 1e-300) + offset
                cells = np.clip((np.clip(y, -4, 4) + 4) / 8 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                key = hilbert_keys(cells, bits).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), dim, np.int32)), pa.array(np.full(len(rows), c, np.int32)), pa.array(key), pa.array((x - mean) @ tie_direction(dim, c)), batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows))], names=["dim", "curve", "place", "tie", "vec_id", "vector"]
                )


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted along the curves; each run of at most ``size`` of one curve is a chunk: (dim, curve, place and tie of its first, its first id, ids, vectors)."""
    now, ids, vectors = None, [], []

    def chunk():
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([now[2]], pa.int64()), pa.array([now[3]], pa.float64()), pa.array([ids[0]], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary())],
            names=["dim", "curve", "place", "tie", "head", "ids", "vectors"],
        )

    for batch in batches:
        for d, c, p, t, i, v in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if ids and ((d, c) != now[:2] or len(ids) >= size):
                yield chunk()
                ids, vectors = [], []
            if not ids:
                now = (d, c, p, t)
            ids.append(i)
            vectors.append(v)
    if ids:
        yield chunk()


def top_rows(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which entries are among the k best of their row, in order of row, score and id."""
    order = np.lexsort((ids, -scores, rows))
    starts = np.searchsorted(rows[order], np.arange(n))
    return order[np.arange(len(order)) - starts[rows[order]] < k]


def candidates(own: np.ndarray, ask: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k best vectors for each query that reach the query's least score."""
    near = ask @ x.T
    near[own[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        least = np.maximum(least, np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k])
    # products from matrix arithmetic only sort out; what may be among the best is summed anew, in one order for all
    q, i = np.nonzero((near >= (least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0.0))))[:, None]) & np.isfinite(near))
    scores = inner(ask[q], x[i])
    keep = top_rows(q, ids[i], scores, k, len(own))
    return q[keep], ids[i][keep], scores[keep]


def found_batch(own, q, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])


def own_chunks(batches: Iterator[pa.RecordBatch], k: int, every: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query's own chunk."""
    for batch in batches:
        at = {n: batch.schema.get_field_index(n) for n in ("ids", "vectors")}
        for r in range(batch.num_rows):
            ids = np.frombuffer(batch.column(at["ids"])[r].as_buffer(), "<i8")
            x = np.frombuffer(batch.column(at["vectors"])[r].as_buffer(), "<f8").reshape(len(ids), -1)
            asks = np.flatnonzero(ids % every == 0)
            if len(asks):
                yield found_batch(ids[asks], *candidates(ids[asks], x[asks], np.full(len(asks), -np.inf), ids, x, k))


def asked_of(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """Each query of a chunk: (dim, curve, number, of, query_id, vector)."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids = np.frombuffer(batch.column(4)[r].as_buffer(), "<i8")
            x = np.frombuffer(batch.column(5)[r].as_buffer(), "<f8").reshape(len(ids), -1)
            asks = np.flatnonzero(ids % every == 0)
            head = [pa.array([batch.column(j)[r].as_py()] * len(asks), batch.schema.field(j).type) for j in range(4)]
            yield pa.RecordBatch.from_arrays([*head, pa.array(ids[asks]), pa.array([v.tobytes() for v in x[asks]], pa.binary())], names=[*batch.schema.names[:4], "query_id", "vector"])


def reranked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (queries of one chunk, another chunk's ids and vectors): what reaches the queries' k-th best so far."""
    for batch in batches:
        for r in range(batch.num_rows):
            asks = batch.column(0)[r].as_py()
            own = np.array([a["query_id"] for a in asks], np.int64)
            ask = np.frombuffer(b"".join(a["vector"] for a in asks), "<f8").reshape(len(own), -1)
            least = np.array([-np.inf if a["least"] is None else a["least"] for a in asks])
            ids = np.frombuffer(batch.column(1)[r].as_buffer(), "<i8")
            x = np.frombuffer(batch.column(2)[r].as_buffer(), "<f8").reshape(len(ids), -1)
            yield found_batch(own, *candidates(own, ask, least, ids, x, k))


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed component after component, so that a pair has the same score wherever it is met."""
    score = np.zeros(len(q))
    for j in range(q.shape[1]):
        score += q[:, j] * x[:, j]
    return score


def sampled(batches: Iterator[pa.RecordBatch], asks: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a batch for each sampled query, over rows (vec_id, dim, vector)."""
    for batch in batches:
        ids, dims, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        for dim in np.unique(dims).tolist():
            if dim in asks:
                rows = np.flatnonzero(dims == dim)
                own, ask = asks[dim]
                x = np.frombuffer(b"".join(vectors[r] for r in rows), "<f8").reshape(len(rows), dim)
                yield found_batch(own, *candidates(own, ask, np.full(len(own), -np.inf), ids[rows], x, k))


def placed_ids(batches: Iterator[pa.RecordBatch], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(dim, curve, number, vec_id) of some ids, over numbered chunks."""
    for batch in batches:
        for r in range(batch.num_rows):
            own = np.frombuffer(batch.column(3)[r].as_buffer(), "<i8")
            hit = own[np.isin(own, ids)]
            yield pa.RecordBatch.from_arrays([*(pa.array([batch.column(j)[r].as_py()] * len(hit), pa.int32()) for j in range(3)), pa.array(hit)], names=["dim", "curve", "number", "vec_id"])


def fitted(few: DataFrame, cut: DataFrame, k: int, every: int, recall: float, asked: int) -> dict[int, tuple[int, float]]:
    """For each length of vectors, how many chunks windows must reach to either side, and the share of the sample's nearest that they then bring together."""
    turn = Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(5), "vec_id"))
    pick = few.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("n", F.row_number().over(turn)).where(F.col("n") <= asked)
    rows: dict[int, list] = {}
    for r in pick.select("dim", "vec_id", "vector").collect():
        rows.setdefault(r["dim"], []).append((r["vec_id"], bytes(r["vector"])))
    asks = {d: (np.array([i for i, _ in its], np.int64), np.frombuffer(b"".join(v for _, v in its), "<f8").reshape(len(its), d)) for d, its in rows.items() if d}
    dim_of = {i: d for d, (own, _) in asks.items() for i in own.tolist()}
    pairs = [(r["query_id"], r["vec_id"]) for r in best(few.mapInArrow(lambda it: sampled(it, asks, k), FOUND), k).collect()]
    ids = np.unique(np.array(pairs, np.int64))
    at: dict[int, dict[int, int]] = {}
    for r in cut.select("dim", "curve", "number", "ids").mapInArrow(lambda it: placed_ids(it, ids), "dim int, curve int, number int, vec_id long").collect():
        at.setdefault(r["vec_id"], {})[r["curve"]] = r["number"]
    gaps: dict[int, list[int]] = {}
    for q, i in pairs:
        gaps.setdefault(dim_of[q], []).append(min(abs(at[q][c] - at[i][c]) for c in at[q]))
    out = {}
    for dim, its in gaps.items():
        its.sort()
        wide = its[max(0, int(np.ceil(recall * len(its))) - 1)]
        out[dim] = (wide, sum(g <= wide for g in its) / len(its))
    return out


def neighbours(rows: DataFrame, k: int = K, every: int = EVERY, curves: int = CURVES, directions: int = DIRECTIONS, bits: int = BITS, cuts: int = CUTS, recall: float = RECALL, asked: int = ASKED, key: str = "vec_id", vector: str = "embedding", report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k nearest found, by inner product, ties to smaller ids.

    Rows without an id, and vectors null, zero, or with null or non-finite components take no part. Vectors meet those of their own length only. Of rows that
    share an id one takes part. Other columns are ignored. Means and spreads that scale the projections come from a sample of about SAMPLE vectors, the windows' width from ``asked``
    queries; all vectors are indexed. ``report``, if given, gets for each length of vectors the chunks of a curve, how many a window reaches to either side, the sample's recall, and
    comparisons for each query as a share of all vectors.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "hilbert")
    data = scratch.keep(usable(rows, key, vector, True), "vectors")
    # answers name at most k copies of a vector beside the query's own; queries all are kept
    few = fewest_copies(data, k + 1).unionByName(data.where(F.pmod("vec_id", F.lit(every)) == 0)).dropDuplicates(["vec_id"])
    few = scratch.keep(few, "few")
    counts = {r["dim"]: r["n"] for r in few.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row for each length of vectors
    scales = {}
    for dim, n in counts.items():
        pick = few.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30)) + 1))
        some = np.frombuffer(b"".join(sorted(bytes(r[0]) for r in pick.select("vector").collect())), "<f8").reshape(-1, max(1, dim))
        scales[dim] = (some.mean(0), float(some.std()) or 1.0) if len(some) else (np.zeros(dim), 1.0)
    total = sum(counts.values())
    chunk = max(FEWEST, min(MOST, -(-max(counts.values(), default=1) // cuts)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(parts, -(-total * curves // (8 * chunk))))
    order = ["dim", "curve", "place", "tie", "vec_id"]
    along = few.mapInArrow(lambda it: placed(it, scales, curves, directions, bits), "dim int, curve int, place long, tie double, vec_id long, vector binary")
    along = along.repartitionByRange(n, *order).sortWithinPartitions(*order)
    cut = scratch.keep(along.mapInArrow(lambda it: chunks(it, chunk), "dim int, curve int, place long, tie double, head long, ids binary, vectors binary"), "chunks")
    # chunks in order along each curve; one row for each chunk is all that this window holds
    numbers = cut.select("dim", "curve", "place", "tie", "head")
    turn = Window.partitionBy("dim", "curve").orderBy("place", "tie", "head")
    numbers = numbers.select(*(F.col(c).alias(f"_{c}") for c in ("dim", "curve", "place", "tie", "head")), (F.row_number().over(turn) - 1).cast("int").alias("number"), F.count("*").over(Window.partitionBy("dim", "curve")).alias("of"))
    same = F.lit(True)
    for c in ("dim", "curve", "place", "tie", "head"):
        same = same & (F.col(c) == F.col(f"_{c}"))
    numbered = scratch.keep(cut.join(numbers, same).select("dim", "curve", "number", "of", "ids", "vectors"), "numbered")
    scratch.drop(cut)
    cut = numbered
    widths = fitted(few, cut, k, every, recall, asked)
    if report is not None:
        of = {r["dim"]: r["of"] for r in cut.groupBy("dim").agg(F.max("of").alias("of")).collect()}
        report |= {d: {"chunks": of[d], "reach": w, "recall": r, "compared": curves * min(1.0, (2 * w + 1) / of[d])} for d, (w, r) in widths.items()}
    # first each query's own chunk of every curve; then the rest of its windows, of which only what reaches the k-th best so far comes out
    first = scratch.keep(cut.mapInArrow(lambda it: own_chunks(it, k, every), FOUND).dropDuplicates(["query_id", "vec_id"]), "first")
    so_far = best(first, k).groupBy(F.col("query_id").alias("_q")).agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    wide = F.lit(0)
    for d, (w, _) in widths.items():
        wide = F.when(F.col("dim") == d, w).otherwise(wide)
    asks = cut.mapInArrow(lambda it: asked_of(it, every), "dim int, curve int, number int, of long, query_id long, vector binary")
    asks = asks.join(so_far, F.col("query_id") == F.col("_q"), "left").groupBy("dim", "curve", "number", "of").agg(F.collect_list(F.struct("query_id", "vector", "least")).alias("asks"))
    asks = asks.withColumn("to", F.explode(F.sequence(F.greatest(F.lit(0), F.col("number") - wide), F.least(F.col("of") - 1, F.col("number") + wide)).cast("array<int>"))).where("to <> number")
    asks = asks.select(F.col("dim").alias("d"), F.col("curve").alias("c"), "to", "asks")
    met = asks.join(cut, (F.col("d") == F.col("dim")) & (F.col("c") == F.col("curve")) & (F.col("to") == F.col("number"))).select("asks", "ids", "vectors")
    rest = met.mapInArrow(lambda it: reranked(it, k), FOUND)
    return best(first.unionByName(rest).dropDuplicates(["query_id", "vec_id"]), k)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest found of all embeddings for every vec_id divisible by 20."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
