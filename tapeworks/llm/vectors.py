"""Vector columns: which rows take part, one row for each id, and at most so many copies of one vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VECTORS = "vec_id long, dim int, vector binary"


def checked(batches: Iterator[pa.RecordBatch], nonzero: bool) -> Iterator[pa.RecordBatch]:
    """(vec_id, dim, vector as little-endian doubles) of rows with an id and a vector without null or non-finite components."""
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), batch.column(1)
        offsets = column.offsets.to_numpy()
        flat = column.values.cast(pa.float64())
        holes = flat.is_null().to_numpy(zero_copy_only=False)
        values = np.where(holes, np.nan, flat.fill_null(0).to_numpy(zero_copy_only=False))
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        out = []
        for k, i in enumerate(ids):
            v = values[offsets[k] : offsets[k + 1]]
            if i is not None and valid[k] and np.isfinite(v).all() and (not nonzero or v.any()):
                out.append((i, len(v), (v + 0.0).tobytes()))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["vec_id", "dim", "vector"])


def usable(rows: DataFrame, key: str, vector: str, nonzero: bool) -> DataFrame:
    """One row (vec_id, dim, vector) for each id: of rows that share an id the one with the smallest vector bytes."""
    rows = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.mapInArrow(lambda it: checked(it, nonzero), VECTORS)
    return rows.groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("v")).select("vec_id", "v.dim", "v.vector")


def fewest_copies(rows: DataFrame, most: int) -> DataFrame:
    """Of each vector the rows with its smallest ids, as many as any answer can name; each task cuts its own rows before they are dealt out."""
    turn = Window.partitionBy("dim", "vector").orderBy("vec_id")
    return rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most).drop("turn")


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores, ties to smaller ids."""
    turn = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
