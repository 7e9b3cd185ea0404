"""Ranks and running sums over tables of any size, in built-in DataFrame operations.

Rows are ordered by a hash in hexadecimal. Its first digits deal the rows to buckets of a few thousand; sums of the buckets give each bucket's offset, and a
window over one bucket gives the rest. The buckets' own offsets are found in two steps, over the first half of the digits and within it. So no task ever orders a whole partition of the
caller's, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4096


def digits(rows: int) -> int:
    """Hexadecimal digits that give buckets of at most about BUCKET_ROWS rows."""
    n = 1
    while 16**n * BUCKET_ROWS < rows and n < 12:
        n += 1
    return n


def running(df: DataFrame, parts: list[str], order: str, tie: str, size: Column, rows: int) -> DataFrame:
    """Adds ``rank`` (from 0) and ``start`` (sum of size over the rows before) within parts, by the hexadecimal column order, then tie.

    df is read twice, so it should be a table. Null parts form parts of their own.
    """
    df = df.withColumn("_bucket", F.substring(order, 1, digits(rows))).withColumn("_size", size)
    keys = [F.coalesce(F.col(p).cast("string"), F.lit("")).alias(f"_p{i}") for i, p in enumerate(parts)] + [F.col(p).isNull().alias(f"_n{i}") for i, p in enumerate(parts)]
    df = df.select("*", *keys)
    names = [f"_p{i}" for i in range(len(parts))] + [f"_n{i}" for i in range(len(parts))]
    rows_before = (Window.unboundedPreceding, -1)
    sums = df.groupBy(*names, "_bucket").agg(F.count("*").alias("_rows"), F.sum("_size").alias("_sum")).withColumn("_top", F.substring("_bucket", 1, (digits(rows) + 1) // 2))
    over = (Window.partitionBy(*names) if names else Window.partitionBy()).orderBy("_top").rowsBetween(*rows_before)
    tops = sums.groupBy(*names, "_top").agg(F.sum("_rows").alias("_n"), F.sum("_sum").alias("_s"))
    tops = tops.select(*names, "_top", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_rank1"), F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_start1"))
    within = Window.partitionBy(*names, "_top").orderBy("_bucket").rowsBetween(*rows_before)
    sums = sums.select(*names, "_top", "_bucket", F.coalesce(F.sum("_rows").over(within), F.lit(0)).alias("_rank2"), F.coalesce(F.sum("_sum").over(within), F.lit(0)).alias("_start2"))
    sums = sums.join(tops, [*names, "_top"]).select(*names, "_bucket", (F.col("_rank1") + F.col("_rank2")).alias("_rank0"), (F.col("_start1") + F.col("_start2")).alias("_start0"))
    inside = Window.partitionBy(*names, "_bucket").orderBy(order, tie)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(sums, [*names, "_bucket"])
    out = out.withColumn("rank", F.col("_rank0") + F.row_number().over(inside) - 1).withColumn("start", F.col("_start0") + F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    return out.drop(*names, "_bucket", "_size", "_rank0", "_start0")
