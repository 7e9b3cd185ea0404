"""Tables that cut lineage: Parquet in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
#: Bytes of the record batches that go to Python workers. Rows may be long, so a number of rows would bound no memory.
BATCH_BYTES = 4 << 20
#: Rows up to which small() has a table broadcast.
SMALL_ROWS = 200_000


def bounded_batches(spark: SparkSession) -> None:
    """Sets the size of record batches, where the session hasn't."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "-1", "268435456", "9223372036854775807", "2147483647"):
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset: a temporary one if all of Spark runs on this machine, as in tests, else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tapeworks"
    if not _own:
        path = tempfile.mkdtemp(prefix="tapeworks-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own.append("file://" + path)
    return _own[0]


class Scratch:
    """The intermediate tables of one operator run. A table stays until drop() or the end of the folder."""

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark, self.home = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.home}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows and returns a frame that reads them; the shuffle files behind them go once nothing refers to them."""
        path = self.path(name)
        cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(cleanup, None)
        self.spark.conf.set(cleanup, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(cleanup) if before is None else self.spark.conf.set(cleanup, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that keep() made and that nothing reads any more."""
        for frame in frames:
            for path in {f.rpartition("/")[0] for f in frame.inputFiles()}:
                if path.split("://")[-1].lstrip("/").startswith(self.home.split("://")[-1].split(":", 1)[-1].lstrip("/")):
                    where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                    where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def numbered(self, df: DataFrame, number: str) -> DataFrame:
        """df with a column of numbers from 0 without gaps, in no particular order: each task counts its rows, and one row for each task says where it begins."""
        rows = self.keep(df.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_task", F.shiftright("_at", 33))
        before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
        begins = rows.groupBy("_task").agg(F.count("*").alias("_n")).select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
        numbered = rows.join(F.broadcast(begins), "_task").withColumn(number, F.col("_begin") + F.pmod("_at", F.lit(1 << 33)))
        return numbered.select(*df.columns, number)


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df with a hint to broadcast it, if it has at most so many rows; a larger table is left to be joined by its keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def joinable(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """small(df), or df with a hint to join it by its keys. Without one Spark goes by the size of the files, and a few MB of those are hundreds of MB of rows, sent to the driver and to all tasks."""
    few = small(df, most)
    return df.hint("merge") if few is df else few
