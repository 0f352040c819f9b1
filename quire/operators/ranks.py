"""Ranks and running sums over a whole table without one task that sorts it all."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: monotonically_increasing_id() counts a partition's rows in its lower bits.
_ROW_BITS = 33


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), deleted when the driver ends.

    Without the setting a folder of this machine serves only where all executors are in this process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.gettempdir()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/quire-{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a scratch path and read again: evaluated once, whoever reads it and however often."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete what written() wrote for df, once nothing reads it any more."""
    roots = df._jdf.queryExecution().analyzed().relation().location().rootPaths()
    path = roots.apply(0)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df, over all cores if it is so small that a scan may leave them idle."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores << 24 else df


def running(rows: DataFrame, order: list[Column], value: str | None = None, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows with ``row_before`` and, of a value column of whole numbers, ``sum_before``: rows and sum ahead of each row in the order.

    The rows are parted by ranges of the order and numbered, and summed up, in their part;
    what a part holds is then added to those after it. Parts are of about one size and as
    many as there are shuffle partitions, so no task sees more than its share, whatever key
    is hot. The numbered rows are written once, so all readers see the same parts, each in
    the order. ``order`` leaves no ties. then: a projection of the rows in their parts, made
    after the shuffle, whose sampling reads what comes before it twice.
    """
    n = shuffle_partitions(rows.sparkSession)
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = then(placed) if then else placed
    columns = placed.columns
    placed = placed.withColumn("_part", F.shiftright(at, _ROW_BITS)).withColumn("_row", at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    if value:
        placed = _summed(placed, value)
    numbered = written(placed, "ranks")
    sums = [F.count("*").alias("_rows"), *([F.max(F.col("_sum") + F.coalesce(value, F.lit(0))).alias("_sums")] if value else [])]
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = numbered.groupBy("_part").agg(*sums)
    shifts = parts.select("_part", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_ahead") for c in parts.columns[1:]))
    found = numbered.join(F.broadcast(shifts), "_part").withColumn("row_before", F.col("_row") + F.col("_rows_ahead"))  # as many rows as shuffle partitions
    if not value:
        return found.select(*columns, "row_before")
    return found.select(*columns, "row_before", (F.col("_sum") + F.col("_sums_ahead")).alias("sum_before"))


def _summed(rows: DataFrame, value: str) -> DataFrame:
    """rows and _sum, the values ahead of each row in its task; values are not negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = 0
        for batch in batches:
            own = np.cumsum(pc.fill_null(batch.column(value).cast(pa.int64()), 0).to_numpy(zero_copy_only=False))
            before = pa.array(np.append(0, own)[:-1] + ahead if len(own) else own)
            ahead += int(own[-1]) if len(own) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, before], [*batch.schema.names, "_sum"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("_sum", LongType())]))
