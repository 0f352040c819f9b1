"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Above this many bytes nothing is broadcast; every operator has another way then.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the setting is missing and all executors are in this process (tests on one
    machine) a folder of our own is made; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        if not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        own = context._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    files, found = _file_system(spark, path)
    return files.exists(found)


def drop_path(spark: SparkSession, path: str) -> None:
    files, found = _file_system(spark, path)
    files.delete(found, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what lies there is deleted when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    files, found = _file_system(spark, path)
    files.deleteOnExit(found)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Values of the session while the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, and survives lost executors.

    What was shuffled for it is deleted once it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in tables:
        roots = _nodes(df)[-1].relation().location().rootPaths()
        drop_path(df.sparkSession, roots.apply(0).toString())


def _nodes(df: DataFrame) -> list:
    """The analysed plan from the top down; ends early where a node has not just one child."""
    node = df._jdf.queryExecution().analyzed()
    found = [node]
    while node.children().size() == 1:
        node = node.children().apply(0)
        found.append(node)
    return found


def is_plain_scan(df: DataFrame) -> bool:
    """Whether each row of df is one row of one file: a scan of distinct paths, filtered and projected the same way each time."""
    *above, leaf = _nodes(df)
    if leaf.nodeName() != "LogicalRelation" or not df._jdf.queryExecution().analyzed().deterministic():
        return False
    if any(n.nodeName() not in ("Project", "Filter", "SubqueryAlias", "View") for n in above):
        return False
    try:
        roots = leaf.relation().location().rootPaths()
    except Exception:  # no relation of files
        return False
    paths = sorted(roots.apply(i).toString().rstrip("/") + "/" for i in range(roots.size()))
    return all(not b.startswith(a) for a, b in zip(paths, paths[1:]))  # no path twice, nor inside another


def placed(docs: DataFrame, columns: list[str], name: str) -> DataFrame:
    """columns of docs and ``name`` (struct<file long, row long>), a different place for each row.

    The place is that in the row's file, where docs are a plain scan; all others (joined,
    exploded, cached docs ..) are written first. Places outlive lost executors.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name)
    if is_plain_scan(docs):
        try:
            return docs.select(*columns, place)
        except AnalysisException:  # files without row numbers
            pass
    return stored(docs.select(*columns), "content").select(*columns, place)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound what an Arrow batch of whole texts can hold: in rows, and in bytes but for its last text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n hash partitions an int that lies there, so that what is spread over them is spread evenly."""
    found, size = {}, 32 * n
    while len(found) < n:
        ids = spark.range(size).select(F.col("id").cast("int").alias("key"))
        found = {r["at"]: r["key"] for r in ids.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("at")).agg(F.min("key").alias("key")).collect()}  # n rows
        size *= 2
    return [found[at] for at in range(n)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def tiled(rows: DataFrame, large: DataFrame, key: str, member: str, size: int) -> DataFrame:
    """rows and ``tile``: groups that large (key, n) names are dealt out to tiles, so that none has many more than 2 * size rows.

    A large group is cut into parts by its members' hash; each two parts, and so each two
    members, meet in one tile. Rows of other groups get tile 0.
    """
    parts = F.coalesce(F.floor(F.col("n") / size) + 1, F.lit(1))
    found = rows.join(large.select(key, "n"), key, "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(member), "parts"))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda other: F.least("part", other) * F.col("parts") + F.greatest("part", other))
    return found.withColumn("tile", F.explode(each)).drop("n", "parts", "part")
