"""Exact deduplication as a stateful stream.

Every row is reduced to a digest of its normalised text, its identifier and a content
locator (file and row). A streaming aggregation keeps, in a disk-backed state store
(RocksDB) without watermark or expiry, for each digest the row that stays and a count.
Rows that hit a digest seen before are then held, byte by byte, against the text their
keeper's locator leads to; rows that only share a digest form groups of their own.
With a named folder the stream goes on, call by call: its checkpoint, the rows' digests and
their texts stay there. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import SPACE_CLASS, drop_path, drop_stored, exists, new_path, placed, settings, stored, text_column

#: A keeper's text is copied once for so many rows that are held against it.
ROWS_A_COPY = 2000
#: Files that a micro-batch of the stream reads at least, and micro-batches that a call makes at most.
FILES, BATCHES = 64, 32
#: Only texts of rows that hit a digest are shuffled, but for false hits of a Bloom filter of at most 1 MB. It passes
#: through the driver, whose memory holds up to 50 copies of it (in plans, tasks and blocks).
_BLOOM = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1024TB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "1000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "8388608",
}
_KEYED = "sha binary, doc_id long, n_chars long, at struct<file: long, row: long>, digest binary"

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # executors keep no open stores and no local files between batches
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text="text"):
    return F.regexp_replace(text_column(text), SPACE_CLASS + "+", "")


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text and a locator (at struct<file long, row long>)."""
    return placed(docs, ["doc_id", "text"], "at").withColumn("doc_id", F.col("doc_id").cast("long"))


def rank():
    """Least for the row that stays: most code points, then least doc_id (null last), then place."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at")


def keyed_rows(texts: DataFrame, digest_bits: int) -> DataFrame:
    """_KEYED: what the stream reads of texts (doc_id, text, at); without the texts themselves."""
    sha = F.unhex(F.sha2(normalised(), 256))
    short = F.lpad(F.substring(F.conv(F.hex(F.substring("sha", 1, 4)), 16, 2), 1, digest_bits), digest_bits, "0").cast("binary")
    found = texts.select(sha.alias("sha"), "doc_id", F.length(text_column()).cast("long").alias("n_chars"), "at")
    return found.withColumn("digest", F.col("sha") if digest_bits == 256 else short)


def run_stream(spark: SparkSession, source: str, checkpoint: str, files: int) -> None:
    """Take the _KEYED files in source into the state; those that a run before with this checkpoint has read are not read again."""
    with settings(spark, _STATE):
        stream = spark.readStream.schema(_KEYED).option("maxFilesPerTrigger", max(FILES, files // BATCHES + 1)).parquet(source)
        query = (
            stream.groupBy("digest").agg(F.min(rank()).alias("best"), F.count("*").alias("n"))
            .writeStream.format("noop").outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).start()
        )
        query.awaitTermination()


def digest_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, best, n): the state of the stream."""
    with settings(spark, _STATE):
        found = spark.read.format("statestore").load(checkpoint)
        state = found.select("key.digest", *(F.col(f"value.{name}").alias(to) for name, to in zip(found.schema["value"].dataType.names, ("best", "n"), strict=True)))
        return stored(state, "digests")


def _once(df: DataFrame, path: str) -> None:
    """Write df to path, unless that was done to the end before."""
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)


def _in_batches(rows: DataFrame) -> DataFrame:
    """doc_id, text and a locator that tells batch, file and row by their names there, wherever the folder lies."""
    name = F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1)
    return rows.select("doc_id", "text", F.struct(F.xxhash64(name).alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))


def continued(docs: DataFrame, folder: str, batch: str, digest_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, keyed, state) of all batches in folder, docs among them; see exact_duplicates().

    The stream reads the new batch alone, once: that it is done is noted by the batch's
    name, so the folder may be moved, or named otherwise, between calls.
    """
    spark = docs.sparkSession
    content, keys, done = (f"{folder}/{part}/{batch}" for part in ("content", "keyed", "done"))
    _once(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), content)
    _once(keyed_rows(_in_batches(spark.read.parquet(content)), digest_bits), keys)
    if not exists(spark, f"{done}/_SUCCESS"):
        run_stream(spark, f"{keys}/*", f"{folder}/state", len(spark.read.schema(_KEYED).parquet(keys).inputFiles()))
        _once(spark.range(0), done)
    keyed = spark.read.schema(_KEYED).parquet(f"{folder}/keyed/*")
    return _in_batches(spark.read.parquet(f"{folder}/content/*")), keyed, digest_state(spark, f"{folder}/state")


def unlike_keeper(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Of rows (at, keeper, copies), those whose normalised text isn't their keeper's: at and norm."""
    members = rows.join(texts.select("at", normalised().alias("norm")), "at").select("at", "norm", "keeper", "copies")
    copy = F.pmod(F.xxhash64("at"), "copies").alias("copy")
    held = members.where(F.col("at") != F.col("keeper")).withColumn("copy", copy)
    keepers = members.where(F.col("at") == F.col("keeper")).select(
        "keeper", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    )
    return held.join(keepers, ["keeper", "copy"]).where("norm <> kept_norm").select("at", "norm", "keeper")


def exact_duplicates(docs: DataFrame, digest_bits: int = 256, folder: str | None = None, batch: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the locator ``at`` of every row of docs (doc_id, text).

    Texts are equal when they are identical without ``[\\x20\\x09-\\x0D]``; null counts as
    empty, and all empty texts are one group. Of a group the row with the most code
    points in its original text stays, then that of the smallest doc_id (null last),
    then, among repeated rows, that of the least locator: just one row is kept. Locators
    differ for all rows, also of joined or exploded docs. Long texts are hashed and
    compared whole. No rows: no rows. Other columns are not read. ``digest_bits`` shortens
    the state's key; shorter keys only mean more texts to compare.

    With a ``folder`` (shared by driver and executors) docs are the stream's next batch,
    named ``batch``: groups span all batches there, and the result has the rows of all of
    them. A batch that is there already, say before a failure, is not added again. The
    folder may have moved since; if a text that a row must be held against is not there,
    the call fails.
    """
    spark = docs.sparkSession
    if folder:
        if not batch:
            raise ValueError("a batch needs a name")
        texts, keyed, state = continued(docs, folder.rstrip("/"), batch, digest_bits)
    else:
        texts = located(docs)
        keyed = stored(keyed_rows(texts, digest_bits), "keyed")
        files, checkpoint = keyed.inputFiles(), new_path(spark, "state")
        run_stream(spark, files[0].rsplit("/", 1)[0], checkpoint, len(files))
        state = digest_state(spark, checkpoint)
        drop_path(spark, checkpoint)
    best = state.select("digest", F.col("best.at").alias("keeper"), F.col("best.doc_id").alias("keep_id"), "n")
    slim = stored(keyed.join(best, "digest").select("at", "doc_id", "sha", "keeper", "keep_id", "n"), "slim")
    drop_stored(state)
    copies = (F.col("n") / ROWS_A_COPY).cast("long") + 1
    with settings(spark, _BLOOM):
        unlike = stored(unlike_keeper(texts, slim.where("n > 1").select("at", "keeper", copies.alias("copies"))), "unlike")
    if folder and not slim.where("at = keeper").join(texts.select("at"), "at", "left_anti").isEmpty():
        raise ValueError(f"{folder} lacks texts of earlier batches")
    if unlike.isEmpty():
        drop_stored(unlike, *([] if folder else [keyed]))
        whole = slim.select("*", F.col("n").alias("group_size"))
    else:
        apart = unlike.groupBy("keeper").agg(F.count("*").alias("apart"))
        like = slim.join(unlike, "at", "left_anti").join(apart, "keeper", "left").select(
            "at", "doc_id", "sha", "keeper", "keep_id", (F.col("n") - F.coalesce("apart", F.lit(0))).alias("group_size")
        )
        lone = keyed.join(unlike.select("at", "norm"), "at")
        groups = lone.groupBy("norm").agg(F.min(rank()).alias("best"), F.count("*").alias("group_size"))
        whole = like.unionByName(
            lone.join(groups, "norm").select("at", "doc_id", "sha", F.col("best.at").alias("keeper"), F.col("best.doc_id").alias("keep_id"), "group_size")
        )
    return whole.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("at") == F.col("keeper")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "at",
    )


def kept_rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of docs that stay, with the named columns; just one of each group of equal texts.

    See exact_duplicates() for null, empty and long texts, ties, repeated rows and null ids.
    No rows: no rows.
    """
    found = placed(docs, columns, "quire_at")
    stay = exact_duplicates(found).where("kept").select(F.col("at").alias("quire_at"))
    return found.join(stay, "quire_at", "left_semi").select(*columns)
