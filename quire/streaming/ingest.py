"""Continuous ingest: new page files become tokens, running word counts and parts of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.text import words
from quire.operators.index import build_index
from quire.sources.pages import PAGES


def stream_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name, page_key, pos, word) of Parquet files of PAGES as they arrive."""
    pages = spark.readStream.schema(PAGES).parquet(path)
    return pages.select("doc_name", "page_key", F.posexplode(words(F.col("text"))).alias("pos", "word"))


def append_tokens(tokens: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append all tokens that are there; each file is read once, whatever is restarted."""
    return tokens.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_words(tokens: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Running counts by word: each batch writes the counts it changed to ``output``, one folder a batch; see latest_counts().

    A batch that is run again after a failure writes its folder anew.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{output}/batch={batch}")

    counts = tokens.groupBy("word").agg(F.count("*").alias("cnt"))
    return counts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, output: str) -> DataFrame:
    """(word, cnt): what the last batch that changed a word says."""
    return spark.read.parquet(output).groupBy("word").agg(F.max_by("cnt", "batch").alias("cnt"))


def append_segments(spark: SparkSession, path: str, output: str, checkpoint: str) -> StreamingQuery:
    """Index the Parquet files of PAGES that are new: each batch becomes an index of its own in ``output``, see index.open_segments().

    A batch that is run again after a failure writes its folder anew; what is there already is not read.
    """

    def write(pages: DataFrame, batch: int) -> None:
        build_index(pages).save(f"{output}/segment={batch}")

    pages = spark.readStream.schema(PAGES).parquet(path)
    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
