"""Readers of raw pages and dictionaries, and the manifest of what is done."""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "doc_name string, page_key long, text string"


def doc_name(path="path"):
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """PAGES of .txt files; form feeds part pages."""
    files = spark.read.option("pathGlobFilter", "*.txt").option("wholetext", True).text(path)
    named = files.select(doc_name("_metadata.file_path").alias("doc_name"), F.posexplode(F.split("value", "\f")).alias("page_key", "text"))
    return named.select("doc_name", F.col("page_key").cast("long").alias("page_key"), "text")


def extract_pdf(content: bytes) -> list[str]:
    """Page texts by an installed pdftotext, one process a document, never through a shell."""
    with tempfile.TemporaryDirectory() as folder:
        file = Path(folder, "in.pdf")
        file.write_bytes(content)
        raw = subprocess.run(["pdftotext", "-layout", str(file), "-"], capture_output=True, check=True).stdout
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    pages = text.split("\f")
    return pages[:-1] if len(pages) > 1 and not pages[-1].strip() else pages


def read_documents(spark: SparkSession, path: str, extractor: Callable[[bytes], list[str]] = extract_pdf, glob: str = "*.pdf", done: DataFrame | None = None) -> DataFrame:
    """PAGES of binary files that ``done`` (doc_name) doesn't name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(doc_name().alias("doc_name"), "content")
    if done is not None:
        files = files.join(done.select("doc_name"), "doc_name", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pages = extractor(content)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pages), pa.string()), pa.array(range(len(pages)), pa.int64()), pa.array(pages, pa.string())], ["doc_name", "page_key", "text"])

    return files.mapInArrow(run, PAGES)


def write_pages(pages: DataFrame, path: str) -> None:
    """Add extracted PAGES to the Parquet files at path; with done_documents() a later run skips them."""
    pages.write.mode("append").parquet(path)


def done_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name) of the documents that write_pages() has written to path."""
    return spark.read.schema(PAGES).parquet(path).select("doc_name").distinct()


def page_count(text):
    """Pages of a text whose pages form feeds part; none if it is null."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\f")))


def read_json_dictionary(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, word): the keys of one JSON object."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.lit(lang).alias("lang"), F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("word"))


def read_line_dictionary(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, word): one word a line."""
    return spark.read.text(path).select(F.lit(lang).alias("lang"), F.trim("value").alias("word")).where("word <> ''")


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Keys of inputs that done lacks; the other way round these are obsolete outputs."""
    return inputs.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")
