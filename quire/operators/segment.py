"""Pages to sentences: fragments, filters, and merging what runs on, by a scan over equal ranges of all fragments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from quire.functions.text import fold, letter_runs
from quire.operators.ranks import shuffle_partitions, written

#: A dictionary of so many bytes, by its words' lengths, is broadcast; a larger one is joined.
BROADCAST_BYTES = 64 << 20


def fragments(numbered: DataFrame) -> DataFrame:
    """(doc_idx, page_no, frag_no, frag): pieces between sentence ends and lines, white space collapsed."""
    shielded = F.regexp_replace("text", r"(Mr|Ms|Mrs|Dr)\.", "$1")
    parts = F.split(F.replace(shielded, F.lit(". "), F.lit(".\n")), "\n")
    cut = numbered.select("doc_idx", "page_no", F.posexplode(parts).alias("frag_no", "frag"))
    return cut.withColumn("frag", F.trim(F.regexp_replace("frag", r"\s\s+|[^\S ]", " ")))


def _membership(dictionary: DataFrame):
    """A function from an array of words to whether each is in the dictionary (word), or None if that is too large."""
    spark = dictionary.sparkSession
    size = dictionary.agg(F.coalesce(F.sum(F.length("word") + 8), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        return None
    known = spark.sparkContext.broadcast(sorted({r["word"] for r in dictionary.select("word").collect() if r["word"] is not None}))  # at most BROADCAST_BYTES

    @F.arrow_udf("array<boolean>")
    def test(lists: pa.Array) -> pa.Array:
        hits = pc.is_in(lists.flatten(), value_set=pa.array(known.value, pa.string()))
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes.to_numpy())), pa.int32()), hits)

    return test


def with_known_words(df: DataFrame, column: str, dictionary: DataFrame | None, longer_than: int = 0) -> DataFrame:
    """Rows with a dictionary word in column; without a dictionary, rows with a letter.

    The words are looked up inside each row. With a dictionary above BROADCAST_BYTES the
    words are joined with it instead, by row.
    """
    if dictionary is None:
        return df.where(fold(F.col(column)).rlike("[a-zA-Z]"))
    runs = letter_runs(F.col(column))
    asked = F.array_distinct(F.filter(runs, lambda w: F.length(w) > longer_than))
    if test := _membership(dictionary):
        return df.withColumn("_known", test(asked)).where(F.exists("_known", lambda known: known)).drop("_known")
    numbered = written(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    keyed = numbered.select("_row", F.explode(asked).alias("run"))
    hits = keyed.join(dictionary.select(F.col("word").alias("run")).distinct(), "run", "left_semi").select("_row").distinct()
    return numbered.join(hits, "_row", "left_semi").drop("_row")


def _merges(soft_end: Column, hard_end: Column) -> Column:
    return F.col("very_hard_start") | (F.col("soft_start") & hard_end) | (F.col("hard_start") & soft_end)


def _starts(kept: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """kept with what each fragment says of itself: how it starts, and how one after it would find it to end."""
    last, first, head = F.right("frag", F.lit(1)), F.left("frag", F.lit(1)), F.split("frag", " ")[0]
    flagged = kept.select(
        "*", head.alias("head"), last.rlike(r"[\p{L}\p{N}]").alias("ends_soft"), last.rlike(r"[\p{Ll}\-):;,\"']").alias("ends_hard"),
        first.rlike(r"[\p{L}\p{N}($\"']").alias("soft_start"), first.rlike(r"\p{Ll}").alias("hard_start"),
    )
    may = F.col("hard_start") & (F.length("head") > 1)
    if dictionary is None:
        return flagged.withColumn("very_hard_start", F.lit(False)).drop("head")
    if test := _membership(dictionary):
        return flagged.withColumn("very_hard_start", may & test(F.array("head"))[0]).drop("head")
    known = dictionary.select(F.col("word").alias("head"), F.lit(True).alias("known")).distinct()
    return flagged.join(known, "head", "left").withColumn("very_hard_start", may & F.coalesce("known", F.lit(False))).drop("known", "head")


def scanned(kept: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """kept (doc_idx, page_no, frag_no, frag) with its flags, merge, whether it goes on with the fragment before in its document, and sent_no.

    Fragments are dealt out by ranges of their order. Every task scans its own; how the
    last fragment of a range ends and how many sentences its document has so far is then
    carried from range to range, in one row each. No document meets in one task.
    """
    order = ["doc_idx", "page_no", "frag_no"]
    spark = kept.sparkSession
    rows = _starts(kept, dictionary).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    flags = ["ends_soft", "ends_hard", "soft_start", "hard_start", "very_hard_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, last, ends, opened, leading = 0, 0, (False, False), 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            doc = pc.fill_null(batch.column("doc_idx").cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            own = {f: batch.column(f).to_numpy(zero_copy_only=False).astype(bool) for f in flags}
            new = np.append([row > 0 and doc[0] != last], doc[1:] != doc[:-1])
            soft, hard = (np.append([e], own[f][:-1]) & ~new for f, e in zip(flags, ends))
            opens = (~(own["very_hard_start"] | (own["soft_start"] & hard) | (own["hard_start"] & soft))).astype(np.int64)
            if row == 0:
                opens[0] = 0  # not known here
            total = np.cumsum(opens) + opened
            heads = np.flatnonzero(new)
            base = np.zeros(n, np.int64)
            base[heads] = total[heads] - opens[heads]
            count = total - np.maximum.accumulate(base)
            lead = leading & (np.cumsum(new) == 0)
            places = np.arange(row, row + n)
            row, last, ends, opened, leading = row + n, doc[-1], (own["ends_soft"][-1], own["ends_hard"][-1]), int(count[-1]), bool(lead[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(soft), pa.array(hard), pa.array(count), pa.array(lead), pa.array(places)], [*batch.schema.names, "soft_end", "hard_end", "_count", "_lead", "_row"])

    extra = [("soft_end", BooleanType()), ("hard_end", BooleanType()), ("_count", LongType()), ("_lead", BooleanType()), ("_row", LongType())]
    found = written(rows.mapInArrow(run, StructType([*(f if f.name != "_part" else StructField("_part", IntegerType()) for f in rows.schema.fields), *(StructField(c, t) for c, t in extra)])), "fragments")
    edge = lambda which: which(F.struct("doc_idx", *flags, "_count", "_lead"), "_row")
    parts = found.groupBy("_part").agg(edge(F.min_by).alias("a"), edge(F.max_by).alias("z"))
    by = Window.orderBy("_part")  # a row a part
    goes_on = F.lag("_part").over(by).isNotNull() & F.col("a.doc_idx").eqNullSafe(F.lag("z.doc_idx").over(by))
    before = lambda c: F.coalesce(F.col("on") & F.lag(f"z.{c}").over(by), F.lit(False))
    parts = parts.withColumn("on", goes_on)
    parts = parts.withColumn("soft", before("ends_soft")).withColumn("hard", before("ends_hard"))
    first = F.col("a.very_hard_start") | (F.col("a.soft_start") & F.col("hard")) | (F.col("a.hard_start") & F.col("soft"))
    parts = parts.withColumn("opens", F.when(first, 0).otherwise(1))
    own = F.col("z._count") + F.when(F.col("z._lead"), F.col("opens")).otherwise(0)
    parts = parts.withColumn("own", own).withColumn("run", F.sum(F.when(F.col("z._lead") & F.col("on"), 0).otherwise(1)).over(by))
    parts = parts.withColumn("so_far", F.sum("own").over(Window.partitionBy("run").orderBy("_part")))
    ahead = F.when(F.col("on"), F.lag("so_far").over(by)).otherwise(0) + F.col("opens")
    parts = parts.select("_part", "soft", "hard", ahead.alias("ahead"))
    carried = found.join(F.broadcast(parts), "_part")  # as many rows as shuffle partitions
    start = F.col("_row") == 0
    soft, hard = (F.when(start, F.col(c)).otherwise(F.col(f"{c}_end")) for c in ("soft", "hard"))
    return carried.select(
        *kept.columns, soft.alias("soft_end"), hard.alias("hard_end"), "soft_start", "hard_start", "very_hard_start", _merges(soft, hard).alias("merge"),
        (F.col("_count") + F.when(F.col("_lead"), F.col("ahead")).otherwise(0)).alias("sent_no"),
    )


def sentences(flagged: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """(doc_idx, sent_no, page_no, sentence) of scanned() fragments: a sentence belongs to the page it starts on."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "frag_no", "frag"))), lambda f: f["frag"]), " ")
    whole = flagged.groupBy("doc_idx", "sent_no").agg(F.min("page_no").alias("page_no"), joined.alias("sentence"))
    return with_known_words(whole, "sentence", dictionary, longer_than=1)


def segmented_pages(numbered: DataFrame, found: DataFrame, n_ignore: int = 0) -> DataFrame:
    """(doc_idx, page_no, text): every page but the first n_ignore with its sentences by lines, empty if it has none."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))), lambda s: s["sentence"]), "\n")
    texts = found.groupBy("doc_idx", "page_no").agg(lines.alias("text"))
    pages = numbered.select("doc_idx", "page_no").where(F.col("page_no") >= n_ignore)
    return pages.join(texts, ["doc_idx", "page_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def segment(numbered: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    kept = with_known_words(fragments(numbered), "frag", dictionary)
    return sentences(scanned(kept, dictionary), dictionary)
