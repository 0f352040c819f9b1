"""The index: pages, documents, tokens, vocabulary, postings and page vectors as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from quire.functions.text import text_words, words
from quire.operators import embed, segment
from quire.operators.blocks import FIELDS, GROUPED, joined_groups, moved_blocks, position_bits, posting_blocks, text_blocks, word_pages, word_places
from quire.operators.matrix import vector_blocks, vector_rows
from quire.operators.ranks import running, shuffle_partitions, written
from quire.operators.word_vectors import train_word_vectors


def number_pages(pages: DataFrame, tokens: bool = False, texts: bool = True) -> DataFrame:
    """(doc_name, page_key, text) with doc_idx, page_no, page_idx and page_start, the document's first page, all from 0.

    Pages are numbered in the order of document and key, documents in that of their names.
    tokens: also what tokenised() makes, in the same pass; texts: whether those who read it
    need the texts too. Pages are dealt out by ranges of that order and numbered in their
    part; where a document runs on from part to part is told by one row a part, so no
    document, however long, meets in one task.
    """
    order = [F.col("doc_name"), F.col("page_key")]
    rows = pages.select("doc_name", "page_key", "text").repartitionByRange(shuffle_partitions(pages.sparkSession), *order).sortWithinPartitions(*order)
    if tokens:
        rows = _with_tokens(rows)  # after the shuffle, whose sampling would normalise all texts once more
    if not texts:
        rows = rows.drop("text")

    def places(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Number of the document, first row of it, row, and tokens ahead, in the part."""
        row, doc, start, ahead, last, first = 0, 0, 0, 0, None, True
        for column, counts in batches:
            names = column.to_pylist()
            docs, starts = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            for i, name in enumerate(names):
                if not first and name != last:
                    doc, start = doc + 1, row + i
                first, last, docs[i], starts[i] = False, name, doc, start
            sizes = np.cumsum(counts.to_numpy(zero_copy_only=False))
            before = np.append(0, sizes)[: len(names)] + ahead
            ahead += int(sizes[-1]) if len(sizes) else 0
            extra = [docs, starts, np.arange(row, row + len(names)), before]
            row += len(names)
            yield pa.StructArray.from_arrays([pa.array(e, pa.int64()) for e in extra], ["_doc", "_doc_row", "_row", "_sum"])

    place = F.arrow_udf(places, "_doc long, _doc_row long, _row long, _sum long", ArrowUDFType.SCALAR_ITER).asNondeterministic()  # texts stay outside Python
    counts = F.col("n_tokens") if tokens else F.lit(0).cast("long")
    numbered = rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", place("doc_name", counts))
    placed = written(numbered.select("*", "_at.*").drop("_at"), "pages")
    return _joined(placed, _parts(placed, tokens), [*(["text"] if texts else []), *(["n_tokens", "tokens"] if tokens else [])], tokens)


def _parts(placed: DataFrame, tokens: bool) -> DataFrame:
    """(_part, rows_ahead, sums_ahead, docs_ahead, first_start) of pages that are numbered in their parts: what is added to those numbers."""
    size = F.max(F.col("_sum") + F.col("n_tokens")) if tokens else F.lit(0)
    parts = placed.groupBy("_part").agg(
        F.count("*").alias("rows"), (F.max("_doc") + 1).alias("docs"), F.min_by("doc_name", "_row").alias("first"), F.max_by("doc_name", "_row").alias("last"),
        F.max("_doc_row").alias("last_start"), size.alias("sums"),
    )
    by = Window.orderBy("_part")  # a row a part
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    parts = parts.withColumn("on", F.coalesce((F.lag("_part").over(by).isNotNull() & F.col("first").eqNullSafe(F.lag("last").over(by))).cast("int"), F.lit(0)))
    parts = parts.withColumn("rows_ahead", ahead("rows")).withColumn("sums_ahead", ahead("sums")).withColumn("docs_ahead", ahead(F.col("docs") - F.col("on")) - F.col("on"))
    parts = parts.withColumn("open", F.when((F.col("docs") > 1) | (F.col("on") == 0), F.col("rows_ahead") + F.col("last_start")))
    parts = parts.withColumn("first_start", F.when(F.col("on") == 1, F.last("open", True).over(earlier)).otherwise(F.col("rows_ahead")))
    return parts.select("_part", "rows_ahead", "sums_ahead", "docs_ahead", "first_start")


def _joined(placed: DataFrame, parts: DataFrame, more: list[str], tokens: bool) -> DataFrame:
    """Pages that are numbered in their parts with their numbers in the whole."""
    found = placed.join(F.broadcast(parts), "_part")  # as many rows as shuffle partitions
    page, start = F.col("_row") + F.col("rows_ahead"), F.when(F.col("_doc") == 0, F.col("first_start")).otherwise(F.col("_doc_row") + F.col("rows_ahead"))
    sums = [(F.col("_sum") + F.col("sums_ahead")).alias("sidx_start")] if tokens else []
    return found.select("doc_name", (F.col("_doc") + F.col("docs_ahead")).alias("doc_idx"), (page - start).alias("page_no"), page.alias("page_idx"), start.alias("page_start"), "page_key", *more, *sums)


def word_bounds(pages: DataFrame, groups: int = 512, most: int = 500, length: int = 2000) -> list[str]:
    """Words in order that part all words into groups of about as many tokens each, by the beginnings of the ``most`` pages of least hash.

    They only say which words travel together.
    """
    few = pages.orderBy(F.xxhash64("doc_name", "page_key")).limit(most).select(F.substring("text", 1, length).alias("text")).toArrow()
    tokens, _ = text_words(few.column("text").combine_chunks())
    found = tokens.take(pc.sort_indices(tokens))
    return sorted(set(found.take(pa.array(np.arange(1, groups) * len(found) // groups)).to_pylist())) if len(found) else []


def posted(pages: DataFrame, texts: bool = True, bounds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages (doc_name, page_key, text), numbered as number_pages() does, with n_tokens and sidx_start, and their posting blocks.

    texts: whether the numbered pages keep them; bounds: the blocks come in groups, as
    blocks.joined_groups() takes them, of the words between them. Each part is read once and makes the rows
    of its pages and its blocks, both written with numbers of their part; what lies ahead
    of the part is added by those who read them.
    """
    order = [F.col("doc_name"), F.col("page_key")]
    rows = pages.select("doc_name", "page_key", "text").repartitionByRange(shuffle_partitions(pages.sparkSession), *order).sortWithinPartitions(*order)
    made = written(text_blocks(rows, texts, bounds), "posted")
    placed = made.where("word is null")
    parts = written(_parts(placed, True), "parts")
    lists = made.where("word is not null").join(F.broadcast(parts), "_part")
    moved = [(F.col(c) + F.col(by)).alias(c) for c, by in (("first_page", "rows_ahead"), ("last_page", "rows_ahead"), ("start", "sums_ahead"))]
    return _joined(placed, parts, [*(["text"] if texts else []), "n_tokens"], True), lists.select("word", *moved, *(FIELDS if bounds is None else GROUPED)[4:])


def doc_dim(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("doc_idx", "doc_name").agg(
        F.min("page_idx").alias("page_start"), (F.max("page_idx") + 1).alias("page_end"), F.count("*").alias("n_pages")
    )


def _with_tokens(rows: DataFrame) -> DataFrame:
    """rows (text, ..) with n_tokens and tokens."""
    return rows.withColumn("tokens", words(F.col("text"))).withColumn("n_tokens", F.size("tokens").cast("long"))


def tokenised(numbered: DataFrame) -> DataFrame:
    """(doc_idx, page_no, page_idx, n_tokens, tokens, sidx_start): every page with its words and how many tokens come before it.

    Written in the order of pages, so that the texts are normalised once, whoever reads the tokens.
    """
    columns = ["doc_idx", "page_no", "page_idx", "n_tokens", "tokens", "sidx_start"]
    if "tokens" in numbered.columns:
        return numbered.select(*columns)
    rows = numbered.select("doc_idx", "page_no", "page_idx", "text")
    counted = running(rows, [F.col("page_idx")], "n_tokens", lambda df: _with_tokens(df).drop("text"))
    return counted.withColumnRenamed("sum_before", "sidx_start").select(*columns)


def page_dim(pages: DataFrame) -> DataFrame:
    """page_idx, doc_idx, page_no, n_tokens and sidx_start, the tokens before the page, of tokenised pages."""
    return pages.select("page_idx", "doc_idx", "page_no", "n_tokens", "sidx_start")


def page_tokens(pages: DataFrame) -> DataFrame:
    """(doc_idx, page_idx, pos, word) of tokenised pages."""
    return pages.select("doc_idx", "page_idx", F.posexplode("tokens").alias("pos", "word"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """(word, cnt, widxord, cumcnt): ranks by falling count, then word; counts up to and with the word.

    rows: one a token (word), or blocks of postings or the like, which say how many they stand for (n).
    """
    counts = rows.groupBy("word").agg((F.sum("n") if "n" in rows.columns else F.count("*")).cast("long").alias("cnt"))
    ranked = running(counts, [F.desc("cnt"), F.asc("word")], "cnt")
    return ranked.select("word", "cnt", F.col("row_before").alias("widxord"), (F.col("sum_before") + F.col("cnt")).alias("cumcnt"))


def first_seen(posting_rows: DataFrame) -> DataFrame:
    """(word, widx): words by their first place in the corpus."""
    first = posting_rows.groupBy("word").agg(F.min("sidx").alias("first"))
    return running(first, [F.col("first")]).select("word", F.col("row_before").alias("widx"))


def pages_of_positions(positions: DataFrame, pages: DataFrame, width: int = 4096) -> DataFrame:
    """(sidx, page_idx) of positions (sidx), by equal buckets of width positions instead of a range join.

    Pages are few beside positions: a task holds its buckets' pages, and positions stream by unsorted.
    """
    filled = pages.where("n_tokens > 0")
    end = F.col("sidx_start") + F.col("n_tokens")
    spread = filled.select("page_idx", "sidx_start", end.alias("sidx_end"), F.explode(F.sequence((F.col("sidx_start") / width).cast("long"), ((end - 1) / width).cast("long"))).alias("bucket"))
    found = positions.withColumn("bucket", (F.col("sidx") / width).cast("long")).join(spread.hint("shuffle_hash"), "bucket")
    return found.where("sidx >= sidx_start and sidx < sidx_end").select("sidx", "page_idx")


def integrity(postings: DataFrame) -> DataFrame:
    """Each position from 0 to the last is held once; postings: their blocks, or rows (sidx).

    Positions are counted as bits of ranges, so neither a row a token is shuffled nor held.
    """
    ranges = position_bits(postings).groupBy("bucket").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("held"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    found = ranges.agg(total("n").alias("n_postings"), total("held").alias("n_positions"), F.max("last").alias("last"))
    return found.withColumn("sound", (F.col("n_postings") == F.col("n_positions")) & (F.col("n_postings") == F.coalesce(F.col("last") + 1, F.lit(0))))


@dataclass
class Index:
    """A built index; each part is a DataFrame. The vectors are there if it was built or opened with them.

    blocks are the posting lists, see operators/blocks.py; vector_blocks the page vectors, see operators/matrix.py.
    known_vocab is the vocabulary of a saved index; another one's is made when it is first asked for.
    """

    pages: DataFrame
    page_dim: DataFrame
    doc_dim: DataFrame
    blocks: DataFrame
    known_vocab: DataFrame | None = None
    word_vectors: DataFrame | None = None
    vector_blocks: DataFrame | None = None
    component: DataFrame | None = None
    moments: DataFrame | None = None
    saved: bool = False

    PARTS = ("pages", "page_dim", "doc_dim", "blocks", "vocab")
    VECTORS = ("word_vectors", "vector_blocks", "component", "moments")
    #: Rows of word vectors in a file, at most.
    FILE_ROWS = 1_000_000
    #: Bytes of a row group of blocks: what a reader can skip.
    GROUP_BYTES = 2 << 20

    @property
    def vocab(self) -> DataFrame:
        if self.known_vocab is None:
            self.known_vocab = vocabulary(self.blocks)
        return self.known_vocab

    @property
    def page_vectors(self) -> DataFrame | None:
        """(page_idx, vec) of the pages that have a vector."""
        return None if self.vector_blocks is None else vector_rows(self.vector_blocks)

    @property
    def postings(self) -> DataFrame:
        """(word, page_idx, pos, sidx) of all tokens."""
        return word_places(self.blocks)

    def lookup(self, *asked: str) -> DataFrame:
        """(word, page_idx, pos, sidx) of the words asked for; what is read of a saved index are the row groups that may hold them."""
        return word_places(self.blocks.where(F.col("word").isin(*asked)))

    def save(self, path: str) -> None:
        """Parquet, over what is there; what is looked up by words lies by words, blocks also by page and in small row groups, so a lookup reads few of them.

        Vectors of an index that has none any more are emptied. Blocks in groups are joined; a vocabulary that is not known yet is that of the saved blocks.
        """
        spark = self.pages.sparkSession
        for part in (*self.PARTS, *self.VECTORS):
            df = vocabulary(spark.read.parquet(f"{path}/blocks")) if part == "vocab" and self.known_vocab is None else getattr(self, part)
            if df is None:
                df = spark.createDataFrame([], "none int")
            order = {"blocks": ["word", "first_page"], "vocab": ["word"], "word_vectors": ["word"]}.get(part, [])
            if order and order[0] in df.columns:
                df = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
            if part == "blocks" and "heads" in df.columns:
                df = joined_groups(df)
            writer = df.write.mode("overwrite").option("maxRecordsPerFile", self.FILE_ROWS if part == "word_vectors" else 0)
            (writer.option("parquet.block.size", self.GROUP_BYTES) if part.endswith("blocks") else writer).parquet(f"{path}/{part}")


def build_index(raw_pages: DataFrame, dictionary: DataFrame | None = None, segmented: bool = False, texts: bool = True) -> Index:
    """Index of raw_pages (doc_name, page_key, text).

    segmented: pages hold their sentences, one a line, and what is no sentence goes;
    dictionary (word) says which lines and sentences count, without one any letter does.
    texts: False leaves out the texts of an index that is only searched; what trains on it
    or merges it needs them.
    """
    if segmented:
        numbered = number_pages(raw_pages)
        lines = segment.segmented_pages(numbered, segment.segment(numbered, dictionary))
        numbered = numbered.drop("text").join(lines, ["doc_idx", "page_no"])
        tokens = tokenised(numbered)
        lists = written(posting_blocks(tokens), "blocks")
    else:
        numbered, lists = posted(raw_pages, texts)
        tokens = numbered
    pages = numbered.select("doc_name", "doc_idx", "page_no", "page_idx", "page_key", *(["text"] if texts else []))
    return Index(pages, page_dim(tokens), doc_dim(numbered), lists)


def build_saved(raw_pages: DataFrame, path: str) -> Index:
    """build_index() of raw_pages (doc_name, page_key, text) that is saved at path and opened.

    Its short blocks travel in groups, so that neither a row for each word of each slice of pages is written nor shuffled.
    """
    numbered, groups = posted(raw_pages, True, word_bounds(raw_pages))
    pages = numbered.select("doc_name", "doc_idx", "page_no", "page_idx", "page_key", "text")
    Index(pages, page_dim(numbered), doc_dim(numbered), groups).save(path)
    return open_index(raw_pages.sparkSession, path)


def page_sentences(pages: DataFrame) -> DataFrame:
    """(tokens): the words of each line of pages (text), one row a line; a segmented index has a sentence a line."""
    return pages.select(F.explode(F.split("text", "\n")).alias("line")).select(words(F.col("line")).alias("tokens"))


def embed_pages(made: Index, word_vectors: DataFrame | None = None, component: list[float] | None = None, earlier: embed.Moments | None = None, **training) -> Index:
    """made with vectors of words (word, vec), trained unless given, and of its pages, less their first component.

    training: see word_vectors.train_word_vectors(). The component is that of the pages
    unless given; earlier: moments of pages indexed before, which it then covers too. The
    moments of all are kept with the index.
    """
    if word_vectors is None:
        word_vectors = train_word_vectors(page_sentences(made.pages), **training)
    spark = made.pages.sparkSession
    means = written(embed.sif_vectors(word_pages(made.blocks), made.vocab, word_vectors, embed.dimension(word_vectors)), "means")
    moments = None
    if component is None:
        moments = embed.vector_moments(means)
        moments = moments if earlier is None else earlier.merged(moments)
        component = moments.component()
    ordered = means.repartitionByRange(shuffle_partitions(spark), "page_idx").sortWithinPartitions("page_idx")
    blocks = written(vector_blocks(embed.page_vectors(ordered, component)), "vectors")  # a search reads them several times
    return replace(made, word_vectors=word_vectors, vector_blocks=blocks, component=embed.component_rows(spark, component), moments=moments and moments.rows(spark))


def open_index(spark: SparkSession, path: str) -> Index:
    """The index that was saved at path; nothing is read before it is asked for."""
    parts = {part: spark.read.parquet(f"{path}/{part}") for part in (*Index.PARTS, *Index.VECTORS)}
    return Index(saved=True, known_vocab=parts.pop("vocab"), **{part: None if df.columns == ["none"] else df for part, df in parts.items()})


def merged(parts: list[Index], gone: DataFrame | None = None) -> Index:
    """One index of parts that were built or opened on their own, as if it had been built of all their pages at once.

    Documents of a later part replace those of the same name; those that gone (doc_name)
    names go. Documents are numbered anew by running ranks of their names, and pages and
    places move with them; neither texts nor tokens are read, only posting blocks are coded
    again. Page vectors hang on the counts of all words: embed_pages() makes them for the
    whole, word_vectors of the first part that has some are kept for that.
    """
    spark = parts[0].pages.sparkSession
    own = [p.doc_dim.select(F.lit(i).alias("part"), "doc_name", F.col("doc_idx").alias("old_doc"), F.col("page_start").alias("old_start"), "n_pages") for i, p in enumerate(parts)]
    every = reduce(DataFrame.unionByName, own)
    last = every.groupBy("doc_name").agg(F.max("part").alias("part"))
    stay = every.join(last, ["doc_name", "part"])
    if gone is not None:
        stay = stay.join(gone.select("doc_name"), "doc_name", "left_anti")
    docs = running(stay, [F.col("doc_name")], "n_pages").withColumnRenamed("row_before", "doc_idx").withColumnRenamed("sum_before", "page_start")
    dims = [
        p.page_dim.select(F.col("page_idx").alias("old_page"), F.col("doc_idx").alias("old_doc"), "page_no", "n_tokens")
        .join(docs.where(F.col("part") == i).select("part", "old_doc", "doc_idx", "page_start"), "old_doc") for i, p in enumerate(parts)
    ]
    numbered = reduce(DataFrame.unionByName, dims).select("part", "old_page", (F.col("page_start") + F.col("page_no")).alias("page_idx"), "doc_idx", "page_no", "n_tokens")
    dim = running(numbered, [F.col("page_idx")], "n_tokens").drop("row_before").withColumnRenamed("sum_before", "sidx_start")
    moves = lambda i: dim.where(F.col("part") == i).select(F.col("old_page").alias("page_idx"), F.col("page_idx").alias("new_page"), F.col("sidx_start").alias("new_start"))
    lists = written(reduce(DataFrame.unionByName, [moved_blocks(p.blocks, moves(i)) for i, p in enumerate(parts)]), "blocks")
    names = docs.select("doc_name", "part", "doc_idx", "page_start")
    texts = [p.pages.select("doc_name", "page_no", "page_key", "text").withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    pages = reduce(DataFrame.unionByName, texts).join(names, ["doc_name", "part"]).select("doc_name", "doc_idx", "page_no", (F.col("page_start") + F.col("page_no")).alias("page_idx"), "page_key", "text")
    bounds = docs.select("doc_idx", "doc_name", "page_start", (F.col("page_start") + F.col("n_pages")).alias("page_end"), "n_pages")
    known = next((p.word_vectors for p in parts if p.word_vectors is not None), None)
    return Index(pages, dim.select("page_idx", "doc_idx", "page_no", "n_tokens", "sidx_start"), bounds, lists, None, known)


def open_segments(spark: SparkSession, path: str, gone: DataFrame | None = None) -> Index:
    """merged() of the indexes in the folders ``segment=N`` of path, later ones last; see streaming.ingest.append_segments()."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = [s.getPath().toString() for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    numbered = sorted((int(f.rsplit("=", 1)[1]), f) for f in found if "/segment=" in f)
    return merged([open_index(spark, f) for _, f in numbered], gone)
