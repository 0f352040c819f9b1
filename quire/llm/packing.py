"""Packing of tokenised documents into sequences by shortest-pack-first over the length histogram.

Documents are cut into full pieces, which are sequences by themselves, and one rest. The
histogram of the rests has as many bins as a sequence has tokens, whatever the corpus.
From the longest to the shortest, all rests of one length are placed at once: into the
emptiest packs that take them, else into new ones, each step updating how many packs
follow a pattern of lengths. The patterns, laid out one after another, name for each
length which ranks go where; the pieces then find their place by their rank among those
of their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_BYTES, small_batches, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces of one length are ranked in so many independent parts, and in more if these would exceed PART pieces.
PARTS = 64
PART = 1 << 20
#: Bytes that a part takes in the table of parts, about.
PART_BYTES = 40
_GAP = re.compile(r"\s{50000}")


class ByteBpe:
    """Token ids of a byte-level BPE, from the public tokenizer files.

    The rank file holds the same vocabulary as the JSON file and gives the same ids
    several times faster; texts with endless white space, which its pattern engine
    gives up on, go through the JSON file.
    """

    def __init__(self, name: str = "byte_bpe_50k", special: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        self.json = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        special = {"<|endoftext|>": 50256} if special is None else special
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if not _GAP.search(text):
            return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
        from tokenizers import Tokenizer

        return np.array(Tokenizer.from_file(self.json).encode(text, add_special_tokens=False).ids, np.uint32)


def pieces_of(docs: DataFrame, size: int, tokenizer=ByteBpe) -> DataFrame:
    """PIECES: each document's ids and a closing 0, cut after every ``size`` ids."""
    small_batches(docs.sparkSession)

    def run(batches):
        encode = tokenizer()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
                rows += [(doc_id, at, len(cut := ids[at : at + size]), zlib.crc32(cut.tobytes()), len(ids)) for at in range(0, len(ids), size)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; every length is used up."""
    packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by what is filled
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        full: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
        for filled in sorted(packs):
            if not left or filled + length > size:
                break
            for pattern in sorted(packs[filled]):
                n = min(left, packs[filled][pattern])
                left -= n
                packs[filled][pattern] -= n
                longer = pattern + (length,)
                full[filled + length][longer] = full[filled + length].get(longer, 0) + n
                if not left:
                    break
            packs[filled] = {p: n for p, n in packs[filled].items() if n}
        while left:  # new packs, with as many of this length as fit
            many = min(size // length, left)
            n = left // many
            left -= n * many
            pattern = (length,) * many
            full[length * many][pattern] = full[length * many].get(pattern, 0) + n
        for filled, patterns in full.items():
            for pattern, n in patterns.items():
                packs[filled][pattern] = packs[filled].get(pattern, 0) + n
    return [(p, n) for filled in sorted(packs, reverse=True) for p, n in sorted(packs[filled].items()) if n]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): ranks first..end-1 go to first sequence + rank - first."""
    found, used, sequence = [], defaultdict(int), 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            found.append((length, used[length], used[length] + n, sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return found


def ranked(pieces: DataFrame, histogram: dict[int, int], part: int = PART, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pieces with their rank (from 0, without gaps) among those of the same length.

    No window spans a length: each is ranked in PARTS parts, or as many as its count in
    the histogram needs for about ``part`` pieces each, which the counts of the parts
    before them then shift. These counts go to all tasks only while they stay under
    broadcast_bytes.
    """
    parts = {length: max(PARTS, n // part + 1) for length, n in histogram.items()}
    of = pieces.sparkSession.createDataFrame(list(parts.items()), "length long, parts long")  # a row a length
    split = pieces.join(F.broadcast(of), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "parts")).drop("parts")
    counts = split.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    if sum(parts.values()) * PART_BYTES <= broadcast_bytes:
        shift = F.broadcast(shift)
    inner = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    return split.withColumn("rank", F.row_number().over(inner) - 1).join(shift, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("part", "shift")


def pack(docs: DataFrame, size: int = 1024, tokenizer=ByteBpe) -> DataFrame:
    """PIECES, sequence_id and offset of every piece of docs (doc_id, text).

    Null texts count as empty: such a document is its closing id alone. A null doc_id
    stays null; repeated rows are packed one by one. Texts of any length are tokenised
    whole. No rows: no rows. Other columns are not read. sequence_id runs from 0 without gaps; a sequence's pieces follow one
    another from offset 0.
    """
    spark = docs.sparkSession
    pieces = stored(pieces_of(docs, size, tokenizer), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most size rows
    full = histogram.get(size, 0)
    patterns = ([((size,), full)] if full else []) + shortest_pack_first({length: n for length, n in histogram.items() if length != size}, size)
    places = spark.createDataFrame(slots(patterns), "length long, first long, last long, sequence long, offset long")
    # Bounded: a length enters each pattern of which there are at most size new ones a step.
    by_length = places.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "last", "sequence", "offset"))).alias("places"))
    placed = ranked(pieces, histogram).join(F.broadcast(by_length), "length")
    place = F.filter("places", lambda p: (p["first"] <= F.col("rank")) & (F.col("rank") < p["last"]))[0]
    return placed.withColumn("place", place).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("place.sequence") + F.col("rank") - F.col("place.first")).alias("sequence_id"), F.col("place.offset").alias("offset"),
    )
