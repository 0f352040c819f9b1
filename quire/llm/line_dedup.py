"""Lines repeated across documents, found through a sharded minimal perfect hash.

A line's identity is the 128-bit hash of its key. All distinct hashes are cut into shards
by their bits; each shard is a minimal perfect hash (levels of bit arrays; a hash rests at
the first level where no other has its place) that numbers its hashes without gaps. Under
that number lie a 32-bit fingerprint and the number of documents that hold the line, in a
byte where the threshold allows; the largest document follows for counts that reach the
threshold, under the number's rank among those. Documents probe these arrays; no line is
joined with another. A hash that isn't in the index fails the fingerprint.

Probes go to their shard in parts of bounded size, as many as the shard has probes for, so
that a line which a third of the documents hold fills no task. Only what is to be dropped
returns to the documents. The index is never broadcast and works alike at every size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACE, drop_stored, small_batches, stored

#: Hashes in a shard, about.
SHARD = 1 << 18
#: Rows that one task holds against a shard, about.
PART = 1 << 20
LEVELS = 40
SHARD_SCHEMA = "shard int, sizes array<long>, bits binary, prints binary, counts binary, last binary, rest binary, least long"
_LEAST_ID = -(1 << 63)


def line_key(line: str, least: int) -> bytes | None:
    """The key whose hash identifies the line; None for lines that are too short."""
    bare = line.strip(SPACE)
    return bare.encode("utf-8", "surrogatepass").lower() if len(bare) >= least else None


def line_hashes(lines: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): the lines that are long enough, and (n, 2) halves of their hashes."""
    digest = xxhash.xxh3_128_digest
    places, found = [], []
    for i, line in enumerate(lines):
        if (key := line_key(line, least)) is not None:
            places.append(i)
            found.append(digest(key))
    return np.array(places, np.int64), np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes[:, 0] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where level puts hashes: a mixed and multiplied form, modulo the level's size."""
    x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


@dataclass
class Shard:
    """One minimal perfect hash and its arrays."""

    sizes: list[int]
    words: np.ndarray  # the levels' bits, one after another, 64 in a word
    prints: np.ndarray  # 32 bits of the second halves
    counts: np.ndarray  # documents, up to what the type holds
    last: np.ndarray  # the largest document of counts of at least ``least``, by rank
    rest: np.ndarray  # (n, 2) hashes that no level could place, numbered after all others; next to never any
    least: int

    def __post_init__(self):
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.rank = np.cumsum(self.counts >= self.least) - 1

    @staticmethod
    def build(hashes: np.ndarray, counts: np.ndarray, last: np.ndarray, least: int) -> Shard:
        """hashes are distinct. Those that share their first half with another stay unplaced."""
        sizes, bits, left = [], [], np.arange(len(hashes))
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-max(64, 2 * len(left)) // 64) * 64
            at = _place(hashes[left, 0], level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        words = np.frombuffer(np.packbits(np.concatenate(bits), bitorder="little").tobytes(), "<u8") if bits else np.zeros(0, "<u8")
        none = np.zeros(0, "<u8")
        number = Shard(sizes, words, none, none, none, none, least).numbers(hashes[:, 0])
        number[left] = len(hashes)
        order = np.argsort(number, kind="stable")
        kind = np.dtype("u1") if least < 256 else np.dtype("<u4")
        few = np.minimum(counts[order], np.iinfo(kind).max).astype(kind)
        prints = (hashes[order, 1] >> np.uint64(32)).astype("<u4")
        return Shard(sizes, words, prints, few, last[order][few >= least].astype("<i8"), hashes[left], least)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The hash's number, or -1; hashes of the index get different numbers."""
        found, left, start = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = start + _place(h[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            left, start = left[~hit], start + size
        return found

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash in the index, -1 for others."""
        n = self.numbers(hashes[:, 0])
        n[(n >= 0) & (self.prints[n] != (hashes[:, 1] >> np.uint64(32)))] = -1
        for extra, (a, b) in enumerate(self.rest, len(self.prints) - len(self.rest)):
            n[(hashes[:, 0] == a) & (hashes[:, 1] == b)] = extra
        return n

    def dropped(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which hashes enough documents hold, the largest of them not that of ids."""
        n = self.probe(hashes)
        hit = np.flatnonzero((n >= 0) & (self.counts[n] >= self.least))
        out = np.zeros(len(hashes), bool)
        out[hit] = self.last[self.rank[n[hit]]] != ids[hit]
        return out

    def row(self, shard: int) -> dict:
        parts = dict(zip(("bits", "prints", "counts", "last", "rest"), (self.words, self.prints, self.counts, self.last, self.rest)))
        return {"shard": shard, "sizes": self.sizes, "least": self.least} | {name: x.tobytes() for name, x in parts.items()}

    @staticmethod
    def of(row: dict) -> Shard:
        count = "u1" if row["least"] < 256 else "<u4"
        arrays = [np.frombuffer(row[c], t) for c, t in (("bits", "<u8"), ("prints", "<u4"), ("counts", count), ("last", "<i8"), ("rest", "<u8"))]
        return Shard(list(row["sizes"]), *arrays[:4], arrays[4].reshape(-1, 2), row["least"])


def held_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id): the distinct line hashes of each document of docs (doc_id, text)."""

    def run(batches):
        for b in batches:
            ids, hashes = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.unique(line_hashes((text or "").split("\n"), min_chars)[1], axis=0)
                hashes.append(h)
                ids.append(np.full(len(h), doc_id, np.int64))
            h = np.concatenate(hashes) if hashes else np.zeros((0, 2), "<u8")
            halves = [pa.array(h[:, k].copy().view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*halves, pa.array(np.concatenate(ids) if ids else [], pa.int64())], ["h1", "h2", "doc_id"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long").distinct()


def shard_number(shards: int):
    return F.shiftrightunsigned(F.shiftrightunsigned("h1", 32) * F.lit(shards), 32).cast("int").alias("shard")


def line_index(lines: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """SHARD_SCHEMA, one row a shard of the distinct lines (h1, h2, n, last)."""

    def build(table: pa.Table) -> pa.Table:
        h = np.stack([table.column(c).to_numpy() for c in ("h1", "h2")], axis=1).view("<u8")
        made = Shard.build(h, table.column("n").to_numpy(), table.column("last").to_numpy(), min_docs)
        return pa.Table.from_pylist([made.row(int(shard_of(h[:1], shards)[0]))], table_schema)

    table_schema = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("bits", "prints", "counts", "last", "rest")), ("least", pa.int64())])
    return lines.groupBy(shard_number(shards)).applyInArrow(build, SHARD_SCHEMA)


def dropped_lines(held: DataFrame, index: DataFrame, shards: int, part: int = PART) -> DataFrame:
    """(doc_id, found array<struct<h1, h2>>): the hashes of lines that each document of held (h1, h2, doc_id) loses."""
    probes = held.select(shard_number(shards), "h1", "h2", "doc_id")
    parts = probes.groupBy("shard").agg((F.count("*") / part).cast("int").alias("parts"))  # a row a shard
    left = probes.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "h1"), F.col("parts") + 1).cast("int")).drop("parts")
    right = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts")))).drop("parts")

    def probe(rows: pa.Table, shard: pa.Table) -> pa.Table:
        rows = rows.select(["doc_id", "h1", "h2"])
        if not shard.num_rows or not rows.num_rows:
            return rows.slice(0, 0)
        h = np.stack([rows.column(c).to_numpy() for c in ("h1", "h2")], axis=1).view("<u8")
        return rows.filter(pa.array(Shard.of(shard.to_pylist()[0]).dropped(h, rows.column("doc_id").to_numpy())))

    hits = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(probe, "doc_id long, h1 long, h2 long")
    return hits.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("found"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, part: int = PART, shard: int = SHARD) -> DataFrame:
    """doc_id, kept_text, n_lines and n_dropped of every row of docs (doc_id, text).

    Texts are split at \\n; null and empty texts are one empty line. A line's key is
    the line without white space at both ends and with A-Z in lower case. Keys of at
    least min_chars code points in at least min_docs documents lose all their lines
    but those in the largest doc_id that holds it. Repeated rows are one document: all
    of them keep or lose a line alike. A null doc_id ranks below all others. Long texts
    and lines are read whole, a batch of rows at a time. No rows: no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = stored(held_lines(rows.select(F.coalesce("doc_id", F.lit(_LEAST_ID)).alias("doc_id"), "text"), min_chars), "held")
    lines = stored(held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")), "lines")
    shards = lines.count() // shard + 1
    index = stored(line_index(lines, shards, min_docs), "index")
    drop_stored(lines)
    dropped = stored(dropped_lines(held, index, shards, part), "dropped")
    drop_stored(held, index)
    joined = rows.join(dropped.withColumnRenamed("doc_id", "id"), F.coalesce("doc_id", F.lit(_LEAST_ID)) == F.col("id"), "left").select("doc_id", "text", "found")

    def run(batches):
        for b in batches:
            out = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                lines, gone = text.split("\n"), set()
                if found:
                    places, h = line_hashes(lines, min_chars)
                    drops = {(x["h1"], x["h2"]) for x in found}
                    gone = {p for p, key in zip(places.tolist(), map(tuple, h.view(np.int64).tolist()), strict=True) if key in drops}
                out.append((doc_id, "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text, len(lines), len(gone)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "kept_text", "n_lines", "n_dropped"])

    return joined.mapInArrow(run, "doc_id long, kept_text string, n_lines long, n_dropped long")
