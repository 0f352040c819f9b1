"""Passages that occur earlier in the corpus, by Rabin-Karp hashes of word windows.

A window is a fixed number of consecutive words of one row. Its hash is two polynomials
over the words' 64-bit hashes, each rolled over the row by prefix sums; 64 bits of the
one and 32 of the other stand for the word sequence. Two passes see every window of every
row. In the first all are counted in Spark by 64 bits of their hash. Hashes that occur
again set bits of a filter of fixed size; a window whose bit is unset is alone.

In the second pass a task keeps of the equal windows in a batch of rows the first, since
the others have an earlier one for certain. The rest are shuffled by their whole hash and
numbered in the order of document, start and row: all but the first are repeated. Windows
that go merge with those that touch them into maximal intervals, which are removed.

The filter saves shuffling; it decides nothing, and as it fills up just more windows are
shuffled whole. At the end what was found goes to the rows: to all tasks while it is under
a checked bound, else by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_BYTES, drop_stored, partition_keys, partitions, placed, small_batches, stored

#: Odd multipliers of the two polynomials, modulo 2**64, and their inverses.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
#: Bits of the filter: 32 MB, whatever the size of the input.
FILTER_BITS = 28
#: A row's name: its doc_id and, where that is null or not its own, its place (else zeros).
NAME = ("doc_id", "file", "row")
#: Windows, and runs of windows that have an earlier one in their batch (start -1).
WINDOWS = "h1 long, h2 int, doc_id long, start int, file long, row long, runs binary"
#: Stands for a null doc_id: after all others.
_NO_ID = (1 << 63) - 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Rabin-Karp hashes of all runs of ``size`` words, with powers kept for the longest row so far."""

    def __init__(self):
        self.up, self.down = [_powers(b, 1) for b in _BASES], [_powers(b, 1) for b in _INVERSES]

    def __call__(self, words: np.ndarray, size: int, which: int) -> np.ndarray:
        n = len(words)
        if n < size:
            return np.zeros(0, np.uint64)
        if len(self.up[which]) < n + 1:
            self.up[which], self.down[which] = _powers(_BASES[which], 2 * n), _powers(_INVERSES[which], 2 * n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * self.up[which][:n])))
        h = (sums[size:] - sums[:-size]) * self.down[which][: n - size + 1]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93)


def runs_of(starts: np.ndarray) -> np.ndarray:
    """(first, last) of each run of consecutive starts."""
    at = np.unique(starts.astype("<i4"))
    turn = np.flatnonzero(np.diff(at) > 1)
    return np.stack([at[np.concatenate(([0], turn + 1))], at[np.concatenate((turn, [len(at) - 1]))]], axis=1)


def hashes_of(rows: DataFrame, window: int, keys: list[int]) -> DataFrame:
    """(bucket, hashes array<long>): 64 bits of the hash of each window of rows (text), by range of the hash, each with one of keys.

    A batch names each hash once, or twice where it occurs more often; arrays keep what is
    shuffled at eight bytes a window.
    """

    def run(batches):
        roll, buckets = Rolling(), len(keys)
        edges, names = np.array([-(-(i << 64) // buckets) for i in range(buckets)], np.uint64), np.array(keys, np.int32)
        for b in batches:
            found = [roll(word_hashes(words_of(text)), window, 0) for text in b.column(0).to_pylist()]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            h = np.repeat(h, np.minimum(n, 2))
            cut = np.append(np.searchsorted(h, edges), len(h)).astype(np.int32)
            some = np.flatnonzero(np.diff(cut))
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut[some], len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), lists], ["bucket", "hashes"])

    return rows.select("text").mapInArrow(run, "bucket int, hashes array<long>")


def repeated_filter(rows: DataFrame, window: int, bits: int = FILTER_BITS) -> np.ndarray:
    """Bytes of a filter by the first bits of the hashes that more than one window has."""
    n = partitions(rows.sparkSession)
    each = hashes_of(rows, window, partition_keys(rows.sparkSession, n)).repartition(n, "bucket").select("bucket", F.explode("hashes").alias("h"))
    again = each.groupBy("bucket", "h").count().where("count > 1")  # where the bucket lies, so nothing is shuffled again
    bit = F.shiftrightunsigned("h", 64 - bits) + 1
    parts = stored(again.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")), "filter")
    found = np.zeros((1 << bits) // 8, np.uint8)
    for part, some in parts.toLocalIterator():  # 4 KB each, together the filter
        some = np.frombuffer(bytes(some), np.uint8)[: len(found)]
        found[(part - 1) * 4096 :][: len(some)] = some
    drop_stored(parts)
    return found


def passes(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> np.uint64(64 - 3 - len(known).bit_length() + 1)
    return (known[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _of_batch(names: np.ndarray, texts: list[str | None], window: int, roll: Rolling, known: np.ndarray) -> pa.RecordBatch:
    """WINDOWS of some rows that pass the filter; names (rows, 3) tell the rows apart."""
    h1, h2, at = [], [], []
    for text in texts:
        words = word_hashes(words_of(text))
        h = roll(words, window, 0)
        some = np.flatnonzero(passes(known, h))
        h1.append(h[some])
        h2.append((roll(words, window, 1)[some] >> np.uint64(32)).astype(np.uint32) if len(some) else np.zeros(0, np.uint32))
        at.append(some)
    a, b, start = (np.concatenate(h) if h else np.zeros(0, np.uint64) for h in (h1, h2, at))
    size = np.array([len(x) for x in at], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    # in the order of hash, then document, start and row: the first of each hash goes on
    place = np.empty(len(texts), np.int64)
    place[np.lexsort(names.T[::-1])] = np.arange(len(texts))
    doc = names[owner, 0]
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    twin = np.flatnonzero(x[1:] == x[:-1])
    again = np.zeros(len(a), bool)
    if len(twin):  # only these need the full order
        some = order[np.union1d(twin, twin + 1)]
        some = some[np.lexsort((place[owner[some]], start[some], doc[some], b[some], a[some]))]
        again[some[1:]] = (a[some[1:]] == a[some[:-1]]) & (b[some[1:]] == b[some[:-1]])
    del x, y, order
    own = owner[again]
    edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    blobs = [runs_of(s).tobytes() for s in np.split(start[again], edges[1:])] if len(own) else []
    spread = np.array([xxhash.xxh64_intdigest(blob) for blob in blobs], np.uint64)  # keys that spread
    whose, one = np.concatenate([owner[~again], own[edges]]), ~again
    columns = [
        pa.array(np.concatenate([a[one], spread]).view(np.int64)), pa.array(np.concatenate([b[one].astype(np.uint32), np.zeros(len(blobs), np.uint32)]).view(np.int32)),
        pa.array(names[whose, 0]), pa.array(np.concatenate([start[one], np.full(len(blobs), -1)]).astype(np.int32)), pa.array(names[whose, 1]), pa.array(names[whose, 2]),
        pa.array([None] * int(one.sum()) + blobs, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc_id", "start", "file", "row", "runs"])


def windows_of(rows: DataFrame, window: int, bits: int) -> DataFrame:
    """WINDOWS of rows (doc_id, file, row, text) that may occur twice."""
    held = rows.sparkSession.sparkContext.broadcast(repeated_filter(rows, window, bits))  # of fixed size

    def run(batches):
        roll, known = Rolling(), held.value
        for b in batches:
            names = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            yield _of_batch(names, b.column(3).to_pylist(), window, roll, known)

    return rows.select(*NAME, "text").mapInArrow(run, WINDOWS)


def later_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, file, row, runs binary): by row, the runs of windows whose hash has an earlier one."""
    order = Window.partitionBy("h1", "h2").orderBy("doc_id", "start", "file", "row")
    later = windows.withColumn("nth", F.row_number().over(order)).where("nth > 1 or start < 0")

    def run(batches):
        for b in batches:
            blobs = []
            for starts, runs in zip((s.values for s in b.column(3)), b.column(4).to_pylist(), strict=True):
                known = [np.arange(a, z + 1) for blob in runs for a, z in np.frombuffer(blob, "<i4").reshape(-1, 2)]
                blobs.append(runs_of(np.concatenate([starts.to_numpy(zero_copy_only=False), *known])).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(blobs, pa.binary())], [*NAME, "runs"])

    starts = F.collect_list(F.when(F.col("start") >= 0, F.col("start")))
    return later.groupBy(*NAME).agg(starts.alias("starts"), F.collect_list("runs").alias("runs")).mapInArrow(run, "doc_id long, file long, row long, runs binary")


def covered(runs: bytes | None, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window of the runs: the union of the intervals."""
    edge = np.zeros(n + 1, np.int64)
    if runs:
        pairs = np.frombuffer(runs, "<i4").reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.subtract.at(edge, pairs[:, 1] + window, 1)
    return np.cumsum(edge)[:n] > 0


def named_rows(docs: DataFrame) -> DataFrame:
    """own (doc_id as it is), NAME and text of each row of docs.

    Ids that several rows share are found first; they are few as a rule, and then the join
    takes them to all tasks. Null ids need no join.
    """
    found = placed(docs, ["doc_id", "text"], "at").withColumn("doc_id", F.col("doc_id").cast("long"))
    shared = stored(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared")
    alone = F.lit(False)
    if shared.isEmpty():
        drop_stored(shared)
    else:
        found = found.join(shared.withColumn("shared", F.lit(True)), "doc_id", "left")
        alone = F.coalesce("shared", alone)
    by_place = alone | F.col("doc_id").isNull()
    part = [F.when(by_place, F.col(f"at.{c}")).otherwise(F.lit(0)).cast("long").alias(c) for c in NAME[1:]]
    return found.select(F.col("doc_id").alias("own"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), *part, "text")


def dedup_substrings(docs: DataFrame, window: int = 20, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed and removed of every row of docs (doc_id, text).

    Words are runs of other characters than white space. A word goes if a window that
    covers it also starts earlier: in a smaller doc_id, or earlier in the same document;
    all windows are judged on the input, and of each word sequence one window stays.
    Rows that share a doc_id are one document with several rows: a window is judged by
    (doc_id, start), equal ones by the row's place, and only the row that holds it loses
    its words; so of repeated rows one stays whole. A null doc_id comes after all others.
    kept_text is the rest, joined by one space; removed holds the maximal intervals
    [start, end) of words that went. Null and empty texts have no words; texts shorter
    than a window stay. Texts of any length are read whole, a batch of rows at a time. No
    rows: no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = named_rows(docs)
    later = stored(later_windows(windows_of(rows, window, bits)), "later")
    size = later.agg(F.sum(F.length("runs") + 32)).first()[0] or 0
    joined = rows.join(F.broadcast(later) if size <= BROADCAST_BYTES else later, [*NAME], "left").select("own", "text", "runs")

    def run(batches):
        for b in batches:
            out = []
            for doc_id, text, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                gone = covered(runs, len(words), window)
                turns = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(turns) else words
                out.append((doc_id, b" ".join(kept).decode("utf-8", "surrogatepass"), len(words), int(gone.sum()), turns.tolist()))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "kept_text", "n_words", "n_removed", "removed"])

    return joined.mapInArrow(run, "doc_id long, kept_text string, n_words long, n_removed long, removed array<array<int>>")
