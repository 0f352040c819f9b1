"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at
most four bits, then in at least one segment they differ in at most one bit, so
with that bit taken out the segments are equal. Each distinct fingerprint is indexed
under its 64 segment variants with one bit as a wildcard; fingerprints that meet
under a variant are compared in full. Links join into components.

The index holds distinct fingerprints only: copies are one entry. A variant with many
fingerprints is searched outwards from one of them at a time, over those not yet
reached, so it yields fewer links than members and never all pairs. One with very many
is cut into tiles first, which tasks search one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import partitions, placed, small_batches, stored, tiled
from quire.llm.components import connected_components

BITS = 64
SEED = 42
#: First bits of the segments.
CUTS = (0, 21, 42, 64)
#: Of variants with up to so many fingerprints all pairs are compared.
SMALL = 16
#: Rows of the index that one task holds at once.
CHUNK = 1 << 20
#: Fingerprints of one variant that a task searches at once; variants with more are tiled.
TILE = 1 << 14

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, lower-cased in A-Z; a shorter text is one run."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Each bit is 1 if it is set in over half the hashes; no hashes: 0."""
    n = len(hashes)
    if not n:
        return 0
    lanes = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n > 512:
        counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    else:
        counts = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0)
    return int(sum(1 << i for i in np.nonzero(2 * counts > n)[0].tolist()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 5, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long) of every row, and its carried columns; null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [_signed(simhash(shingle_hashes(t, words))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *carried])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    return rows.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)]))


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under its segments with one bit as a wildcard."""
    keys = []
    for lo, hi in zip(CUTS, CUTS[1:]):
        segment = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        for bit in range(lo, hi):
            rest = segment.bitwiseAND(F.lit(((1 << (hi - lo)) - 1) & ~(1 << (bit - lo))))
            keys.append(rest.bitwiseOR(F.lit(bit << 22)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def forest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most ``most`` bits that connect whatever such links connect; fewer than len(fps)."""
    left, right, rest = [], [], fps
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            new = []
            for one in frontier:
                near = np.bitwise_count(rest ^ one) <= most
                if near.any():
                    found, rest = rest[near], rest[~near]
                    left.append(np.full(len(found), one, fps.dtype))
                    right.append(found)
                    new.append(found)
                    if not len(rest):
                        break
            frontier = np.concatenate(new) if new else rest[:0]
    if not left:
        return fps[:0], fps[:0]
    return np.concatenate(left), np.concatenate(right)


def links_of(keys: np.ndarray, fps: np.ndarray, most: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links among rows that are sorted by key, within each key, and the keys of more than largest rows, which are passed over."""
    if len(keys) < 2:
        return fps[:0], fps[:0], keys[:0]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    k, f = keys[small], fps[small]
    for d in range(1, SMALL):
        same = k[d:] == k[:-d]
        if not same.any():
            break
        near = same & (np.bitwise_count(f[d:] ^ f[:-d]) <= most)
        left.append(f[:-d][near])
        right.append(f[d:][near])
    dense = (sizes > SMALL) & (sizes <= largest)
    for s, n in zip(starts[dense], sizes[dense]):
        a, b = forest(fps[s : s + n], most)
        left.append(a)
        right.append(b)
    over = keys[starts[sizes > largest]]
    if not left:
        return fps[:0], fps[:0], over
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[:, 0].copy(), pairs[:, 1].copy(), over


def _links(index: DataFrame, most_bits: int, largest: int) -> DataFrame:
    """(a, b): links within each key of index (key, fp); (key, null) for keys of more than largest rows."""

    def run(batches):
        keys, values, held, skip = [], [], 0, None

        def out(last: bool):
            nonlocal keys, values, held, skip
            k, f = np.concatenate(keys), np.concatenate(values)
            cut = len(k) if last else int(np.searchsorted(k, k[-1]))
            a, b, over = links_of(k[:cut], f[:cut], most_bits, largest)
            k, f = k[cut:], f[cut:]
            if len(k) > largest:  # the key under way is too large already: the rest of it needn't be held
                skip = int(k[0])
                over, k, f = np.append(over, skip), k[:0], f[:0]
            keys, values, held = [k], [f], len(k)
            both = [pa.array(np.concatenate([a.view(np.int64), over])), pa.array([*b.view(np.int64).tolist(), *[None] * len(over)], pa.int64())]
            return pa.RecordBatch.from_arrays(both, ["a", "b"])

        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
            if skip is not None:
                k, f = k[k != skip], f[k != skip]
            keys.append(k)
            values.append(f)
            held += len(k)
            if held >= CHUNK:
                yield out(False)
        if held:
            yield out(True)

    n = partitions(index.sparkSession)
    return index.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def find_links(fps: DataFrame, most_bits: int, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all that are connected."""
    found = stored(_links(variants(fps), most_bits, tile), "links")
    links = found.where("b is not null").select("a", "b")
    over = found.where("b is null").select(F.col("a").alias("key")).distinct()
    if over.isEmpty():
        return links.distinct()
    rows = variants(fps).join(over, "key", "left_semi")
    parts = tiled(rows, rows.groupBy("key").agg(F.count("*").alias("n")), "key", "fp", tile)
    # keys that should share a hash are compared together, which links nothing wrong
    more = _links(parts.select(F.xxhash64("key", "tile").alias("key"), "fp"), most_bits, 1 << 62)
    return links.union(more).distinct()


def rooted(marks: DataFrame, least: Column, most_bits: int, tile: int = TILE) -> DataFrame:
    """(fp, least, root) of each distinct fingerprint of marks; linked fingerprints have the same root."""
    if not 0 <= most_bits <= 4:
        raise ValueError("three segments cover up to 4 differing bits")
    distinct = stored(marks.groupBy("fp").agg(least.alias("least")), "distinct")
    roots = connected_components(find_links(distinct.select("fp"), most_bits, tile))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 5, most_bits: int = 4, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (doc_id, text).

    Fingerprints link at ``most_bits`` (at most 4) or fewer differing bits;
    component_id is the smallest doc_id reachable over links, itself included.
    Null and empty texts, and those of white space only, have fingerprint zero and
    link like any other. Fewer words than a shingle: the whole sequence is the one
    shingle. A null doc_id gets a row and takes part, but names no component unless
    all others are null too. Repeated rows get a row each. Texts of any length are read
    whole. No rows: no rows. Other columns are not read.
    """
    marks = stored(fingerprints(docs, words), "marks")
    labelled = rooted(marks, F.min("doc_id"), most_bits, tile)
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = labelled.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marks.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept_rows(docs: DataFrame, columns: list[str], words: int = 5, most_bits: int = 4) -> DataFrame:
    """One row of each group of near-duplicates, with the named columns.

    The row of the smallest doc_id stays (null last), of rows that share it the first by
    place. Rows are told apart by their place, so null or repeated ids keep no row too many.
    """
    found = placed(docs, columns, "quire_at")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "quire_at")
    marks = stored(fingerprints(found, words, ("quire_at",)), "marks")
    first = rooted(marks, F.min(rank), most_bits).groupBy("root").agg(F.min("least").alias("first"))
    return found.join(first.select("first.quire_at"), "quire_at", "left_semi").select(*columns)
