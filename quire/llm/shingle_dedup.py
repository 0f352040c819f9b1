"""Near copies by SimHash fingerprints, deletion variants and the Jaccard similarity of word shingles.

Two sets of similarity 0.8 differ in 15 % of the bits of their fingerprints: in about ten of
64, which op3's three segments don't cover. So a fingerprint here has 36 segments of 16 bits
and 128 bits more for comparison. A segment is indexed under its deletion variants, each with
one bit as a wildcard: the five bits whose counts lie nearest to half the shingles, where
near copies differ if anywhere. Two sets of similarity 0.8 meet under a variant of a segment
with a probability of about 0.19, in any of the 36 of about 0.999 (see the README).

What meets is compared by the 128 bits: up to 34 may differ (20 do on average at 0.8, 64 of
sets without a common shingle). Links join into components, and within each component the
sets themselves are compared, so no estimate decides.

Equal sets are one entry, known by a 64-bit hash of the set. A variant with many entries is
searched outwards from one of them at a time, never in pairs; one with very many, and a
component of many entries, is compared in tiles, each of two parts of the whole, so that no
task holds a whole one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_stored, partitions, placed, small_batches, stored, tiled
from quire.llm.components import connected_components
from quire.llm.simhash import SEED, shingle_hashes

#: Segments, their bits, and bits of each that are a wildcard in one of its variants.
SEGMENTS, WIDTH, FREE = 36, 16, 5
#: Bits that are compared, and how many of them may differ.
CHECKED, MOST = 128, 34
WORDS = (SEGMENTS * WIDTH + CHECKED) // 64
#: Shingles whose bits are counted at once (in bytes), and labels in a batch.
CHUNK, LABELS = 255, 10000
#: Of variants with up to so many entries all pairs are compared.
SMALL = 16
#: Rows of the index that one task holds at once; entries of a variant above which it is tiled.
HELD, DENSE = 1 << 20, 1 << 14
#: Entries of a component that one task compares at once; larger ones are tiled.
TILE = 500

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_MIX = _rng.integers(0, 1 << 64, 1, np.uint64) | np.uint64(1)
#: A fingerprint as the index takes it.
_MARK = np.dtype([("check", "<u8", CHECKED // 64), ("segments", "<u2", SEGMENTS), ("free", "u1", (SEGMENTS, FREE))])


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def leanings(shingles: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint, hashes that have it less those that don't; the bit is 1 if that is over 0."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(shingles), CHUNK):
        h = shingles[at : at + CHUNK, None] * _FACTORS  # op3's hash has but 64 bits
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        counts += np.add.reduce(np.unpackbits(h.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return 2 * counts - len(shingles)


def mark(shingles: np.ndarray) -> bytes | None:
    """The fingerprint and its uncertain bits (_MARK); an empty set has none."""
    if not len(shingles):
        return None
    lean = leanings(shingles)
    packed = np.packbits(lean > 0, bitorder="little")
    made = np.zeros((), _MARK)
    made["segments"] = packed[: SEGMENTS * WIDTH // 8].view("<u2")
    made["check"] = packed[SEGMENTS * WIDTH // 8 :].view("<u8")
    made["free"] = np.argsort(np.abs(lean[: SEGMENTS * WIDTH]).reshape(SEGMENTS, WIDTH), axis=1, kind="stable")[:, :FREE]
    return made.tobytes()


def variant_keys(marks: np.ndarray) -> np.ndarray:
    """SEGMENTS * FREE keys of each mark: segment, place of the wildcard, and the segment without that bit."""
    free = marks["free"].astype(np.int64)
    rest = marks["segments"].astype(np.int64)[:, :, None] & ~(np.int64(1) << free)
    return ((np.arange(SEGMENTS)[:, None] << (WIDTH + 4)) | (free << WIDTH) | rest).reshape(len(marks), -1)


def linked(sets: list[np.ndarray], least: float) -> np.ndarray:
    """The first member of each set's group: sets of similarity ``least`` or more, and what such links connect."""
    sizes, group = np.array([len(s) for s in sets], np.int64), np.full(len(sets), -1, np.int64)

    def indexed(held):
        values, owners = np.concatenate([sets[i] for i in held]), np.repeat(np.arange(len(held)), sizes[held])
        order = np.argsort(values, kind="stable")
        return values[order], owners[order]

    held = np.arange(len(sets))
    values, owners = indexed(held)
    for seed in range(len(sets)):
        if group[seed] >= 0:
            continue
        group[seed], frontier = seed, [seed]
        while frontier:
            one = frontier.pop()
            left = group[held] < 0
            n = int(left.sum())
            if not n:
                break
            if 2 * n <= len(held):  # only sets not yet reached are searched
                held = held[left]
                values, owners = indexed(held)
                left = np.ones(n, bool)
            starts = np.searchsorted(values, sets[one], "left")
            counts = np.searchsorted(values, sets[one], "right") - starts
            at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            common = np.bincount(owners[at], minlength=len(held))
            found = held[left & (common >= least * (sizes[one] + sizes[held] - common) - 1e-9)]
            group[found] = seed
            frontier.extend(found.tolist())
    return group


def _marks(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, quire_at, fp, mark) of every row: the hash of its set and its fingerprint."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column(2).to_pylist()]
            fps = np.array([set_hash(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps), pa.array([mark(s) for s in sets], pa.binary())], ["doc_id", "quire_at", "fp", "mark"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "quire_at", "text")
    return rows.mapInArrow(run, f"doc_id long, quire_at {rows.schema['quire_at'].dataType.simpleString()}, fp long, mark binary")


def variants(entries: DataFrame) -> DataFrame:
    """(key, fp, c0, c1) of entries (fp, mark): each under all its keys, with the bits to compare."""

    def run(batches):
        for b in batches:
            marks = np.frombuffer(b"".join(b.column(1).to_pylist()), _MARK)
            n = SEGMENTS * FREE
            columns = [variant_keys(marks).ravel(), *(np.repeat(c, n) for c in (b.column(0).to_numpy(), *marks["check"].T.astype(np.uint64).view(np.int64)))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "fp", "c0", "c1"])

    return entries.where("mark is not null").select("fp", "mark").mapInArrow(run, "key long, fp long, c0 long, c1 long")


def _differing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ others).sum(axis=-1, dtype=np.int64)


def forest(checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (numbers of rows) that connect whatever links of up to MOST bits connect; fewer than len(checks)."""
    left, right, rest = [], [], np.arange(len(checks))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            one = frontier.pop()
            near = _differing(checks[one], checks[rest]) <= MOST
            if near.any():
                left.append(np.full(int(near.sum()), one))
                right.append(rest[near])
                frontier.extend(rest[near].tolist())
                rest = rest[~near]
    return np.concatenate([np.empty(0, np.int64), *left]), np.concatenate([np.empty(0, np.int64), *right])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that links (a, b) connect to lesser ones, and the least of them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        now = least.copy()
        low = np.minimum(least[left], least[right])
        for ends in (left, right, least[left], least[right]):
            np.minimum.at(now, ends, low)
        now = now[now]
        if (now == least).all():
            return nodes[least != np.arange(len(nodes))], nodes[least[least != np.arange(len(nodes))]]
        least = now


def links_of(keys: np.ndarray, fps: np.ndarray, checks: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, keys of more than largest rows) of rows that are sorted by key: what links within the other keys connect, as stars.

    The keys of a group of near copies hold different parts of it; as stars over all keys at
    hand they name about one link a member, not one a member and key.
    """
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    for d in range(1, SMALL):
        a, b = small[:-d], small[d:]
        same = keys[a] == keys[b]
        if not same.any():
            break
        a, b = a[same], b[same]
        near = _differing(checks[a], checks[b]) <= MOST
        left.append(fps[a[near]])
        right.append(fps[b[near]])
    dense = (sizes > SMALL) & (sizes <= largest)
    for s, n in zip(starts[dense].tolist(), sizes[dense].tolist()):
        a, b = forest(checks[s : s + n])
        left.append(fps[s + a])
        right.append(fps[s + b])
    return *stars(np.concatenate(left), np.concatenate(right)), keys[starts[sizes > largest]]


def _links(index: DataFrame, largest: int) -> DataFrame:
    """(a, b): what links within each key of index (key, fp, c0, c1) connect; (key, null) for keys of more than largest rows."""

    def run(batches):
        parts, held, skip = [], 0, None

        def out(last: bool):
            nonlocal parts, held, skip
            k, f, c = (np.concatenate(p) for p in zip(*parts, strict=True))
            cut = len(k) if last else int(np.searchsorted(k, k[-1]))
            a, b, over = links_of(k[:cut], f[:cut], c[:cut], largest)
            k, f, c = k[cut:], f[cut:], c[cut:]
            if len(k) > largest:  # the key under way is too large already: the rest of it needn't be held
                skip = int(k[0])
                over, k, f, c = np.append(over, skip), k[:0], f[:0], c[:0]
            parts, held = [(k, f, c)], len(k)
            b = pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(over), pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(np.append(a, over), pa.int64()), b], ["a", "b"])

        for batch in batches:
            k, f, *c = (column.to_numpy() for column in batch.columns)
            c = np.stack(c, axis=1).view(np.uint64)
            if skip is not None:
                other = k != skip
                k, f, c = k[other], f[other], c[other]
            parts.append((k, f, c))
            held += len(k)
            if held >= HELD:
                yield out(False)
        if held:
            yield out(True)

    n = partitions(index.sparkSession)
    return index.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def find_links(entries: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b): links between entries (fp, mark), just enough to connect all that are connected by links under a variant."""
    found = stored(_links(variants(entries), dense), "links")
    links = found.where("b is not null")
    over = found.where("b is null").select(F.col("a").alias("key")).distinct()
    if over.isEmpty():
        return links.distinct()
    rows = variants(entries).join(over, "key", "left_semi")
    parts = tiled(rows, rows.groupBy("key").agg(F.count("*").alias("n")), "key", "fp", dense)
    # keys that should share a hash are compared together, which links nothing wrong
    more = _links(parts.select(F.xxhash64("key", "tile").alias("key"), "fp", "c0", "c1"), 1 << 62)
    return links.union(more).distinct()


def _verified(members: DataFrame, words: int, least: float) -> DataFrame:
    """(node, root) of members (root, tile, fp, text): roots of the groups that the sets themselves make in each tile."""

    def run(batches):
        now, fps, sets, nodes, roots = None, [], [], [], []

        def settle():
            nodes.extend(fps)
            roots.extend(fps[i] for i in linked(sets, least).tolist())

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])
            nodes.clear()
            roots.clear()
            return made

        for b in batches:
            for *root, fp, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if fps and root != now:
                    settle()
                    fps, sets = [], []
                    if len(nodes) >= LABELS:
                        yield out()
                now = root
                fps.append(fp)
                sets.append(shingle_set(text, words))
        if fps:
            settle()
        yield out()

    return members.repartition(partitions(members.sparkSession), "root", "tile").sortWithinPartitions("root", "tile", "fp").mapInArrow(run, "node long, root long")


def kept_rows(docs: DataFrame, columns: list[str], words: int = 5, least: float = 0.8, tile: int = TILE, dense: int = DENSE) -> DataFrame:
    """One row of each group of near copies, with the named columns.

    Rows link if the sets of their runs of ``words`` words (see shingle_hashes) have
    Jaccard similarity ``least`` or more; links join into groups. Null and empty texts and
    those of white space only are copies of each other. Texts of any length are compared whole. The row of the smallest doc_id
    stays (null last), of rows that share it the first by place. Rows are told apart by
    their place, so null or repeated ids keep no row too many. No rows: no rows.
    """
    found = placed(docs, columns, "quire_at")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "quire_at")
    marks = stored(_marks(found, words), "marks")
    distinct = stored(marks.groupBy("fp").agg(F.min(rank).alias("least"), F.first("mark").alias("mark")), "distinct")
    drop_stored(marks)
    candidates = stored(distinct.join(connected_components(find_links(distinct, dense)), F.col("fp") == F.col("node")).select("root", "fp", F.col("least.quire_at").alias("quire_at")), "candidates")
    large = stored(candidates.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > tile), "large")
    members = tiled(candidates, large, "root", "fp", tile).join(found.select("quire_at", "text"), "quire_at").select("root", "tile", "fp", "text")
    roots = stored(_verified(members, words, least), "roots")
    if not large.isEmpty():  # an entry of a large component has a root in each of its tiles
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("least", F.coalesce("root", "fp").alias("root"))
    first = labelled.groupBy("root").agg(F.min("least").alias("first"))
    return found.join(first.select("first.quire_at"), "quire_at", "left_semi").select(*columns)
