"""Compression of vectors to codes: each part of a vector becomes the index of a codebook entry, fitted by filtering Lloyd.

Vectors are cut into blocks of bounded size; of each block and part position a kd-tree is
built once, whose nodes know their bounding box and, by running sums, the sum and count of
their points. The trees lie in a table in the shared folder. A round sends the codebook
entries down every tree: an entry that loses to another one all over a box is dropped for
the whole subtree, and a subtree that one entry is left for is assigned at once. Tasks add
up their sums and counts; what meets on the driver is one sum an entry, whatever the rows.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from quire.llm.common import placed, small_batches, stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Points of a leaf at most, unless they are all equal.
LEAF = 16
#: Rows of a block, and components of all its vectors, at most (one vector at least).
BLOCK_ROWS = 8192
BLOCK_COMPONENTS = 1 << 21
#: Integers up to this size are summed and compared in 64 bits without overflow; beyond it Python's are used.
SMALL = 1 << 24
LONGEST = (1 << 63) - 1
#: Labels up to this number are broadcast with their sums (16 bytes each); more of them are joined by a shuffle.
BROADCAST_LABELS = 1 << 20
#: Ways that a label's rows are dealt out in that shuffle.
SALTS = 32


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers, exact; Python integers where some are too large for SMALL."""
    x = np.asarray(x, np.float64)
    if not x.size or np.abs(x).max() * scale < SMALL:
        return np.floor(x * scale).astype(np.int64)
    whole = [int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    found = np.empty(len(whole), object)
    found[:] = whole
    return found.reshape(x.shape)


def exact(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as 64-bit integers, or all as Python integers if one needs it."""
    large = any(a.size and (a.dtype == object or np.abs(a).max() >= SMALL) for a in arrays)
    return tuple(a.astype(object if large else np.int64) for a in arrays)


def part_bounds(dim: int, parts: int) -> list[int]:
    """Where parts start and end; of equal width where dim allows, else some are one wider."""
    return [i * dim // parts for i in range(parts + 1)]


@dataclass
class Tree:
    """kd-tree of points: node i holds points[start[i]:stop[i]], its children are child[i] and child[i] + 1, or none (-1)."""

    order: np.ndarray  # row of each point
    points: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray


def build_tree(points: np.ndarray) -> Tree:
    """Splits at the median of the widest side, a level at a time, down to LEAF points or equal ones."""
    order = np.arange(len(points))
    starts, stops = np.array([0]), np.array([len(points)])
    found, n_nodes = [], 1
    while len(starts):
        inside = np.repeat(np.arange(len(starts)), stops - starts)
        at = np.arange(len(inside)) - np.repeat(np.cumsum(stops - starts) - (stops - starts), stops - starts) + np.repeat(starts, stops - starts)
        own = points[order[at]]
        heads = np.cumsum(stops - starts) - (stops - starts)
        low, high = np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads)
        sides = high - low
        wide = sides.argmax(axis=1) if sides.shape[1] else np.zeros(len(starts), int)
        split = (stops - starts > LEAF) & (sides.max(axis=1, initial=0) > 0)
        child = np.full(len(starts), -1)
        child[split] = n_nodes + 2 * np.arange(split.sum())
        found.append((starts, stops, low, high, child))
        if not split.any():
            break
        moved = split[inside]
        key, nodes, at = own[moved, wide[inside[moved]]], inside[moved], at[moved]
        by = np.argsort(key, kind="stable")
        by = by[np.argsort(nodes[by], kind="stable")]
        order[at] = order[at[by]]
        middle = (starts[split] + stops[split]) // 2
        starts, stops = np.stack([starts[split], middle], 1).ravel(), np.stack([middle, stops[split]], 1).ravel()
        n_nodes += len(starts)
    columns = [np.concatenate(c) for c in zip(*found)]
    return Tree(order, points[order], *columns)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (points, entries)."""
    apart = points[:, None, :] - entries[None, :, :]
    return (apart * apart).sum(axis=2)


def filtered(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, their entries, places of points, their entries): all points' nearest entries, lower ones first of equals.

    An entry stays for a box unless another, the one nearest to the middle of the box, is
    nearer to (or as near, and lower) the corner that favours the entry most; then it is so
    everywhere in the box.
    """
    n = len(entries)
    index = np.arange(n)
    nodes, left = np.array([0]), np.ones((1, n), bool)
    out = [[], [], [], []]
    while len(nodes):
        low, high = tree.low[nodes], tree.high[nodes]
        middle = distances(low + high, 2 * entries)
        best = np.where(left, middle, middle.max() + 1).argmin(axis=1)
        rival = entries[best][:, None, :]
        corner = np.where(entries[None] > rival, high[:, None, :], low[:, None, :])
        gap = ((entries[None] - corner) ** 2 - (rival - corner) ** 2).sum(axis=2)
        left &= (gap < 0) | ((gap == 0) & (index[None] <= best[:, None]))
        alone = left.sum(axis=1) == 1
        out[0].append(nodes[alone])
        out[1].append(best[alone])
        leaf = ~alone & (tree.child[nodes] < 0)
        for node, some in zip(nodes[leaf].tolist(), left[leaf]):
            far = distances(tree.points[tree.start[node] : tree.stop[node]], entries[some])
            out[2].append(np.arange(tree.start[node], tree.stop[node]))
            out[3].append(index[some][far.argmin(axis=1)])
        deeper = ~alone & ~leaf
        nodes, left = np.stack([tree.child[nodes[deeper]], tree.child[nodes[deeper]] + 1], 1).ravel(), np.repeat(left[deeper], 2, axis=0)
    return tuple(np.concatenate([*x, np.zeros(0, int)]).astype(int) for x in out)


def sums_of(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the points nearest to each entry; a subtree's are those cached with it."""
    nodes, whole, places, own = filtered(tree, entries)
    running = np.concatenate([np.zeros_like(tree.points[:1]), np.cumsum(tree.points, axis=0)])
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    np.add.at(sums, whole, running[tree.stop[nodes]] - running[tree.start[nodes]])
    np.add.at(counts, whole, tree.stop[nodes] - tree.start[nodes])
    np.add.at(sums, own, tree.points[places])
    np.add.at(counts, own, 1)
    return sums, counts


def nearest_of(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of the block."""
    nodes, whole, places, own = filtered(tree, entries)
    sizes = tree.stop[nodes] - tree.start[nodes]
    at = np.arange(sizes.sum()) + np.repeat(tree.start[nodes] - (np.cumsum(sizes) - sizes), sizes)
    found = np.zeros(len(tree.order), int)
    found[at] = np.repeat(whole, sizes)
    found[places] = own
    apart = tree.points - entries[found]
    entry, error = np.empty_like(found), np.empty(len(found), tree.points.dtype)
    entry[tree.order], error[tree.order] = found, (apart * apart).sum(axis=1)
    return entry, error


def _valid(vec):
    return vec.isNotNull() & F.coalesce(F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def _smallest(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object or not x.size else x.astype(np.promote_types(np.min_scalar_type(int(x.min())), np.min_scalar_type(-abs(int(x.max())) - 1)))


def forest(rows: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """One row a block: the other columns of its rows as arrays, and the trees of its parts. rows: (vec, ..)."""
    others = [c for c in rows.columns if c != "vec"]
    bounds = part_bounds(dim, parts)
    size = max(1, min(BLOCK_ROWS, BLOCK_COMPONENTS // max(1, dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            vec = table.column("vec").combine_chunks()
            x = integers(vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), dim), scale)
            trees = [build_tree(x[:, a:b]) for a, b in zip(bounds, bounds[1:])]
            for t in trees:
                t.points, t.low, t.high = _smallest(t.points), _smallest(t.low), _smallest(t.high)
                t.order, t.start, t.stop, t.child = (v.astype(np.int32) for v in (t.order, t.start, t.stop, t.child))
            columns = [pa.ListArray.from_arrays(pa.array([0, len(vec)], pa.int32()), table.column(c).combine_chunks()) for c in others]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps([vars(t) for t in trees], 5)], pa.binary())], [*others, "trees"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, size))
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield block(pa.Table.from_batches(held))

    schema = StructType()
    for c in others:
        schema = schema.add(c, ArrayType(rows.schema[c].dataType))
    return rows.select("vec", *others).mapInArrow(run, schema.add("trees", BinaryType()))


def _trees(blob: bytes, books: list[np.ndarray]) -> Iterator[tuple[Tree, np.ndarray]]:
    for held, book in zip(pickle.loads(blob), books, strict=True):
        tree = Tree(**held)
        tree.points, tree.low, tree.high, entries = exact(tree.points, tree.low, tree.high, book)
        yield tree, entries


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part of (part, salt, sums): JSON of [count, sums ..] by entry, exact at any size."""
    total: dict[int, list[list[int]]] = {}
    for batch in batches:
        for part, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = json.loads(text)
            total[part] = [[x + y for x, y in zip(a, b)] for a, b in zip(total[part], own)] if part in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array(list(map(json.dumps, total.values())), pa.string())], ["part", "salt", "sums"])


def lloyd_round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after every entry has become the floor of the mean of its parts; unused ones stay."""
    shared = trees.sparkSession.sparkContext.broadcast(books)  # entries x dim numbers

    def run(batches):
        from pyspark import TaskContext

        salt, total = TaskContext.get().partitionId() % SALTS, None
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                own = []
                for tree, entries in _trees(blob, shared.value):
                    sums, counts = sums_of(tree, entries)
                    own.append(np.concatenate([counts[:, None].astype(object), sums.astype(object)], axis=1))
                total = own if total is None else [a + b for a, b in zip(total, own)]
        for part, sums in enumerate(total or []):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([salt], pa.int32()), pa.array([json.dumps(sums.tolist())], pa.string())], ["part", "salt", "sums"])

    schema = "part int, salt int, sums string"
    some = trees.select("trees").mapInArrow(run, schema).repartition("part", "salt").mapInArrow(_added, schema)
    found = {r["part"]: json.loads(r["sums"]) for r in some.repartition("part").mapInArrow(_added, schema).collect()}  # a row a part
    after = []
    for part, book in enumerate(books):
        entries = [[s // row[0] for s in row[1:]] if row[0] else old for row, old in zip(found[part], book.tolist(), strict=True)] if part in found else book.tolist()
        new = np.empty(book.shape, object)
        new[:] = np.array(entries, object).reshape(book.shape)
        after.append(exact(new)[0] if not new.size or max(map(abs, new.ravel().tolist())) >= SMALL else new.astype(np.int64))
    return after


@dataclass
class Compressed:
    """codes: (.., code, error) of every kept row; codebooks: one array (entries, width) a part."""

    codes: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for book in self.codebooks for v in book.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """Codes of the rows of vectors (key, column, keep ..).

    Rows whose vector is null or holds a null or non-finite component are left out; so are
    those of another length than most vectors have (the longer of equally frequent
    lengths). A length that parts does not divide gives parts that differ by one in width.
    The codebooks start from the vectors of the smallest keys, nulls last, and of equal
    keys by components; with fewer vectors there are fewer entries. Repeated keys and equal
    vectors are a row each; equal vectors meet the same leaf and share one comparison. A
    row's error beyond a long is the greatest long. No rows: no codes, codebooks without
    entries. Columns that are not named are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part")
    small_batches(vectors.sparkSession)
    rows = vectors.select(key, F.col(column).alias("vec"), *keep).where(_valid(F.col("vec")))
    usual = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = usual[0]["dim"] if usual else 0
    rows = rows.where(F.size("vec") == dim)
    first = rows.select(key, "vec").orderBy(F.asc_nulls_last(key), "vec").limit(entries).collect()  # as many rows as entries
    start = integers(np.array([r["vec"] for r in first], np.float64).reshape(len(first), dim), scale)
    bounds = part_bounds(dim, parts)
    books = [start[:, a:b] for a, b in zip(bounds, bounds[1:])]
    trees = stored(forest(rows, dim, parts, scale), "trees")
    for _ in range(rounds if usual else 0):
        books = lloyd_round(trees, books)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    others = [key, *keep]

    def run(batches):
        for batch in batches:
            for i, blob in enumerate(batch.column(len(others)).to_pylist()):
                made = [nearest_of(tree, book) for tree, book in _trees(blob, shared.value)]
                codes = [bytes(c).hex() for c in np.stack([e for e, _ in made], 1).astype(np.uint8)]
                errors = sum((e.astype(object) for _, e in made[1:]), made[0][1].astype(object))
                own = [batch.column(j).slice(i, 1).flatten() for j in range(len(others))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(codes, pa.string()), pa.array([min(e, LONGEST) for e in errors.tolist()], pa.int64())], [*others, "code", "error"])

    schema = StructType()
    for c in others:
        schema = schema.add(c, vectors.schema[c].dataType)
    codes = trees.select(*others, "trees").mapInArrow(run, schema.add("code", StringType()).add("error", LongType()))
    return Compressed(codes, books)


def decode(codes: DataFrame, codebooks: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """codes and vec: the vector that a code stands for, each component in the middle of its integer's range."""
    books = F.array(*(F.array(*(F.array(*(F.lit((v + 0.5) / scale) for v in entry)) for entry in book.tolist())) for book in codebooks))
    index = lambda part: F.conv(F.substring("code", 2 * part + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vec", F.flatten(F.array(*(books[part][index(part)] for part in range(len(codebooks))))))


def with_label_errors(codes: DataFrame, label: str = "label") -> DataFrame:
    """codes (label, error, ..) with label_error, the error summed over rows of the same label, null labels together.

    Sums beyond a long are the greatest long. Labels are summed in part before the
    shuffle; up to BROADCAST_LABELS sums are broadcast, more are joined with each label's
    rows dealt out over SALTS keys.
    """
    codes = stored(codes, "codes")
    sums = codes.groupBy(label).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = stored(sums.withColumnRenamed(label, "_label"), "labels")
    if sums.count() <= BROADCAST_LABELS:
        return codes.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("_label"))).drop("_label")
    dealt = placed(codes, codes.columns, "_at").withColumn("_salt", F.pmod(F.col("_at.row"), F.lit(SALTS))).drop("_at")
    each = sums.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(each, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_other"))).drop("_label", "_salt", "_other")
