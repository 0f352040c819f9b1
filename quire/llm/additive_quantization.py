"""Nearest neighbours by inner product over additively quantised vectors.

A vector's direction is encoded as one entry from each of several codebooks whose entries
have all its dimensions; their sum approximates it. The codebooks start as k-means of what
the codebooks before leave over, on a bounded sample, and are then fitted together by least
squares. Every direction is encoded by a beam search that keeps the best sums so far. With
the codes goes a stored norm: the vector's norm over that of its sum, in double precision,
so that neither huge nor tiny vectors disturb the codebooks or each other.

Queries come in blocks of bounded size. The inner products of a query's direction with all
entries form its tables; a candidate's look-up score is its sum of look-ups times its
stored norm. In each block of candidates the best by that score are scored again on the
original vectors, in double precision. Equal vectors are one candidate with their smallest
vec_ids, so that copies crowd no other vector out of a block's best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import BROADCAST_BYTES, drop_stored, new_path, stored

BOOKS = 16
ENTRIES = 128
BEAM = 8
#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 8192
#: Candidates in a block, and how many of them by look-up are scored exactly.
BLOCK = 4096
RERANK = 256
#: Queries whose scores are held at once.
QUERY_ROWS = 256
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id and embedding (double) of the vectors that take part; see nearest()."""
    v = F.col("embedding").cast("array<double>")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where("vec_id is not null and embedding is not null").where(sound)
    return rows if dim is None else rows.where(F.size("embedding") == dim)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors float32, norms) of finite vectors other than zero, whatever their scale."""
    most = np.abs(x).max(axis=1, keepdims=True)
    scaled = np.ldexp(x, -np.frexp(most)[1])  # exact, and neither overflows nor vanishes
    size = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
    with np.errstate(over="ignore"):
        return (scaled / size[:, None]).astype(np.float32), np.ldexp(size, np.frexp(most[:, 0])[1])


@dataclass
class Quantizer:
    books: np.ndarray  # (BOOKS, entries, dim) float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norms of the sums): the best sums a beam search finds for directions x."""
        n, dim = x.shape
        codes = np.zeros((n, 1, 0), np.uint8)
        left = x[:, None, :]
        for book in self.books:
            half = (book * book).sum(axis=1) / 2
            # |left - entry|^2 / 2, less what all entries share within one left
            cost = half - left @ book.T + (left * left).sum(axis=2, keepdims=True) / 2
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            parent, entry = best // len(book), best % len(book)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), entry[:, :, None].astype(np.uint8)], axis=2)
            left = np.take_along_axis(left, parent[:, :, None], axis=1) - book[entry]
        best = (left * left).sum(axis=2).argmin(axis=1)
        rows = np.arange(n)
        made = x - left[rows, best]
        return codes[rows, best], np.sqrt((made * made).sum(axis=1))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(BOOKS, entries, queries): inner products of all entries with the directions of all queries."""
        return np.einsum("bed,qd->beq", self.books, directions(q)[0], optimize=True)

    @staticmethod
    def scores(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """(candidates, queries): sums of look-ups, times the stored norms."""
        out = tables[0][codes[:, 0]]
        for book in range(1, len(tables)):
            out += tables[book][codes[:, book]]
        return out * norms[:, None]


def _means(x: np.ndarray, entries: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), entries, replace=len(x) < entries)].copy()
    for _ in range(rounds):
        near = ((centres * centres).sum(axis=1) / 2 - x @ centres.T).argmin(axis=1)
        counts = np.bincount(near, minlength=entries)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
    return centres


def fit(sample: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 2, seed: int = 3) -> Quantizer:
    """Codebooks for directions, from a sample of them."""
    x = sample.astype(np.float32)
    rng = np.random.default_rng(seed)
    entries = min(entries, max(1, len(x)))
    left, found = x.copy(), []
    for _ in range(books):
        book = _means(left, entries, rng)
        left -= book[((book * book).sum(axis=1) / 2 - left @ book.T).argmin(axis=1)]
        found.append(book)
    made = Quantizer(np.stack(found))
    for _ in range(rounds):  # all entries together, for the codes as they are
        codes, _ = made.encode(x)
        flat = codes.astype(np.int64) + np.arange(books) * entries
        width = books * entries
        both = np.zeros((width, width), np.float32)
        for a in range(books):
            for b in range(books):
                both[a * entries : (a + 1) * entries, b * entries : (b + 1) * entries] = np.bincount(codes[:, a].astype(np.int64) * entries + codes[:, b], minlength=entries * entries).reshape(entries, entries)
        sums = np.zeros((width, x.shape[1]), np.float32)
        for b in range(books):
            np.add.at(sums, flat[:, b], x)
        ridge = np.float32(0.1)
        base = made.books.reshape(width, -1)
        both[np.diag_indices(width)] += ridge
        made = Quantizer(np.linalg.solve(both, sums + ridge * base).reshape(books, entries, -1).astype(np.float32))
    return made


def query_blocks(queries: DataFrame, dim: int, k: int, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All queries in blocks that with their k best take at most bound bytes, from one stored table, a partition at a time."""
    ids, rows, most = [], [], max(1, bound // (8 * (dim + 2 * k)))
    for row in queries.toLocalIterator():
        ids.append(row["vec_id"])
        rows.append(np.array(row["embedding"]))
        if len(ids) == most:
            yield np.array(ids, np.int64), np.stack(rows)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.stack(rows)


def encoded(vectors: DataFrame, quantizer: Quantizer) -> DataFrame:
    """vec_ids, embedding, codes and stored norm of every vector."""
    held = vectors.sparkSession.sparkContext.broadcast(quantizer.books)

    def run(batches):
        books = Quantizer(held.value)
        for b in batches:
            x = matrix(b.column(1), books.books.shape[2])
            unit, norms = directions(x)
            parts = [books.encode(unit[at : at + 256]) for at in range(0, len(x), 256)]
            codes = [c.tobytes() for part, _ in parts for c in part]
            sums = np.concatenate([n for _, n in parts]) if parts else np.zeros(0)
            norms = np.minimum(norms / np.maximum(sums, 1e-3), np.finfo(float).max)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary()), pa.array(norms)], ["vec_ids", "embedding", "codes", "norm"])

    return vectors.mapInArrow(run, "vec_ids array<long>, embedding array<double>, codes binary, norm double")


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """vec_ids (ascending) and embedding: each distinct vector once, with its ``most`` smallest vec_ids.

    Spark cuts to ``most`` rows a vector before the shuffle, so a vector that many rows share is no hot key.
    """
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids")).select("vec_ids", "embedding")


def id_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, real): a row of at least two ids a vector, and which of them are real."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    real = np.arange(max(2, sizes.max())) < sizes[:, None]
    ids = np.zeros(real.shape, np.int64)
    ids[real] = column.flatten().to_numpy(zero_copy_only=False)
    return ids, real


def best_of_tasks(index: DataFrame, held: Broadcast, k: int, rerank: int) -> DataFrame:
    """FOUND: for each query of the block that held carries, its k best among each task's candidates.

    Slots that no candidate fills yet are told by ``real``, not by their score, which may be infinite.
    """

    def search(cand: np.ndarray, real: np.ndarray, codes: np.ndarray, norms: np.ndarray, x: np.ndarray, ids: np.ndarray, best: np.ndarray, filled: np.ndarray):
        entries, qids, q = held.value
        books = Quantizer(entries)
        for at in range(0, len(q), QUERY_ROWS):
            part = slice(at, at + QUERY_ROWS)
            some, some_ids = q[part], qids[part]
            rough = books.scores(books.tables(some), codes, norms).T
            alone = (some_ids[:, None] == cand[:, 0]) & ~real[:, 1]
            rough[alone] = -np.inf
            n = min(rerank, len(cand))
            near = np.argpartition(-rough, n - 1, axis=1)[:, :n]
            with np.errstate(over="ignore", invalid="ignore"):
                exact = np.einsum("qd,qnd->qn", some, x[near])
            exact[np.isnan(exact)] = -np.inf
            alone = np.take_along_axis(alone, near, axis=1)
            first = np.where(cand[near, 0] == some_ids[:, None], cand[near, 1], cand[near, 0])
            lead = np.lexsort((first, -exact, alone), axis=1)[:, :k]  # each has an id to give, so k vectors are enough
            near, exact = np.take_along_axis(near, lead, axis=1), np.take_along_axis(exact, lead, axis=1)
            given = real[near] & (cand[near] != some_ids[:, None, None])
            score = np.concatenate([best[part], np.repeat(exact, given.shape[2], axis=1)], axis=1)
            found = np.concatenate([ids[part], cand[near].reshape(len(some), -1)], axis=1)
            sound = np.concatenate([filled[part], given.reshape(len(some), -1)], axis=1)
            order = np.lexsort((found, -score, ~sound), axis=1)[:, :k]
            best[part], ids[part], filled[part] = (np.take_along_axis(v, order, axis=1) for v in (score, found, sound))

    def run(batches):
        kept, n = [], 0
        entries, qids, q = held.value
        ids, best, filled = np.zeros((len(q), k), np.int64), np.zeros((len(q), k)), np.zeros((len(q), k), bool)

        def block():
            codes = np.frombuffer(b"".join(c for b in kept for c in b.column(2).to_pylist()), np.uint8).reshape(-1, len(entries))
            norms = np.concatenate([b.column(3).to_numpy() for b in kept])
            return *id_matrix(pa.concat_arrays([b.column(0) for b in kept])), codes, norms, np.concatenate([matrix(b.column(1), q.shape[1]) for b in kept])

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                kept.append(b.slice(at, BLOCK))
                n += kept[-1].num_rows
                if n >= BLOCK:
                    search(*block(), ids, best, filled)
                    kept, n = [], 0
        if n:
            search(*block(), ids, best, filled)
        for at in range(0, len(q), QUERY_ROWS):
            part = slice(at, at + QUERY_ROWS)
            real = filled[part]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[part], real.sum(axis=1))), pa.array(ids[part][real]), pa.array(best[part][real])], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, rerank: int = RERANK, query_bytes: int = BROADCAST_BYTES // 4) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found for each row whose vec_id is divisible by ``every``.

    Nearness is the inner product of the original vectors in double precision; ties go
    to the smaller vec_id; a query isn't its own candidate. Vectors that are null, zero
    or hold null or non-finite components take no part, nor do those without a vec_id
    or of another length than most (ties: the shorter). Rows that repeat a vec_id and
    vector count once; of rows that share only a vec_id each is a candidate, and the
    vector that sorts first is the query. Vectors of any scale take part alike; inner
    products beyond double precision are infinite, undefined ones the least. Fewer than k
    candidates: all of them. No rows: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    sound = usable(vectors)
    lengths = sound.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths["dim"]
    rows = usable(vectors, dim).dropDuplicates()
    distinct = stored(distinct_vectors(rows, k + 1), "vectors")
    first = F.col("vec_ids")[0]
    sample = distinct.orderBy(F.xxhash64(first), first, "embedding").limit(SAMPLE).select("embedding").collect()  # at most SAMPLE rows
    quantizer = fit(directions(np.array([r[0] for r in sample]))[0])
    index = stored(encoded(distinct, quantizer), "index")
    drop_stored(distinct)
    queries = stored(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    path = new_path(spark, "found")
    spark.createDataFrame([], FOUND).write.parquet(path)
    for ids, block in query_blocks(queries, dim, k, query_bytes):  # written block by block, so that the plan and what is broadcast don't grow
        held = spark.sparkContext.broadcast((quantizer.books, ids, block))
        best_of_tasks(index, held, k, rerank).write.mode("append").parquet(path)
        held.destroy()
    drop_stored(index, queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema(FOUND).parquet(path)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
