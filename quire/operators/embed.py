"""Word vectors and page vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.vectors import SIF_A, sif, unit, without
from quire.operators.ranks import written


#: Bytes of words' vectors that are broadcast at once, about, and how many times so many; more words are joined by a shuffle.
BROADCAST_BYTES, BROADCASTS = 64 << 20, 8


def sif_vectors(counted: DataFrame, vocab: DataFrame, word_vectors: DataFrame, dim: int, key: str = "page_idx", total: int | None = None) -> DataFrame:
    """(key, vec): mean of the known tokens' vectors, each weighted by its rarity; keys without any are left out. counted: (key, word, n).

    One sum for each dimension, so nothing is exploded. The words are broadcast, in shares of
    BROADCAST_BYTES, so that a task adds up a key's words where they lie. A row looks its word
    up in one share after another, so counted is read once and a row of sums for each key is
    shuffled, however many shares there are.
    """
    total = total or vocab.agg(F.sum("cnt")).first()[0] or 1
    weighted = written(vocab.join(word_vectors, "word").select("word", sif(F.col("cnt"), F.lit(float(total))).alias("w"), "vec"), "weighted")
    shares = max(1, -(-weighted.count() * (8 * dim + 64) // BROADCAST_BYTES))
    if shares > BROADCASTS:
        known = counted.join(weighted, "word")
    elif shares == 1:
        known = counted.join(F.broadcast(weighted), "word")
    else:
        known = counted
        for i in range(shares):
            part = weighted.where(F.pmod(F.xxhash64("word"), F.lit(shares)) == i).select("word", F.struct("w", "vec").alias(f"_{i}"))
            known = known.join(F.broadcast(part), "word", "left")
        known = known.withColumn("_of", F.coalesce(*(f"_{i}" for i in range(shares)))).where("_of is not null").select(key, "n", "_of.w", "_of.vec")
    sums = [F.sum(F.col("n") * F.col("w") * F.col("vec")[i].cast("double")).alias(f"s{i}") for i in range(dim)]
    summed = known.groupBy(key).agg(F.sum("n").alias("n"), *sums)
    return summed.select(key, F.array(*(F.col(f"s{i}") / F.col("n") for i in range(dim))).alias("vec"))


@dataclass
class Moments:
    """Number, mean and squared deviations of vectors; those of two sets give those of both, so batches equal the whole up to rounding."""

    n: int
    mean: np.ndarray
    squares: np.ndarray

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        apart, n = other.mean - self.mean, self.n + other.n
        return Moments(n, self.mean + apart * (other.n / n), self.squares + other.squares + np.outer(apart, apart) * (self.n * other.n / n))

    def component(self) -> list[float]:
        """First principal component; its sign is arbitrary. Zeros if all vectors are equal."""
        if not self.n or not self.squares.any():
            return [0.0] * len(self.mean)
        return np.linalg.eigh(self.squares)[1][:, -1].tolist()

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.n, self.mean.tolist(), self.squares.ravel().tolist())], "n long, mean array<double>, squares array<double>")

    @staticmethod
    def of_rows(rows: DataFrame) -> Moments:
        r = rows.first()  # one row
        return Moments(r["n"], np.array(r["mean"]), np.array(r["squares"]).reshape(len(r["mean"]), -1))


#: Tasks that add up the moments of all others.
MERGERS = 16


def vector_moments(vectors: DataFrame, column: str = "vec") -> Moments:
    """Moments of an array column: each task sums up its own, MERGERS tasks theirs; MERGERS matrices of dim x dim meet on the driver."""

    def packed(m: Moments) -> pa.RecordBatch:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() % MERGERS
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([m.n], pa.int64()), pa.array([m.mean.tobytes()], pa.binary()), pa.array([m.squares.tobytes()], pa.binary())], ["at", "n", "mean", "squares"])

    def unpacked(n: int, mean: bytes, squares: bytes) -> Moments:
        middle = np.frombuffer(mean)
        return Moments(n, middle, np.frombuffer(squares).reshape(len(middle), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments(0, np.zeros(0), np.zeros((0, 0)))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                mean = x.mean(axis=0)
                total = total.merged(Moments(len(x), mean, (x - mean).T @ (x - mean)))
        if total.n:
            yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments(0, np.zeros(0), np.zeros((0, 0)))
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[1:])):
                total = total.merged(unpacked(*row))
        if total.n:
            yield packed(total)

    schema = "at int, n long, mean binary, squares binary"
    found = vectors.select(column).where(F.col(column).isNotNull()).mapInArrow(run, schema).repartition(MERGERS, "at").mapInArrow(add, schema).collect()  # at most MERGERS rows
    return reduce(Moments.merged, (unpacked(r["n"], bytes(r["mean"]), bytes(r["squares"])) for r in found), Moments(0, np.zeros(0), np.zeros((0, 0))))


def first_component(vectors: DataFrame, column: str = "vec") -> list[float]:
    """First principal component; its sign is arbitrary."""
    return vector_moments(vectors, column).component()


def dimension(word_vectors: DataFrame) -> int:
    row = word_vectors.select(F.size("vec").alias("n")).first()
    return row["n"] if row else 0


def component_rows(spark: SparkSession, component: list[float]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(component)), "dim int, value double")


def component_values(component: DataFrame) -> list[float]:
    return [r["value"] for r in component.orderBy("dim").collect()]  # one row a dimension


def query_vectors(vocab: DataFrame, word_vectors: DataFrame, component: list[float], queries: list[list[str]], total: int | None = None) -> list[list[float]]:
    """The vector of each query (its words), made as a page's: weighted mean, less the component, at unit length; zeros without a known word."""
    total = total or vocab.agg(F.sum("cnt")).first()[0] or 1
    asked = sorted({w for words in queries for w in words})
    rows = vocab.where(F.col("word").isin(asked)).join(word_vectors, "word").select("word", "cnt", "vec").collect() if asked else []  # at most the queries' words
    weighted = {r["word"]: SIF_A / (SIF_A + r["cnt"] / total) * np.array(r["vec"], float) for r in rows}
    u, found = np.array(component), []
    for words in queries:
        known = [weighted[w] for w in words if w in weighted]
        v = np.mean(known, axis=0) if known else np.zeros(len(u))
        v = v - u * (u @ v)
        size = np.sqrt(v @ v)
        found.append((v / size if size > 0 else v).tolist())
    return found


def page_vectors(means: DataFrame, component: list[float]) -> DataFrame:
    """means (.., vec) less the component, at unit length; zero vectors stay."""
    u = F.array(*(F.lit(x) for x in component))
    return means.withColumn("vec", unit(without(F.col("vec"), u)))
