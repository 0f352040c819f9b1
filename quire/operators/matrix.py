"""Vectors in blocks: many rows as one matrix, scored by one product; bounds of a block's scores let readers skip it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and components of all its vectors, at most (one row at least).
ROWS = 4096
COMPONENTS = 1 << 19
SCHEMA = "first_page long, last_page long, n_pages int, dim int, pages binary, data binary, centre binary, radius double"


def _vectors(column: pa.Array) -> np.ndarray:
    """(rows, dim) doubles of an array of lists of one length without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def vector_blocks(rows: DataFrame, key: str = "page_idx", column: str = "vec") -> DataFrame:
    """SCHEMA from rows (key, vec), as they lie; centre and radius: the mean and the greatest distance from it."""

    def block(pages: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        centre = vectors.mean(axis=0)
        radius = float(np.sqrt(((vectors - centre) ** 2).sum(axis=1).max()))
        parts = [[int(pages.min())], [int(pages.max())], [len(pages)], [vectors.shape[1]], [pages.tobytes()], [vectors.tobytes()], [centre.tobytes()], [radius]]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, types)], ["first_page", "last_page", "n_pages", "dim", "pages", "data", "centre", "radius"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages, vectors = np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in batches:
            if batch.num_rows:
                own = _vectors(batch.column(1))
                pages, vectors = np.append(pages, batch.column(0).to_numpy()), np.concatenate([vectors.reshape(-1, own.shape[1]), own])
                size = max(1, min(ROWS, COMPONENTS // max(1, own.shape[1])))
                while len(pages) >= size:
                    yield block(pages[:size], vectors[:size])
                    pages, vectors = pages[size:], vectors[size:]
        if len(pages):
            yield block(pages, vectors)

    return rows.select(F.col(key).cast("long").alias("page_idx"), column).mapInArrow(run, SCHEMA)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for dim, pages, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "pages", "data"))):
        yield np.frombuffer(pages, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)


def vector_rows(blocks: DataFrame) -> DataFrame:
    """(page_idx, vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, vectors in _unpacked(batch):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pages) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(pages), lists], ["page_idx", "vec"])

    return blocks.select("dim", "pages", "data").mapInArrow(run, "page_idx long, vec array<double>")


def scores(blocks: DataFrame, queries: list[list[float]]) -> DataFrame:
    """(page_idx, score): the greatest inner product of each row with the queries."""
    asked = np.array(queries, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, vectors in _unpacked(batch):
                yield pa.RecordBatch.from_arrays([pa.array(pages), pa.array((vectors @ asked.T).max(axis=1))], ["page_idx", "score"])

    return blocks.select("dim", "pages", "data").mapInArrow(run, "page_idx long, score double")


def bounds(blocks: DataFrame, queries: list[list[float]]) -> DataFrame:
    """(first_page, last_page, n_pages, bound): no row of a block scores more; read from centres and radii alone."""
    asked = np.array(queries, np.float64)
    size = np.sqrt((asked * asked).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres = np.array([np.frombuffer(c, np.float64) for c in batch.column(3).to_pylist()]).reshape(batch.num_rows, -1)
            if batch.num_rows:
                most = (centres @ asked.T + batch.column(4).to_numpy()[:, None] * size).max(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(most + 1e-9)], ["first_page", "last_page", "n_pages", "bound"])

    return blocks.select("first_page", "last_page", "n_pages", "centre", "radius").mapInArrow(run, "first_page long, last_page long, n_pages int, bound double")


def top_rows(rows: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, score) of the k rows (key, vector) with the greatest inner products, ties to the smaller key: each task hands on k of its own."""
    asked = np.array(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, best = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            if batch.num_rows:
                keys, best = np.append(keys, batch.column(0).to_numpy()), np.append(best, _vectors(batch.column(1)) @ asked)
                order = np.lexsort((keys, -best))[:k]
                keys, best = keys[order], best[order]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(best)], [key, "score"])

    found = rows.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, f"{key} long, score double")
    return found.orderBy(F.desc("score"), key).limit(k)
