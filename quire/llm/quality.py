"""Quality classifier over random-indexing word vectors.

Each token's hash bucket has a sparse random index vector. A bucket's context vector is
the sum, over all documents, of the index vectors around its tokens; every task adds up
its own part, and the parts are added bucket range by bucket range. A document is the
mean and the spread of the context vectors of its tokens, and of the likeness of neighbours. A two-layer network, trained in
numpy on a bounded sample of labelled rows and calibrated by a temperature on rows it was
not trained on, gives the probability that the label is 1.

The number of buckets is fixed, so the vectors are BUCKETS x DIM numbers at any size.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import partitions, small_batches

BUCKETS = 1 << 15
DIM = 32
#: Nonzero entries of an index vector, half of them negative.
NONZERO = 2
WINDOW = 2
#: Inputs of the network.
WIDTH = 2 * DIM + 2
#: Buckets in one row of the summed vectors.
RANGE = 256
#: Labelled documents that training takes at most, one row of each.
SAMPLE = 20_000
#: Tasks that sum up context vectors at most, for each core; and splits of the scan that one of them reads at most.
TASKS_A_CORE, SPLITS = 4, 16
HIDDEN = 32
#: Tokens that are added up at once.
CHUNK = 1 << 18

TOKEN = re.compile(r"\w+|[^\w\s]+")


def bucket_ids(text: str | None, known: dict[str, int]) -> np.ndarray:
    """The hash bucket of each token; known remembers a bounded number of them."""
    tokens = TOKEN.findall(text or "")
    try:
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    except KeyError:
        if len(known) > 500_000:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) % BUCKETS
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places (BUCKETS, NONZERO) and signs (NONZERO) of the nonzero entries."""
    places = np.random.default_rng(11).integers(0, DIM, (BUCKETS, NONZERO))
    places[:, 1] = (places[:, 0] + 1 + places[:, 1] % (DIM - 1)) % DIM
    return places, np.where(np.arange(NONZERO) % 2, -1.0, 1.0)


def add_contexts(total: np.ndarray, ids: np.ndarray, doc: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to total (flat) the index vectors within WINDOW tokens of each token in the same document."""
    for step in range(1, WINDOW + 1):
        same = doc[step:] == doc[:-step]
        a, b = ids[:-step][same], ids[step:][same]
        for k in range(NONZERO):
            flat = np.concatenate([a * DIM + places[b, k], b * DIM + places[a, k]])
            total += signs[k] * np.bincount(flat, minlength=len(total))


def context_sums(docs: DataFrame) -> DataFrame:
    """(range, sums binary): the context vectors of RANGE buckets a row, over all of docs."""
    small_batches(docs.sparkSession)

    def run(batches):
        total, known = np.zeros(BUCKETS * DIM), {}
        places, signs = index_vectors()
        held, sizes = [], []

        def flush():
            if held:
                add_contexts(total, np.concatenate(held), np.repeat(np.arange(len(sizes)), sizes), places, signs)
                held.clear()
                sizes.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = bucket_ids(text, known)
                held.append(ids)
                sizes.append(len(ids))
                if sum(sizes[-1:]) > CHUNK or len(held) % 500 == 0:
                    flush()
        flush()
        parts = total.astype("<i8").reshape(-1, RANGE * DIM)
        some = np.flatnonzero(parts.any(axis=1))
        small = [np.abs(parts[i]).max() < 2**31 for i in some]
        blobs = [parts[i].astype("<i4").tobytes() if s else parts[i].tobytes() for i, s in zip(some, small, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["range", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(blob, "<i4" if len(blob) == RANGE * DIM * 4 else "<i8").astype(np.int64)
                sums[at] = sums[at] + part if at in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], ["range", "sums"])

    schema = "range int, sums binary"
    n = min(partitions(docs.sparkSession), BUCKETS // RANGE)
    texts = docs.select("text")
    splits = texts._jdf.queryExecution().toRdd().getNumPartitions()
    tasks = max(TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism, -(-splits // SPLITS))  # however few cores there are by now
    few = texts.coalesce(tasks)  # each task sends one set of sums
    return few.mapInArrow(run, schema).repartition(n, "range").mapInArrow(add, schema)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) unit context vectors, or zero where a bucket has none: 4 MB at any size."""
    total = np.zeros((BUCKETS // RANGE, RANGE * DIM))
    for row in context_sums(docs).collect():  # at most BUCKETS / RANGE rows
        total[row["range"]] = np.frombuffer(row["sums"], "<i8")
    vectors = total.reshape(BUCKETS, DIM)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, known: dict[str, int]) -> np.ndarray:
    """Mean and standard deviation of the tokens' vectors, and of the likeness of neighbours; zeros for a text without tokens."""
    ids = bucket_ids(text, known)
    out = np.zeros(WIDTH, np.float32)
    if not len(ids):
        return out
    near, near2 = [], []
    for at in range(0, len(ids), CHUNK):
        rows = vectors[ids[at : at + CHUNK + 1]]
        like = np.einsum("ij,ij->i", rows[1:], rows[:-1])
        rows = rows[:CHUNK]
        out[:DIM] += rows.sum(axis=0)
        out[DIM : 2 * DIM] += np.einsum("ij,ij->j", rows, rows)
        near.append(like.sum())
        near2.append(like @ like)
    out[: 2 * DIM] /= len(ids)
    out[2 * DIM :] = sum(near) / max(1, len(ids) - 1), sum(near2) / max(1, len(ids) - 1)
    for mean, square in ((slice(0, DIM), slice(DIM, 2 * DIM)), (2 * DIM, 2 * DIM + 1)):
        out[square] = np.sqrt(np.maximum(out[square] - out[mean] ** 2, 0))
    return out


@dataclass
class Network:
    """Two layers (tanh, then a sigmoid) over standardised inputs, and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def constant(p: float) -> Network:
    """For labels of one kind, or none."""
    n = WIDTH
    p = min(max(p, 1e-3), 1 - 1e-3)
    return Network(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), np.array([np.log(p / (1 - p))]))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 40, seed: int = 5) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the rest sets the temperature."""
    if len(y) < 10 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    fit, held = order[len(y) // 5 :], order[: len(y) // 5]
    scale = x[fit].std(axis=0)
    net = Network(
        x[fit].mean(axis=0), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1),
    )
    params = [net.w1, net.b1, net.w2, net.b2]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - net.mean) / net.scale
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            hidden = np.tanh(z[at] @ net.w1 + net.b1)
            error = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2[0], -60, 60))) - y[at]) / len(at)
            back = np.outer(error, net.w2) * (1 - hidden * hidden)
            step += 1
            for p, g, m, v in zip(params, (z[at].T @ back + 1e-4 * net.w1, back.sum(axis=0), hidden.T @ error + 1e-4 * net.w2, error.sum(keepdims=True)), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    logits, target = net.logits(x[held]), y[held]
    losses = [(float(np.mean(np.logaddexp(0, logits / t) - target * logits / t)), t) for t in np.geomspace(0.25, 8, 41)]
    net.temperature = float(min(losses)[1])
    return net


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from: crc32 of doc_id as text divisible by 5; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, label: str = "quality", left_out: Column | None = None) -> DataFrame:
    """(text, y) of at most bound documents that have one label, 0 or 1, and are not left out (held_out() unless given).

    The labelled ids that docs hold are taken in the order of their hash; of rows that share
    an id the text that sorts first stands for it. Where rows lie makes no difference.
    """
    aside = held_out() if left_out is None else left_out
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(~aside).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other"))
    there = known.where("y = other").join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = there.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most bound rows
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def fitted(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[np.ndarray, Network]:
    small_batches(docs.sparkSession)
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            xs = [pooled(t, shared.value, known).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), batch.column(1).cast(pa.int32())], ["x", "y"])

    rows = labelled_sample(docs, labels, bound).mapInArrow(run, "x binary, y int").collect()  # at most bound rows
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(-1, WIDTH)
    y = np.array([r["y"] for r in rows], np.float64)
    order = np.lexsort((y, *x.T)) if len(x) else []
    return vectors, train(x[order], y[order])


def scorer(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE):
    """A function from a text column to its score, fitted on docs and labels."""
    made, net = fitted(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), bound)
    shared = docs.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        x = [pooled(t, shared.value, known) for t in texts]
        return pd.Series(net.score(np.array(x, np.float64)) if x else [], dtype=float)

    return score


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    labels has doc_id and quality; other values than 0 and 1 and contradictory labels
    are left out. Null and empty texts have no tokens and get the score of the zero
    vector. Without labels, or with labels of one kind, all scores are the share of
    ones (0.5 without any). Texts of any length are pooled whole, CHUNK tokens at a time.
    Repeated rows get a row each; a null doc_id counts as the text '' for the fold. No rows:
    no rows. Other columns are not read.
    """
    score = scorer(docs, labels, bound)("text")
    return docs.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that score_quality() predicts 1 for.

    Null, empty and long texts, odd labels, null and repeated ids: see score_quality(). Equal
    texts go or stay together. No rows: no rows.
    """
    return docs.where(scorer(docs, labels, bound)("text") >= threshold)
