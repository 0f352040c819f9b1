"""Languages by their letters: smoothed likelihoods of character n-grams, fitted in Spark on a bounded sample."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that a model is fitted on at most.
SAMPLE = 20_000
#: N-grams that a model holds at most, the most frequent ones; their lengths; and what each counts for besides its occurrences.
GRAMS, SIZES, SMOOTHING = 20_000, (1, 2, 3), 0.5
#: Words whose scores, or n-grams, a task remembers.
KNOWN = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def grams_of(word: str) -> list[str]:
    """The n-grams of a lower-case word, with its ends marked."""
    marked = f" {word} "
    return [marked[i : i + n] for n in SIZES for i in range(len(marked) - n + 1) if marked[i : i + n] != " "]


@dataclass
class LanguageModel:
    """langs in order, and for each n-gram the logarithm of its likelihood in each."""

    langs: list[str]
    likely: dict[str, np.ndarray]

    def scores(self, text: str | None, known: dict[str, np.ndarray]) -> np.ndarray:
        """Log-likelihood of the whole text in each language, and how many n-grams that rests on; known remembers words."""
        total = np.zeros(len(self.langs) + 1)
        for word, n in Counter(m.group().lower() for m in _WORD.finditer(text or "")).items():
            if word not in known:
                if len(known) > KNOWN:
                    known.clear()
                found = [self.likely[g] for g in grams_of(word) if g in self.likely]
                known[word] = np.append(np.sum(found, axis=0), len(found)) if found else np.zeros(len(self.langs) + 1)
            total += n * known[word]
        return total

    def score_column(self, text: Column) -> Column:
        """array<double>: scores() of a text."""
        model = self

        @F.arrow_udf("array<double>")
        def score(texts: pa.Array) -> pa.Array:
            known: dict[str, np.ndarray] = {}
            found = [model.scores(t, known) for t in texts.to_pylist()]
            flat = np.concatenate([*found, np.zeros(0)])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * (len(model.langs) + 1), pa.int32()), pa.array(flat))

        return score(text)

    def best(self, scores: Column, default: str | None) -> Column:
        """The likeliest language of scores, the first by name of equal ones; default without any n-gram."""
        langs = F.array(*map(F.lit, self.langs))

        def choose(s: Column) -> Column:
            own = F.slice(s, 1, len(self.langs))
            return F.when(s[len(self.langs)] > 0, langs[F.array_position(own, F.array_max(own)).cast("int") - 1]).otherwise(F.lit(default))

        return F.transform(F.array(scores), choose)[0]

    def detect(self, text: Column, default: str | None = "en") -> Column:
        """The likeliest language of the whole text."""
        return self.best(self.score_column(text), default)

    def document_languages(self, pages: DataFrame, default: str | None = "en", skip: int = 1) -> DataFrame:
        """(doc_idx, lang) of pages (doc_idx, page_no, text): by all pages but the first ``skip``; default where these say nothing."""
        scored = pages.select("doc_idx", self.score_column(F.when(F.col("page_no") >= skip, F.col("text"))).alias("s"))
        sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(len(self.langs) + 1)]
        return scored.groupBy("doc_idx").agg(*sums).select("doc_idx", self.best(F.array(*(F.col(f"s{i}") for i in range(len(sums)))), default).alias("lang"))


def fit_languages(texts: DataFrame, bound: int = SAMPLE, grams: int = GRAMS) -> LanguageModel:
    """A model of texts (text, lang): about bound of them, those of the least hashes, are counted (equal ones all or none); all languages count alike."""
    rows = texts.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text", "lang").alias("hash"))
    last = rows.select("hash").orderBy("hash").limit(bound).agg(F.max("hash")).first()[0]  # bound numbers meet, no texts
    sample = rows.where(F.col("hash") <= F.lit(last)).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, str]] = Counter()

        def out() -> pa.RecordBatch:
            keys = list(counts)
            made = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"])
            counts.clear()
            return made

        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                for word, n in Counter(m.group().lower() for m in _WORD.finditer(text)).items():
                    for g in grams_of(word):
                        counts[lang, g] += n
                if len(counts) > KNOWN:
                    yield out()
        yield out()

    counted = sample.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    of = counted.groupBy("gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("each"))  # at most an entry a language
    kept = of.orderBy(F.desc("all"), "gram").limit(grams).collect()  # at most grams rows
    langs = sorted({e["lang"] for r in kept for e in r["each"]})
    at = {lang: i for i, lang in enumerate(langs)}
    counts = np.full((len(kept), len(langs)), SMOOTHING)
    for i, r in enumerate(kept):
        for e in r["each"]:
            counts[i, at[e["lang"]]] += e["n"]
    logs = np.log(counts / counts.sum(axis=0)) if len(kept) else counts
    return LanguageModel(langs, {r["gram"]: v for r, v in zip(kept, logs)})
