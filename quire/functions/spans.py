"""Character spans: occurrences, merging, and mapping back to the text before folding."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.functions.text import EXPANSIONS, fold


def _automaton(grams: list[str]) -> ahocorasick.Automaton:
    """Finds all grams in one pass over a text, however many they are."""
    found = ahocorasick.Automaton()
    for gram in grams:
        found.add_word(gram, len(gram))
    found.make_automaton()
    return found


def places_of(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """(start, stop) of all grams, overlapping ones too."""
    return [(end + 1 - size, end + 1) for end, size in automaton.iter(text)]


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of overlapping or touching spans."""
    found: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], stop))
        else:
            found.append((start, stop))
    return found


def unfolded(spans: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    """Spans of fold(text) as spans of text, by a sorted array of the characters that fold to several.

    A span that starts or ends inside what a character folds to holds the character.
    """
    longer = [i for i, c in enumerate(text) if c in EXPANSIONS]
    if not longer or not spans:
        return spans
    at = np.array(longer)
    extra = np.array([len(EXPANSIONS[text[i]]) - 1 for i in longer])
    before = np.cumsum(extra) - extra
    starts = at + before  # where each begins in the folded text

    def raw(places: np.ndarray) -> np.ndarray:
        last = np.searchsorted(starts, places, side="right") - 1
        inside = np.minimum(places - starts[last], extra[last])
        return np.where(last >= 0, places - before[last] - inside, places)

    both = np.array(spans)
    return list(zip(raw(both[:, 0]).tolist(), (raw(both[:, 1] - 1) + 1).tolist()))


def _spans_of(rows: DataFrame, key: str, find) -> DataFrame:
    """(key, start, stop): the spans that find(*texts) has for each row (key, texts ..)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found = [], []
            for i, texts in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                if texts[0]:
                    spans = find(*texts)
                    own += [i] * len(spans)
                    found += spans
            places = np.array(found, np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(places[:, 0]), pa.array(places[:, 1])], [key, "start", "stop"])

    schema = StructType([rows.schema[key], StructField("start", IntegerType()), StructField("stop", IntegerType())])
    return rows.mapInArrow(run, schema)


def ngram_positions(texts: DataFrame, grams: list[str], key: str) -> DataFrame:
    """(key, start, stop): all places of the grams in texts (key, text), overlapping ones too, in one scan."""
    asked = list(filter(None, dict.fromkeys(grams)))
    if not asked:
        return _spans_of(texts.select(key, "text").limit(0), key, lambda text: [])
    automaton = _automaton(asked)
    return _spans_of(texts.select(key, "text"), key, lambda text: places_of(text, automaton))


def folded_spans(texts: DataFrame, grams: list[str], key: str) -> DataFrame:
    """(key, start, stop): merged places of the grams in the folded lower-case texts (key, text), as spans of the texts; one scan."""
    asked = list(filter(None, dict.fromkeys(grams)))
    rows = texts.select(key, F.lower(fold(F.col("text"))).alias("low"), "text")
    if not asked:
        return _spans_of(rows.limit(0), key, lambda low, text: [])
    automaton = _automaton(asked)
    return _spans_of(rows, key, lambda low, text: unfolded(united(places_of(low, automaton)), text))


def fuse_spans(spans: DataFrame, *key: str) -> DataFrame:
    """Union of overlapping or touching spans (key, start, stop) of each key."""
    before = Window.partitionBy(*key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.col("start") > F.max("stop").over(before), 1).otherwise(0)
    islands = spans.distinct().withColumn("opens", opens).withColumn("island", F.sum("opens").over(so_far))
    return islands.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")
