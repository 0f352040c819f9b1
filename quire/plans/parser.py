"""Query text to terms: quoted phrases and keywords, of one query or of a table of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.functions.text import normalized
from quire.operators.language import stop_words

_QUOTES = str.maketrans({"“": '"', "”": '"', "«": '"', "»": '"'})


@dataclass(frozen=True)
class Term:
    """A keyword (one word) or a phrase."""

    words: tuple[str, ...]
    phrase: bool


def plain_words(text: str) -> list[str]:
    """Words of a query part, by the rules of the index's tokens (text.normalize)."""
    return normalized(text).split()


def parse(query: str, lang: str = "en", lists: dict[str, list[str]] | None = None) -> list[Term]:
    """Terms in order of keywords, then phrases. Typographic quotes count as quotes; of an odd
    number the last is dropped; stop words (lists, by language) go outside quotes only; empty phrases go."""
    text = query.translate(_QUOTES)
    if text.count('"') % 2:
        at = text.rfind('"')
        text = text[:at] + text[at + 1 :]
    parts = text.split('"')
    stop = stop_words(lang, lists)
    keywords = [Term((w,), False) for part in parts[::2] for w in plain_words(part) if w not in stop]
    phrases = [Term(tuple(w), True) for w in map(plain_words, parts[1::2]) if w]
    return keywords + phrases


def parse_rows(queries: DataFrame, lang: str = "en", lists: dict[str, list[str]] | None = None) -> DataFrame:
    """(query_no, term_no, words, phrase) of a table of queries (query_no long, query); null and empty ones have no terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, i, " ".join(t.words), t.phrase) for n, q in zip(*(c.to_pylist() for c in batch.columns)) for i, t in enumerate(parse(q or "", lang, lists))]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["query_no", "term_no", "words", "phrase"])

    return queries.select("query_no", "query").mapInArrow(run, "query_no long, term_no long, words string, phrase boolean")
