"""Spans to highlight on result pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.spans import folded_spans
from quire.operators.index import Index
from quire.operators.language import Translator, contains_share, detect_language
from quire.plans.parser import parse, parse_rows, plain_words
from quire.plans.search import query_texts


def highlight_terms(query: str, lang: str = "en", shortest: int = 3, stop_lists: dict[str, list[str]] | None = None) -> list[str]:
    """Keywords of at least ``shortest`` letters that are no stop words, and phrases as a whole."""
    return [" ".join(t.words) for t in parse(query, lang, stop_lists) if t.phrase or len(t.words[0]) >= shortest]


def highlight_term_rows(queries: DataFrame, lang: str = "en", shortest: int = 3, stop_lists: dict[str, list[str]] | None = None) -> DataFrame:
    """(query_no, term): highlight_terms() of a table of queries (query_no, query)."""
    terms = parse_rows(queries, lang, stop_lists)
    return terms.where(F.col("phrase") | (F.length("words") >= shortest)).select("query_no", F.col("words").alias("term"))


def highlight(texts: DataFrame, terms: list[str], key: str) -> DataFrame:
    """(key, start, stop): merged places of the terms in texts (key, text), as substrings of the folded lower-case text."""
    return folded_spans(texts, terms, key)


def page_language(text: Column, texts: dict[str, str], default: str | None = None, detect: Callable[[Column, str | None], Column] = detect_language) -> Column:
    """The language whose query (texts, by language) has the greatest share of its words in text.

    Of several with the greatest share the page's own language decides, if it is one of
    them, then default, then the first. detect: finds the page's own language, by frequent
    words unless LanguageModel.detect or another function is given.
    """
    langs = list(texts)
    shares = F.array(*(contains_share(text, plain_words(texts[lang])) for lang in langs))

    def choose(share):
        best = F.filter(F.array(*map(F.lit, langs)), lambda _, i: share[i] == F.array_max(share))
        own = detect(text, default)
        pick = lambda lang: F.when(F.array_contains(best, lang), lang)
        return F.when(F.size(best) == 1, best[0]).otherwise(F.coalesce(pick(own), pick(F.lit(default)) if default else F.lit(None), best[0]))

    return F.transform(F.array(shares), choose)[0] if detect is detect_language else choose(shares)


def display(index: Index, query: str, pages: DataFrame, langs: list[str] | None = None, limit: int | None = None, translate: Translator | None = None, stop_lists: dict[str, list[str]] | None = None, detect: Callable[[Column, str | None], Column] = detect_language) -> DataFrame:
    """(result_id, lang, text, spans) of result pages (doc_rank, page_idx): file and page number, text and the places to highlight.

    pages as search() ranks them, or some of its rows; limit: those of the first documents
    only. Spans are merged and sorted; the terms are those of the page's language, see
    page_language(), which detect is for. A query without words has none.
    """
    langs = langs or ["en"]
    texts = dict(zip(langs, query_texts(query, langs, translate)))
    asked = pages.where(F.col("doc_rank") <= limit) if limit is not None else pages
    shown = asked.select("page_idx").join(index.pages.select("page_idx", "doc_name", "page_no", "text"), "page_idx").withColumn("lang", page_language(F.col("text"), texts, langs[0], detect))
    found = None
    for lang in langs:
        some = highlight(shown.where(F.col("lang") == lang), highlight_terms(texts[lang], lang, stop_lists=stop_lists), "page_idx")
        found = some if found is None else found.unionByName(some)
    spans = found.groupBy("page_idx").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return shown.join(spans, "page_idx", "left").select(F.concat_ws("-", "doc_name", "page_no").alias("result_id"), "lang", "text", F.coalesce("spans", none).alias("spans"))
