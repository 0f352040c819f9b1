"""Offline language detection and translation; both can be replaced by other functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import fold, folded, words

# Frequent words of each language, as they are written; compared in their folded form.
STOPWORDS = {
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die ein eine einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind über um und von war wie wir zu zum zur".split(),
    "en": "a about an and are as at be been but by can for from had has have he her his if in into is it its not of on or that the their there they this to was we were which will with you".split(),
    "es": "al como con de del el ella en entre era es esta este fue ha han la las le lo los más muy no o para pero por que se ser si sin sobre son su sus también un una y ya".split(),
    "fr": "à au avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur mais même ne nous ont ou par pas plus pour qu que qui sa se ses si son sont sur un une vous".split(),
}
# English words and their French ones, for queries when no other translator is given.
GLOSSARY = {
    "agreement": "accord", "article": "article", "book": "livre", "city": "ville", "convention": "convention", "country": "pays", "day": "jour", "earth": "terre", "fire": "feu", "hand": "main",
    "history": "histoire", "house": "maison", "language": "langue", "law": "loi", "letter": "lettre", "life": "vie", "light": "lumière", "name": "nom", "new": "nouveau", "number": "nombre",
    "page": "page", "paper": "papier", "peace": "paix", "people": "peuple", "present": "présente", "question": "question", "right": "droit", "river": "rivière", "school": "école", "sea": "mer",
    "search": "recherche", "state": "état", "sun": "soleil", "time": "temps", "tree": "arbre", "war": "guerre", "water": "eau", "word": "mot", "work": "travail", "world": "monde", "year": "année",
}
_PAIRS = {("en", "fr"): GLOSSARY, ("fr", "en"): {fr: en for en, fr in GLOSSARY.items()}}


def stop_words(lang: str, lists: dict[str, list[str]] | None = None) -> set[str]:
    """Folded stop words of a language; none for one without a list."""
    return {folded(w).lower() for w in (STOPWORDS if lists is None else lists).get(lang, [])}


def language_scores(text: Column, lists: dict[str, list[str]] | None = None) -> Column:
    """array<struct<hits, lang>>: how many tokens are frequent words of each language."""
    found = STOPWORDS if lists is None else lists
    frequent = {lang: sorted(stop_words(lang, found)) for lang in sorted(found)}
    among = lambda tokens, words: F.filter(tokens, lambda w: w.isin(*words))
    of_any = lambda tokens: among(tokens, sorted(set().union(*frequent.values())))
    counted = lambda hits: F.array(*(F.struct(F.size(among(hits, words)).alias("hits"), F.lit(lang).alias("lang")) for lang, words in frequent.items()))
    return F.transform(F.array(of_any(words(text))), counted)[0]


def best_language(scores: Column, default: str | None) -> Column:
    """The language with most hits of scores, the first by name of equal ones; default without any."""

    def choose(scores):
        best = F.array_max(F.transform(scores, lambda s: s["hits"]))
        return F.when(best > 0, F.filter(scores, lambda s: s["hits"] == best)[0]["lang"]).otherwise(F.lit(default))

    return F.transform(F.array(scores), choose)[0]


def detect_language(text: Column, default: str | None = "en", lists: dict[str, list[str]] | None = None) -> Column:
    """The language with most frequent words in the whole text."""
    return best_language(language_scores(text, lists), default)


def document_languages(pages: DataFrame, default: str | None = "en", skip: int = 1, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_idx, lang) of pages (doc_idx, page_no, text): by all pages but the first ``skip``; default where these say nothing."""
    found = STOPWORDS if lists is None else lists
    scores = F.when(F.col("page_no") >= skip, language_scores(F.col("text"), found))
    counted = pages.select("doc_idx", scores.alias("s"))
    sums = [F.coalesce(F.sum(F.col("s")[i]["hits"]), F.lit(0)) for i in range(len(found))]
    whole = F.array(*(F.struct(n.alias("hits"), F.lit(lang).alias("lang")) for lang, n in zip(sorted(found), sums)))
    return counted.groupBy("doc_idx").agg(whole.alias("s")).select("doc_idx", best_language(F.col("s"), default).alias("lang"))


def translate_words(text: str, source: str, target: str, glossary: dict[str, str] | None = None) -> str:
    """text with the glossary's words replaced, quotes kept; a word without an entry stays as it is."""
    known = _PAIRS.get((source, target), {}) if glossary is None else glossary
    return " ".join('"'.join(known.get(part, part) for part in word.split('"')) for word in text.split(" "))


def translated(text: Column, glossary: dict[str, str]) -> Column:
    """translate_words() of a column."""
    known = F.create_map(*(F.lit(x) for pair in glossary.items() for x in pair)) if glossary else None
    one = lambda part: part if known is None else F.coalesce(F.try_element_at(known, part), part)
    word = lambda w: F.array_join(F.transform(F.split(w, '"', -1), one), '"')
    return F.array_join(F.transform(F.split(text, " ", -1), word), " ")


#: (text, source, target) to the text in the target language.
Translator = Callable[[str, str, str], str]


def contains_share(page: Column, terms: list[str]) -> Column:
    """Share of terms that the folded lower-case page holds as substrings; 0 without terms."""
    low = F.lower(fold(page))
    hits = sum((F.when(F.instr(low, t) > 0, 1).otherwise(0) for t in terms), F.lit(0))
    return hits / F.lit(float(max(1, len(terms))))
