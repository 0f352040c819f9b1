"""Search: terms to scored pages, ranked documents, nested answers, counts and CSV."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import embed, matrix
from quire.operators.blocks import RANGES, in_ranges, page_lists, page_ranges, word_pages
from quire.operators.index import Index
from quire.operators.language import Translator, translate_words
from quire.operators.ranks import running, written
from quire.plans.parser import Term, parse, plain_words

TERMS = "lang_no int, term_no int, offset int, word string, term_len int"


def term_rows(spark: SparkSession, variants: list[list[Term]]) -> DataFrame:
    """TERMS of the query in each language."""
    rows = [(lang, no, at, w, len(t.words)) for lang, terms in enumerate(variants) for no, t in enumerate(terms) for at, w in enumerate(t.words)]
    return spark.createDataFrame(rows, TERMS)


def query_texts(query: str, langs: list[str], translate: Translator | None = None) -> list[str]:
    """The query in its own language, the first, and translated into the others."""
    to = translate or translate_words
    return [query if lang == langs[0] else to(query, langs[0], lang) for lang in langs]


def query_variants(query: str, langs: list[str], translate: Translator | None = None, stop_lists: dict[str, list[str]] | None = None) -> list[list[Term]]:
    """The terms of the query in each language."""
    return [parse(text, lang, stop_lists) for text, lang in zip(query_texts(query, langs, translate), langs)]


def asked_lists(index: Index, variants: list[list[Term]]) -> DataFrame:
    """The posting blocks that the terms need: those of a saved index, which lie by word, or those of the terms' words.

    The latter lie among all others, so they are written and all blocks are read once.
    """
    return index.blocks if index.saved else word_lists(index.blocks, {w for terms in variants for t in terms for w in t.words})


def word_lists(lists: DataFrame, words: Iterable[str]) -> DataFrame:
    """The blocks of some words, written."""
    return written(lists.where(F.col("word").isin(sorted(words))), "asked")


def known_terms(vocab: DataFrame, variants: list[list[Term]]) -> list[list[Term]]:
    """The terms without keywords that the index doesn't hold; a phrase with an unknown word stays and matches nothing. vocab: a row a word, or blocks."""
    asked = sorted({w for terms in variants for t in terms if not t.phrase for w in t.words})
    known = {r["word"] for r in vocab.where(F.col("word").isin(asked)).select("word").distinct().collect()} if asked else set()  # at most the query's words
    return [[t for t in terms if t.phrase or t.words[0] in known] for terms in variants]


#: A phrase's rarest word whose pages are collected, as ranges that the other words' blocks are read by; beyond it all their blocks are.
FEW_PLACES = 100_000
#: So many times rarer it must be than the others together: else its pages leave out few of their blocks.
RARER = 16


def phrase_lists(lists: DataFrame, words: Sequence[str], few: int = FEW_PLACES) -> DataFrame:
    """(page_idx, pos array<long>): the places where the words stand one after another in a page, a row a page; lists: blocks of postings.

    The rarest word comes first: the other words' blocks are read only where they may hold
    its pages (those ranges reach the scan), then the words' places meet page by page, rarer
    words before others.
    """
    spark, asked = lists.sparkSession, sorted(set(words))
    known = {r["word"]: r["n"] for r in lists.where(F.col("word").isin(asked)).groupBy("word").agg(F.sum("n").alias("n")).collect()}  # at most the phrase's words
    if len(known) < len(asked):
        return spark.createDataFrame([], "page_idx long, pos array<long>")
    order = sorted(range(len(words)), key=lambda at: (known[words[at]], at))
    places = lambda at, own: page_lists(own.where(F.col("word") == words[at]), "pos").select("page_idx", F.transform("pos", lambda p: p - at).alias("pos"))
    found, near = places(order[0], lists), lists
    rarest = known[words[order[0]]]
    if rarest <= few and RARER * rarest <= sum(known.values()) - rarest:
        pages = word_pages(lists.where(F.col("word") == words[order[0]])).select("page_idx").collect()  # at most few rows
        near = lists.where(in_ranges(page_ranges([r["page_idx"] for r in pages])))
    for at in order[1:]:
        both = shuffled_join(found, places(at, near).withColumnRenamed("pos", "next"))
        found = both.select("page_idx", F.array_intersect("pos", "next").alias("pos")).where(F.size("pos") > 0)
    return found


def phrase_places(lists: DataFrame, words: Sequence[str], few: int = FEW_PLACES) -> DataFrame:
    """(page_idx, pos): where the words stand one after another in a page, see phrase_lists()."""
    return phrase_lists(lists, words, few).select("page_idx", F.explode("pos").alias("pos")).withColumn("pos", F.col("pos").cast("int"))


def shuffled_join(rows: DataFrame, more: DataFrame, how: str = "inner") -> DataFrame:
    """rows and more by page_idx, never by a broadcast: tables of pages are guessed by the bytes of the coded blocks they are made from, far below their own, and would meet on the driver."""
    return rows.join(more.hint("merge"), "page_idx", how)


def term_pages(lists: DataFrame, variants: list[list[Term]]) -> DataFrame:
    """(lang_no, term_no, page_idx): pages that hold a keyword, or a phrase's words one after another; lists: blocks of postings.

    Terms are few, a row for each word of the query, so they are broadcast.
    """
    spark = lists.sparkSession
    single = [(lang, no, t.words[0]) for lang, terms in enumerate(variants) for no, t in enumerate(terms) if len(t.words) == 1]
    keys = spark.createDataFrame(single, "lang_no int, term_no int, word string")
    found = word_pages(lists.where(F.col("word").isin(sorted({w for _, _, w in single})))).join(F.broadcast(keys), "word").select("lang_no", "term_no", "page_idx")
    phrases: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for lang, terms in enumerate(variants):
        for no, t in enumerate(terms):
            if len(t.words) > 1:
                phrases.setdefault(t.words, []).append((lang, no))
    for words, terms in phrases.items():
        each = F.array(*(F.struct(F.lit(lang).alias("lang_no"), F.lit(no).alias("term_no")) for lang, no in terms))
        pages = phrase_lists(lists, words)
        found = found.unionByName(pages.select(F.explode(each).alias("t"), "page_idx").select("t.lang_no", "t.term_no", "page_idx"))
    return found


def page_shares(found: DataFrame, sizes: list[int]) -> DataFrame:
    """(page_idx, matched, n_terms, grep) of the pages that found (lang_no, term_no, page_idx) holds: the best language's share of terms."""
    counts = found.groupBy("lang_no", "page_idx").agg(F.count("*").alias("matched"))
    of = F.element_at(F.array(*(F.lit(n) for n in sizes or [0])), F.col("lang_no") + 1)
    best = counts.withColumn("n_terms", of).groupBy("page_idx").agg(F.max(F.struct((F.col("matched") / F.col("n_terms")).alias("grep"), "matched", "n_terms")).alias("b"))
    return best.select("page_idx", F.col("b.matched").cast("long").alias("matched"), F.col("b.n_terms").cast("long").alias("n_terms"), F.col("b.grep").alias("grep"))


def page_grep(page_dim: DataFrame, found: DataFrame, sizes: list[int]) -> DataFrame:
    """(page_idx, doc_idx, page_no, matched, n_terms, grep): for every page the best language's share of terms."""
    return with_shares(page_dim, page_shares(found, sizes), sizes)


def with_shares(page_dim: DataFrame, shares: DataFrame, sizes: list[int]) -> DataFrame:
    none = {"matched": F.lit(0).cast("long"), "n_terms": F.lit(max(sizes, default=0)).cast("long"), "grep": F.lit(0.0)}
    rows = shuffled_join(page_dim.select("page_idx", "doc_idx", "page_no"), shares, "left")
    return rows.select("page_idx", "doc_idx", "page_no", *(F.coalesce(c, n).alias(c) for c, n in none.items()))


def rank(scored: DataFrame) -> DataFrame:
    """scored pages (grep, distance) with rank_in_doc, and doc_rank by each document's best page.

    Both are running ranks over equal parts, so neither many documents nor one with most of the pages fill a task.
    """
    order = [F.desc("grep"), F.desc("distance"), F.asc("page_idx")]
    inside = running(scored, [F.asc("doc_idx"), *order])
    first = inside.groupBy("doc_idx").agg(F.min("row_before").alias("first"))
    ranked = inside.join(first, "doc_idx").withColumn("rank_in_doc", F.col("row_before") - F.col("first") + 1).drop("row_before", "first")
    best = running(ranked.where("rank_in_doc = 1").select("doc_idx", "grep", "distance", "page_idx"), order)
    return ranked.join(best.select("doc_idx", (F.col("row_before") + 1).alias("doc_rank")), "doc_idx")


def nested(ranked: DataFrame) -> DataFrame:
    """(doc_rank, doc_idx, best, matching, rest): page numbers within the document, best first; the three lists are disjoint."""
    pages = F.array_sort(F.collect_list(F.struct("rank_in_doc", "page_no", "matched")))
    docs = ranked.groupBy("doc_rank", "doc_idx").agg(pages.alias("p"))
    others = F.slice("p", 2, F.greatest(F.size("p"), F.lit(1)))
    number = lambda p: p["page_no"]
    return docs.select(
        "doc_rank", "doc_idx", F.col("p")[0]["page_no"].alias("best"),
        F.transform(F.filter(others, lambda p: p["matched"] > 0), number).alias("matching"), F.transform(F.filter(others, lambda p: p["matched"] == 0), number).alias("rest"),
    )


def result_counts(ranked: DataFrame) -> DataFrame:
    """Documents whose best page holds all terms, some, and all documents; an empty query (n_terms null) finds all in full."""
    best, empty = ranked.where("rank_in_doc = 1"), F.col("n_terms").isNull()
    full = empty | ((F.col("matched") == F.col("n_terms")) & (F.col("matched") > 0))
    return best.agg(F.count_if(full).alias("n_full"), F.count_if(empty | (F.col("matched") > 0)).alias("n_some"), F.count("*").alias("n_docs"))


def answers_csv(answers: DataFrame, docs: DataFrame, n_full: int) -> DataFrame:
    """(line_no, line): a header, then the full matches with their pages."""
    pages = F.array_join(F.concat(F.array("best"), "matching", "rest").cast("array<string>"), "/")
    lines = answers.where(F.col("doc_rank") <= n_full).join(docs.select("doc_idx", "doc_name"), "doc_idx").select(F.col("doc_rank").cast("long").alias("line_no"), F.concat_ws(",", "doc_name", pages).alias("line"))
    head = answers.sparkSession.createDataFrame([(0, "File name,Page numbers")], "line_no long, line string")
    return head.unionByName(lines)


#: Pages of a top answer's documents that are ranked by a window; more of them are ranked in parts.
WINDOW_PAGES = 1_000_000
#: Blocks of vectors that are scored first when distances alone decide.
FIRST_BLOCKS = 32
#: Distances are compared to so many places: sums of the same numbers in another order are ties.
PLACES = 12


class Scores:
    """A query over an index: pages with their shares of terms and distances, in whole or for ranges of pages."""

    def __init__(self, index: Index, pages: DataFrame, variants: list[list[Term]], vectors: DataFrame | None, queries: list[list[float]] | None, lists: DataFrame | None = None):
        """vectors: blocks of page vectors, see operators/matrix.py; queries: the query's vector in each language; lists: the posting blocks of all terms, if not the index's."""
        self.index, self.pages, self.variants = index, pages, variants
        self.lists = index.blocks if lists is None else lists
        self.sizes = [len(v) for v in variants]
        self.vectors, self.queries = (vectors, queries) if vectors is not None and queries else (None, None)

    def shares(self, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
        lists = self.lists if ranges is None else self.lists.where(in_ranges(ranges))
        return page_shares(term_pages(lists, self.variants), self.sizes)

    def with_distance(self, rows: DataFrame, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
        """rows (page_idx, ..) with distance: 0 for pages without a vector."""
        if self.vectors is None:
            return rows.withColumn("distance", F.lit(0.0))
        near = self.vectors if ranges is None else self.vectors.where(in_ranges(ranges))
        found = matrix.scores(near, self.queries).select("page_idx", F.round("score", PLACES).alias("distance"))
        return shuffled_join(rows, found, "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))

    def every(self) -> DataFrame:
        """All pages."""
        return self.with_distance(with_shares(self.pages, self.shares(), self.sizes))

    def first_documents(self, limit: int) -> list:
        """(doc_idx, ..) of the first documents by their best page: at most limit rows.

        Only pages whose share of terms reaches the level that holds enough documents are
        looked at; where no page has a term and distances decide, only blocks of vectors
        whose bound reaches the distance found so far.
        """
        dim = self.pages.select("page_idx", "doc_idx")
        if any(self.sizes):
            hits = shuffled_join(self.shares(), dim).persist()
            levels = hits.groupBy("doc_idx").agg(F.max("grep").alias("grep")).groupBy("grep").count().orderBy(F.desc("grep")).collect()  # as many rows as shares of terms
            seen, least = 0, None
            for r in levels:
                seen, least = seen + r["count"], r["grep"]
                if seen >= limit:
                    break
            if seen >= limit:
                found = _first(self._near(hits.where(F.col("grep") >= least)), limit)
                hits.unpersist()
                return found
            hits.unpersist()
        elif self.vectors is not None and (found := self._first_by_bounds(dim, limit)) is not None:
            return found
        return _first(self.every(), limit)

    def _near(self, rows: DataFrame) -> DataFrame:
        """rows with their distances; of few rows the pages choose the blocks that are read."""
        if self.vectors is None:
            return self.with_distance(rows)
        some = rows.select("page_idx").limit(FEW_PLACES + 1).collect()  # at most FEW_PLACES + 1 rows
        return self.with_distance(rows, page_ranges([r["page_idx"] for r in some]) if len(some) <= FEW_PLACES else None)

    def _first_by_bounds(self, dim: DataFrame, limit: int) -> list | None:
        """The first documents by distance, all shares being 0; None if bounds can't tell."""
        most = matrix.bounds(self.vectors, self.queries)
        best = most.orderBy(F.desc("bound")).limit(FIRST_BLOCKS).collect()
        rows = lambda ranges: self.with_distance(_pages_in(dim, ranges).withColumn("grep", F.lit(0.0)), ranges)
        found = _first(rows([(r["first_page"], r["last_page"]) for r in best]), limit)
        least = found[-1]["distance"] if len(found) == limit else 0.0
        if least <= 0:  # pages without a vector may come before
            return None
        left = most.where(F.col("bound") >= least).select("first_page", "last_page").limit(FEW_PLACES + 1).collect()  # at most FEW_PLACES + 1 rows
        if len(left) > FEW_PLACES:
            return None
        return _first(rows(merged([(r["first_page"], r["last_page"]) for r in left])), limit)

    def top(self, limit: int) -> DataFrame:
        """The pages of the first documents, as rank() has them; nothing is written and no order of all pages is made."""
        spark = self.pages.sparkSession
        first = [(r["doc_idx"], at + 1) for at, r in enumerate(self.first_documents(limit))]
        ids = [doc for doc, _ in first]
        docs = self.index.doc_dim.where(F.col("doc_idx").isin(ids)).select("page_start", "page_end", "n_pages").collect() if ids else []  # at most limit rows
        ranges = merged([(r["page_start"], r["page_end"] - 1) for r in docs])
        pages = self.pages.where(F.col("doc_idx").isin(ids)) if ids else self.pages.limit(0)
        shares = self.shares(ranges) if any(self.sizes) else None
        if shares is None:
            rows = pages.select("page_idx", "doc_idx", "page_no", F.lit(0).cast("long").alias("matched"), F.lit(max(self.sizes, default=0)).cast("long").alias("n_terms"), F.lit(0.0).alias("grep"))
        else:
            rows = with_shares(pages, shares, self.sizes)
        scored = self.with_distance(rows, ranges)
        ranks = F.broadcast(spark.createDataFrame(first, "doc_idx long, doc_rank long"))
        if sum(r["n_pages"] for r in docs) > WINDOW_PAGES:
            return rank(scored).drop("doc_rank").join(ranks, "doc_idx")
        inside = Window.partitionBy("doc_idx").orderBy(F.desc("grep"), F.desc("distance"), F.asc("page_idx"))
        return scored.withColumn("rank_in_doc", F.row_number().over(inside).cast("long")).join(ranks, "doc_idx")


def merged(ranges: list[tuple[int, int]], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges that hold all of the given ones, at most so many: those with the least between them are joined."""
    found: list[list[int]] = []
    for a, b in sorted(ranges):
        if found and a <= found[-1][1] + 1:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    gaps = sorted(((y[0] - x[1], i) for i, (x, y) in enumerate(zip(found, found[1:]))), reverse=True)
    cuts = sorted(i for _, i in gaps[: most - 1])
    ends = [*cuts, len(found) - 1] if found else []
    return [(found[a][0], found[b][1]) for a, b in zip([0, *(c + 1 for c in cuts)], ends)]


def _pages_in(dim: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    inside = F.lit(False)
    for a, b in ranges:
        inside = inside | F.col("page_idx").between(a, b)
    return dim.where(inside)


def _first(scored: DataFrame, limit: int) -> list:
    """doc_idx, grep, distance and page_idx of the first documents by their best page; each task keeps limit of its own."""
    best = scored.groupBy("doc_idx").agg(F.max(F.struct("grep", "distance", (-F.col("page_idx")).alias("before"))).alias("b"))
    rows = best.select("doc_idx", "b.grep", "b.distance", (-F.col("b.before")).alias("page_idx"))
    return rows.orderBy(F.desc("grep"), F.desc("distance"), F.asc("page_idx")).limit(limit).collect()  # at most limit rows


def search(
    index: Index, query: str, langs: list[str] | None = None, docs: list[str] | None = None, page_vectors: DataFrame | None = None, query_vectors: list[list[float]] | None = None,
    translate: Translator | None = None, stop_lists: dict[str, list[str]] | None = None, limit: int | None = None,
) -> DataFrame:
    """Ranked pages of a query; see rank(), nested() and result_counts().

    langs: the query's language, then those it is translated into (translate: by this
    function instead of the glossary). stop_lists: stop words by language instead of the
    library's. docs: names of documents to search, all without; unknown names are ignored.
    Keywords that the index doesn't hold are left out and count for nothing; so do the stop
    words. The distance is the best cosine of the page's vector with the vector of the
    query in a language, 0 without vectors; they are the index's own, if it has any, unless
    given. A query without terms left ranks by distance alone, then page. One without
    any word finds all pages in order, and n_terms is null then.

    limit: the pages of the first so many documents only, with the same ranks. They are
    found without ranking all pages, see Scores.top(). Without it all pages are ranked, by
    tables in the shared folder that stay until the driver ends.
    """
    langs = langs or ["en"]
    pages = index.page_dim
    if docs is not None:
        pages = pages.join(index.doc_dim.where(F.col("doc_name").isin(docs)).select("doc_idx"), "doc_idx", "left_semi")
    if not plain_words(query):
        found = pages.select("page_idx", "doc_idx", "page_no", F.lit(0).cast("long").alias("matched"), F.lit(None).cast("long").alias("n_terms"), F.lit(0.0).alias("grep"), F.lit(0.0).alias("distance"))
        ranked = found.withColumn("rank_in_doc", F.col("page_no") + 1)
        if docs is None:
            ranked = ranked.withColumn("doc_rank", F.col("doc_idx") + 1)
        else:
            ids = sorted(r["doc_idx"] for r in index.doc_dim.where(F.col("doc_name").isin(docs)).select("doc_idx").collect())  # at most the names given
            ranked = ranked.join(F.broadcast(pages.sparkSession.createDataFrame([(doc, at + 1) for at, doc in enumerate(ids)], "doc_idx long, doc_rank long")), "doc_idx")
        return ranked if limit is None else ranked.where(F.col("doc_rank") <= limit)
    variants = query_variants(query, langs, translate, stop_lists)
    lists = asked_lists(index, variants)
    variants = known_terms(index.vocab if index.saved else lists, variants)
    blocks = index.vector_blocks if page_vectors is None else matrix.vector_blocks(page_vectors)
    if query_vectors is None and index.word_vectors is not None:
        asked = [plain_words(text) for text in query_texts(query, langs, translate)]
        query_vectors = embed.query_vectors(index.vocab, index.word_vectors, embed.component_values(index.component), asked)
    scores = Scores(index, pages, variants, blocks, query_vectors, lists)
    return rank(scores.every()) if limit is None else scores.top(limit)


def answer(index: Index, query: str, **how) -> tuple[DataFrame, DataFrame]:
    """(answers, counts) of a query, see nested() and result_counts(); how: as search() takes it."""
    ranked = search(index, query, **how)
    return nested(ranked), result_counts(ranked)


def empty_query(doc_dim: DataFrame) -> DataFrame:
    """Every document in order, its first page best and all others after it."""
    last = F.col("n_pages").cast("int") - 1
    rest = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return doc_dim.select((F.col("doc_idx") + 1).alias("doc_rank"), "doc_idx", F.lit(0).alias("best"), F.array().cast("array<int>").alias("matching"), rest.alias("rest"))
