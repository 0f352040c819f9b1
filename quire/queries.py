"""The library's queries over the driver's tables, each with its SQL where SQL can express it.

A paged document is a ``source`` of documents, its pages are its rows by doc_id; the
``flat`` queries take each row as a document of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import spans, text, vectors
from quire.operators import blocks, embed, index, language, language_model, matrix, ranks, segment
from quire.operators import word_vectors as word_vectors_of
from quire.plans import highlight, parser, search
from quire.sources import pages as sources

KEYWORDS = 'the heed "of the" ing'
#: Stands for a translator.
TRANSLATIONS = {"heed": "eau", "ing": "ment"}
LANGS = ["en", "fr"]
DOCS = ["src1", "src3", "src7", "nowhere"]
GRAMS = ["the", "he", "and"]
MIN_COUNT = 30
#: Rows that show every rule of normalisation.
SAMPLES = (
    (-1, "employe(e) a.b 1.2.3 10:30 co-operate a-1 5(a)(iii) ( () (a b) (1.2) (a-b) l'eau 1,5 ,x -y z' 'q"),
    (-2, "Straße Œuvre élan ÿ … Mr. Smith (x-1) 3:4:5 a'b'c"),
    (-3, ""),
)
FOUND: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            return df.select(*(F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))

        FOUND[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- tables and their SQL

def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fold(x: str) -> str:
    out = f"translate({x}, {quoted(text.FROM)}, {quoted(text.TO)})"
    return reduce(lambda s, e: f"replace({s}, {quoted(e[0])}, {quoted(e[1])})", text.EXPANSIONS.items(), out)


_SIGNS = ((r"\.", "[0-9]", 3), (",", "[0-9]", 4), (":", "[0-9]", 5), ("'", "[A-Za-z]", 6), ("-", "[A-Za-z]", 7))


def sql_signs(x: str, which=_SIGNS) -> str:
    """Signs between their kind as control characters; twice, since matches overlap."""
    for sign, kind, code in which:
        for _ in range(2):
            x = f"regexp_replace({x}, {quoted(f'({kind}){sign}({kind})')}, '\\1' || chr({code}) || '\\2', 'g')"
    return x


_BACK = "chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7), '().,:''-'"


def sql_norm(x: str) -> str:
    p = rf"regexp_replace({sql_signs(sql_fold(x))}, '\(([A-Za-z0-9\x03\x07]+)\)', chr(1) || '\1' || chr(2), 'g')"
    return rf"lower(trim(regexp_replace(translate(regexp_replace({p}, '[^A-Za-z0-9\x01-\x07]', ' ', 'g'), {_BACK}), ' +', ' ', 'g')))"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({sql_norm(x)}, ' '), lambda w: w <> '')"


FLAT = "flat AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(t)})" for i, t in SAMPLES) + ") v(doc_id, text))"
PG = (
    "pg AS (SELECT source AS doc_name, doc_id AS page_key, text, dense_rank() OVER (ORDER BY source) - 1 AS doc_idx,"
    " row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page_no, row_number() OVER (ORDER BY source, doc_id) - 1 AS page_idx FROM documents)"
)
_CLASS = quoted("[" + "".join(text.EXPANSIONS) + "]")
WL = f"{PG}, wl AS MATERIALIZED (SELECT *, {sql_words('text')} AS l FROM pg)"
PD = f"{WL}, pd AS (SELECT page_idx, doc_idx, page_no, len(l) AS n_tokens, CAST(coalesce(sum(len(l)) OVER (ORDER BY page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sidx_start FROM wl)"
TK = f"{WL}, tk AS MATERIALIZED (SELECT doc_idx, page_idx, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM wl)"
PO = TK + PD.removeprefix(WL) + ", po AS MATERIALIZED (SELECT word, page_idx, tk.doc_idx, pos, sidx_start + pos AS sidx FROM tk JOIN pd USING (page_idx))"
VO = ", vo AS (SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) - 1 AS widxord, CAST(sum(cnt) OVER (ORDER BY cnt DESC, word ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumcnt FROM (SELECT word, count(*) AS cnt FROM tk GROUP BY word))"


def documents(t):
    return ranks.spread(t("documents"))


def flat(t):
    docs = t("documents").select("doc_id", "text")
    return ranks.spread(docs.unionByName(docs.sparkSession.createDataFrame(SAMPLES, "doc_id long, text string")))


def low(t):
    return flat(t).select("doc_id", F.lower(text.fold(F.col("text"))).alias("text"))


def raw(t):
    return documents(t).select(F.col("source").alias("doc_name"), F.col("doc_id").alias("page_key"), "text")


def numbered(t):
    return index.number_pages(raw(t))


def tokens(t):
    return index.tokenised(index.number_pages(raw(t), tokens=True, texts=False))


def lists(t):
    """Posting blocks; they are written, for those who read them several times."""
    return index.posted(raw(t), texts=False)[1]


def places(t):
    return blocks.word_places(lists(t))


def built(t, texts=False):
    return index.build_index(raw(t), texts=texts)


def translate(query, source, target):
    return language.translate_words(query, source, target, TRANSLATIONS)


# --- text

@query(f"WITH {FLAT} SELECT doc_id, {sql_norm('text')} AS norm FROM flat")
def normalize_text(t):
    return flat(t).select("doc_id", text.normalize(F.col("text")).alias("norm"))


@query(f"WITH {FLAT} SELECT doc_id, translate(regexp_replace({sql_signs('text', _SIGNS[:3])}, '[.,:]', ' ', 'g'), chr(3)||chr(4)||chr(5), '.,:') AS out FROM flat")
def normalize_numeric_punct(t):
    return flat(t).select("doc_id", text.numeric_punctuation(F.col("text")).alias("out"))


@query(f"WITH {FLAT} SELECT doc_id, translate(regexp_replace({sql_signs(sql_fold('text'), _SIGNS[3:])}, '[''-]', ' ', 'g'), chr(6)||chr(7), '''-') AS out FROM flat")
def normalize_word_punct(t):
    return flat(t).select("doc_id", text.word_punctuation(text.fold(F.col("text"))).alias("out"))


@query(rf"WITH {FLAT} SELECT doc_id, translate(array_to_string(regexp_extract_all({sql_signs(sql_fold('text'), (_SIGNS[0], _SIGNS[4]))}, '\(([A-Za-z0-9\x03\x07]+)\)', 1), '|'), chr(3)||chr(7), '.-') AS kept FROM flat")
def normalize_parens(t):
    return flat(t).select("doc_id", F.array_join(text.kept_parens(F.col("text")), "|").alias("kept"))


@query(f"WITH {FLAT} SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS word FROM (SELECT doc_id, {sql_words('text')} AS l FROM flat)")
def tokenize(t):
    return flat(t).select("doc_id", F.posexplode(text.words(F.col("text"))).alias("pos", "word"))


@query(f"SELECT word, count(*) AS cnt FROM (SELECT unnest({sql_words('text')}) AS word FROM documents) GROUP BY word")
def word_count(t):
    return documents(t).select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


@query(f"WITH {FLAT} SELECT doc_id, len(string_split(text, chr(12))) AS n_pages FROM flat")
def page_count(t):
    return flat(t).select("doc_id", sources.page_count(F.col("text")).alias("n_pages"))


@query(f"WITH {FLAT} SELECT doc_id FROM flat WHERE len({sql_words('text')}) = 0")
def empty_docs(t):
    return flat(t).where(F.size(text.words(F.col("text"))) == 0).select("doc_id")


_HITS = ", ".join(f"len(list_filter(l, lambda w: list_contains([{', '.join(map(quoted, sorted(language.stop_words(lang))))}], w))) AS {lang}" for lang in sorted(language.STOPWORDS))
_BEST = " ".join(f"WHEN {lang} > 0 AND {lang} = greatest({', '.join(sorted(language.STOPWORDS))}) THEN '{lang}'" for lang in sorted(language.STOPWORDS))


@query(f"SELECT doc_id, CASE {_BEST} ELSE 'en' END AS detected FROM (SELECT doc_id, {_HITS} FROM (SELECT doc_id, {sql_words('text')} AS l FROM documents))")
def detect_lang(t):
    return documents(t).select("doc_id", language.detect_language(F.col("text")).alias("detected"))


@query(
    f"WITH {WL}, hi AS (SELECT doc_idx, page_no, {_HITS} FROM wl), su AS (SELECT doc_idx, {', '.join(f'coalesce(sum({lang}) FILTER (page_no >= 1), 0) AS {lang}' for lang in sorted(language.STOPWORDS))} FROM hi GROUP BY doc_idx)"
    f" SELECT doc_idx, CASE {_BEST} ELSE 'en' END AS lang FROM su"
)
def document_languages(t):
    return language.document_languages(numbered(t))


@query()
def detect_lang_model(t):
    """By character n-grams, fitted on rows whose crc32(doc_id) leaves a remainder when divided by 5; the others are held out."""
    docs, held = documents(t), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_model.fit_languages(docs.where(~held))
    return docs.select("doc_id", held.alias("held_out"), model.detect(F.col("text")).alias("detected"))


def sql_spans(rows: str, grams: list[str]) -> str:
    """sp: all places of grams in rows (doc_id, low); none of these grams overlaps itself."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, s - {len(g)} AS start, s AS stop FROM (SELECT doc_id, i, n, sum(length(p) + {len(g)}) OVER (PARTITION BY doc_id ORDER BY i) AS s"
        f" FROM (SELECT doc_id, len(l) AS n, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(low, {quoted(g)}) AS l FROM {rows}))) WHERE i < n" for g in grams
    )
    return f"sp AS (SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM ({each}))"


_FUSE = (
    "fu AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM"
    " (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM (SELECT DISTINCT * FROM sp))) GROUP BY doc_id, island)"
)
LOW = f"lo AS MATERIALIZED (SELECT doc_id, text, lower({sql_fold('text')}) AS low FROM flat)"
_SHIFT = (  # only characters that fold to several move what follows
    f"e0 AS (SELECT doc_id, unnest(regexp_extract_all(text, {_CLASS})) AS c, unnest(list_slice(string_split_regex(text, {_CLASS}), 1, -2)) AS part, generate_subscripts(regexp_extract_all(text, {_CLASS}), 1) AS i"
    f" FROM lo WHERE regexp_matches(text, {_CLASS}) AND doc_id IN (SELECT doc_id FROM fu)), e1 AS (SELECT doc_id, i, length({sql_fold('c')}) AS n, length(part) AS before FROM e0),"
    " ex AS (SELECT doc_id, n, sum(before + n) OVER (PARTITION BY doc_id ORDER BY i) - n AS ofs FROM e1),"
    " sh AS (SELECT doc_id, CAST(start - coalesce(sum(least(greatest(start - ofs, 0), n - 1)), 0) AS BIGINT) AS start, CAST(stop - coalesce(sum(least(greatest(stop - 1 - ofs, 0), n - 1)), 0) AS BIGINT) AS stop"
    " FROM fu LEFT JOIN ex USING (doc_id) GROUP BY doc_id, fu.start, fu.stop)"
)


@query(f"WITH {FLAT}, {LOW}, {sql_spans('lo', ['the'])} SELECT * FROM sp")
def ngram_positions(t):
    return spans.ngram_positions(low(t), ["the"], "doc_id")


@query(f"WITH {FLAT}, {LOW}, {sql_spans('lo', GRAMS)}, {_FUSE} SELECT * FROM fu")
def fuse_spans(t):
    return spans.fuse_spans(spans.ngram_positions(low(t), GRAMS, "doc_id"), "doc_id")


@query(f"WITH {FLAT}, {LOW}, {sql_spans('lo', ['ass', 'oe'])}, {_FUSE}, {_SHIFT} SELECT * FROM sh")
def span_shift(t):
    return highlight.highlight(flat(t), ["ass", "oe"], "doc_id")


@query(f"WITH {FLAT}, {LOW}, {sql_spans('lo', ['heed', 'ing', 'of the'])}, {_FUSE}, {_SHIFT} SELECT * FROM sh")
def highlight_spans(t):
    return highlight.highlight(flat(t), highlight.highlight_terms(KEYWORDS), "doc_id")


@query(f"WITH {FLAT}, {LOW} SELECT doc_id, round((contains(low, 'heed')::INT + contains(low, 'ing')::INT) / 2.0::DOUBLE, 6) AS en, round((contains(low, 'eau')::INT + contains(low, 'ment')::INT) / 2.0::DOUBLE, 6) AS fr FROM lo")
def lang_score(t):
    page = F.col("text")
    return flat(t).select("doc_id", F.round(language.contains_share(page, ["heed", "ing"]), 6).alias("en"), F.round(language.contains_share(page, ["eau", "ment"]), 6).alias("fr"))


# --- index

@query(f"WITH {PG} SELECT doc_idx, doc_name, min(page_idx) AS page_start, max(page_idx) + 1 AS page_end, count(*) AS n_pages FROM pg GROUP BY ALL")
def doc_dim(t):
    return index.doc_dim(numbered(t))


@query(f"WITH {PD} SELECT page_idx, doc_idx, page_no, n_tokens, sidx_start FROM pd")
def page_breaks(t):
    return index.page_dim(tokens(t))


@query(f"WITH {PG} SELECT doc_idx, min(page_idx) AS first_page FROM pg GROUP BY doc_idx")
def doc_breaks(t):
    return numbered(t).groupBy("doc_idx").agg(F.min("page_idx").alias("first_page"))


@query(f"WITH {PO} SELECT word, row_number() OVER (ORDER BY min(sidx)) - 1 AS widx FROM po GROUP BY word")
def vocab_first_seen(t):
    return index.first_seen(places(t))


@query(f"WITH {TK}{VO} SELECT word, cnt, widxord FROM vo")
def vocab_rank(t):
    return index.vocabulary(lists(t)).select("word", "cnt", "widxord")


@query(f"WITH {TK}{VO} SELECT word, cumcnt FROM vo")
def vocab_cumcount(t):
    return index.vocabulary(lists(t)).select("word", "cumcnt")


@query(f"WITH {TK}{VO} SELECT word, cnt FROM vo WHERE cnt >= {MIN_COUNT}")
def embedding_vocab(t):
    return index.vocabulary(lists(t)).where(F.col("cnt") >= MIN_COUNT).select("word", "cnt")


@query(f"WITH {PO} SELECT word, page_idx, string_agg(sidx::VARCHAR, ' ' ORDER BY sidx) AS positions FROM po GROUP BY word, page_idx")
def inverted_index(t):
    return blocks.page_lists(lists(t)).select("word", "page_idx", F.array_join(F.col("sidx").cast("array<string>"), " ").alias("positions"))


@query(f"WITH {PO} SELECT word, page_idx, string_agg(sidx::VARCHAR, ' ' ORDER BY sidx) AS positions FROM po GROUP BY word, page_idx")
def merged_index(t):
    """The same from two indexes, each of the sources whose names hash alike, that are merged without their texts."""
    pages = raw(t).withColumn("half", F.pmod(F.crc32(F.col("doc_name").cast("binary")), F.lit(2)))
    whole = index.merged([index.build_index(pages.where(F.col("half") == half).drop("half")) for half in (0, 1)])
    return blocks.page_lists(whole.blocks).select("word", "page_idx", F.array_join(F.col("sidx").cast("array<string>"), " ").alias("positions"))


@query(f"WITH {PO} SELECT page_idx, pos, sidx FROM po WHERE word = 'heed'")
def posting_lookup(t):
    """From a saved index: what is read of the posting blocks are the row groups that may hold the word."""
    path = ranks.scratch_path(t("region").sparkSession, "index")
    return index.build_saved(raw(t), path).lookup("heed").select("page_idx", "pos", "sidx")


@query(f"WITH {PO} SELECT count(*) AS n_postings, count(DISTINCT sidx) AS n_positions, max(sidx) AS last, count(*) = count(DISTINCT sidx) AND count(*) = max(sidx) + 1 AS sound FROM po")
def index_integrity(t):
    return index.integrity(lists(t))


@query(f"WITH {WL} SELECT page_idx, array_to_string(l, ' ') AS tokens, len(l) AS n FROM wl")
def page_tokens(t):
    return tokens(t).select("page_idx", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n"))


@query(f"WITH {PO} SELECT sidx, page_idx FROM po")
def asof_page_lookup(t):
    dim = index.page_dim(tokens(t))
    total = dim.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return index.pages_of_positions(dim.sparkSession.range(0, total).withColumnRenamed("id", "sidx"), dim)


@query(f"WITH {PG} SELECT page_idx, doc_idx, doc_name, page_no FROM pg")
def page_to_doc(t):
    return numbered(t).select("page_idx", "doc_idx", "doc_name", "page_no")


# --- query and search

_TERMS = "tm(lang_no, term_no, ofs, word, term_len) AS (VALUES (0, 0, 0, 'heed', 1), (0, 1, 0, 'ing', 1), (0, 2, 0, 'of', 2), (0, 2, 1, 'the', 2), (1, 0, 0, 'the', 1), (1, 1, 0, 'eau', 1), (1, 2, 0, 'ment', 1), (1, 3, 0, 'of', 2), (1, 3, 1, 'the', 2))"
_TP = f"{_TERMS}, tp AS (SELECT DISTINCT lang_no, term_no, page_idx FROM (SELECT lang_no, term_no, term_len, page_idx, pos - ofs AS s, count(DISTINCT ofs) AS n FROM po JOIN tm USING (word) GROUP BY ALL) WHERE n = term_len)"
_KT = ", kt AS (SELECT lang_no, count(DISTINCT term_no) AS n FROM tm WHERE lang_no < {n} AND (term_len > 1 OR word IN (SELECT word FROM tk)) GROUP BY lang_no)"
_GREP = (
    _KT + ", gr AS (SELECT page_idx, max(struct_pack(grep := matched / n, matched := matched, n_terms := n)) AS b FROM (SELECT lang_no, page_idx, count(*) AS matched, any_value(n) AS n FROM tp JOIN kt USING (lang_no) GROUP BY ALL) GROUP BY page_idx)"
    ", sc AS (SELECT page_idx, doc_idx, page_no, coalesce(b.matched, 0) AS matched, coalesce(b.n_terms, (SELECT max(n) FROM kt)) AS n_terms, coalesce(b.grep, 0.0) AS grep FROM pd LEFT JOIN gr USING (page_idx))"
)
_ONE, _TWO = _GREP.format(n=1), _GREP.format(n=2)
_RANK = (
    ", ra AS (SELECT *, row_number() OVER (PARTITION BY doc_idx ORDER BY grep DESC, {d} page_idx) AS rank_in_doc FROM sc),"
    " rd AS (SELECT doc_idx, row_number() OVER (ORDER BY grep DESC, {d} page_idx) AS doc_rank FROM ra WHERE rank_in_doc = 1), rk AS (SELECT * FROM ra JOIN rd USING (doc_idx))"
)
_R = _RANK.format(d="")
_LISTS = (
    ", ne AS (SELECT doc_rank, doc_idx, min(page_no) FILTER (rank_in_doc = 1) AS best, coalesce(string_agg(page_no::VARCHAR, '/' ORDER BY rank_in_doc) FILTER (rank_in_doc > 1 AND matched > 0), '') AS matching,"
    " coalesce(string_agg(page_no::VARCHAR, '/' ORDER BY rank_in_doc) FILTER (rank_in_doc > 1 AND matched = 0), '') AS rest FROM rk GROUP BY ALL)"
)


def terms(t, langs=("en",)):
    return search.term_rows(t("region").sparkSession, search.query_variants(KEYWORDS, list(langs), translate))


def hits(t, langs=("en",)):
    variants = search.query_variants(KEYWORDS, list(langs), translate)
    return search.term_pages(search.word_lists(lists(t), {w for terms in variants for one in terms for w in one.words}), variants)


def grep(t, langs=("en",)):
    made = built(t)
    variants = search.query_variants(KEYWORDS, list(langs), translate)
    asked = search.asked_lists(made, variants)
    variants = search.known_terms(asked, variants)
    found = search.term_pages(asked, variants)
    return search.page_grep(made.page_dim, found, [len(v) for v in variants])


def ranked(t, docs=None):
    return search.search(built(t), KEYWORDS, docs=docs)


def joined(answers):
    lists = [F.array_join(F.col(c).cast("array<string>"), "/").alias(c) for c in ("matching", "rest")]
    return answers.select("doc_rank", "doc_idx", "best", *lists)


QUERIES = ("“of the” heed and « ing » the \"odd", KEYWORDS, '""', 'cœur "Straße employe(e)" 1.2 a.b', 'the of and', '" "heed" the" and "ing', "l’été co-operate (x", "", '"')
_ASK = (  # every turn of a conversation is a query; each sentence end but the last opens or closes a quote
    "q AS (SELECT conv_id * 1000 + turn AS query_no, replace(text, '. ', '\" ') AS query FROM conversations UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {quoted(q)})" for i, q in enumerate(QUERIES)) + ") v(query_no, query))"
)
_PARSE = (
    _ASK + ", q1 AS (SELECT query_no, translate(query, '“”«»', '\"\"\"\"') AS s FROM q),"
    " q2 AS (SELECT query_no, CASE WHEN (length(s) - length(replace(s, '\"', ''))) % 2 = 1 THEN left(s, length(s) - strpos(reverse(s), '\"')) || right(s, strpos(reverse(s), '\"') - 1) ELSE s END AS s FROM q1),"
    " q3 AS (SELECT query_no, unnest(string_split(s, '\"')) AS part, generate_subscripts(string_split(s, '\"'), 1) AS i FROM q2), q4 AS (SELECT query_no, i, " + sql_words("part") + " AS l FROM q3),"
    " kw AS (SELECT query_no, false AS phrase, i, generate_subscripts(l, 1) AS j, unnest(l) AS words FROM q4 WHERE i % 2 = 1),"
    " al AS (SELECT * FROM kw WHERE words NOT IN (" + ", ".join(map(quoted, sorted(language.stop_words("en")))) + ") UNION ALL SELECT query_no, true, i, 0, array_to_string(l, ' ') FROM q4 WHERE i % 2 = 0 AND len(l) > 0)"
)


@query(f"WITH {_PARSE} SELECT query_no, row_number() OVER (PARTITION BY query_no ORDER BY phrase, i, j) - 1 AS term_no, words, phrase FROM al")
def parse_query(t):
    return parser.parse_rows(asked(t))


def asked(t):
    """Every turn of a conversation as a query with quotes, and queries that show every rule."""
    turns = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_no"), F.replace("text", F.lit(". "), F.lit('" ')).alias("query"))
    return turns.unionByName(turns.sparkSession.createDataFrame([(-1 - i, q) for i, q in enumerate(QUERIES)], "query_no long, query string"))


@query(f"WITH {_TERMS} SELECT lang_no, term_no, ofs AS \"offset\", word, term_len FROM tm WHERE word IN (SELECT unnest({sql_words('text')}) FROM documents)")
def query_terms(t):
    return terms(t, LANGS).join(index.page_tokens(tokens(t)).select("word"), "word", "left_semi").select("lang_no", "term_no", "offset", "word", "term_len")


@query(f"WITH {_PARSE} SELECT query_no, words AS term FROM al WHERE phrase OR length(words) >= 3")
def highlight_terms(t):
    return highlight.highlight_term_rows(asked(t))


_WORDS = "CASE p " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in TRANSLATIONS.items()) + " ELSE p END"


@query(f"WITH {_ASK} SELECT query_no, array_to_string(list_transform(string_split(query, ' '), lambda w: array_to_string(list_transform(string_split(w, '\"'), lambda p: {_WORDS}), '\"')), ' ') AS query FROM q")
def translate_query(t):
    return asked(t).select("query_no", language.translated(F.col("query"), TRANSLATIONS).alias("query"))


@query(f"WITH {PO}, {_TP} SELECT term_no, page_idx FROM tp WHERE lang_no = 0")
def term_pages(t):
    return hits(t).select("term_no", "page_idx")


@query(f"WITH {PO} SELECT a.page_idx, count(*) AS n FROM po a JOIN po b ON a.page_idx = b.page_idx AND b.pos = a.pos + 1 WHERE a.word = 'of' AND b.word = 'the' GROUP BY a.page_idx")
def phrase_search(t):
    return search.phrase_places(search.word_lists(lists(t), ("of", "the")), ("of", "the")).groupBy("page_idx").agg(F.count("*").alias("n"))


@query(f"WITH {TK}{VO} SELECT arg_min(word, struct_pack(cnt := cnt, word := word)) AS word, min(cnt) AS cnt FROM vo WHERE word IN ('heed', 'ing', 'of', 'the')")
def rarest_term(t):
    counts = lists(t).where(F.col("word").isin("heed", "ing", "of", "the")).groupBy("word").agg(F.sum("n").alias("cnt"))
    return counts.agg(F.min_by("word", F.struct("cnt", "word")).alias("word"), F.min("cnt").alias("cnt"))


@query(f"WITH {PO}, {_TP} SELECT page_idx FROM tp WHERE lang_no = 0 GROUP BY page_idx HAVING count(*) = 3")
def pages_all_terms(t):
    return hits(t).groupBy("page_idx").agg(F.count("*").alias("n")).where("n = 3").select("page_idx")


@query(f"WITH {PO}, {_TP} SELECT DISTINCT page_idx FROM tp")
def pages_any_term(t):
    return hits(t, LANGS).select("page_idx").distinct()


@query(f"WITH {TK} SELECT page_idx, round((2 * max((word = 'heed')::INT) + max((word = 'ing')::INT)) / 3.0::DOUBLE, 6) AS grep FROM tk WHERE word IN ('heed', 'ing') GROUP BY page_idx")
def dup_terms(t):
    variants = [parser.parse("heed heed ing")]
    pages, made = index.posted(raw(t), texts=False)
    found = search.term_pages(made, variants)
    return search.page_grep(index.page_dim(pages), found, [3]).where("matched > 0").select("page_idx", F.round("grep", 6).alias("grep"))


@query(f"WITH {PO}, {_TP}{_ONE} SELECT page_idx, matched, n_terms, round(grep, 6) AS grep FROM sc")
def page_grep(t):
    return grep(t).select("page_idx", "matched", "n_terms", F.round("grep", 6).alias("grep"))


@query(f"WITH {PO}, {_TP}{_TWO} SELECT page_idx, matched, n_terms, round(grep, 6) AS grep FROM sc")
def multilang_grep(t):
    return grep(t, LANGS).select("page_idx", "matched", "n_terms", F.round("grep", 6).alias("grep"))


@query(f"WITH {PO}, {_TP}{_ONE} SELECT page_idx, row_number() OVER (ORDER BY sc.grep DESC, page_idx) AS page_rank, round(grep, 6) AS grep FROM sc")
def ranked_pages(t):
    pages = ranks.running(grep(t), [F.desc("grep"), F.asc("page_idx")])
    return pages.select("page_idx", (F.col("row_before") + 1).alias("page_rank"), F.round("grep", 6).alias("grep"))


@query(f"WITH {PO} SELECT count(*) FILTER (words = 2) AS n_full, count(*) AS n_docs FROM (SELECT doc_idx, max(w) AS words FROM (SELECT doc_idx, page_idx, count(DISTINCT word) FILTER (word IN ('heed', 'ing')) AS w FROM pd LEFT JOIN po USING (page_idx, doc_idx) GROUP BY ALL) GROUP BY doc_idx)")
def unknown_words(t):
    """A keyword that no page holds doesn't keep documents from holding all terms."""
    return search.result_counts(search.search(built(t), "heed zzqqzz ing")).select("n_full", "n_docs")


@query(f"WITH {PO}, {_TP}{_ONE}{_R} SELECT doc_idx, doc_rank, page_idx AS best_page, matched FROM rk WHERE rank_in_doc = 1")
def ranked_docs(t):
    return ranked(t).where("rank_in_doc = 1").select("doc_idx", "doc_rank", F.col("page_idx").alias("best_page"), "matched")


@query(f"WITH {PO}, {_TP}{_ONE}{_R}{_LISTS} SELECT * FROM ne")
def answers_nested(t):
    return joined(search.nested(ranked(t)))


@query(f"WITH {PO}, {_TP}{_ONE}{_R} SELECT count(*) FILTER (matched = n_terms AND matched > 0) AS n_full, count(*) FILTER (matched > 0) AS n_some, count(*) AS n_docs FROM rk WHERE rank_in_doc = 1")
def result_counts(t):
    return search.result_counts(ranked(t))


@query(f"WITH {PO}, {_TP}{_ONE}{_R} SELECT doc_rank, doc_name || '-' || page_no AS result_id FROM rk JOIN (SELECT DISTINCT doc_idx, doc_name FROM pg) USING (doc_idx) WHERE rank_in_doc = 1")
def result_id(t):
    best = ranked(t).where("rank_in_doc = 1").join(index.doc_dim(numbered(t)).select("doc_idx", "doc_name"), "doc_idx")
    return best.select("doc_rank", F.concat_ws("-", "doc_name", F.col("page_no").cast("string")).alias("result_id"))


@query(f"WITH {PO}, {_TP}{_ONE}{_R}{_LISTS} SELECT doc_rank, doc_idx, best FROM ne ORDER BY doc_rank LIMIT 10")
def top_answers(t):
    """Without an order of all pages."""
    return search.nested(search.search(built(t), KEYWORDS, limit=10)).select("doc_rank", "doc_idx", "best")


@query(f"WITH {PO}, {_TP}{_ONE}{_RANK.format(d='').replace('FROM sc)', 'FROM sc WHERE doc_idx IN (SELECT doc_idx FROM pg WHERE doc_name IN (' + ', '.join(map(quoted, DOCS)) + ')))')}{_LISTS} SELECT * FROM ne")
def filtered_search(t):
    return joined(search.nested(ranked(t, DOCS)))


@query(f"WITH {PG} SELECT doc_idx + 1 AS doc_rank, doc_idx, 0::BIGINT AS best, '' AS matching, coalesce(string_agg(page_no::VARCHAR, '/' ORDER BY page_no) FILTER (page_no > 0), '') AS rest FROM pg GROUP BY doc_idx")
def empty_query(t):
    return joined(search.answer(built(t), " ,")[0])


@query(f"WITH {PG} SELECT count(DISTINCT doc_idx) AS n_full, count(DISTINCT doc_idx) AS n_some, count(DISTINCT doc_idx) AS n_docs FROM pg")
def empty_query_counts(t):
    return search.answer(built(t), "")[1]


@query(f"WITH {FLAT}, {LOW}, hi AS (SELECT doc_id, {_HITS} FROM (SELECT doc_id, {sql_words('text')} AS l FROM flat)), sa AS (SELECT doc_id, contains(low, 'heed')::INT + contains(low, 'ing')::INT AS e, contains(low, 'eau')::INT + contains(low, 'ment')::INT AS f, CASE {_BEST} ELSE 'en' END AS own FROM lo JOIN hi USING (doc_id)) SELECT doc_id, CASE WHEN e > f THEN 'en' WHEN f > e THEN 'fr' WHEN own IN ('en', 'fr') THEN own ELSE 'en' END AS lang FROM sa")
def display_language(t):
    texts = {"en": "heed ing", "fr": "eau ment"}
    return flat(t).select("doc_id", highlight.page_language(F.col("text"), texts, "en").alias("lang"))


@query(
    f"WITH {PO}, {_TP}{_ONE}{_R}{_LISTS} SELECT 0::BIGINT AS line_no, 'File name,Page numbers' AS line UNION ALL SELECT doc_rank, doc_name || ',' || concat_ws('/', best::VARCHAR, nullif(matching, ''), nullif(rest, '')) FROM ne JOIN (SELECT DISTINCT doc_idx, doc_name FROM pg) USING (doc_idx)"
    " WHERE doc_rank <= (SELECT count(*) FROM rk WHERE rank_in_doc = 1 AND matched = n_terms AND matched > 0)"
)
def answers_csv(t):
    rows = ranked(t)
    return search.answers_csv(search.nested(rows), index.doc_dim(numbered(t)), search.result_counts(rows).first()["n_full"])


# --- vectors: embeddings stand for word vectors (vec_id = rank), its first row for the component

DIM = 64
_U = "u AS (SELECT embedding::DOUBLE[] AS u FROM embeddings WHERE vec_id = 0)"
_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
_WV = ", wv AS (SELECT word, cnt, 0.001 / (0.001 + cnt / (SELECT sum(cnt) FROM vo)::DOUBLE) AS w, embedding::DOUBLE[] AS vec FROM vo JOIN embeddings ON vec_id = widxord)"
_SUM = ", ".join(f"sum(n * w * vec[{i + 1}]) / sum(n)" for i in range(DIM))
_PV = f", pv AS (SELECT page_idx, [{_SUM}] AS vec FROM (SELECT page_idx, word, count(*) AS n FROM tk GROUP BY ALL) JOIN wv USING (word) GROUP BY page_idx)"
_LESS = f", {_U}, pr AS (SELECT page_idx, list_transform(list_zip(vec, u, list_resize(list_value({_DOT.format(a='vec', b='u')}), {DIM}, {_DOT.format(a='vec', b='u')})), lambda x: x[1] - x[2] * x[3]) AS vec FROM pv, u)"
_UNIT = "list_transform({v}, lambda x: CASE WHEN n > 0 THEN x / n ELSE 0 END)"


def component(t):
    return [float(x) for x in t("embeddings").where("vec_id = 0").first()["embedding"]]


def word_vectors(t, vocab):
    return vocab.join(t("embeddings").select(F.col("vec_id").alias("widxord"), F.col("embedding").alias("vec")), "widxord").select("word", "vec")


def rounded(df, *keys):
    """One column a dimension is compared as a text of numbers with 5 places."""
    return df.select(*keys, F.posexplode("vec").alias("dim", "x")).select(*keys, "dim", F.round("x", 5).alias("x"))


def means(t):
    made = built(t)
    return embed.sif_vectors(blocks.word_pages(made.blocks), made.vocab, word_vectors(t, made.vocab), DIM)


@query(f"WITH {_U} SELECT vec_id, round({_DOT.format(a='embedding', b='u')}, 6) AS score FROM embeddings, u WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(t):
    found = matrix.top_rows(t("embeddings").where("vec_id <> 0"), component(t), 20)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, unnest(range({DIM})) AS dim, round(unnest({_UNIT.format(v='v')}), 5) AS x FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE * 9))) AS n FROM embeddings)")
def l2_normalize(t):
    tripled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return rounded(t("embeddings").select("vec_id", vectors.unit(tripled).alias("vec")), "vec_id")


@query(f"WITH {_U} SELECT vec_id, unnest(range({DIM})) AS dim, round(unnest(list_transform(list_zip(embedding, u), lambda x: x[1]::DOUBLE - x[2] * d)), 5) + 0.0 AS x FROM (SELECT vec_id, embedding, u, {_DOT.format(a='embedding', b='u')} AS d FROM embeddings, u)")
def remove_component(t):
    u = F.array(*(F.lit(x) for x in component(t)))
    return rounded(t("embeddings").select("vec_id", vectors.without(F.col("embedding"), u).alias("vec")), "vec_id").withColumn("x", F.col("x") + 0.0)


@query(f"WITH {TK}{VO} SELECT word, round(0.001 / (0.001 + cnt / (SELECT sum(cnt) FROM vo)::DOUBLE), 6) AS weight FROM vo")
def sif_weight(t):
    vocab = index.vocabulary(lists(t))
    total = vocab.agg(F.coalesce(F.sum("cnt"), F.lit(1))).first()[0]
    return vocab.select("word", F.round(vectors.sif(F.col("cnt"), F.lit(float(total))), 6).alias("weight"))


@query(f"WITH {TK}{VO}{_WV}{_PV} SELECT page_idx, unnest(range({DIM})) AS dim, round(unnest(vec), 5) + 0.0 AS x FROM pv")
def sif_page_vector(t):
    return rounded(means(t), "page_idx").withColumn("x", F.col("x") + 0.0)


_QV = "tk0(word) AS (VALUES {words})"
_ASKED = "('the'), ('heed'), ('of'), ('the'), ('ing')"


def query_vector_of(t, query):
    vocab = index.vocabulary(lists(t))
    return embed.query_vectors(vocab, word_vectors(t, vocab), component(t), [parser.plain_words(query)])[0]


_QU = (
    f", {_QV}, qm AS (SELECT [{_SUM}] AS vec FROM (SELECT word, count(*) AS n FROM tk0 GROUP BY word) JOIN wv USING (word)), {_U},"
    f" qr AS (SELECT list_transform(list_zip(vec, u, list_resize(list_value({_DOT.format(a='vec', b='u')}), {DIM}, {_DOT.format(a='vec', b='u')})), lambda x: x[1] - x[2] * x[3]) AS v FROM qm, u),"
    f" qv AS (SELECT {_UNIT.format(v='v')} AS q FROM (SELECT v, sqrt({_DOT.format(a='v', b='v')}) AS n FROM qr))"
)


@query(f"WITH {TK}{VO}{_WV}{_QU.format(words=_ASKED)} SELECT unnest(range({DIM})) AS dim, round(unnest(q), 5) + 0.0 AS x FROM qv")
def query_vector(t):
    found = query_vector_of(t, KEYWORDS)
    return t("region").sparkSession.createDataFrame(list(enumerate(found)), "dim long, x double").select("dim", (F.round("x", 5) + 0.0).alias("x"))


_DIST = (
    f"{_PV}{_QU}, pr AS (SELECT page_idx, list_transform(list_zip(vec, u, list_resize(list_value({_DOT.format(a='vec', b='u')}), {DIM}, {_DOT.format(a='vec', b='u')})), lambda x: x[1] - x[2] * x[3]) AS v FROM pv, u),"
    f" ds AS (SELECT page_idx, round(CASE WHEN n > 0 THEN {_DOT.format(a='v', b='q')} / n ELSE 0 END, 12) AS distance FROM (SELECT page_idx, v, sqrt({_DOT.format(a='v', b='v')}) AS n FROM pr), qv)"
)


def embedded(t):
    made = built(t)
    return index.embed_pages(made, word_vectors(t, made.vocab), component(t))


@query(
    f"WITH {PO}{VO}{_WV}{_DIST.format(words=_ASKED)}, {_TP}{_ONE}{_RANK.format(d='distance DESC,').replace('FROM sc)', 'FROM (SELECT sc.*, coalesce(distance, 0.0) AS distance FROM sc LEFT JOIN ds USING (page_idx)))')}"
    " SELECT doc_rank, rank_in_doc, doc_idx, page_idx, matched, round(distance, 6) + 0.0 AS distance FROM rk"
)
def search_pages(t):
    out = search.search(embedded(t), KEYWORDS)
    return out.select("doc_rank", "rank_in_doc", "doc_idx", "page_idx", "matched", (F.round("distance", 6) + 0.0).alias("distance"))


FOUND["search"] = FOUND.pop("search_pages")
SQL["search"] = SQL.pop("search_pages")


_STOP = "('the'), ('of'), ('and')"


@query(
    f"WITH {PO}{VO}{_WV}{_DIST.format(words=_ASKED)}, {_TP}{_ONE}{_RANK.format(d='distance DESC,').replace('FROM sc)', 'FROM (SELECT sc.*, coalesce(distance, 0.0) AS distance FROM sc LEFT JOIN ds USING (page_idx)))')}"
    " SELECT doc_rank, rank_in_doc, doc_idx, page_idx, matched, round(distance, 6) + 0.0 AS distance FROM rk WHERE doc_rank <= 10"
)
def search_top(t):
    """The pages of the first ten documents, found without an order of all pages."""
    out = search.search(embedded(t), KEYWORDS, limit=10)
    return out.select("doc_rank", "rank_in_doc", "doc_idx", "page_idx", "matched", (F.round("distance", 6) + 0.0).alias("distance"))


@query(
    f"WITH {PO}{VO}{_WV}{_DIST.format(words=_STOP)}, sc AS (SELECT page_idx, doc_idx, 0::BIGINT AS matched, coalesce(distance, 0.0) AS distance FROM pd LEFT JOIN ds USING (page_idx))"
    f"{_RANK.format(d='distance DESC,').replace('grep DESC, ', '')} SELECT doc_rank, rank_in_doc, doc_idx, page_idx, round(distance, 6) + 0.0 AS distance FROM rk WHERE doc_rank <= 5"
)
def stopword_top(t):
    """Of the first five documents by distance alone: blocks of vectors whose bound is too low are not read."""
    found = search.search(embedded(t), "the of and", limit=5)
    return found.select("doc_rank", "rank_in_doc", "doc_idx", "page_idx", (F.round("distance", 6) + 0.0).alias("distance"))


@query(
    f"WITH {PO}{VO}{_WV}{_DIST.format(words=_STOP)}, sc AS (SELECT page_idx, doc_idx, 0::BIGINT AS matched, coalesce(distance, 0.0) AS distance FROM pd LEFT JOIN ds USING (page_idx))"
    f"{_RANK.format(d='distance DESC,').replace('grep DESC, ', '')} SELECT doc_rank, doc_idx, page_idx, matched, round(distance, 6) + 0.0 AS distance FROM rk WHERE rank_in_doc = 1"
)
def stopword_query(t):
    """Stop words alone: pages are ranked by the cosine of their vectors with that of the query."""
    found = search.search(embedded(t), "the of and").where("rank_in_doc = 1")
    return found.select("doc_rank", "doc_idx", "page_idx", "matched", (F.round("distance", 6) + 0.0).alias("distance"))


_PCA = (  # the power method on the covariance matrix
    f"WITH RECURSIVE dv AS MATERIALIZED (SELECT vec_id, unnest(range({DIM})) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), mu AS (SELECT dim, avg(x) AS m FROM dv GROUP BY dim), ce AS MATERIALIZED (SELECT vec_id, dim, x - m AS x FROM dv JOIN mu USING (dim)),"
    " co AS MATERIALIZED (SELECT a.dim AS i, b.dim AS j, sum(a.x * b.x) AS c FROM ce a JOIN ce b USING (vec_id) GROUP BY ALL), ro AS (SELECT i, list(c ORDER BY j) AS r FROM co GROUP BY i), ma AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM ro),"
    f" it(k, v) AS (SELECT 0, list_transform(range({DIM}), lambda i: 1.0::DOUBLE + i / 100.0) UNION ALL SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM it, ma WHERE k < 3000))"
    f" SELECT unnest(range({DIM})) AS dim, round(abs(unnest(v)), 4) AS size FROM it WHERE k = 3000"
)


@query(_PCA)
def pca_component(t):
    found = embed.first_component(t("embeddings"), "embedding")
    return t("region").sparkSession.createDataFrame([(i, abs(x)) for i, x in enumerate(found)], "dim long, size double").withColumn("size", F.round("size", 4))


@query()
def word2vec(t):
    """From the sentences of the segmented documents."""
    sentences = segment.segment(numbered(t)).select(text.bulk_words("sentence").alias("tokens"))
    return word_vectors_of.train_word_vectors(sentences, min_count=MIN_COUNT)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_docs(t):
    return sources.pending(t("documents"), t("labels"), "doc_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT page_id FROM pages)")
def obsolete_docs(t):
    """Outputs (vectors) whose input (the page of the same number) is gone."""
    return sources.pending(t("embeddings"), t("pages").withColumnRenamed("page_id", "vec_id"), "vec_id")


# --- segmentation of conversations (a page is a turn); the dictionary is the benchmark's words

_CV = "cv AS (SELECT conv_id AS doc_idx, turn AS page_no, text FROM conversations)"
_FR = (
    rf", fr AS (SELECT doc_idx, page_no, generate_subscripts(l, 1) - 1 AS frag_no, trim(regexp_replace(unnest(l), '\s+', ' ', 'g')) AS frag FROM (SELECT *, string_split(replace(regexp_replace(text, '(Mr|Ms|Mrs|Dr)\.', '\1', 'g'), '. ', '.' || chr(10)), chr(10)) AS l FROM cv))"
)
_DICT = f", di AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower({sql_fold('text')}), '[a-z]+')) AS word FROM benchmark)"
_RUNS = "regexp_extract_all(lower(" + sql_fold("{c}") + "), '[a-z]+')"
_KE = f", ru AS (SELECT DISTINCT doc_idx, page_no, frag_no, unnest({_RUNS.format(c='frag')}) AS run FROM fr), ke AS MATERIALIZED (SELECT fr.* FROM fr SEMI JOIN (SELECT * FROM ru SEMI JOIN di ON run = word) k USING (doc_idx, page_no, frag_no))"
_MF = (
    r", m0 AS (SELECT *, right(lag(frag) OVER (PARTITION BY doc_idx ORDER BY page_no, frag_no), 1) AS z, left(frag, 1) AS a, split_part(frag, ' ', 1) AS head FROM ke),"
    r" m1 AS (SELECT *, coalesce(regexp_matches(z, '[\p{L}\p{N}]'), false) AS soft_end, coalesce(regexp_matches(z, '[\p{Ll}\-):;," + '"' + r"'']'), false) AS hard_end,"
    r" regexp_matches(a, '[\p{L}\p{N}($" + '"' + r"'']') AS soft_start, regexp_matches(a, '\p{Ll}') AS hard_start FROM m0),"
    " m2 AS (SELECT *, hard_start AND length(head) > 1 AND head IN (SELECT word FROM di) AS very_hard_start FROM m1),"
    " mf AS MATERIALIZED (SELECT *, very_hard_start OR (soft_start AND hard_end) OR (hard_start AND soft_end) AS merge FROM m2)"
)
_SE = (
    ", s0 AS (SELECT *, CAST(sum(CASE WHEN merge THEN 0 ELSE 1 END) OVER (PARTITION BY doc_idx ORDER BY page_no, frag_no) AS BIGINT) AS sent_no FROM mf),"
    " s1 AS (SELECT doc_idx, sent_no, min(page_no) AS page_no, string_agg(frag, ' ' ORDER BY page_no, frag_no) AS sentence FROM s0 GROUP BY ALL),"
    f" s2 AS (SELECT DISTINCT doc_idx, sent_no, unnest({_RUNS.format(c='sentence')}) AS run FROM s1), se AS MATERIALIZED (SELECT s1.* FROM s1 SEMI JOIN (SELECT * FROM s2 SEMI JOIN di ON run = word AND length(run) > 1) k USING (doc_idx, sent_no))"
)


def turns(t):
    return t("conversations").select(F.col("conv_id").alias("doc_idx"), F.col("turn").alias("page_no"), "text")


def dictionary(t):
    return t("benchmark").select(F.explode(text.letter_runs(F.col("text"))).alias("word")).distinct()


def kept(t):
    return segment.with_known_words(segment.fragments(turns(t)), "frag", dictionary(t))


@query(f"WITH {_CV}{_FR} SELECT * FROM fr")
def seg_fragments(t):
    return segment.fragments(turns(t))


@query(f"WITH {_CV}{_FR}{_DICT}{_KE} SELECT * FROM ke")
def seg_filter(t):
    return kept(t)


@query(f"WITH {_CV}{_FR}{_DICT}{_KE}{_MF} SELECT doc_idx, page_no, frag_no, soft_end, hard_end, soft_start, hard_start, very_hard_start, merge FROM mf")
def seg_merge_flags(t):
    return segment.scanned(kept(t), dictionary(t)).drop("frag", "sent_no")


@query(f"WITH {_CV}{_FR}{_DICT}{_KE}{_MF}{_SE} SELECT * FROM se")
def seg_sentences(t):
    return segment.segment(turns(t), dictionary(t))


@query(f"WITH {_CV}{_FR}{_DICT}{_KE}{_MF}{_SE} SELECT cv.doc_idx, cv.page_no, coalesce(string_agg(sentence, chr(10) ORDER BY sent_no), '') AS text FROM cv LEFT JOIN se USING (doc_idx, page_no) GROUP BY ALL")
def seg_pages(t):
    return segment.segmented_pages(turns(t), segment.segment(turns(t), dictionary(t)))


@query(f"WITH {_CV}{_FR}{_DICT}{_KE}{_MF}{_SE} SELECT doc_idx, page_no, string_agg(sentence, chr(10) ORDER BY sent_no) AS text FROM se WHERE page_no >= 1 GROUP BY ALL")
def page_text(t):
    return segment.segmented_pages(turns(t), segment.segment(turns(t), dictionary(t)), n_ignore=1).where("text <> ''")


@query(f"WITH {_CV}{_FR}{_DICT}{_KE}{_MF}{_SE} SELECT doc_idx, sent_no, page_no, array_to_string({sql_words('sentence')}, ' ') AS tokens FROM se")
def sentence_tokens(t):
    found = segment.segment(turns(t), dictionary(t))
    return found.select("doc_idx", "sent_no", "page_no", F.array_join(text.words(F.col("sentence")), " ").alias("tokens"))
