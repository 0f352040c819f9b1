import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire.functions import spans, text
from quire.operators import blocks, embed, index, language_model, matrix, ranks, segment, word_vectors
from quire.plans import highlight, parser, search
from quire.sources import pages
from quire.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations region".split()
ORACLES = "normalize_text normalize_parens inverted_index vocab_cumcount asof_page_lookup answers_nested answers_csv multilang_grep search seg_pages span_shift highlight_spans obsolete_docs asof_page_lookup ranked_pages detect_lang parse_query stopword_query unknown_words empty_query_counts document_languages display_language pca_component phrase_search posting_lookup term_pages rarest_term top_answers search_top stopword_top cosine_topk merged_index".split()


@pytest.mark.parametrize(
    "given, expected",
    [
        ("employe(e)", "employe(e)"), ("a.b", "a b"), ("1.2", "1.2"), ("10:30", "10:30"), ("co-operate", "co-operate"), ("a-1", "a 1"), ("5(a)(iii)", "5(a)(iii)"),
        ("( ()", ""), ("Straße", "strasse"), ("1.2.3,4", "1.2.3,4"), ("(a b)", "a b"), ("l’été", "l'ete"), ("", ""),
    ],
)
def test_normalize(spark, given, expected):
    row = spark.createDataFrame([(given,)], "t string").select(text.normalize(F.col("t"))).first()[0]
    assert row == expected
    assert spark.createDataFrame([(row,)], "t string").select(text.normalize(F.col("t"))).first()[0] == row == text.normalized(given)


def test_one_normalisation(spark):
    """Words of a query are those of the index, whatever the sign or alphabet."""
    given = ["cœur Straße employe(e) l’été co-operate", "Жизнь щука Ёлка", "Ψυχή θάλασσα φως", "5(a)(iii) 1.2.3,4 10:30 a.b (x", "ÆON ﬁn ½ 100€ 5° « a » — …", "", "naïve Łódź İstanbul ığ", "\u0001x\u0002 (a\u0001)"]
    rows = spark.createDataFrame(list(enumerate(given)), "i long, t string").select("i", text.words(F.col("t")).alias("w")).collect()
    assert {r.i: r.w for r in rows} == {i: parser.plain_words(g) for i, g in enumerate(given)}
    assert parser.plain_words("cœur Straße employe(e) Жизнь щука θάλασσα") == ["coeur", "strasse", "employe(e)", "zhizn'", "shchuka", "thalassa"] or parser.plain_words("Жизнь") == ["zhizn"]


def test_parser():
    terms = parser.parse("“of the” heed the « ing » \"odd")
    assert [(t.words, t.phrase) for t in terms] == [(("heed",), False), (("odd",), False), (("of", "the"), True), (("ing",), True)]
    assert parser.parse('""') == []
    assert highlight.highlight_terms("an heed") == ["heed"]


def test_spans(spark):
    low = spark.createDataFrame([(1, "aaa b"), (2, None), (3, "")], "id long, text string")
    found = spans.ngram_positions(low, ["aa", "b"], "id").collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 2), (1, 1, 3), (1, 4, 5)]
    fused = spans.fuse_spans(spark.createDataFrame([(1, 0, 2), (1, 2, 3), (1, 5, 6), (1, 0, 9)], "id long, start int, stop int"), "id").collect()
    assert [tuple(r) for r in fused] == [(1, 0, 9)]
    raw = spark.createDataFrame([(1, "Maß Maße")], "id long, text string")
    assert sorted(tuple(r) for r in highlight.highlight(raw, ["asse"], "id").collect()) == [(1, 5, 8)]


def test_segmentation(spark):
    rows = spark.createDataFrame([(0, 0, "Mr. Smith went home\nand slept. Next"), (0, 1, "day came.\n1234")], "doc_idx long, page_no long, text string")
    found = sorted((r.sent_no, r.page_no, r.sentence) for r in segment.segment(rows).collect())
    assert found == [(1, 0, "Mr Smith went home and slept."), (2, 0, "Next day came.")]


def test_index(spark, tmp_path):
    raw = spark.createDataFrame([("b", 1, "of the heed"), ("a", 1, "heed of the the"), ("a", 2, "")], "doc_name string, page_key long, text string")
    made = index.build_index(raw)
    made.save(str(tmp_path / "i"))
    opened = index.open_index(spark, str(tmp_path / "i"))
    assert index.integrity(opened.postings).first()["sound"]
    assert [tuple(r) for r in opened.page_dim.orderBy("page_idx").select("page_idx", "doc_idx", "n_tokens", "sidx_start").collect()] == [(0, 0, 4, 0), (1, 0, 0, 4), (2, 1, 3, 4)]
    assert [r.word for r in opened.vocab.orderBy("widxord").collect()] == ["the", "heed", "of"]
    ranked = search.search(opened, '"heed of" the "unknown word"')
    assert {(r.page_idx, r.matched) for r in ranked.collect()} == {(0, 1), (1, 0), (2, 0)}
    assert search.result_counts(search.search(opened, '"of the"')).first().asDict() == {"n_full": 2, "n_some": 2, "n_docs": 2}
    assert search.search(opened, "heed", docs=["nowhere"]).count() == 0
    assert search.result_counts(search.search(opened, "heed zzqq")).first().asDict() == {"n_full": 2, "n_some": 2, "n_docs": 2}
    assert search.result_counts(search.search(opened, 'heed "zzqq of"')).first()["n_full"] == 0
    answers, counts = search.answer(opened, " ")
    assert counts.first().asDict() == {"n_full": 2, "n_some": 2, "n_docs": 2}
    assert [tuple(r) for r in answers.orderBy("doc_rank").collect()] == [(1, 0, 0, [], [1]), (2, 1, 0, [], [])]
    assert opened.page_vectors is None


def test_words_of_other_spellings_are_found(spark):
    raw = spark.createDataFrame([("a", 1, "le cœur bat"), ("b", 1, "die Straße"), ("c", 1, "un employe(e) parle")], "doc_name string, page_key long, text string")
    made = index.build_index(raw)
    for query, page in (("cœur", 0), ("coeur", 0), ("Straße", 1), ("STRASSE", 1), ("employe(e)", 2), ("'employe(e)'", 2)):
        assert [r.page_idx for r in search.search(made, query).where("matched > 0").collect()] == [page], query


def test_index_with_vectors(spark, tmp_path):
    """Built with segmentation and vectors, saved, opened and searched by cosine alone."""
    animals, tools = "cat dog horse bird fish", "hammer saw drill nail screw"
    raw = spark.createDataFrame([(f"d{i}", 0, f"The {a} saw it.\n1234\nand so did {a}") for i, a in enumerate([animals, tools] * 20)], "doc_name string, page_key long, text string")
    vectors = spark.createDataFrame([(w, [1.0 + 0.01 * i, 0.1 * i, 0.5]) for i, w in enumerate(animals.split())] + [(w, [0.1 * i, 1.0 + 0.01 * i, 0.5]) for i, w in enumerate(tools.split())] + [("the", [0.3, 0.3, 1.0])], "word string, vec array<double>")
    made = index.embed_pages(index.build_index(raw, segmented=True), vectors, [0.0, 0.0, 1.0])
    assert all("1234" not in r.text for r in made.pages.collect())
    made.save(str(tmp_path / "i"))
    opened = index.open_index(spark, str(tmp_path / "i"))
    assert opened.page_vectors.count() == 40 and opened.component.count() == 3
    best = search.search(opened, "cat horse", stop_lists={"en": ["cat", "horse"]}).where("doc_rank <= 20").collect()
    assert {r.doc_idx for r in best} == {i for i, r in enumerate(sorted(f"d{i}" for i in range(40))) if int(r[1:]) % 2 == 0} and all(r.matched == 0 for r in best)
    trained = index.embed_pages(index.build_index(raw), dim=8, min_count=1, iterations=1)
    assert embed.dimension(trained.word_vectors) == 8 and trained.page_vectors.count() == 40
    index.build_index(raw).save(str(tmp_path / "i"))
    assert index.open_index(spark, str(tmp_path / "i")).page_vectors is None


def topic_sentences(spark, n, seed=1):
    rng = random.Random(seed)
    topics = [[f"{t}{i}" for i in range(8)] for t in "ab"]
    return topics, spark.createDataFrame([([rng.choice(topics[k % 2]) for _ in range(20)],) for k in range(n)] + [(None,), ([],), (["alone"],)], "tokens array<string>")


@pytest.mark.parametrize("part_tokens", [word_vectors.PART_TOKENS, 1500])
def test_trained_vectors_tell_topics_apart(spark, part_tokens):
    topics, sentences = topic_sentences(spark, 600)
    found = word_vectors.train_word_vectors(sentences, dim=16, min_count=1, part_tokens=part_tokens)
    vec = {r.word: r.vec for r in found.collect()}
    assert set(vec) == {w for t in topics for w in t}
    cosine = lambda x, y: sum(a * b for a, b in zip(vec[x], vec[y])) / (sum(a * a for a in vec[x]) * sum(b * b for b in vec[y])) ** 0.5
    same = [cosine(a, b) for t in topics for a in t for b in t if a < b]
    other = [cosine(a, b) for a in topics[0] for b in topics[1]]
    assert sum(same) / len(same) > sum(other) / len(other) + 0.5


def test_vectors_are_trained_in_many_tasks_of_bounded_size(spark):
    topics, sentences = topic_sentences(spark, 300)
    dealt, parts = word_vectors.dealt_sentences(sentences, part_tokens=600)
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert parts == 10 and len(sizes) == 10 and max(sizes) < 60 and sum(sizes) == 300
    words = word_vectors.part_words(dealt, 200)
    counts = {r.word: r.cnt for r in words.select("word", "cnt").distinct().collect()}
    told = {}
    for r in sentences.collect():
        for w in r.tokens or []:
            told[w] = told.get(w, 0) + 1
    assert counts == {w: n for w, n in told.items() if n >= 200}
    model = word_vectors.train_round(dealt, words, None, sum(counts.values()), 4, 3, 1, 0)
    assert {r.word for r in model.collect()} == set(counts) and all(len(r.vec) == len(r.out) == 16 for r in model.collect())
    assert word_vectors.train_word_vectors(sentences.limit(0), dim=4).count() == 0


def test_display(spark):
    raw = spark.createDataFrame([("a", 0, "Das Maß heed"), ("a", 1, "l'eau de la mer et la terre"), ("b", 0, "nothing here")], "doc_name string, page_key long, text string")
    made = index.build_index(raw)
    how = {"langs": ["en", "fr"], "translate": lambda text, source, target: text.replace("heed", "eau")}
    ranked = search.search(made, "heed", **how)
    shown = {r.result_id: (r.lang, r.text, [tuple(s) for s in r.spans]) for r in highlight.display(made, "heed", ranked, **how).collect()}
    assert shown == {"a-0": ("en", "Das Maß heed", [(8, 12)]), "a-1": ("fr", "l'eau de la mer et la terre", [(2, 5)]), "b-0": ("en", "nothing here", [])}
    assert {r.result_id for r in highlight.display(made, "heed", ranked, limit=1, **how).collect()} == {"a-0", "a-1"}
    assert all(not r.spans for r in highlight.display(made, " ", ranked).collect())


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.bin").write_bytes(b"x|y")
    (tmp_path / "d.json").write_text('{"word": 1, "other": 2}')
    assert sorted(tuple(r) for r in pages.read_text_pages(spark, str(tmp_path)).collect()) == [("a", 0, "one"), ("a", 1, "two")]
    found = pages.read_documents(spark, str(tmp_path), lambda c: c.decode().split("|"), "*.bin")
    assert sorted(tuple(r) for r in found.collect()) == [("b", 0, "x"), ("b", 1, "y")]
    done = spark.createDataFrame([("b",)], "doc_name string")
    assert pages.read_documents(spark, str(tmp_path), lambda c: [""], "*.bin", done).count() == 0
    (tmp_path / "words").write_text("un\n\n deux \n")
    assert {tuple(r) for r in pages.read_line_dictionary(spark, str(tmp_path / "words"), "fr").collect()} == {("fr", "un"), ("fr", "deux")}
    pages.write_pages(found, str(tmp_path / "out"))
    kept = pages.done_documents(spark, str(tmp_path / "out"))
    assert [r.doc_name for r in kept.collect()] == ["b"] and pages.read_documents(spark, str(tmp_path), lambda c: [""], "*.bin", kept).count() == 0
    assert {r.word for r in pages.read_json_dictionary(spark, str(tmp_path / "d.json"), "en").collect()} == {"word", "other"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", 0, "of the of")], pages.PAGES).write.parquet(str(tmp_path / "in"))
    query = ingest.append_tokens(ingest.stream_tokens(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    for n, page in ((1, "of the of"), (2, "of and")):
        spark.createDataFrame([("b", n, page)], pages.PAGES).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.count_words(ingest.stream_tokens(spark, str(tmp_path / "in")), str(tmp_path / "counts"), str(tmp_path / "c2")).awaitTermination()
    assert {tuple(r) for r in ingest.latest_counts(spark, str(tmp_path / "counts")).collect()} == {("of", 5), ("the", 2), ("and", 1)}


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    relation = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    shown = lambda rows: sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)
    assert shown(df.select(*columns).collect()) == shown(relation.select(",".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_running_ranks(spark):
    from quire.operators.ranks import running

    words = sorted({f"{a}{b}" for a in ("", "a", "ab", "abc", "abcd", "é") for b in ("", "x", "yz")})
    counts = [(w, 1 + i % 3) for i, w in enumerate(words)] + [(f"w{i:04}", 2) for i in range(500)]
    rows = spark.createDataFrame(counts, "word string, cnt long").repartition(5)
    ranked = running(rows, [F.desc("cnt"), F.asc("word")], "cnt")
    expected, before = [], 0
    for i, (w, n) in enumerate(sorted(counts, key=lambda r: (-r[1], r[0].encode()))):
        expected.append((w, n, i, before))
        before += n
    assert sorted(map(tuple, ranked.collect())) == sorted(expected)
    assert running(rows.limit(0), [F.asc("word")]).count() == 0


def test_word_vectors_come_whole(spark):
    found = __spark_entry__.queries()["word2vec"](spark, SF).collect()
    assert found and all(len(r.vec) == 100 and any(r.vec) for r in found)


def test_language_of_a_long_text(spark):
    from quire.operators.language import detect_language, document_languages

    text = "the " * 1300 + "les " * 5000
    assert spark.createDataFrame([(text,)], "text string").select(detect_language(F.col("text"))).first()[0] == "fr"
    assert spark.createDataFrame([("zzz",)], "text string").select(detect_language(F.col("text"), None)).first()[0] is None
    rows = [(0, 0, "the and of is it"), (0, 1, "les et des"), (1, 0, "les et des"), (2, 0, None), (2, 1, "der und ist")]
    found = document_languages(spark.createDataFrame(rows, "doc_idx long, page_no long, text string"))
    assert {tuple(r) for r in found.collect()} == {(0, "fr"), (1, "en"), (2, "de")}


def test_saved_postings_are_pruned(spark, tmp_path):
    raw = spark.createDataFrame([("a", i, " ".join(f"w{i % 7}{k}" for k in range(50))) for i in range(40)], "doc_name string, page_key long, text string")
    index.build_index(raw).save(str(tmp_path / "i"))
    opened = index.open_index(spark, str(tmp_path / "i"))
    plan = opened.lookup("w35").select("page_idx")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(word), EqualTo(word,w35)]" in plan and "Window" not in plan
    assert sorted(r.page_idx for r in opened.lookup("w35").collect()) == [i for i in range(40) if i % 7 == 3]


@pytest.mark.parametrize("block, size", [(4096, 1_000_000), (1, 7), (5, 40)])
def test_blocks_hold_all_places(spark, block, size):
    rng = random.Random(block)
    pages = [[rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 5, 40]))] for _ in range(60)]
    rows, start = [], 1 << 40
    for i, p in enumerate(pages):
        rows.append((3 * i, start, p))
        start += len(p)
    made = blocks.posting_blocks(spark.createDataFrame(rows, "page_idx long, sidx_start long, tokens array<string>").repartition(3, "page_idx"), block, size)
    expected = sorted((w, i, at, s + at) for i, s, p in rows for at, w in enumerate(p))
    assert sorted(map(tuple, blocks.word_places(made).collect())) == expected
    counts = {}
    for w, i, _, sidx in expected:
        counts.setdefault((w, i), []).append(sidx)
    assert sorted(map(tuple, blocks.word_pages(made).collect())) == sorted((w, i, len(s)) for (w, i), s in counts.items())
    assert sorted((r.word, r.page_idx, r.sidx) for r in blocks.page_lists(made).collect()) == sorted((w, i, s) for (w, i), s in counts.items())
    assert all(r.n <= block or r.n_pages == 1 or r.n - counts[r.word, r.last_page].__len__() < block for r in made.collect())
    assert blocks.posting_blocks(spark.createDataFrame([], "page_idx long, sidx_start long, tokens array<string>")).count() == 0


def test_ranges():
    assert blocks.page_ranges([9, 1, 2, 50, 3, 51], 2) == [(1, 9), (50, 51)] and blocks.page_ranges([], 3) == [] and blocks.page_ranges([7]) == [(7, 7)]
    assert search.merged([(5, 9), (0, 2), (3, 4), (20, 30)], 64) == [(0, 9), (20, 30)] and search.merged([(0, 1), (5, 6), (50, 60)], 2) == [(0, 6), (50, 60)] and search.merged([]) == []


def test_rare_words_choose_the_blocks_of_frequent_ones(spark, tmp_path):
    """The rarer the other word, the fewer rows of "the" are read; the ranges reach the scan."""
    raw = [("d", i, "the " * 30 + ("seldom " if i == 700 else "") + ("sometimes the " if i % 100 == 0 else "") + "often the end") for i in range(1000)]
    made = index.build_index(spark.createDataFrame(raw, "doc_name string, page_key long, text string"))
    small = blocks.posting_blocks(made.page_dim.join(spark.createDataFrame([(i, t.split()) for _, i, t in raw], "page_idx long, tokens array<string>"), "page_idx"), 100)
    small.repartitionByRange(2, "word", "first_page").sortWithinPartitions("word", "first_page").write.parquet(str(tmp_path / "b"))
    lists = spark.read.parquet(str(tmp_path / "b"))
    total = lists.where("word = 'the'").count()
    read = {}
    for word in ("seldom", "sometimes", "often"):
        pages = [r.page_idx for r in blocks.word_pages(lists.where(F.col("word") == word)).collect()]
        near = lists.where(blocks.in_ranges(blocks.page_ranges(pages))).where("word = 'the'")
        read[word] = near.count()
        assert "GreaterThanOrEqual(last_page" in near._jdf.queryExecution().toString().replace(" ", "")
        places = {(r.page_idx, r.pos) for r in search.phrase_places(lists, (word, "the")).collect()}
        assert places == {(i, t.split().index(word)) for _, i, t in raw if f"{word} the" in t}
    assert read["seldom"] <= 2 < read["sometimes"] < read["often"] == total > 200
    assert search.phrase_places(lists, ("the", "nowhere")).count() == 0
    assert search.phrase_places(lists, ("the", "the"), few=0).count() == 1000 * 29
    bytes_a_token = lists.agg(F.sum(F.length("data")) / F.sum("n")).first()[0]
    assert bytes_a_token < 2


def test_scores_of_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(i // 50, 1) for _ in range(6)]) for i in range(300)]
    asked = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(2)]
    expected = {i: max(sum(a * b for a, b in zip(v, q)) for q in asked) for i, v in rows}
    monkeypatch.setattr(matrix, "ROWS", 7)
    made = matrix.vector_blocks(spark.createDataFrame(rows, "page_idx long, vec array<double>").repartitionByRange(3, "page_idx").sortWithinPartitions("page_idx"))
    assert {r.page_idx: r.vec for r in matrix.vector_rows(made).collect()} == dict(rows)
    found = {r.page_idx: r.score for r in matrix.scores(made, asked).collect()}
    assert found.keys() == expected.keys() and all(abs(found[i] - expected[i]) < 1e-9 for i in found)
    for r in matrix.bounds(made, asked).collect():
        assert r.n_pages <= 7 and max(expected[i] for i in range(r.first_page, r.last_page + 1)) <= r.bound
    table = spark.createDataFrame([(i, v) for i, v in rows] + [(1000 + i, v) for i, v in rows[:20]], "vec_id long, embedding array<float>").repartition(5)
    one = lambda v: sum(__import__("struct").unpack("f", __import__("struct").pack("f", a))[0] * b for a, b in zip(v, asked[0]))
    best = sorted(((-round(one(v), 9), i) for i, v in [*rows, *((1000 + i, v) for i, v in rows[:20])]))[:25]
    assert [r.vec_id for r in matrix.top_rows(table, asked[0], 25).collect()] == [i for _, i in best]


@pytest.mark.parametrize("query", ["alpha beta", 'beta "gamma alpha"', "the of", "rare", "alpha zzqq"])
def test_first_documents_equal_the_whole_order(spark, monkeypatch, query):
    rng = random.Random(9)
    vocabulary = ["alpha", "beta", "gamma", "delta", "the", "of", "and"]
    raw = [(f"d{rng.randint(0, 25)}", i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))) + (" rare" if i % 97 == 5 else "")) for i in range(400)] + [("d3", 999, ""), ("hot", 1, "")] + [("hot", i, "alpha beta the") for i in range(2, 60)]
    vectors = spark.createDataFrame([(w, [rng.gauss(0, 1) for _ in range(5)]) for w in vocabulary[:-1]], "word string, vec array<double>")
    monkeypatch.setattr(matrix, "ROWS", 9)
    monkeypatch.setattr(search, "FIRST_BLOCKS", 3)
    made = index.build_index(spark.createDataFrame(raw, "doc_name string, page_key long, text string"))
    with_vectors = index.embed_pages(made, vectors)
    for own, how, limits in ((with_vectors, {}, (4, 100)), (made, {"docs": ["d1", "d2", "hot"]}, (1,))):
        whole = search.search(own, query, **how).collect()
        for limit in limits:
            monkeypatch.setattr(search, "WINDOW_PAGES", 1_000_000 if limit > 1 else 0)
            top = search.search(own, query, limit=limit, **how)
            assert sorted(map(tuple, top.select(*whole[0].__fields__).collect())) == sorted(tuple(r) for r in whole if r.doc_rank <= limit)


def test_a_search_for_few_writes_nothing(spark, tmp_path, monkeypatch):
    raw = spark.createDataFrame([(f"d{i % 9}", i, f"alpha {'beta ' * (i % 4)}") for i in range(60)], "doc_name string, page_key long, text string")
    index.build_index(raw).save(str(tmp_path / "i"))
    opened = index.open_index(spark, str(tmp_path / "i"))
    monkeypatch.setattr(ranks, "scratch_path", lambda *_: pytest.fail("a table is written"))
    assert {r.doc_rank for r in search.search(opened, "alpha beta", limit=3).collect()} == {1, 2, 3}
    assert [(r.doc_rank, r.rank_in_doc) for r in search.search(opened, " ", limit=2, docs=["d8", "d3", "d5"]).orderBy("page_idx").collect()] == [(d, n) for d, m in ((1, 7), (2, 7)) for n in range(1, m + 1)]
    assert {r.doc_rank for r in search.search(opened, " ").collect()} == set(range(1, 10))


def parts_of(made):
    """All parts of an index as plain rows, whatever their order."""
    frames = (made.pages.select("doc_name", "doc_idx", "page_no", "page_idx", "page_key", "text"), made.page_dim, made.doc_dim, made.postings, made.vocab)
    return [sorted(map(str, map(tuple, f.select(*sorted(f.columns)).collect()))) for f in frames]


def test_merged_indexes_equal_one_of_all_pages(spark, tmp_path):
    rng = random.Random(5)
    page = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "the", "of"]) for _ in range(rng.choice([0, 3, 30])))
    rows = [(f"d{rng.randint(0, 9)}", i, page()) for i in range(80)]
    schema = "doc_name string, page_key long, text string"
    made = lambda keep: index.build_index(spark.createDataFrame([r for r in rows if keep(r[0])], schema))
    old = [("d2", 7, "an older text of the document")]
    a, b = index.build_index(spark.createDataFrame([r for r in rows if r[0] in ("d1", "d4", "d7", "d9")] + old, schema)), made(lambda d: d not in ("d1", "d4", "d7", "d9"))
    a.save(str(tmp_path / "a"))
    opened = index.open_index(spark, str(tmp_path / "a"))
    whole = index.merged([opened, b])
    assert parts_of(whole) == parts_of(made(lambda d: True))
    assert index.integrity(whole.postings).first()["sound"]
    gone = spark.createDataFrame([("d4",), ("d0",), ("nowhere",)], "doc_name string")
    assert parts_of(index.merged([whole], gone)) == parts_of(made(lambda d: d not in ("d4", "d0")))
    plan = str(index.merged([opened, b]).blocks._jdf.queryExecution().toString())
    assert "text" not in plan


def test_segments_of_a_stream(spark, tmp_path):
    batches = [[("b", 0, "of the of"), ("a", 0, "the sea")], [("c", 0, "of and"), ("b", 0, "the newer text")]]
    for rows in batches:
        spark.createDataFrame(rows, pages.PAGES).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.append_segments(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    found = index.open_segments(spark, str(tmp_path / "out"))
    assert parts_of(found) == parts_of(index.build_index(spark.createDataFrame([("a", 0, "the sea"), ("b", 0, "the newer text"), ("c", 0, "of and")], pages.PAGES)))


@pytest.mark.parametrize("tokens", [False, True])
def test_numbers_of_a_document_over_many_parts(spark, tokens):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"d{rng.randint(0, 30)}", i, "a b " * rng.randint(0, 3)) for i in range(600)] + [("alone", 1, "x"), ("zz", 5, None)]
    given = spark.createDataFrame(rows, "doc_name string, page_key long, text string").repartition(4)
    found = index.number_pages(given, tokens).orderBy("page_idx").collect()
    docs, start, expected, before = {}, {}, [], 0
    for at, (name, key, text) in enumerate(sorted(rows, key=lambda r: (r[0], r[1]))):
        docs.setdefault(name, len(docs))
        start.setdefault(name, at)
        n = len((text or "").split())
        expected.append((name, docs[name], at - start[name], at, start[name], key, *((n, before) if tokens else ())))
        before += n
    columns = ["doc_name", "doc_idx", "page_no", "page_idx", "page_start", "page_key", *(("n_tokens", "sidx_start") if tokens else ())]
    assert [tuple(r[c] for c in columns) for r in found] == expected
    assert index.number_pages(given.limit(0), tokens).count() == 0


@pytest.mark.parametrize("size", [segment.BROADCAST_BYTES, 0])
def test_segmentation_of_a_document_over_many_parts(spark, monkeypatch, size):
    """Against a plain loop; most fragments are of one document, and ranges begin anywhere in sentences."""
    monkeypatch.setattr(segment, "BROADCAST_BYTES", size)
    rng = random.Random(11)
    pieces = ["And then", "the end.", "went home", "1234", "(see", "below):", "Next day", "so,", "house", "The big", "zz q", "of", "x", "\"quoted\""]
    rows = [(7 if i % 4 else rng.randint(0, 20), i, "\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))) for i in range(500)]
    known = {"the", "end", "of", "day", "house", "big", "so", "then"}
    table = spark.createDataFrame([(w,) for w in known], "word string")
    given = spark.createDataFrame(rows, "doc_idx long, page_no long, text string").repartition(3)
    runs = lambda s: __import__("re").findall("[a-z]+", s.lower())
    expected, state = [], {}
    for doc, page, whole in sorted(rows):
        for frag in whole.split("\n"):
            if not any(r in known for r in runs(frag)):
                continue
            last, open_ = state.get(doc, ("", 0))
            soft_end, hard_end = last.isalnum(), bool(last) and (last.islower() or last in "-):;,\"'")
            head = frag.split(" ")[0]
            soft, hard = frag[0].isalnum() or frag[0] in "($\"'", frag[0].islower()
            merge = (hard and len(head) > 1 and head in known) or (soft and hard_end) or (hard and soft_end)
            number = open_ + (not merge)
            state[doc] = (frag[-1], number)
            expected.append((doc, number, page, frag))
    found = {}
    for doc, number, page, frag in expected:
        first, said = found.get((doc, number), (page, []))
        found[doc, number] = (first, [*said, frag])
    sentences = sorted((d, n, page, " ".join(said)) for (d, n), (page, said) in found.items() if any(r in known and len(r) > 1 for r in runs(" ".join(said))))
    assert sorted((r.doc_idx, r.sent_no, r.page_no, r.sentence) for r in segment.segment(given, table).collect()) == sentences
    kept = segment.with_known_words(segment.fragments(given), "frag", table)
    assert sorted((r.doc_idx, r.sent_no, r.page_no, r.frag) for r in segment.scanned(kept, table).collect()) == sorted(expected)
    assert segment.segment(given.limit(0), table).count() == 0


def test_moments_of_batches_equal_the_whole(spark):
    rng = random.Random(3)
    rows = [([rng.gauss(5, 3), rng.gauss(0, 1), rng.gauss(-2, 0.5), rng.gauss(0, 0.1)],) for _ in range(900)]
    frame = lambda some: spark.createDataFrame(some, "vec array<double>").repartition(40)
    whole = embed.vector_moments(frame(rows))
    parts = embed.vector_moments(frame(rows[:100])).merged(embed.vector_moments(frame(rows[100:] + [(None,)])))
    x = np.array([r[0] for r in rows])
    for m in (whole, parts):
        assert m.n == 900 and np.allclose(m.mean, x.mean(axis=0), atol=1e-12) and np.allclose(m.squares, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), rtol=1e-10, atol=1e-9)
        assert abs(np.dot(m.component(), whole.component())) > 1 - 1e-12
    assert embed.Moments.of_rows(parts.rows(spark)).component() == parts.component()
    assert embed.vector_moments(frame(rows[:5]).limit(0)).component() == [] and embed.vector_moments(frame(rows[:1] * 3)).component() == [0.0] * 4


def test_spans_of_many_terms_in_one_scan(spark):
    rng = random.Random(12)
    texts = [(i, "".join(rng.choice(["a", "b", "ß", "Œ", "x", " ", "…", "é"]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(100, None)]
    terms = ["a", "ss", "ab", "oe", "s", "b x", "..", "e"]
    df = spark.createDataFrame(texts, "id long, text string")
    found = highlight.highlight(df, terms, "id")
    assert "Window" not in found._jdf.queryExecution().toString() and found._jdf.queryExecution().toString().count("MapInArrow") <= 4
    expected = set()
    for i, raw in texts:
        raw = raw or ""
        at = [k for k, c in enumerate(raw) for _ in text.folded(c)]
        low = text.folded(raw).lower()
        marked = [False] * len(low)
        for t in terms:
            for s in range(len(low)):
                if low.startswith(t, s):
                    marked[s : s + len(t)] = [True] * len(t)
        s = 0
        while s < len(low):
            if marked[s]:
                e = s
                while e < len(low) and marked[e]:
                    e += 1
                expected.add((i, at[s], at[e - 1] + 1))
                s = e
            s += 1
    assert {tuple(r) for r in found.collect()} == expected
    assert spans.ngram_positions(df, [], "id").count() == 0


def test_languages_of_held_out_and_short_texts(spark):
    """Better than lists of frequent words on pieces of a few words, from documents that the model has not seen."""
    from quire.operators.language import detect_language

    found = __spark_entry__.queries()["detect_lang_model"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").collect()
    assert len(held) > 25 and sum(r.detected == r.lang for r in held) >= 0.97 * len(held)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = language_model.fit_languages(docs.where("not held"), bound=300)
    pieces = docs.where("held").select("lang", F.explode(F.slice(F.regexp_extract_all("text", F.lit(r"\S+ \S+ \S+"), F.lit(0)), 1, 20)).alias("text"))
    right = pieces.select((model.detect(F.col("text")) == F.col("lang")).cast("int").alias("m"), (detect_language(F.col("text")) == F.col("lang")).cast("int").alias("l")).agg(F.avg("m"), F.avg("l"), F.count("*")).first()
    print("accuracy on pieces of three words: n-grams", right[0], "lists", right[1], "of", right[2])
    assert right[0] > right[1] and right[0] > 0.9


def test_language_model_against_brute_force(spark):
    import math

    rows = [("der Hund und die Katze", "de"), ("the dog and the cat", "en"), ("le chien et la souris", "fr"), ("und", "de"), (None, "en"), ("x", None)]
    model = language_model.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    counts = {}
    for said, lang in rows:
        for word in (said or "").lower().split() if lang else []:
            for n in (1, 2, 3):
                for i in range(len(word) + 3 - n):
                    if (g := f" {word} "[i : i + n]) != " ":
                        counts.setdefault(g, {}).setdefault(lang, 0)
                        counts[g][lang] += 1
    totals = {lang: sum(c.get(lang, 0) + 0.5 for c in counts.values()) for lang in ("de", "en", "fr")}
    asked = ["die Katze", "cat", "la", "zzz", "", None, "12 34"]
    found = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i long, text string").select("i", model.detect(F.col("text"), None).alias("lang")).collect()
    for r in found:
        grams = [f" {w} "[i : i + n] for w in (asked[r.i] or "").lower().split() for n in (1, 2, 3) for i in range(len(w) + 3 - n)]
        grams = [g for g in grams if g in counts]
        scores = {lang: sum(math.log((counts[g].get(lang, 0) + 0.5) / total) for g in grams) for lang, total in totals.items()}
        assert r.lang == (min(scores, key=lambda k: (-scores[k], k)) if grams else None), asked[r.i]
    pages_ = spark.createDataFrame([(0, 0, "the dog"), (0, 1, "die Katze"), (1, 0, "the")], "doc_idx long, page_no long, text string")
    assert {tuple(r) for r in model.document_languages(pages_, "fr").collect()} == {(0, "de"), (1, "fr")}
    raw = spark.createDataFrame([("a", 0, "die Katze"), ("b", 0, "la souris")], "doc_name string, page_key long, text string")
    made = index.build_index(raw)
    shown = highlight.display(made, "zzz", search.search(made, "zzz"), langs=["de", "fr"], detect=model.detect).collect()
    assert {(r.result_id, r.lang) for r in shown} == {("a-0", "de"), ("b-0", "fr")}
    assert language_model.fit_languages(spark.createDataFrame([], "text string, lang string")).langs == []


def test_signs_are_decided_as_before(spark):
    """Words by a pattern that names all signs, whatever stands around them."""
    rng = random.Random(5)
    given = ["".join(rng.choice("aZé09.,:'-()_ \t\n\u0001\u0002\u007f€—«中𝒳\"") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [None]
    rows = spark.createDataFrame(list(enumerate(given)), "i long, t string").select("i", text.words(F.col("t")).alias("w")).collect()
    assert {r.i: r.w for r in rows} == {i: parser.plain_words(g or "") for i, g in enumerate(given)}


def test_words_of_long_texts_take_few_passes(spark):
    """Letters cost no look around: words take a few times as long as one plain pattern, not a hundred."""
    rows = spark.range(8).select(F.repeat(F.lit("Of the earth, ein Wörtchen and so on "), 20_000).alias("t")).localCheckpoint()

    def seconds(column):
        found = []
        for _ in range(3):
            at = time.time()
            rows.agg(F.max(F.xxhash64(column))).collect()
            found.append(time.time() - at)
        return min(found)

    assert seconds(text.words(F.col("t"))) < 12 * seconds(F.regexp_replace("t", "[.,]", " "))


def test_training_takes_no_longer_with_wider_windows():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 3000, 40_000)

    def seconds(window):
        inner, outer = rng.random((3000, 32), np.float32), np.zeros((3000, 32), np.float32)
        at = time.time()
        word_vectors.train_part(ids, np.arange(len(ids)) // 5000, np.full(3000, 10.0), 30_000.0, inner, outer, window, rng)
        assert np.isfinite(inner).all() and outer.any()
        return time.time() - at

    seconds(2)
    assert seconds(200) < 4 * seconds(3)


def test_page_vectors_are_summed_where_their_words_lie(spark, monkeypatch):
    """Words are broadcast in shares, whatever Spark's threshold; the shuffled join gives the same."""
    rng = random.Random(4)
    counted = spark.createDataFrame([(p, f"w{rng.randrange(40)}", rng.randrange(1, 5)) for p in range(50) for _ in range(9)], "page_idx long, word string, n long")
    vocab = spark.createDataFrame([(f"w{i}", i + 1) for i in range(40)], "word string, cnt long")
    known = spark.createDataFrame([(f"w{i}", [rng.random(), rng.random()]) for i in range(30)], "word string, vec array<double>")
    made = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, size, most in (("one", 64 << 20, 8), ("shares", 500, 8), ("joined", 1, 0)):
            monkeypatch.setattr(embed, "BROADCAST_BYTES", size, raising=False)
            monkeypatch.setattr(embed, "BROADCASTS", most, raising=False)
            found = embed.sif_vectors(counted, vocab, known, 2)
            assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == (most > 0)
            made[name] = {r.page_idx: r.vec for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(made["one"]) == set(made["shares"]) == set(made["joined"])
    for name in ("shares", "joined"):
        assert all(np.allclose(made["one"][p], made[name][p], rtol=1e-12) for p in made["one"])


def test_positions_are_not_sorted_to_find_their_pages(spark):
    dim = spark.createDataFrame([(i, i * 3, 3 if i != 4 else 0) for i in range(5)], "page_idx long, sidx_start long, n_tokens long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.pages_of_positions(spark.range(0, 12).withColumnRenamed("id", "sidx"), dim, width=5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan
        assert sorted(map(tuple, found.collect())) == [(i, i // 3) for i in range(12)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_full_blocks_are_unpacked_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    starts = np.arange(300) * 1000
    made = blocks.slice_blocks(np.arange(300), starts, np.full(300, 1000), pa.array([f"w{i % 7}" for i in range(300_000)]))
    parts = list(blocks._bounded([made.slice(0, 0), made]))
    assert len(parts) > 1 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([made]))
    assert max(sum(p.column("n").to_pylist()) for p in parts) <= blocks.HELD + blocks.BLOCK + 1000


def test_positions_are_counted_as_bits_of_ranges(spark, monkeypatch):
    """No row a token is shuffled; what is held twice, or not, is found, in whatever order and however few ranges are held at once."""
    tokens = [[f"w{(i * j) % 50}" for j in range(900)] for i in range(100)]
    pages = spark.createDataFrame([(i, 900 * i, t) for i, t in enumerate(tokens)], "page_idx long, sidx_start long, tokens array<string>")
    made = blocks.posting_blocks(pages.repartition(3), 100, 20_000)
    sound = {"n_postings": 90_000, "n_positions": 90_000, "last": 89_999, "sound": True}
    for held in (1, 512):
        monkeypatch.setattr(blocks.position_bits, "__defaults__", (held,))
        assert index.integrity(made).first().asDict() == index.integrity(blocks.word_places(made)).first().asDict() == sound
        twice = made.unionByName(made.where("word = 'w7'"))
        more = made.where("word = 'w7'").agg(F.sum("n")).first()[0]
        assert index.integrity(twice).first().asDict() == sound | {"n_postings": 90_000 + more, "sound": False}
        assert index.integrity(made.where("word <> 'w7'")).first()["n_positions"] == 90_000 - more
    assert not index.integrity(spark.range(1, 5).withColumnRenamed("id", "sidx")).first()["sound"]
    assert index.integrity(made.limit(0)).first().asDict() == {"n_postings": 0, "n_positions": 0, "last": None, "sound": True}
    assert blocks.position_bits(made).count() <= 3 * 8 * 3


def test_tokens_alone_leave_texts_unwritten(spark):
    given = spark.createDataFrame([("a", 1, "x y"), ("b", 1, "z")], "doc_name string, page_key long, text string")
    found = index.number_pages(given, tokens=True, texts=False)
    assert "text" not in found.columns and sorted((r.page_idx, r.sidx_start, r.tokens) for r in index.tokenised(found).collect()) == [(0, 0, ["x", "y"]), (1, 2, ["z"])]


def test_shares_of_words_shuffle_a_page_once(spark, monkeypatch):
    """However many shares are broadcast, what counts words is read once, and one row of sums a page is shuffled."""
    rng = random.Random(5)
    counted = spark.createDataFrame([(p, f"w{rng.randrange(40)}", 1) for p in range(50) for _ in range(9)], "page_idx long, word string, n long")
    vocab = spark.createDataFrame([(f"w{i}", i + 1) for i in range(40)], "word string, cnt long")
    known = spark.createDataFrame([(f"w{i}", [rng.random(), rng.random()]) for i in range(30)], "word string, vec array<double>")
    monkeypatch.setattr(embed, "BROADCAST_BYTES", 500)
    plan = embed.sif_vectors(counted, vocab, known, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") > 4 and plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan


def test_page_vectors_are_made_once(spark):
    raw = spark.createDataFrame([("a", 1, "x y"), ("b", 1, "y z")], "doc_name string, page_key long, text string")
    known = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "word string, vec array<double>")
    made = index.embed_pages(index.build_index(raw), known, [0.0, 0.0])
    plan = made.vector_blocks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" not in plan and made.page_vectors.count() == 2


def test_words_of_arrow_texts_are_those_of_the_column(spark):
    """All bytes of many texts are decided on at once, as the column expression decides on each text."""
    draw, signs = random.Random(3), [*"aB1 2c.,:'-()\n\t_\u0001\x00￿é…ß°Щщ—€²½漢😀'", "(a)", "(1.2)", "(a-b)", "a-b", "1.2", "l'eau", "ﬁ", "’", " ", "İ", "é"]
    given = ["".join(draw.choice(signs) for _ in range(draw.randrange(30))) for _ in range(2000)] + [None, "", "é", "(", "(a)", "a€", ".", "1.", "a'"]
    rows = spark.createDataFrame(list(enumerate(given)), "i long, t string").select("i", text.words(F.col("t")).alias("w")).collect()
    expected = {r.i: r.w for r in rows}
    for part in (given, given[-9:]):
        found, sizes = text.text_words(pa.array(part, pa.string()))
        ends = np.cumsum(sizes).tolist()
        assert [found[a:b].to_pylist() for a, b in zip([0, *ends], ends)] == [expected[len(given) - len(part) + i] for i in range(len(part))]
    assert len(text.text_words(pa.array([], pa.string()))[1]) == 0


@pytest.mark.parametrize("size", [5, 1_000_000])
def test_posted_pages_are_numbered_pages_and_their_blocks(spark, size, monkeypatch):
    """Pages and posting blocks come from one pass; neither texts nor tokens are written unless asked for."""
    monkeypatch.setattr(blocks.text_blocks, "__defaults__", (3, size))
    rows = [(f"d{i % 4}" if i % 9 else None, i, None if i == 7 else "" if i == 8 else f"the sea {i % 5} of é{i} the") for i in range(60)]
    given = spark.createDataFrame(rows, "doc_name string, page_key long, text string")
    numbered = index.number_pages(given, tokens=True)
    made, lists = index.posted(given, texts=False)
    columns = ["doc_name", "doc_idx", "page_no", "page_idx", "page_start", "page_key", "n_tokens", "sidx_start"]
    assert sorted(made.columns) == sorted(columns) and lists.columns == blocks.FIELDS
    assert sorted(map(str, made.select(*columns).collect())) == sorted(map(str, numbered.select(*columns).collect()))
    expected = numbered.select("page_idx", "sidx_start", F.posexplode("tokens").alias("pos", "word")).select("word", "page_idx", "pos", F.expr("sidx_start + pos as sidx"))
    assert sorted(map(tuple, blocks.word_places(lists).collect())) == sorted(map(tuple, expected.collect()))
    assert {r.n for r in lists.select("n").collect()} <= set(range(1, 61)) and index.posted(given.limit(0))[1].count() == 0
    kept = index.posted(given)[0]
    assert sorted((r.page_idx, str(r.text)) for r in kept.collect()) == sorted((r.page_idx, str(r.text)) for r in numbered.collect())


def test_a_search_of_a_new_index_ranks_no_words_and_reads_its_blocks_once(spark, tmp_path, monkeypatch):
    raw = spark.createDataFrame([(f"d{i % 9}", i, f"alpha {'beta ' * (i % 4)} gamma") for i in range(40)], "doc_name string, page_key long, text string")
    asked = 'alpha nowhere "beta gamma"'
    index.build_index(raw).save(str(tmp_path / "i"))
    opened = index.open_index(spark, str(tmp_path / "i"))
    expected = sorted(map(str, search.search(opened, asked).collect()))
    made = index.build_index(raw, texts=False)
    read = []
    monkeypatch.setattr(index, "vocabulary", lambda *_: pytest.fail("all words are ranked"))
    monkeypatch.setattr(search, "word_lists", lambda lists, words, own=search.word_lists: read.append(sorted(words)) or own(lists, words))
    assert sorted(map(str, search.search(made, asked).collect())) == expected and len(search.search(made, "nowhere").collect()) == 40
    assert read == [["alpha", "beta", "gamma", "nowhere"], ["nowhere"]] and "text" not in made.pages.columns
    assert search.asked_lists(opened, []) is opened.blocks


@pytest.mark.parametrize("block, size, full", [(4096, 1_000_000, 512), (5, 40, 3), (3, 200, 1), (4096, 40, 512)])
def test_saved_short_blocks_travel_in_groups(spark, tmp_path, monkeypatch, block, size, full):
    """A saved index holds the places of one built as before; its rare words' blocks of many slices came in few rows and are joined."""
    monkeypatch.setattr(blocks.text_blocks, "__defaults__", (block, size))
    monkeypatch.setattr(blocks._grouped, "__defaults__", (full,))
    rng = random.Random(block + size)
    rare = [f"r{i}" for i in range(300)]
    rows = [(f"d{i % 3}", i, " ".join(rng.choice(rare) if rng.random() < 0.5 else rng.choice(["the", "of", "r7"]) for _ in range(rng.choice([0, 1, 10, 60])))) for i in range(150)] + [(None, 7, None)]
    raw = spark.createDataFrame(rows, "doc_name string, page_key long, text string")
    monkeypatch.setattr(index.word_bounds, "__defaults__", (8, 500, 2000))
    bounds = index.word_bounds(raw)
    assert bounds == sorted(set(bounds)) and 1 <= len(bounds) <= 7 and index.word_bounds(raw.limit(0)) == []
    opened, plain = index.build_saved(raw, str(tmp_path / "i")), index.build_index(raw)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(opened.postings) == key(plain.postings) and index.integrity(opened.blocks).first()["sound"]
    assert key(opened.vocab) == key(plain.vocab) and key(opened.page_dim) == key(plain.page_dim) and key(opened.doc_dim) == key(plain.doc_dim)
    assert key(opened.pages.select(sorted(opened.pages.columns)).fillna("")) == key(plain.pages.select(sorted(opened.pages.columns)).fillna(""))
    assert key(opened.lookup("r7", "the")) == key(plain.lookup("r7", "the"))
    if full == 512:  # once a word, twice where a task's share ends in its group; before, a block for each word of each slice was written and shuffled
        assert opened.blocks.count() < 2 * plain.vocab.count() < plain.blocks.count()
        assert 3 * index.posted(raw, bounds=bounds)[1].count() < plain.blocks.count()
    assert index.build_saved(raw.limit(0), str(tmp_path / "none")).blocks.count() == 0


def test_tables_of_pages_never_meet_on_the_driver(spark, tmp_path):
    """Their sizes are guessed by those of coded blocks, so that a broadcast would hold every place of a frequent word."""
    texts = ["of the of x the of the", "the of", "", "of of the the", "x of the"]
    index.build_saved(spark.createDataFrame([(f"d{i // 2}", i, t) for i, t in enumerate(texts)], "doc_name string, page_key long, text string"), str(tmp_path))
    made = index.open_index(spark, str(tmp_path))
    found = search.phrase_places(made.blocks, ("of", "the"))
    assert sorted((r.page_idx, r.pos) for r in found.collect()) == [(0, 0), (0, 5), (3, 1), (4, 1)]
    shares = search.page_shares(search.term_pages(made.blocks, [parser.parse('x "of the"')]), [2])
    assert {r.page_idx: r.matched for r in search.with_shares(made.page_dim, shares, [2]).collect()} == {0: 2, 1: 0, 2: 0, 3: 1, 4: 2}
    vectors = matrix.vector_blocks(spark.createDataFrame([(0, [1.0, 0.0]), (3, [0.0, 1.0])], "page_idx long, vec array<double>"))
    scores = search.Scores(made, made.page_dim, [[]], vectors, [[1.0, 0.0]])
    plain = made.page_dim.select("page_idx", "doc_idx", "page_no")
    for df in (found, search.with_shares(plain, plain.select("page_idx", *(F.lit(1).alias(c) for c in ("matched", "n_terms", "grep"))), [1]), scores.with_distance(plain)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_sentences_are_split_many_at_once(spark, monkeypatch):
    """As words() splits them, over several batches and cuts of a batch."""
    given = ["l'eau (a) 1.2", None, "", "é ß a-b", "x" * 50, "of the of"] * 40
    rows = spark.createDataFrame(list(enumerate(given)), "i long, t string")
    assert all((r.a or []) == r.b for r in rows.select(text.words(F.col("t")).alias("a"), text.bulk_words("t").alias("b")).collect())
    monkeypatch.setattr(text, "AT_ONCE", 7)
    found = text.word_arrays(pa.array(given, pa.string())).to_pylist()
    assert found == [text.normalized(g or "").split() for g in given]
    assert text.word_arrays(pa.array([], pa.string())).to_pylist() == []
