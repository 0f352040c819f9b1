"""Vector codes, conversation repair and toxicity against brute force, SQL and held-out labels, and on odd rows."""

import hashlib
import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import conversation_repair, filtering_lloyd, queries, toxicity

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_conversation_repair"])
def test_queries_against_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.sql(queries.oracle_sql()[name]).select(",".join(columns)).fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, expected)) and expected


# --- vector codes


@pytest.mark.parametrize("spread", [2, 1000, 1 << 40])
def test_filtering_finds_the_nearest_entries(spread):
    rng = random.Random(spread)
    for trial in range(40):
        n, width, k = rng.randint(1, 120), rng.randint(1, 5), rng.randint(1, 64)
        points = [[rng.randint(-spread, spread) for _ in range(width)] for _ in range(n)]
        points[: n // 3] = [points[0]] * (n // 3)
        entries = [[rng.randint(-spread, spread) for _ in range(width)] for _ in range(k)]
        kind = object if spread > filtering_lloyd.SMALL else np.int64
        tree, book = filtering_lloyd.build_tree(np.array(points, kind)), np.array(entries, kind)
        best = [min((sum((a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(entries)) for p in points]
        entry, error = filtering_lloyd.nearest_of(tree, book)
        assert list(zip(error.tolist(), entry.tolist())) == best
        sums, counts = filtering_lloyd.sums_of(tree, book)
        own = [[p for p, (_, e) in zip(points, best) if e == i] for i in range(k)]
        assert counts.tolist() == list(map(len, own)) and sums.tolist() == [[sum(p[d] for p in some) for d in range(width)] for some in own]


def test_whole_subtrees_are_assigned():
    tree = filtering_lloyd.build_tree(np.random.default_rng(1).normal(0, 40, (4000, 2)).astype(np.int64))
    nodes, _, places, _ = filtering_lloyd.filtered(tree, np.array([[-30, 0], [30, 0], [0, 50], [500, 500]]))
    assert len(places) < 1000 and (tree.stop - tree.start)[nodes].sum() + len(places) == 4000 and len(nodes) < 300


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1])
    cut = [i * dim // parts for i in range(parts + 1)]
    ints = [[math.floor(256 * x) for x in r[1]] for r in kept]
    books = [[v[a:b] for v in ints[:entries]] for a, b in zip(cut, cut[1:])]

    def assigned():
        return [[min((sum((x - y) ** 2 for x, y in zip(v[a:b], e)), i) for i, e in enumerate(book)) for book, a, b in zip(books, cut, cut[1:])] for v in ints]

    for _ in range(rounds):
        found = assigned()
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            for e in range(len(books[p])):
                own = [v[a:b] for v, f in zip(ints, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = assigned()
    coded = [(r[0], r[2], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for r, f in zip(kept, found)]
    sums = {}
    for _, label, _, error in coded:
        sums[label] = sums.get(label, 0) + error
    return sorted((str(i), str(label), code, error, sums[label]) for i, label, code, error in coded), hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


@pytest.mark.parametrize("dim", [32, 19, 5])
def test_codes_of_odd_rows(spark, monkeypatch, dim):
    rng = random.Random(dim)
    vec = lambda: [rng.gauss(0, 0.3) for _ in range(dim)]
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec(), rng.choice([0, 1, None])) for i in range(-50, 100)]
    rows += [(200, None, 1), (201, [None] * dim, 1), (202, [float("nan")] * dim, 1), (203, [float("inf")] * dim, None), (5, vec(), 7), (None, vec(), None), (None, vec(), None), (204, [0.0] * dim, 3), (205, [3e38] * dim, 9)]
    df = spark.createDataFrame([(i, v, label, "x", 0.0) for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string, error double").repartition(4)
    for blocks, labels in ((filtering_lloyd.BLOCK_ROWS, filtering_lloyd.BROADCAST_LABELS), (7, 0)):
        monkeypatch.setattr(filtering_lloyd, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(filtering_lloyd, "BROADCAST_LABELS", labels)
        done = filtering_lloyd.compress(df, keep=("label",))
        found = filtering_lloyd.with_label_errors(done.codes).collect()
        expected, digest = brute_codes(rows)
        top = filtering_lloyd.LONGEST
        assert sorted((str(r.vec_id), str(r.label), r.code, r.error, r.label_error) for r in found) == [(*e[:3], min(e[3], top), min(e[4], top)) for e in expected]
        assert done.digest() == digest
    near = {r.vec_id: r.vec for r in filtering_lloyd.decode(done.codes.where("vec_id between 0 and 9"), done.codebooks).collect()}
    assert len(near) == 10 and all(len(v) == dim for v in near.values())


def test_codes_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    none = filtering_lloyd.compress(spark.createDataFrame([], schema), keep=("label",))
    assert filtering_lloyd.with_label_errors(none.codes).count() == 0 and none.digest() == hashlib.sha256(b"").hexdigest()
    mixed = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 16, 1), (3, [1.0] * 8, 1), (4, [], 1)], schema)
    assert [(r.vec_id, r.code, r.error) for r in filtering_lloyd.compress(mixed).codes.orderBy("vec_id").collect()] == [(1, "00" * 16, 0), (2, "00" * 16, 0)]


# --- conversation repair


def cheapest(turns, longest):
    """(cost, audit, repaired lines) by trying all edits, with up to ``longest`` inserted turns in all."""
    best = None

    def legal(roles):
        rest = roles[1:] if roles[:1] == ["s"] else roles
        return (not roles) or (len(rest) > 0 and len(rest) % 2 == 0 and all(r == "ua"[i % 2] for i, r in enumerate(rest)))

    gone = []
    for n, (role, text) in enumerate(turns):
        bare = text.strip(WS)
        gone.append(None if not bare or (role, text) in turns[:n] else 0 if bare[-1] in ".!?" else 5)
    options = [[("D", 2, None)] + ([] if cut is None else [("K", cut, (role, text)), ("R", 1 + cut, ("user", text)), ("R", 1 + cut, ("assistant", text))]) for cut, (role, text) in zip(gone, turns)]
    adds = [("I", 5, ("user", "")), ("I", 5, ("assistant", ""))]
    spots = len(turns) + 1
    for n in range(longest + 1):
        for where in itertools.combinations_with_replacement(range(spots), n):
            for edits in itertools.product(*options, *[adds] * n):
                own, more = edits[: len(turns)], edits[len(turns) :]
                whole = []
                for at in range(spots):
                    whole += [m for m, w in zip(more, where) if w == at]
                    whole += own[at : at + 1]
                kept = [e[2] for e in whole if e[2]]
                if legal([r[:1] for r, _ in kept]):
                    found = (sum(e[1] for e in whole), "".join(e[0] for e in whole), "\n".join(":".join(k) for k in kept))
                    best = min(best, found) if best else found
    return best


def test_repairs_are_the_cheapest(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No", "", "Why?", " \t", "So be it!"]
    convs = {c: [(rng.choice(["system", "user", "assistant", "assistant", "user", "tool", ""]), rng.choice(texts)) for _ in range(rng.randint(1, 4))] for c in range(40)}
    rows = [(c, n, role, text) for c, turns in convs.items() for n, (role, text) in enumerate(turns)]
    made = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    hashes = {r.conv_id: r.sha256 for r in made.transcripts().collect()}
    found = {r.conv_id: (r.cost, r.audit, hashes.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in made.conversations.collect()}
    expected = {c: cheapest(turns, 2) for c, turns in convs.items()}
    assert found == {c: (cost, audit, hashlib.sha256(said.encode()).hexdigest()) for c, (cost, audit, said) in expected.items()}


def scanned(turns):
    """(cost, audit, repaired lines) turn by turn: a plain dynamic programme over the four states."""
    seen, states = set(), {0: (0, "", ())}

    def best(options):
        out = {}
        for state, way in options:
            if state not in out or way < out[state]:
                out[state] = way
        return out

    def inserted(states):
        for _ in range(3):
            options = list(states.items())
            for i, (cost, audit, said) in states.items():
                for role in ("user", "assistant"):
                    if (j := conversation_repair.NEXT.get((i, role[0]))) is not None:
                        options.append((j, (cost + 5, audit + "I", (*said, f"{role}:"))))
            states = best(options)
        return states

    for role, text in turns:
        states, bare, options = inserted(states), text.strip(WS), []
        for i, (cost, audit, said) in states.items():
            options.append((i, (cost + 2, audit + "D", said)))
            if bare and (role, text) not in seen:
                more = 0 if bare[-1] in ".!?" else 5
                for letter, new, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if (j := conversation_repair.NEXT.get((i, new[:1]))) is not None:
                        options.append((j, (cost + price + more, audit + letter, (*said, f"{new}:{text}"))))
        states = best(options)
        seen.add((role, text))
    return min(inserted(states)[i] for i in (0, 3) if i in inserted(states))


def test_a_hot_conversation_over_many_parts(spark, monkeypatch):
    """Most turns are of one conversation; parts, trees of runs and chunks of text are all made small."""
    rng = random.Random(7)
    monkeypatch.setattr(conversation_repair, "FAN", 2)
    monkeypatch.setattr(conversation_repair, "CHUNK", 300)
    hot = [(rng.choice(["user", "assistant", "system", "other"]), rng.choice(["Same again.", f"Turn {n}.", f"Cut {n}", " "])) for n in range(900)]
    convs = {5: hot, 1: [("user", "a."), ("assistant", "b.")], None: [("user", "x."), ("assistant", None), ("assistant", "y.")], 9: [(None, "z.")]}
    rows = [(c, n * 2 if n else None, role, text, "clash", -1) for c, turns in convs.items() for n, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, digest string, cost int").repartition(6)
    made = conversation_repair.repair(df)
    found = {r.conv_id: r for r in made.conversations.collect()}
    hashes = {r.conv_id: r.sha256 for r in made.transcripts().collect()}
    for c, turns in convs.items():
        turns = [(" " if r is None else r, " " if t is None else t) for r, t in turns]
        cost, audit, said = scanned(turns)
        assert (found[c].cost, found[c].audit) == (cost, audit)
        assert hashes.get(c, hashlib.sha256(b"").hexdigest()) == hashlib.sha256("\n".join(said).encode()).hexdigest()
        blank = sum(not t.strip(WS) for _, t in turns)
        again = sum(bool(t.strip(WS)) and (r, t) in turns[:n] for n, (r, t) in enumerate(turns))
        assert (found[c].blank, found[c].duplicate, found[c].gaps) == (blank, again, max(0, len(turns) - 2))
        assert found[c].illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    assert made.answers.select(F.max(F.size("runs"))).first()[0] > 3


def test_matrices_are_associative():
    rng = random.Random(3)
    for _ in range(50):
        kinds = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randint(2, 40)))
        one = conversation_repair.NOTHING
        for k in kinds:
            one = conversation_repair.product(one, conversation_repair.turn_matrix(k))
        assert conversation_repair.matrix_of(kinds) == one
    long = conversation_repair.matrix_of("uax" * 20_000)
    assert len(min(long[j] for j in (0, 3))[1]) >= 60_000


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B! C?") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    found = conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    expected = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        new = (c, t, "user" if fault == 4 else role, "" if fault == 1 else text.translate(str.maketrans("", "", ".!?")) if fault == 2 else text)
        expected += [new] * (0 if fault == 0 else 2 if fault == 3 else 1)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert conversation_repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).conversations.count() == 0


# --- toxicity


def toxic_table(spark, n=1200):
    rng = random.Random(2)
    common = ["the", "of", "and", "house", "river", "night", "you", "your", "walks", "green", "about"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice([f"brankel{rng.choice(['s', 'ed', 'ing', ''])}", "idiot", "1d1ot", "STUPID", "s.t.u.p.i.d"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_table(spark)
    odd = [(5000, None), (5001, ""), (5002, " \n"), (5003, "you idiot " * 150_000), (None, "you brankels are here"), (5004, "river of night"), (5004, "river of night")]
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows + odd], "doc_id long, text string, y int, score double").repartition(3)
    marks = spark.createDataFrame([*labels, (5000, None), (1, 1), (5001, 7), (None, 1)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(docs, marks).collect()
    assert len(found) == len(rows) + len(odd)
    truth = dict(labels)
    held = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) >= 0.98 * len(held) and len(held) > 300
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r.predicted for r in found}
    assert (by[5003], by[None], by[5004], by[5000], by[5001]) == (1, 1, 0, 0, 0)
    assert len({r.score for r in found if r.doc_id in (5000, 5001, 5002)}) == 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_toxicity(docs, none).collect()] == [0.5, 0.5]
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0


def test_features():
    reader = toxicity.Reader({"brank*": 3.0, "xyz": 2.0})
    at = lambda text: dict(zip(toxicity.NAMES, reader.features(text)))
    one = at("You are an 1d1ot, a brankel! stuuuupid f**k YOUR s.t.u.p.i.d")
    assert (one["insults"], one["hidden"], one["learned"], one["greatest_weight"]) == (3, 3, 1, 3.0)
    assert one["nearest"] == 1 / 2 and one["kinds"] == 4 and one["masked_density"] > 0 and one["stretched_density"] > 0 and one["shouted"] > 0
    assert not any(reader.features("")) and not any(reader.features(None))
    text = "river you idiot " * 200_000
    long, short = at(text), at("river you idiot " * 2)
    assert long["insults"] == 200_000 and long["insult_density"] == pytest.approx(short["insult_density"]) and long["near_density"] == pytest.approx(short["near_density"])


def test_isotonic_curve_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        score, y = rng.integers(0, 12, n).astype(float), rng.integers(0, 2, n).astype(float)
        at, level = toxicity.isotonic(score, y)
        assert (np.diff(at) > 0).all() and (np.diff(level) > 0).all()
        keys = np.unique(score)  # least squares: max over starts of min over ends of means
        expected = [max(min(y[(score >= a) & (score <= b)].mean() for b in keys[keys >= k]) for a in keys[keys <= k]) for k in keys]
        means = [level[np.abs(at - at[np.searchsorted(level, e - 1e-9)]).argmin()] for e in expected]
        assert np.allclose(means, expected)


def test_trees_fit_what_no_single_feature_shows():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = toxicity.boost(x[:1500], y[:1500])
    assert (((trees.logits(x[1500:]) > 0) == y[1500:]).mean()) > 0.9


def test_context_sums_read_bounded_splits(spark, monkeypatch):
    """A task reads so many splits at most, however few cores there are."""
    from quire.llm import quality

    monkeypatch.setattr(quality, "TASKS_A_CORE", 0)
    monkeypatch.setattr(quality, "SPLITS", 3)
    docs = spark.createDataFrame([(i, f"word{i} and the rest of it") for i in range(60)], "doc_id long, text string").repartition(20)
    one, whole = quality.word_vectors(docs.coalesce(1)), quality.word_vectors(docs)
    assert (one == whole).all() and one.any()
