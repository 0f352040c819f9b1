"""Toxicity scores: gradient-boosted trees over a few dense features of a text, with isotonic calibration.

Features are densities of words from two lexicons (fixed insults, and beginnings of words
that a bounded sample of labelled rows shows to mark label 1), how near such words are to
words of the second person, and rates of capitals, punctuation and obfuscated spelling.
The lexicon that a training row is measured by comes from the other folds' rows, and the
isotonic curve is fitted to scores of trees that have not seen the row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_stored, small_batches, stored
from quire.llm.quality import labelled_sample

#: Labelled documents that training takes at most, one row of each.
SAMPLE = 20_000
FOLDS = 3
#: Lengths of the beginnings of words that the learned lexicon may hold, besides whole words of up to LONGEST characters.
STEMS = (4, 5, 6, 7)
LONGEST = 24
#: Entries of the learned lexicon at most, and the log-likelihood ratio that one needs.
LEXICON = 4_000
EVIDENCE = 20.0
#: Characters that are tokenised at once.
CHUNK = 1 << 20
#: Words that a task remembers.
KNOWN = 300_000

# Insults in the languages of the corpus, and words of the second person, folded to lower case.
INSULTS = {
    "en": "asshole bastard bitch bullshit clown coward creep crap cretin cunt damn dickhead disgusting dumb dumbass fool freak fuck fucking garbage idiot idiotic imbecile jackass jerk liar loser lunatic moron moronic motherfucker pathetic pig prick psycho retard scum scumbag shit shithead shut sick slut stupid sucker trash ugly vermin vile whore worthless".split(),
    "de": "abschaum arsch arschloch blödmann depp drecksau dumm dummkopf fresse hure idiot idiotisch lügner miststück penner scheiße scheiss schlampe schwachkopf schwein spinner trottel versager wertlos widerlich wichser".split(),
    "es": "asco asqueroso basura bastardo cabrón cerdo cobarde estúpido gilipollas idiota imbécil inútil maldito mentiroso mierda patético payaso perdedor puta tonto".split(),
    "fr": "abruti bâtard connard connasse con crétin débile dégoûtant enculé idiot imbécile menteur merde minable ordure pathétique pourriture pute raclure salaud salope stupide".split(),
}
SECOND_PERSON = "you your yours yourself yourselves ur u ya du dich dir dein deine deinen deiner ihr euch euer eure tú tu tus te ti usted ustedes vosotros toi ton ta tes vous votre vos".split()
# Signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"})

_INSULTS = frozenset(w for words in INSULTS.values() for w in words)
_SECOND = frozenset(SECOND_PERSON)
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_REPEATED = re.compile(r"(.)\1{2,}")
_NO_LETTER = re.compile(r"[\W\d_]+")

NAMES = [
    "log_words", "insults", "insult_density", "learned", "learned_density", "weight", "weight_density", "greatest_weight", "kinds", "hidden", "hidden_density", "second_density",
    "nearest", "near_density", "hits_in_chunk", "capitals", "shouted", "punctuation", "exclaimed", "questions", "digits", "mixed_density", "stretched_density", "masked_density", "word_length",
]

#: What a token is, as bits of one number beside its learned weight.
INSULT, SECOND, HIDDEN, SHOUTED, MIXED, STRETCHED, MASKED, WORD = (1 << i for i in range(8))


def bare(token: str) -> str:
    return _EDGE.sub("", token).lower()


def plain(word: str) -> str:
    """word as it was meant: signs that stand for letters, signs between letters and drawn-out letters undone."""
    return _REPEATED.sub(r"\1", _NO_LETTER.sub("", word.translate(LEET)))


def stems(word: str) -> list[str]:
    """What the learned lexicon may know word by: beginnings as ``stem*``, and the whole word."""
    return [*(word[:n] + "*" for n in STEMS if len(word) > n), *([word] if 1 < len(word) <= LONGEST else [])]


class Reader:
    """Turns texts to features by a lexicon (stem or word to weight); remembers a bounded number of tokens."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def token(self, token: str) -> tuple[int, float, int]:
        """(kind, learned weight, hash of the word if it has either)."""
        word = bare(token)
        kind, weight = 0, 0.0
        if word:
            letters = plain(word) if not word.isalpha() or _REPEATED.search(word) else word
            kind = WORD | (INSULT if word in _INSULTS else 0) | (SECOND if word in _SECOND else 0)
            weight = max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0)
            if letters != word:
                found = max((self.lexicon.get(s, 0.0) for s in stems(letters)), default=0.0)
                if not kind & INSULT and (letters in _INSULTS or found > weight):
                    kind |= HIDDEN | (INSULT if letters in _INSULTS else 0)
                    weight = max(weight, found)
                digit, alpha = any(c.isdigit() for c in word), any(c.isalpha() for c in word)
                kind |= (MIXED if digit and alpha else 0) | (STRETCHED if _REPEATED.search(word) and alpha else 0) | (MASKED if alpha and ("*" in word or "#" in word or "@" in word or "$" in word) else 0)
            if len(word) > 2 and token.isupper():
                kind |= SHOUTED
        return kind, weight, xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) if kind & (INSULT | HIDDEN) or weight else 0

    def tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        try:
            found = list(map(known.__getitem__, tokens))
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = self.token(t)
            found = list(map(known.__getitem__, tokens))
        table = np.array(found, np.float64).reshape(-1, 3)
        return table[:, 0].astype(np.int64), table[:, 1], table[:, 2]

    def features(self, text: str | None) -> np.ndarray:
        """The whole text's features, a chunk at a time; zeros for a text without words."""
        text = text or ""
        kinds_of, weights, second, hits, seen = np.zeros(8), [], [], [], set()
        n_words, chars, start, most = 0, np.zeros(256), 0, 0
        accents = 0
        while start < len(text):
            stop = start + CHUNK
            while stop < len(text) and not text[stop].isspace() and stop < start + 2 * CHUNK:
                stop += 1
            piece = text[start:stop]
            start = stop
            data = np.frombuffer(piece.encode("utf-8", "surrogatepass"), np.uint8)
            chars += np.bincount(data, minlength=256)
            accents += int(((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)).sum())  # capitals À to Þ
            kind, weight, word = self.tokens(piece.split())
            kinds_of += [(kind & (1 << i) != 0).sum() for i in range(8)]
            toxic = (kind & (INSULT | HIDDEN) != 0) | (weight > 0)
            places = np.flatnonzero(toxic)
            hits.append(places + n_words)
            weights.append(weight[places])
            second.append(np.flatnonzero(kind & SECOND) + n_words)
            most = max(most, len(places))
            if len(seen) < 10_000:
                seen.update(word[places].tolist())
            n_words += len(kind)
        if not n_words:
            return np.zeros(len(NAMES))
        hits, weights, second = np.concatenate(hits), np.concatenate(weights), np.concatenate(second)
        gap = np.full(len(hits), 1e6)
        if len(second) and len(hits):
            after = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(second[np.minimum(after, len(second) - 1)] - hits), np.abs(hits - second[np.maximum(after - 1, 0)]))
        count = dict(zip(("insult", "second", "hidden", "shouted", "mixed", "stretched", "masked", "word"), kinds_of))
        words, n_chars = max(1.0, count["word"]), max(1.0, chars.sum() - chars[128:192].sum())
        letters = max(1.0, chars[65:91].sum() + chars[97:123].sum() + chars[192:].sum())
        signs = sum(chars[a:b].sum() for a, b in ((33, 48), (58, 65), (91, 97), (123, 127)))
        learned = (weights > 0).sum()
        return np.array([
            np.log1p(n_words), count["insult"], count["insult"] / words, learned, learned / words, weights.sum(), weights.sum() / words, weights.max(initial=0.0), len(seen),
            count["hidden"], count["hidden"] / words, count["second"] / words, 1 / (1 + gap.min(initial=1e6)), (gap <= 5).sum() / words, most,
            (chars[65:91].sum() + accents) / letters, count["shouted"] / words, signs / n_chars, chars[33] / n_chars, chars[63] / n_chars, chars[48:58].sum() / n_chars,
            count["mixed"] / words, count["stretched"] / words, count["masked"] / words, n_chars / n_words,
        ])


def evidence(with_: np.ndarray, without: np.ndarray, ones: float, zeros: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood ratio, log odds) of label 1 against 0 for what with_ documents of label 1 and without of 0 hold."""
    n, total = with_ + without, ones + zeros
    expected = (n * ones / total, n * zeros / total)
    parts = [2 * x * np.log(np.where(x > 0, x, 1) / np.where(e > 0, e, 1)) for x, e in zip((with_, without), expected)]
    odds = np.log((with_ + 0.5) / (ones + 1)) - np.log((without + 0.5) / (zeros + 1))
    return parts[0] + parts[1], odds


def lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """FOLDS + 1 lexicons from rows (text, y, fold): one without each fold's rows, then that of all rows.

    Documents are counted, once for each stem; each task adds up its own first. An entry
    has EVIDENCE for label 1 and is at least e^1.5 times as frequent there; the LEXICON
    best by evidence are kept, whatever the rows.
    """
    def run(batches):
        counts: dict[str, list[int]] = {}
        stems_of: dict[str, list[str]] = {}

        def out():
            columns = list(zip(*counts.values())) or [()] * (2 * FOLDS)
            done = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["stem", *names])
            counts.clear()
            return done

        for batch in batches:
            for text, y, fold in zip(*(c.to_pylist() for c in batch.columns)):
                found = set()
                for token in set(text.split()):
                    if token not in stems_of:
                        if len(stems_of) > KNOWN:
                            stems_of.clear()
                        stems_of[token] = stems(bare(token))
                    found.update(stems_of[token])
                for stem in found:
                    counts.setdefault(stem, [0] * (2 * FOLDS))[2 * fold + y] += 1
                if len(counts) > KNOWN:
                    yield out()
        yield out()

    names = [f"n{fold}_{y}" for fold in range(FOLDS) for y in (0, 1)]
    schema = "stem string, " + ", ".join(f"{n} long" for n in names)
    sizes = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}  # at most 2 * FOLDS rows
    counted = rows.select("text", "y", "fold").mapInArrow(run, schema).groupBy("stem").agg(*(F.sum(n).alias(n) for n in names))
    ones = sum(n for (_, y), n in sizes.items() if y == 1)
    zeros = sum(n for (_, y), n in sizes.items() if y == 0)
    total = lambda y: sum((F.col(f"n{fold}_{y}") for fold in range(FOLDS)), F.lit(0))
    expected = F.lit(ones / max(1, ones + zeros)) * (total(0) + total(1))
    best = counted.where(total(1) > expected).orderBy(F.desc(total(1) * F.log(total(1) / expected)), "stem").limit(2 * LEXICON).toPandas()  # at most 2 * LEXICON rows
    found = []
    for without in [*range(FOLDS), None]:
        kept = [f for f in range(FOLDS) if f != without]
        a, b = (best[[f"n{f}_{y}" for f in kept]].sum(axis=1).to_numpy(float) for y in (1, 0))
        n1, n0 = (float(sum(sizes.get((f, y), 0) for f in kept)) for y in (1, 0))
        ratio, odds = evidence(a, b, n1, n0) if n1 and n0 and len(best) else (np.zeros(len(best)), np.zeros(len(best)))
        good = np.flatnonzero((ratio >= EVIDENCE) & (odds >= 1.5))
        good = good[np.lexsort((best["stem"].to_numpy()[good], -ratio[good]))][:LEXICON] if len(good) else good
        found.append({best["stem"].iloc[i]: round(float(odds[i]), 6) for i in good})
    return found


@dataclass
class Trees:
    """Boosted trees of equal depth over binned features; scores are log odds."""

    edges: list[np.ndarray]
    base: float
    features: np.ndarray  # (trees, nodes)
    cuts: np.ndarray
    leaves: np.ndarray  # (trees, 2 ** depth)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def logits(self, x: np.ndarray) -> np.ndarray:
        bins, total = self.binned(x), np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.features.shape[1]
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), int)
            while inner and at[0] < inner:
                at = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return total


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, penalty: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; splits are found in histograms of quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    made = Trees(edges, float(np.log(p / (1 - p))), np.zeros((rounds, 2**depth - 1), int), np.full((rounds, 2**depth - 1), bins), np.zeros((rounds, 2**depth)))
    binned, total = made.binned(x), np.full(len(y), made.base)
    width = bins + 1
    offsets = np.arange(x.shape[1]) * width
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(total, -60, 60)))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), int)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            flat = ((at - first)[:, None] * (x.shape[1] * width) + offsets + binned).ravel()
            g, h = (np.bincount(flat, np.repeat(v, x.shape[1]), n * x.shape[1] * width).reshape(n, x.shape[1], width).cumsum(axis=2) for v in (grad, hess))
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
            gain = np.where((h >= least) & (all_h - h >= least), gain, 0.0).reshape(n, -1)
            best = gain.argmax(axis=1)
            useful = gain[np.arange(n), best] > 1e-9
            made.features[t, first : first + n] = best // width
            made.cuts[t, first : first + n] = np.where(useful, best % width, width)  # without gain all rows go left
            at = 2 * at + 1 + (binned[np.arange(len(y)), made.features[t, at]] > made.cuts[t, at])
        leaf = at - (2**depth - 1)
        sums = [np.bincount(leaf, v, 2**depth) for v in (grad, hess)]
        made.leaves[t] = rate * sums[0] / (sums[1] + penalty)
        total += made.leaves[t][leaf]
    return made


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities): the rising curve of least squares, one point a level, at the level's mean score."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of scores, rows
    keys, first = np.unique(score[order], return_index=True)
    for a, b in zip(first, [*first[1:], len(order)]):
        own = order[a:b]
        blocks.append([float(y[own].sum()), float(score[own].sum()), float(b - a)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


@dataclass
class Scorer:
    """Trees and the curve that makes probabilities of their log odds; between its points it is linear."""

    trees: Trees
    scores: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.logits(x), self.scores, self.levels), 0, 1) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Scorer:
    """Trees of all rows; the curve is that of each fold's scores by trees of the other folds."""
    if len(y) < 10 or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        width = x.shape[1] if x.ndim == 2 else len(NAMES)
        return Scorer(Trees([np.zeros(1)] * width, 0.0, np.zeros((0, 1), int), np.zeros((0, 1), int), np.zeros((0, 2))), np.zeros(1), np.array([p]))
    scores = np.zeros(len(y))
    for f in range(FOLDS):
        own = fold == f
        if own.any() and not own.all():
            scores[own] = boost(x[~own], y[~own]).logits(x[own])
    return Scorer(boost(x, y), *isotonic(scores, y))


def toxic_held_out(doc_id="doc_id"):
    """Rows that no label is learned from: crc32 of doc_id as text leaves 1 when divided by 3; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def scorer(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE):
    """A function from a text column to its score, fitted on docs (doc_id, text) and labels (doc_id, toxic)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = labelled_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), bound, "toxic", toxic_held_out())
    rows = rows.select("text", "y", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))  # equal texts are in one fold
    rows = stored(rows, "labelled")
    books = lexicons(rows)
    shared = spark.sparkContext.broadcast(books)  # at most (FOLDS + 1) * LEXICON entries

    def run(batches):
        readers = [Reader(book) for book in shared.value[:-1]]
        for batch in batches:
            texts, _, folds = (c.to_pylist() for c in batch.columns)
            xs = [readers[f].features(t).tobytes() for t, f in zip(texts, folds)]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), batch.column(1).cast(pa.int32()), batch.column(2)], ["x", "y", "fold"])

    found = rows.mapInArrow(run, "x binary, y int, fold int").collect()  # at most bound rows
    drop_stored(rows)
    x = np.array([np.frombuffer(r["x"], np.float64) for r in found]).reshape(-1, len(NAMES))
    y, fold = np.array([r["y"] for r in found], np.float64), np.array([r["fold"] for r in found], int)
    order = np.lexsort((y, fold, *x.T)) if len(x) else np.zeros(0, int)
    model = spark.sparkContext.broadcast((books[-1], fit(x[order], y[order], fold[order])))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        book, made = model.value
        reader = Reader(book)
        return pd.Series(made.score(np.array([reader.features(t) for t in texts]).reshape(-1, len(NAMES))), dtype=float)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    labels has doc_id and toxic; other values than 0 and 1 and contradictory labels are left
    out. Null and empty texts have no words and get the score of the zero vector. Without
    labels, with fewer than ten or with labels of one kind, all scores are the share of
    ones (0.5 without any). Texts of any length are read whole, CHUNK characters at a time.
    Equal texts have equal scores; repeated rows get a row each; a null doc_id counts as the
    text '' for the fold. No rows: no rows. Other columns are not read.
    """
    score = scorer(docs, labels, bound)("text")
    return docs.select("doc_id", toxic_held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
