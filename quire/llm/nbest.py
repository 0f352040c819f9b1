"""N-best segmentation of texts into the pieces of a SentencePiece vocabulary, and back.

A text's piece lattice has an edge for every piece at every place, and, for a character
that is no piece, one edge into its bytes. A segmentation's score is the sum of its
pieces' scores. Forward Viterbi gives the best score from the start to every place; the
search for the n best then runs backward from the end by A*, where that score is the
exact value of what is still to come, so paths come off the queue in order.

No piece reaches over a space, nor over a character that occurs in no longer piece, so
the lattice is a chain of small ones, its blocks. Each distinct block of a group of texts
is scored once, many at a time, forward and backward; the two together give each block's
best score without its best path. Only blocks whose loss is among the n - 1 least of
their text can differ in its n best, so only those are searched, and a last A* over their
alternatives orders the text's segmentations.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches

MARK = "▁"
#: A byte edge's score, below the least piece's.
PENALTY = 10
LOW = -(1 << 60)
#: Blocks scored at once, and the longest of them; longer ones go one by one.
ROWS, LONG = 8192, 48
#: Characters whose blocks are scored together.
GROUP = 1 << 23
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {int(self.texts[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.texts)]
        self.ids = {self.texts[i]: i for i in range(n) if i not in special and i not in self.byte_of}
        self.scores = {t: int(model.get_score(i)) for t, i in self.ids.items()}
        if any(model.get_score(i) != s for i, s in ((self.ids[t], s) for t, s in self.scores.items())):
            raise ValueError("the scores must be whole numbers")
        self.fallback = min((s for s in self.scores.values() if s > -(10**8)), default=0) - PENALTY
        self.longest = max(map(len, self.ids))
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece reaches over a space")
        joined = {c for t in self.ids if len(t) > 1 for c in t}
        alone = "".join(sorted({c for t in self.ids for c in t} - joined | {"\n", "\t", "\r"} - joined))
        split = re.escape(alone)
        self.block = re.compile(f"[{split}]|{MARK}*[^{MARK}{split}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        # open addressing by the pieces' polynomial hashes
        size = 1 << 18
        hashes = np.array([self._hash(t) for t in self.ids], np.uint64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("piece hashes collide")
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        for h, i in zip(hashes.tolist(), self.ids.values(), strict=True):
            at = (h * int(_MULTIPLIER) % (1 << 64)) >> 46
            while self.keys[at]:
                at = (at + 1) & (size - 1)
            self.keys[at], self.values[at] = h, i
        self.score_of = np.array([self.scores.get(t, LOW) if i not in special else LOW for i, t in enumerate(self.texts)], np.int64)

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_MULTIPLIER) + ord(c) + 1) % (1 << 64)
        return h

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each hash's piece, -1 for none. A 64-bit hash stands for its piece."""
        at = (hashes * _MULTIPLIER) >> np.uint64(46)  # the upper 18 bits
        key = self.keys[at]
        out = np.where(key == hashes, self.values[at], -1)
        more = np.flatnonzero((key != hashes) & (key != 0))
        while len(more):
            at[more] = (at[more] + np.uint64(1)) & self.mask
            key = self.keys[at[more]]
            hit = key == hashes[more]
            out[more[hit]] = self.values[at[more[hit]]]
            more = more[~hit & (key != 0)]
        return out

    def blocks(self, text: str) -> list[str]:
        return self.block.findall(MARK + text.replace(" ", MARK)) if text else []

    def edges(self, block: str, end: int):
        """(start, score, piece or None for bytes) of the edges that end here, by start."""
        for start in range(max(0, end - self.longest), end):
            if (score := self.scores.get(block[start:end])) is not None:
                yield start, score, block[start:end]
        if end and block[end - 1] not in self.scores:
            yield end - 1, self.fallback, None

    def forward(self, block: str, edges=None) -> list[int]:
        edges, best = edges or self.all_edges(block), [0]
        for end in range(1, len(block) + 1):
            best.append(max(best[start] + score for start, score in edges(end)))
        return best

    def all_edges(self, block: str):
        """A function from an end to the (start, score) of the edges that end there, by start; those of long blocks are looked up at once."""
        size = len(block)
        if size <= LONG:
            return [[(start, score) for start, score, _ in self.edges(block, end)] for end in range(size + 1)].__getitem__
        chars = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        h, ends, starts, scores = np.zeros(size, np.uint64), [], [], []
        for length in range(1, min(self.longest, size) + 1):
            h = h[: size - length + 1] * _MULTIPLIER + chars[length - 1 :]
            ids = self.found(h)
            at = np.arange(len(h)) if length == 1 else np.flatnonzero(ids >= 0)
            ids = ids[at]
            starts.append(at)
            ends.append(at + length)
            scores.append(np.where(ids >= 0, self.score_of[ids], self.fallback))
        end, start, score = map(np.concatenate, (ends, starts, scores))
        order = np.lexsort((start, end))
        cut = memoryview(np.searchsorted(end[order], np.arange(size + 2)))
        start, score = memoryview(start[order]), memoryview(score[order])
        return lambda at: zip(start[cut[at] : cut[at + 1]], score[cut[at] : cut[at + 1]])

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            out += [self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def search(self, block: str, n: int, heuristic: list[int] | None = None) -> list[tuple[int, list[str]]]:
        """The n best segmentations, best first. Of equal ones that comes first which was
        branched off last: the best has the latest starts of its pieces, seen from the end.

        Paths that leave the best one at different edges differ, so the n - 1 least losses
        among those edges bound what the others can lose, and nothing beyond is queued. Time
        and memory grow with the block's length.
        """
        edges = self.all_edges(block)
        best = heuristic or self.forward(block, edges)
        most = self._bound(edges, best, n)
        found, serial = [], 0
        queue = [(-best[-1], 0, len(block), 0, ())]  # -score, serial, place, score from there on, starts from there on
        while queue and len(found) < n:
            cost, _, at, done, path = heapq.heappop(queue)
            while at:  # of the edges that lose nothing the latest would come off the queue next
                on = None
                for start, score in edges(at):  # later starts get the smaller serial
                    whole = best[start] + score + done
                    if whole == -cost:
                        if on:
                            serial -= 1
                            heapq.heappush(queue, (cost, serial, on[0], on[1], (on[0], path)))
                        on = start, done + score
                    elif best[start] > LOW and (most is None or best[-1] - whole <= most):
                        serial -= 1
                        heapq.heappush(queue, (-whole, serial, start, done + score, (start, path)))
                at, done = on
                path = (at, path)
            starts = []
            while path:
                start, path = path
                starts.append(start)
            found.append((done, [block[a:b] for a, b in zip(starts, [*starts[1:], len(block)])]))
        return found

    @staticmethod
    def _bound(edges, best: list[int], n: int) -> int | None:
        """What the n-th best segmentation loses at most; None if unknown."""
        least: list[int] = []  # negated: the n - 1 least losses
        at = len(best) - 1
        while at:
            on = None
            for start, score in reversed([*edges(at)]):  # the later start first
                loss = best[at] - best[start] - score
                if on is None and not loss:
                    on = start
                elif best[start] > LOW:
                    if len(least) < n - 1:
                        heapq.heappush(least, -loss)
                    elif least and -loss > least[0]:
                        heapq.heapreplace(least, -loss)
            at = on
        return (-least[0] if least else 0) if len(least) == n - 1 else None

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, bytes read as UTF-8, marks as spaces, the first one dropped."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        text = raw.decode("utf-8", "surrogatepass")
        return text[text.startswith(MARK) :].replace(MARK, " ")

    def _lattice(self, blocks: list[str]):
        """For blocks of one length: best scores forward and backward (place, block), and
        the edges (start, end, blocks, ids, scores); a character that is no piece has id -1."""
        n, size = len(blocks), len(blocks[0])
        chars = np.frombuffer("".join(blocks).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).T.astype(np.uint64) + np.uint64(1)
        edges = []
        for start in range(size):
            h = np.zeros(n, np.uint64)
            for end in range(start + 1, min(size, start + self.longest) + 1):
                h = h * _MULTIPLIER + chars[end - 1]
                ids = self.found(h)
                rows = np.arange(n) if end == start + 1 else np.flatnonzero(ids >= 0)
                if len(rows):
                    ids = ids[rows]
                    edges.append((start, end, rows, ids, np.where(ids >= 0, self.score_of[ids], self.fallback)))
        forward, back = np.full((size + 1, n), LOW, np.int64), np.full((size + 1, n), LOW, np.int64)
        forward[0] = back[size] = 0
        for start, end, rows, _, score in sorted(edges, key=lambda e: e[1]):
            forward[end, rows] = np.maximum(forward[end, rows], forward[start, rows] + score)
        for start, end, rows, _, score in sorted(edges, key=lambda e: -e[0]):
            back[start, rows] = np.maximum(back[start, rows], back[end, rows] + score)
        return forward, back, edges

    def _many(self, blocks: list[str]) -> list[tuple[list[int], int, int]]:
        """(ids, score, loss) of the best path of each block of one length; loss: to the second best, -1 for none."""
        n, size = len(blocks), len(blocks[0])
        forward, back, edges = self._lattice(blocks)
        best = forward[size]
        second = np.full(n, LOW, np.int64)
        # back from the end: of equal edges the one that starts later
        at = np.full(n, size)
        path_rows, path_ids, path_starts = [], [], []
        for start, end, rows, ids, score in sorted(edges, key=lambda e: (-e[1], -e[0])):
            whole = forward[start, rows] + score
            on = (at[rows] == end) & (whole == forward[end, rows])
            hit = rows[on]
            at[hit] = start
            path_rows.append(hit)
            path_ids.append(ids[on])
            path_starts.append(np.full(len(hit), start))
            off = ~on
            second[rows[off]] = np.maximum(second[rows[off]], whole[off] + back[end, rows[off]])
        row, ids, starts = np.concatenate(path_rows), np.concatenate(path_ids), np.concatenate(path_starts)
        order = np.lexsort((starts, row))
        row, ids, starts = row[order], ids[order].tolist(), starts[order]
        cuts = np.searchsorted(row, np.arange(n + 1)).tolist()
        made = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for r in np.unique(row[np.array(ids) < 0]).tolist():  # characters that are no pieces
            cut = starts[cuts[r] : cuts[r + 1]].tolist()
            made[r] = self.ids_of([blocks[r][s:e] for s, e in zip(cut, [*cut[1:], size])])
        loss = np.where(second > LOW // 2, best - second, -1)
        return list(zip(made, best.tolist(), loss.tolist()))

    def best_paths(self, blocks: list[str], n: int = 2, searched: dict[int, list[tuple[int, list[int]]]] | None = None) -> list[tuple[list[int], int, int]]:
        """(ids, score, loss) of each block's best path, see _many(). Long blocks are searched at once for their n best, which go to ``searched``."""
        out: list = [None] * len(blocks)
        sizes: dict[int, list[int]] = {}
        for i, b in enumerate(blocks):
            if len(b) > LONG:
                made = [(s, self.ids_of(p)) for s, p in self.search(b, max(2, n))]
                out[i] = (made[0][1], made[0][0], made[0][0] - made[1][0] if len(made) > 1 else -1)
                if searched is not None:
                    searched[i] = made
            else:
                sizes.setdefault(len(b), []).append(i)
        for places in sizes.values():
            for at in range(0, len(places), ROWS):
                some = places[at : at + ROWS]
                for i, made in zip(some, self._many([blocks[i] for i in some]), strict=True):
                    out[i] = made
        return out


def combine(options: list[tuple[int, list[int]]], n: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """The n cheapest choices: (loss, ((place, alternative), ...)).

    options: (place, losses of its alternatives 1, 2, ...) by place. A*: a choice is
    extended by the next place, whose remaining cost is zero, exactly; ties go to the
    choice with fewer changes, then to earlier places and alternatives.
    """
    queue = [(0, 0, ())]
    found = []
    while queue and len(found) < n:
        loss, changes, chosen = heapq.heappop(queue)
        found.append((loss, tuple((options[i][0], a) for i, a in chosen)))
        last, alternative = chosen[-1] if chosen else (-1, 0)
        for i in range(last + 1, len(options)):
            if options[i][1]:
                heapq.heappush(queue, (loss + options[i][1][0], changes + 1, (*chosen, (i, 1))))
        if chosen and alternative < len(options[last][1]):
            more = options[last][1]
            heapq.heappush(queue, (loss + more[alternative] - more[alternative - 1], changes, (*chosen[:-1], (last, alternative + 1))))
    return found


def segment(pieces: Pieces, texts: list[str], n: int) -> list[tuple[list[int], int, list[tuple[int, list[tuple[int, int, list[int]]]]]]]:
    """For each text: ids and score of the best segmentation, and the others as (score, changes).

    A change (at, drop, ids) replaces ``drop`` of the best ids from ``at`` on.
    """
    cut = [pieces.blocks(t) for t in texts]
    number: dict[str, int] = {}
    for blocks in cut:
        for b in blocks:
            number.setdefault(b, len(number))
    known = list(number)
    searched: dict[int, list[tuple[int, list[int]]]] = {}
    paths = pieces.best_paths(known, n, searched)
    score = np.array([s for _, s, _ in paths], np.int64)
    loss = np.array([x if x >= 0 else np.iinfo(np.int64).max for _, _, x in paths], np.int64)
    sizes = np.array([len(i) for i, _, _ in paths], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.array([i for ids, _, _ in paths for i in ids], np.int32)
    out = []
    for blocks in cut:
        if not blocks:
            out.append(([], 0, []))
            continue
        of = np.fromiter(map(number.__getitem__, blocks), np.int64, len(blocks))
        size = sizes[of]
        ends = np.cumsum(size)
        ids = flat[np.repeat(starts[of] - ends + size, size) + np.arange(ends[-1])]
        total, others = int(score[of].sum()), []
        if n > 1:
            lost = loss[of]
            if len(of) > n - 1:  # the n - 1 least losses, of equal ones the first places
                edge = np.partition(lost, n - 2)[n - 2]
                below, equal = np.flatnonzero(lost < edge), np.flatnonzero(lost == edge)
                near = np.sort(np.concatenate([below, equal[: n - 1 - len(below)]]))
            else:
                near = np.arange(len(of))
            options = []
            for place in near.tolist():
                b = int(of[place])
                if b not in searched:
                    searched[b] = [(s, pieces.ids_of(p)) for s, p in pieces.search(known[b], n)]
                options.append((place, [searched[b][0][0] - s for s, _ in searched[b][1:n]]))
            for lose, chosen in combine(options, n)[1:]:
                changes = [(int(ends[p] - size[p]), int(size[p]), searched[int(of[p])][a][1]) for p, a in chosen]
                others.append((total - lose, changes))
        out.append((ids, total, others))
    return out


SCHEMA = "doc_id long, ids array<int>, score long, others array<struct<score: long, changes: array<struct<at: int, drop: int, ids: array<int>>>>>, round_trip boolean"


def encode_nbest(docs: DataFrame, n: int = 4, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, ids, score, others and round_trip of every row of docs (doc_id, text).

    ids and score are the best segmentation's, others the next n - 1, best first, each
    as its score and what it changes in ids; fewer where the lattice has fewer paths.
    round_trip says that decoding ids gives the text; only a text that holds the mark
    U+2581 itself, which decodes to a space, fails. Null and empty texts have no ids and
    score 0. Whole texts are encoded, in time and memory that grow with their length, also
    without any space. Repeated rows get a row each. No rows: no rows. Other columns are not read.
    ``model`` names a file of the public tokenizers, or is a path.
    """
    small_batches(docs.sparkSession, 2500)

    def run(batches):
        import public_tokenizers

        pieces = Pieces(model if "/" in model else public_tokenizers.path(model))
        schema = None
        for b in batches:
            schema = schema or pa.schema([
                ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("score", pa.int64()),
                ("others", pa.list_(pa.struct([("score", pa.int64()), ("changes", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))),
                ("round_trip", pa.bool_()),
            ])
            doc_ids, texts, at = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()], 0
            while at < len(texts):
                end, held = at + 1, len(texts[at])
                while end < len(texts) and held + len(texts[end]) <= GROUP:
                    held += len(texts[end])
                    end += 1
                made = segment(pieces, texts[at:end], n)
                decoded = [pieces.decode(ids.tolist() if len(ids) else []) for ids, _, _ in made]
                others = [o for _, _, o in made]  # tuples in the order of the fields
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum([len(i) for i, _, _ in made]))), pa.int32()),
                    pa.array(np.concatenate([np.asarray(i, np.int32) for i, _, _ in made])),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[at:end], pa.int64()), lists, pa.array([s for _, s, _ in made], pa.int64()), pa.array(others, schema.field("others").type), pa.array([d == t for d, t in zip(decoded, texts[at:end], strict=True)])],
                    schema=schema,
                )
                at = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def decode_ids(rows: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids count as none."""

    def run(batches):
        import public_tokenizers

        pieces = Pieces(model if "/" in model else public_tokenizers.path(model))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
