"""Repair of conversations at least cost, by a scan of min-plus matrices.

A turn is a 4x4 matrix over (cost, audit): the cheapest edits that lead from one state of
the conversation to another (nothing yet, after system, after user, after assistant), with
any inserted turns around it. Products of such matrices are associative and the order of
equal costs by audit survives them, because two audits of the same turns at one cost never
begin one another. So turns are dealt out by ranges of their order, every task multiplies
its own runs as a balanced tree, and only the runs at the edges of a range, two a range,
are multiplied further, sixteen at a time. A conversation of any length fills no task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACE, drop_stored, partition_keys, partitions, small_batches, stored

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: (state, initial of the role) to the state after it; states: nothing, system, user, assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: States that a conversation may end in.
ENDS = (0, 3)
#: Letters of edits inside matrices, which also tell the role, and those of audits. Both sort alike.
DELETED, INSERTED, KEPT, REROLED = "D", {"u": "I", "a": "J"}, {"u": "K", "a": "K", "s": "K"}, {"u": "R", "a": "S"}
PUBLIC = str.maketrans("JS", "IR")
#: Turns whose products are remembered.
REMEMBERED = 8
#: Runs that one task multiplies for a conversation.
FAN = 16
#: Bytes of a conversation's text that are hashed, or sent on, at once.
CHUNK = 1 << 20
LEGAL = {"su", "ua", "au"}

Matrix = tuple  # 16 of (cost, edits) or None, by row


def product(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            best = None
            for k in range(4):
                x, y = a[i + k], b[4 * k + j]
                if x and y:
                    cost = x[0] + y[0]
                    if best is None or cost < best[0] or cost == best[0] and x[1] + y[1] < best[1]:
                        best = (cost, x[1] + y[1])
            out.append(best)
    return tuple(out)


def _least(a: Matrix, b: Matrix) -> Matrix:
    return tuple(min(x, y) if x and y else x or y for x, y in zip(a, b))


def _matrix(steps: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(steps.get(divmod(at, 4)) for at in range(16))


NOTHING = _matrix({(i, i): (0, "") for i in range(4)})


def closure() -> Matrix:
    """Any number of inserted turns: no path that is worth its cost passes a state twice."""
    one = _least(NOTHING, _matrix({(i, j): (INSERT, INSERTED[r]) for (i, r), j in NEXT.items() if r in INSERTED}))
    return product(product(one, one), one)


INSERTS = closure()


@lru_cache(maxsize=None)
def turn_matrix(kind: str) -> Matrix:
    """kind: the role's initial if it is s, u or a, else x; in capitals if the text is truncated; d if the turn must go."""
    found = _matrix({(i, i): (DELETE, DELETED) for i in range(4)})
    if kind != "d":
        more, role = (TRUNCATED if kind.isupper() else 0), kind.lower()
        for (i, r), j in NEXT.items():
            if r in REROLED:
                found = _least(found, _matrix({(i, j): (REROLE + more, REROLED[r])}))
            if r == role:
                found = _least(found, _matrix({(i, j): (more, KEPT[r])}))
    return product(product(INSERTS, found), INSERTS)


def matrix_of(kinds: str) -> Matrix:
    """The product of the turns' matrices, as a balanced tree."""
    if len(kinds) <= REMEMBERED:
        return _short(kinds)
    half = len(kinds) // 2
    half = max(REMEMBERED, half - half % REMEMBERED)
    return product(matrix_of(kinds[:half]), matrix_of(kinds[half:]))


@lru_cache(maxsize=1 << 16)
def _short(kinds: str) -> Matrix:
    return turn_matrix(kinds) if len(kinds) == 1 else product(_short(kinds[: len(kinds) // 2]), _short(kinds[len(kinds) // 2 :]))


def joined(a: dict, b: dict) -> dict:
    """What is known of a run of turns followed by another of the same conversation."""
    same = a["turns"] and b["turns"] and a["turns"][1] == b["turns"][0]
    turns = [a["turns"][0], b["turns"][1], a["turns"][2] + b["turns"][2] - bool(same)] if a["turns"] and b["turns"] else a["turns"] or b["turns"]
    return {
        "faults": [x + y for x, y in zip(a["faults"], b["faults"])],
        "illegal": a["illegal"] + b["illegal"] + (a["roles"][1] + b["roles"][0] not in LEGAL),
        "roles": [a["roles"][0], b["roles"][1]], "turns": turns, "runs": a["runs"] + b["runs"], "matrix": product(tuple(a["matrix"]), tuple(b["matrix"])),
    }


class Run:
    """Turns of one conversation that follow one another in one part."""

    def __init__(self, conv, part: int, row: int, first: bool):
        self.conv, self.part, self.row, self.first = conv, part, row, first
        self.kinds: list[str] = []
        self.faults, self.illegal, self.roles, self.turns = [0, 0, 0], 0, [], []

    def add(self, turn: int | None, role: str, kind: str, fault: int) -> None:
        """turn: its number; role: the initial; fault: 0 none, then blank, duplicate, truncated."""
        if fault:
            self.faults[fault - 1] += 1
        if self.roles and self.roles[1] + role not in LEGAL:
            self.illegal += 1
        self.roles = [self.roles[0] if self.roles else role, role]
        if turn is not None and not (self.turns and self.turns[1] == turn):
            self.turns = [self.turns[0] if self.turns else turn, turn, (self.turns[2] if self.turns else 0) + 1]
        self.kinds.append(kind)

    def element(self) -> dict:
        runs = [[self.part, self.row, len(self.kinds)]]
        return {"faults": self.faults, "illegal": self.illegal, "roles": self.roles, "turns": self.turns, "runs": runs, "matrix": matrix_of("".join(self.kinds))}


def ordered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with initial, blank, cut, digest, and part and row, which number them in order.

    Nulls of role and text count as one space. The order is that of conv_id, turn (nulls
    first) and, of equal turns, of the SHA-256 of role and text. Written, by ranges.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    rows = rows.select(
        "*", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
        F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)).alias("digest"),
    ).withColumn("_tie", F.monotonically_increasing_id())
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("digest"), F.asc("_tie")]
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    return stored(dealt.drop("_tie").withColumn("part", F.shiftright(at, 33).cast("int")).withColumn("row", at.bitwiseAND(F.lit((1 << 33) - 1))), "turns")


def _by_part(rows: DataFrame, *order: str) -> DataFrame:
    """rows with each part in one task, in order; parts are spread evenly over the tasks."""
    spark = rows.sparkSession
    n = partitions(spark)
    keys = F.array(*map(F.lit, partition_keys(spark, n)))
    key = keys[F.pmod(F.col("part"), F.lit(n))]
    return rows.repartition(n, key).sortWithinPartitions("part", *order)


def _elements(rows: DataFrame) -> DataFrame:
    """(conv_id, part, edge, element) of the runs of rows; edge: the conversation may go on in another part."""
    groups = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "row")).alias("at"))
    none = F.lit(None)
    firsts = groups.select("at.part", "at.row", none.cast(rows.schema["conv_id"].dataType).alias("conv_id"), none.cast("long").alias("turn"), none.cast("string").alias("initial"), none.cast("boolean").alias("blank"), none.cast("boolean").alias("cut"))
    both = rows.select("part", "row", "conv_id", "turn", "initial", "blank", "cut").unionByName(firsts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mark, kind = None, None, None

        def out(own: Run, last: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own.conv], kind), pa.array([own.part], pa.int32()), pa.array([own.first or last]), pa.array([json.dumps(own.element())])], ["conv_id", "part", "edge", "element"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for part, row, conv, turn, initial, blank, cut in zip(*(c.to_pylist() for c in batch.columns)):
                if initial is None:
                    mark = (part, row)
                    continue
                if held is None or held.part != part or held.conv != conv:
                    if held is not None:
                        yield out(held, held.part != part)
                    held = Run(conv, part, row, held is None or held.part != part)
                fault = 1 if blank else 2 if mark != (part, row) else 3 if cut else 0
                role = initial if initial in ("s", "u", "a") else "x"
                held.add(turn, initial, "d" if fault in (1, 2) else role.upper() if fault else role, fault)
        if held is not None:
            yield out(held, True)

    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, part int, edge boolean, element string"
    return _by_part(both, "row", "initial").mapInArrow(run, schema)  # nulls first: a mark comes before its row


def _reduced(edges: DataFrame, n: int) -> DataFrame:
    """One element a conversation of edges (conv_id, part, element), FAN at a time in the order of parts."""
    def run(key, table):
        found = sorted(zip(table.column("part").to_pylist(), table.column("element").to_pylist()))
        whole = reduce(joined, (json.loads(e) for _, e in found))
        return pa.table({"conv_id": table.column("conv_id").slice(0, 1), "part": pa.array([found[0][0] // FAN], pa.int32()), "element": pa.array([json.dumps(whole)])})

    schema = edges.select("conv_id", "part", "element").schema
    while n > 1:
        edges = edges.select("conv_id", "part", "element").groupBy("conv_id", F.floor(F.col("part") / FAN).alias("_group")).applyInArrow(run, schema)
        n = -(-n // FAN)
    return edges.select("conv_id", "element")


def _answers(elements: DataFrame) -> DataFrame:
    schema = f"conv_id {dict(elements.dtypes)['conv_id']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, edits string, runs array<struct<part:int,row:long,n:long>>"

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                e = json.loads(text)
                cost, edits = min(tuple(e["matrix"][j]) for j in ENDS if e["matrix"][j])
                gaps = e["turns"][1] - e["turns"][0] + 1 - e["turns"][2] if e["turns"] else 0
                rows.append((gaps, *e["faults"], e["illegal"], cost, edits.translate(PUBLIC), edits, [dict(zip(("part", "row", "n"), r)) for r in e["runs"]]))
            columns = list(zip(*rows)) or [()] * 9
            types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([("part", pa.int32()), ("row", pa.int64()), ("n", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "edits", "runs"])

    return elements.mapInArrow(run, schema)


def row_edits(edits: str, sizes: list[int]) -> list[list[str]]:
    """For each run of sizes its turns' edits: a turn's own letter after those of the turns inserted before it; the last has those after it too."""
    found, own = [], ""
    for letter in edits:
        own += letter
        if letter not in "IJ":
            found.append(own)
            own = ""
    found[-1] += own
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    return [found[end - n : end] for end, n in zip(ends, sizes)]


def _edited_rows(answers: DataFrame) -> DataFrame:
    """(part, row, letters) for every turn."""
    def run(batches):
        for batch in batches:
            for edits, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for place, own in zip(runs, row_edits(edits, [r["n"] for r in runs]), strict=True):
                    for at in range(0, len(own), 10_000):
                        some = own[at : at + 10_000]
                        first = place["row"] + at
                        yield pa.RecordBatch.from_arrays([pa.array([place["part"]] * len(some), pa.int32()), pa.array(range(first, first + len(some)), pa.int64()), pa.array(some)], ["part", "row", "letters"])

    return answers.select("edits", "runs").mapInArrow(run, "part int, row long, letters string")


class Repaired:
    """conversations: one row a conversation; turns: the repaired turns. Both read tables in the shared folder."""

    def __init__(self, rows: DataFrame, answers: DataFrame):
        self.answers, self.rows = answers, rows
        self.conversations = answers.drop("edits", "runs")

    @property
    def turns(self) -> DataFrame:
        """(conv_id, part, row, step, turn, role, text, edit) in the order of part, row and step; edit: K, R or I."""
        found = self.rows.select("part", "row", "conv_id", "turn", "role", "text").join(_edited_rows(self.answers), ["part", "row"])
        steps = found.select("conv_id", "part", "row", "turn", "role", "text", F.posexplode(F.split("letters", "")).alias("step", "letter")).where("letter not in ('', 'D')")
        role = F.when(F.col("letter").isin("I", "R"), "user").when(F.col("letter").isin("J", "S"), "assistant").otherwise(F.col("role"))
        added = F.col("letter").isin("I", "J")
        return steps.select(
            "conv_id", "part", "row", "step", F.when(~added, F.col("turn")).alias("turn"), role.alias("role"),
            F.when(added, "").otherwise(F.col("text")).alias("text"), F.translate("letter", "JS", "IR").alias("edit"),
        )

    def transcripts(self) -> DataFrame:
        """(conv_id, sha256) of the repaired turns as ``role:text``, joined by newlines; conversations without any are left out.

        A conversation inside one part is hashed there. Of others the parts send their texts
        on in chunks, which one task hashes one by one: SHA-256 has no other order.
        """
        lines = self.turns.select("part", "row", "step", "conv_id", F.concat_ws(":", "role", "text").alias("line"))
        kind = dict(lines.dtypes)["conv_id"]

        def run(batches):
            conv, at, first, held, size, sent, arrow = None, None, True, [], 0, 0, None

            def out(last: bool, edge: bool):
                data = b"\n".join(held) + (b"" if last else b"\n")
                whole = hashlib.sha256(data).hexdigest() if last and not edge and not sent else None
                columns = [pa.array([conv], arrow), pa.array([at], pa.int32()), pa.array([sent], pa.int64()), pa.array([None if whole else data], pa.binary()), pa.array([whole], pa.string())]
                return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "chunk", "data", "sha256"])

            for batch in batches:
                arrow = batch.schema.field("conv_id").type
                for part, _, _, own, line in zip(*(c.to_pylist() for c in batch.columns)):
                    if at is not None and (part != at or own != conv):
                        yield out(True, first or part != at)
                        first, held, size, sent = part != at, [], 0, 0
                    elif size > CHUNK:
                        yield out(False, True)
                        held, size, sent = [], 0, sent + 1
                    conv, at = own, part
                    held.append(line.encode("utf-8", "surrogatepass"))
                    size += len(held[-1])
            if at is not None:
                yield out(True, True)

        def whole(batches):
            conv, some, last, arrow = None, None, None, None

            def out():
                return pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array([some.hexdigest()])], ["conv_id", "sha256"])

            for batch in batches:
                arrow = batch.schema.field("conv_id").type
                for own, part, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if some is not None and own != conv:
                        yield out()
                        some = None
                    if some is None:
                        conv, some = own, hashlib.sha256()
                    elif part != last:
                        some.update(b"\n")
                    last = part
                    some.update(data)
            if some is not None:
                yield out()

        found = stored(_by_part(lines, "row", "step").mapInArrow(run, f"conv_id {kind}, part int, chunk long, data binary, sha256 string"), "lines")
        open_ = found.where("sha256 is null").select("conv_id", "part", "chunk", "data").repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
        return found.where("sha256 is not null").select("conv_id", "sha256").unionByName(open_.mapInArrow(whole, f"conv_id {kind}, sha256 string"))


def repair(turns: DataFrame) -> Repaired:
    """turns (conv_id, turn, role, text) judged and repaired at least cost.

    A turn's first fault counts: blank (nothing but white space), duplicate (role and text
    were there earlier in the conversation), truncated (no . ! ? at its end). Keeping a turn
    costs nothing, another role 1, deleting 2 (blank and duplicate turns must go), an
    inserted empty turn 5; truncated turns that stay cost 5 more. The repaired roles are
    an optional system turn and then user and assistant in turn, or nothing; of equally
    cheap audits the least in ASCII counts. gaps: numbers missing between the least and the
    greatest turn. illegal: neighbours, as given, whose roles don't follow each other.

    Null roles and texts count as one space, other roles than those three can't stay; null
    turns come first and count for no gap; turns of one number are ordered by a hash of role
    and text, so equal rows, and repeated ones, are neighbours and all but the first are
    duplicates. A null conv_id is a conversation of its own. Other columns are not read. No
    rows: no conversations.
    """
    small_batches(turns.sparkSession)
    rows = ordered(turns)
    elements = stored(_elements(rows), "runs")
    reduced = _reduced(elements.where("edge"), partitions(turns.sparkSession))
    answers = stored(_answers(elements.where("not edge").select("conv_id", "element").unionByName(reduced)), "answers")
    drop_stored(elements)
    return Repaired(rows, answers)


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with faults by the checksum of ``conv_id:turn``; nulls become one space, but in conv_id and turn.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes . ! ? out of it, 3
    repeats it and 4 makes it the user's.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    changed = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), changed.alias("text"), times.alias("_copy")).drop("_copy")
