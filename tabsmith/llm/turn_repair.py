"""Repair of conversations whose turns are out of order, blank, repeated or cut short, by the cheapest edits.

The roles of a repaired conversation are nothing, or an optional system turn and then pairs of a user and an assistant turn. A row is kept
(cost 0), given the role that fits (1), or deleted (2; blank rows and repeated ones must be); a turn without text is inserted for 5; a row cut short that stays
costs 5 more. Of the cheapest lists of edits the one whose initials (Delete, Insert, Keep, Rerole) come first in ASCII order is taken.

The costs form a shortest path with four states (nothing yet, after system, after user, after assistant). ``walk`` stores backward vectors of
least costs only at each square-root-th row; walking forward it computes the vectors of one block anew, and takes at each row the first letter
whose edit is tight, that is, lies on a cheapest path. An edit and a state give the next state, so the first tight letter at each step gives the first list.

On Spark the rows are sorted by range over (conversation, turn, role and text), so that a conversation of any length is spread over tasks, and each task cuts
its rows into blocks of bounded size. A conversation inside one block is done at once. The blocks of the others are the checkpoints on the next
level: each gives a 4 x 4 matrix of least costs between states, a backward pass over these small matrices gives the vector behind every block, and a forward
pass walks block after block. That pass is one sequential stream a conversation, as its result (one list of edits and one SHA-256) is; it holds one block.

Order: by turn, nulls first, then by role and text (their first ``HEAD`` characters, then a hash). Edge cases: nulls in role and text read as one space; a null conversation is one of its own; a
conversation without rows has zeros, no edits and the digest of nothing; a role that is empty fits nowhere; equal rows are interchangeable; an empty table
gives no rows; differences of turns beyond a 64-bit integer read as the greatest one; columns beside the four are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import stored

# Costs of the edits.
RELABEL, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5

NEVER = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (0, NEVER, NEVER, 0)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
DUE = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
"""The role that is due in each state, and the state behind it."""
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
GREATEST = (1 << 63) - 1
BLOCK_ROWS, BLOCK_CHARACTERS = 1024, 1 << 19
HEAD = 64
"""Rows of one turn are told apart by so many characters, then by a hash, so that the range bounds stay small."""

Vector = tuple[int, int, int, int]


class Turn(NamedTuple):
    role: str
    text: str
    must_go: bool
    cut_short: bool


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone, repeat): faults by a checksum of each row's id and turn. Dropped rows stay as marks without text."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                (F.crc32(key.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    text = F.when(fault <= 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fault == 0, "").when(fault == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(0), F.when(fault == 3, 1).otherwise(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), copies.alias("repeat"))


def _inserted(vector: Sequence[int]) -> Vector:
    """The vector after any insertions in front of it."""
    user, assistant = vector[USER], vector[ASSISTANT]
    user, assistant = min(user, assistant + INSERT), min(assistant, user + INSERT)
    return (min(vector[START], user + INSERT), min(vector[SYSTEM], user + INSERT), user, assistant)


def _before(turn: Turn, after: Vector) -> Vector:
    """Least costs in front of a row from those behind it."""
    if turn.must_go:
        return _inserted([v + DELETE for v in after])
    extra = CUT_SHORT if turn.cut_short else 0
    keep = NEXT.get(turn.role[:1], {})
    best = []
    for state in range(4):
        cost = min(after[state] + DELETE, after[DUE[state][1]] + RELABEL + extra)
        if state in keep:
            cost = min(cost, after[keep[state]] + extra)
        best.append(cost)
    return _inserted(best)


def last_vector(ends: Sequence[int] = ENDS) -> Vector:
    """Least costs behind the last row of a conversation."""
    return _inserted(ends)


def backward(turns: Iterable[Turn], after: Vector) -> Vector:
    """Least costs in front of rows given in reverse order."""
    for turn in turns:
        after = _before(turn, after)
    return after


def walk(turns: Sequence[Turn], state: int, after: Vector) -> tuple[list[str], list[tuple[str, str]], int]:
    """Initials of the edits of these rows, the (role, text) rows they leave, and the state behind the last row.

    ``after``: least costs behind the last row. Insertions behind it are left to whoever walks on.
    """
    step = max(math.isqrt(len(turns)), 1)
    marks = range(0, len(turns), step)
    stored_at: dict[int, Vector] = {}
    vector = after
    for at in reversed(marks):
        stored_at[at] = vector  # behind this block
        vector = backward(reversed(turns[at : at + step]), vector)
    edits: list[str] = []
    kept: list[tuple[str, str]] = []
    for at in marks:
        block = turns[at : at + step]
        behind = [stored_at[at]]
        for turn in reversed(block[1:]):
            behind.append(_before(turn, behind[-1]))
        behind.reverse()
        for turn, next_ in zip(block, behind):
            here = _before(turn, next_)
            while True:
                cost, (role, due) = here[state], DUE[state]
                if next_[state] + DELETE == cost:
                    edits.append("D")
                    break
                if here[due] + INSERT == cost:
                    edits.append("I")
                    kept.append((role, ""))
                    state = due
                    continue
                extra, to = CUT_SHORT if turn.cut_short else 0, NEXT.get(turn.role[:1], {}).get(state)
                if to is not None and next_[to] + extra == cost:
                    edits.append("K")
                    kept.append((turn.role, turn.text))
                    state = to
                else:
                    edits.append("R")
                    kept.append((role, turn.text))
                    state = due
                break
    return edits, kept, state


def finish(state: int) -> tuple[list[str], list[tuple[str, str]]]:
    """Insertions behind the last row."""
    edits, kept, vector = [], [], last_vector()
    while ENDS[state] != vector[state]:
        role, state = DUE[state]
        edits.append("I")
        kept.append((role, ""))
    return edits, kept


def _sound(text: str) -> tuple[bool, bool]:
    """Whether a text is blank, and whether it is cut short."""
    end = text.rstrip(BLANKS)
    return not end, bool(end) and end[-1] not in ".!?"


@dataclass
class Report:
    """What is counted of a conversation while its rows pass in order."""

    conv_id: Any
    least: int | None = None
    greatest: int | None = None
    turns: int = 0
    last: int | None = None
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    initial: str | None = None
    cost: int = 0
    edits: list[str] = field(default_factory=list)
    digest: Any = field(default_factory=hashlib.sha256)
    started: bool = False

    def count(self, turn: int | None, row: Turn, blank: bool) -> None:
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.greatest, self.last, self.turns = turn, turn, self.turns + 1
        self.blank += blank
        self.duplicate += row.must_go and not blank
        self.truncated += row.cut_short
        initial = row.role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial

    def add(self, edits: list[str], kept: list[tuple[str, str]]) -> None:
        self.edits += edits
        for role, text in kept:
            self.digest.update((("\n" if self.started else "") + role + ":" + text).encode())
            self.started = True

    def row(self) -> tuple:
        gaps = 0 if self.least is None else min(self.greatest - self.least + 1 - self.turns, GREATEST)
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.edits), self.digest.hexdigest())


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
BLOCKS = "conv_id long, part int, block long, turns array<long>, roles array<string>, texts array<string>, firsts array<binary>, places array<int>"


def _report_batch(reports: list[Report], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*[r.row() for r in reports])) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


RESULT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _judged(roles: Sequence[str], texts: Sequence[str], repeated: Callable[[int], bool]) -> tuple[list[Turn], list[bool]]:
    turns, blanks = [], []
    for at, (role, text) in enumerate(zip(roles, texts)):
        blank, cut_short = _sound(text)
        again = not blank and repeated(at)
        turns.append(Turn(role, text, blank or again, cut_short and not again))
        blanks.append(blank)
    return turns, blanks


def _whole(conv_id: Any, numbers: list, roles: list[str], texts: list[str]) -> Report:
    """A conversation that lies in one block."""
    seen: set[tuple[str, str]] = set()

    def repeated(at: int) -> bool:
        key = (roles[at], texts[at])
        known = key in seen
        seen.add(key)
        return known

    turns, blanks = _judged(roles, texts, repeated)
    report = Report(conv_id)
    for number, turn, blank in zip(numbers, turns, blanks):
        report.count(number, turn, blank)
    behind = last_vector()
    report.cost = backward(reversed(turns), behind)[START]
    edits, kept, state = walk(turns, START, behind)
    report.add(edits, kept)
    report.add(*finish(state))
    return report


def _name(role: str, text: str) -> bytes:
    """128 bits of a row's role and text."""
    role_bytes = role.encode()
    return hashlib.blake2b(len(role_bytes).to_bytes(8, "little") + role_bytes + text.encode(), digest_size=16).digest()


BLOCK_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
    ("texts", pa.list_(pa.string())), ("firsts", pa.list_(pa.binary())), ("places", pa.list_(pa.int32()))])
BOTH_SCHEMA = pa.schema([*RESULT, *[pa.field(f.name, f.type) for f in BLOCK_SCHEMA][1:]])


def _blocks(ordered: DataFrame, most_rows: int, most_characters: int) -> DataFrame:
    """Reports of conversations inside one block of a task, and blocks (``part`` is set) of all others."""
    fields = f"conv_id long, {REPORT}, " + BLOCKS.split(", ", 1)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        conv_id, turns, roles, texts, size = None, [], [], [], 0
        opened, cut, first = False, False, True  # ``cut``: a part of this conversation is in a block already
        ready: list[Report] = []

        def block() -> pa.RecordBatch:
            nonlocal turns, roles, texts, size, number
            places: dict[bytes, int] = {}
            for at, (role, text) in enumerate(zip(roles, texts)):
                if text.strip(BLANKS):
                    places.setdefault(_name(role, text), at)
            values = [[conv_id], [part], [number], [turns], [roles], [texts], [list(places)], [list(places.values())]]
            nulls = [pa.nulls(1, f.type) for f in list(RESULT)[1:]]
            columns = [pa.array(v, f.type) for v, f in zip(values, BLOCK_SCHEMA)]
            turns, roles, texts, size, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([columns[0], *nulls, *columns[1:]], schema=BOTH_SCHEMA)

        def reports() -> pa.RecordBatch:
            nonlocal ready
            done = _report_batch(ready, RESULT)
            nulls = [pa.nulls(done.num_rows, f.type) for f in list(BLOCK_SCHEMA)[1:]]
            ready = []
            return pa.RecordBatch.from_arrays([*done.columns, *nulls], schema=BOTH_SCHEMA)

        for batch in batches:
            for conv, turn, role, text, gone in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if opened and conv != conv_id:
                    if first or cut:  # the first one may have begun in the task before
                        yield block()
                    else:
                        ready.append(_whole(conv_id, turns, roles, texts))
                        turns, roles, texts, size = [], [], [], 0
                    first, cut = False, False
                    if len(ready) >= 1000:
                        yield reports()
                conv_id, opened = conv, True
                if not gone:
                    if turns and (len(turns) >= most_rows or size + len(text) > most_characters):
                        yield block()
                        cut = True
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    size += len(text) + len(role)
        if opened:  # the last one may go on in the next task
            yield block()
        yield reports()

    return ordered.select("conv_id", "turn", "role", "text", "gone").mapInArrow(run, fields)


def _matrix(turns: Sequence[Turn]) -> list[int]:
    """Least costs from each state in front of a block to each state behind it, row by row; insertions behind the block are not in it."""
    columns = []
    for to in range(4):
        vector = tuple(0 if s == to else NEVER for s in range(4))
        columns.append(backward(reversed(turns), vector))
    return [min(columns[to][s], NEVER) for s in range(4) for to in range(4)]


def _long(blocks: DataFrame) -> DataFrame:
    """Reports of conversations that lie in several blocks or at the edge of a task."""
    first = blocks.select("conv_id", F.struct("part", "block").alias("at"), F.explode(F.arrays_zip("firsts", "places")).alias("one"))
    first = first.groupBy("conv_id", F.col("one.firsts").alias("name")).agg(
        F.min(F.struct("at.part", "at.block", F.col("one.places").alias("place"))).alias("least"))
    fresh = first.groupBy(F.col("least.part").alias("part"), F.col("least.block").alias("block")).agg(F.collect_list("least.place").alias("fresh"))
    judged = stored(blocks.drop("firsts", "places").join(fresh, ["part", "block"], "left"), "conversation-blocks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = []
            for roles, texts, fresh in zip(*[batch.column(i).to_pylist() for i in (3, 4, 5)]):
                new = set(fresh or ())
                costs.append(_matrix(_judged(roles, texts, lambda at: at not in new)[0]))
            yield pa.RecordBatch.from_arrays([*batch.select([0, 1, 2]).columns, pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "part", "block", "costs"])

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, vector, begun = None, last_vector(), False
        for batch in batches:
            out = []
            for conv, costs in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if not begun or conv != conv_id:
                    conv_id, vector, begun = conv, last_vector(), True
                out.append(list(vector))
                # The vector behind a block has insertions in it; those in front come with the matrix.
                vector = tuple(min(costs[4 * s + to] + vector[to] for to in range(4)) for s in range(4))
            yield pa.RecordBatch.from_arrays([*batch.select([1, 2]).columns, pa.array(out, pa.list_(pa.int64()))], ["part", "block", "behind"])

    small = judged.select("conv_id", "part", "block", "roles", "texts", "fresh").mapInArrow(matrices, "conv_id long, part int, block long, costs array<long>")
    down = stored(small, "block-costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block"))
    vectors = stored(down.mapInArrow(behind, "part int, block long, behind array<long>"), "block-vectors")
    up = judged.join(vectors, ["part", "block"]).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, state, ready = None, START, []
        for batch in batches:
            for i in range(batch.num_rows):
                conv, numbers, roles, texts, fresh, after = [c[0].as_py() for c in batch.slice(i, 1).columns]
                new = set(fresh or ())
                turns, blanks = _judged(roles, texts, lambda at: at not in new)
                after = tuple(after)
                if report is None or conv != report.conv_id:
                    if report is not None:
                        report.add(*finish(state))
                        ready.append(report)
                        if len(ready) >= 1000:
                            yield _report_batch(ready, RESULT)
                            ready = []
                    report, state = Report(conv), START
                    report.cost = backward(reversed(turns), after)[START]
                for number, turn, blank in zip(numbers, turns, blanks):
                    report.count(number, turn, blank)
                edits, kept, state = walk(turns, state, after)
                report.add(edits, kept)
        if report is not None:
            report.add(*finish(state))
            ready.append(report)
        yield _report_batch(ready, RESULT)

    return up.select("conv_id", "turns", "roles", "texts", "fresh", "behind").mapInArrow(forward, f"conv_id long, {REPORT}")


def repaired(rows: DataFrame, most_rows: int = BLOCK_ROWS, most_characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """A report per conversation of ``rows(conv_id, turn, role, text, gone)``: faults, cost, edits and the digest of the repaired rows.

    Rows with ``gone`` only say that their conversation exists.
    """
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "gone",
                        F.monotonically_increasing_id().alias("__row"))
    both = F.concat("role", F.lit("\0"), "text")
    keyed = keyed.withColumns({"__head": F.substring(both, 1, HEAD), "__hash": F.xxhash64(both)})
    keys = ["conv_id", "turn", "__head", "__hash", "__row"]
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    both = stored(_blocks(ordered, most_rows, most_characters), "conversations")
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    pieces = both.where("part is not null").select("conv_id", "part", "block", "turns", "roles", "texts", "firsts", "places")
    return both.where("part is null").select(*names).unionByName(_long(pieces).select(*names))
