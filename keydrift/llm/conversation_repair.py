"""Repair of conversations by alignment to the strings of their grammar (operator 12).

Turns should read `(s?(ua)+)?` in role initials: a system turn perhaps, then user and assistant in alternation. A
block of turns is aligned to every string of the grammar whose length can still win: Wagner and Fischer's table of
edit costs, kept to Ukkonen's band, which the cheapest alignment found so far bounds. The table runs from the back,
so that the way through it from the front spells the least audit in ASCII order; audits of equal cost are compared.

A conversation streams through its task block by block. Between blocks stand at most four candidates, one for each
state of the grammar; a block's edits leave as soon as all candidates agree on them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keydrift.llm.common import mapped

#: Turns that are aligned together.
BLOCK = 64
#: Costs: a turn deleted, an empty turn inserted, a role changed, a truncated turn that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: States of the grammar: nothing yet, after a system, a user, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: What leads into a state, and what can follow it.
ENTERED = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
#: From any state the rest costs at most so much more than from any other (a system turn lost, a turn inserted).
APART = DELETE + INSERT
NEVER = 1 << 40
SPACE = " \t\n\x0b\x0c\r"


def expected(state: int) -> str:
    return "a" if state == USER else "u"


def strings(state: int, length: int) -> Iterator[tuple[str, int]]:
    """The strings of a length that can follow a state, and the state after each."""
    first = expected(state)
    alternating = (("ua" if first == "u" else "au") * (length // 2 + 1))[:length]
    yield alternating, ENTERED[alternating[-1]] if length else state
    if state == START and length:
        yield "s" + alternating[:-1], ENTERED[alternating[-2]] if length > 1 else SYSTEM


@dataclass
class Turn:
    turn: int | None
    role: str
    text: str
    fault: str | None

    @property
    def initial(self) -> str:
        return self.role[:1]

    @property
    def forced(self) -> bool:
        return self.fault in ("blank", "duplicate")

    @property
    def stays(self) -> int:
        """What it costs if it is not deleted."""
        return TRUNCATED * (self.fault == "truncated")


def fault(text: str, seen: bool) -> str | None:
    """The first fault of a turn; seen tells that its role and text came earlier."""
    said = text.rstrip(SPACE)
    return "blank" if not said else "duplicate" if seen else None if said[-1] in ".!?" else "truncated"


def align(turns: list[Turn], target: str, bound: int) -> tuple[int, str] | None:
    """The cheapest edits that give the turns these role initials, and the ASCII-least audit of them; None if they
    cost more than bound.

    Places in the target are counted from the number of turns before them that need not be deleted. Being d
    places off costs 2 * d at least, which is the band.
    """
    n, length = len(turns), len(target)
    free = [not t.forced for t in turns]
    least = sum(t.stays if f else DELETE for t, f in zip(turns, free, strict=True))
    shift = length - sum(free)
    spare = (bound - least) // 2 - abs(shift)
    if spare < 0:
        return None
    low, high = min(0, shift) - spare // 2, max(0, shift) + spare // 2
    place = sum(free)
    table: list[list[int]] = [[]] * (n + 1)
    after: list[int] = []
    for i in range(n, -1, -1):
        turn = turns[i] if i < n else None
        if turn is not None and free[i]:
            place -= 1
        row = [NEVER] * (high - low + 1)
        for q in range(min(high, length - place), max(low, -place) - 1, -1):
            j, at = place + q, q - low
            best = NEVER
            if turn is None:
                best = 0 if j == length else NEVER
            elif not free[i]:
                best = after[at] + DELETE
            else:
                if at:
                    best = after[at - 1] + DELETE
                if j < length and (turn.initial == target[j] or target[j] != "s"):
                    best = min(best, after[at] + turn.stays + (REROLE if turn.initial != target[j] else 0))
            if j < length and q < high and target[j] != "s":
                best = min(best, row[at + 1] + INSERT)
            row[at] = best
        table[i] = after = row
    if table[0][-low] > bound:
        return None
    audit, i, place, q = [], 0, 0, 0
    while i < n or place + q < length:
        cost, back = table[i][q - low], q - free[i] if i < n else q
        if i < n and back >= low and table[i + 1][back - low] + DELETE == cost:
            audit.append("D")
            i, place, q = i + 1, place + free[i], back
        elif place + q < length and q < high and target[place + q] != "s" and table[i][q + 1 - low] + INSERT == cost:
            audit.append("I")
            q += 1
        else:
            audit.append("K" if turns[i].initial == target[place + q] else "R")
            i, place = i + 1, place + 1
    return table[0][-low], "".join(audit)


def alignments(turns: list[Turn], state: int, exits: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """For each state that may follow the turns, the cheapest cost and its least audit from a state before them.

    Lengths are tried from the number of turns that may stay outwards, as long as their least cost can win;
    states that cost over APART more than another are left out, as no conversation is cheapest through them.
    """
    free = sum(not t.forced for t in turns)
    least = sum(DELETE if t.forced else t.stays for t in turns)
    most = least + DELETE * len(turns) + 4 * INSERT
    best: dict[int, tuple[int, str]] = {}
    away = 0
    while True:
        floor = least + INSERT * away
        open_bound = min((c for c, _ in best.values()), default=most) + APART
        if all(floor > min(best[x][0] if x in best else NEVER, open_bound) for x in exits):
            return best
        for length in sorted({free - away, free + away}):
            for target, after in strings(state, length) if length >= 0 else ():
                if after not in exits:
                    continue
                top = min(best[after][0] if after in best else NEVER, min((c for c, _ in best.values()), default=most) + APART)
                # Nothing known yet: widen the band until the alignment lies inside it.
                bound = top if best else min(top, floor + 4)
                found = align(turns, target, bound)
                while found is None and bound < top:
                    bound = min(top, 2 * bound + 4)
                    found = align(turns, target, bound)
                if found is not None and (after not in best or found < best[after]):
                    best[after] = found
        away += 1


@dataclass
class Block:
    """Turns in order, with what is counted over them."""

    turns: list[Turn] = field(default_factory=list)
    illegal: int = 0
    new_turns: int = 0


class Conversation:
    """Aligns the turns of one conversation as they come; blocks leave with their audits and costs."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.number, self.state = conv_id, 0, START
        self.block, self.last, self.last_turn = Block(), None, None
        #: Blocks whose edits are not settled, and per state the cost so far and the (state, cost, audit) of each of them.
        self.waiting: list[Block] = []
        self.candidates: dict[int, tuple[int, tuple]] = {START: (0, ())}

    def add(self, turn: Turn) -> list[dict]:
        out = self.aligned(tuple(range(4))) if len(self.block.turns) == BLOCK else []
        block = self.block
        block.turns.append(turn)
        block.illegal += self.last is not None and self.last + turn.initial not in ("su", "ua", "au")
        block.new_turns += turn.turn is not None and turn.turn != self.last_turn
        self.last, self.last_turn = turn.initial, turn.turn
        return out

    def aligned(self, exits: tuple[int, ...]) -> list[dict]:
        """Align the block that is complete, and return the rows of blocks that are settled by it."""
        block, self.block = self.block, Block()
        self.waiting.append(block)
        found: dict[int, tuple[int, tuple]] = {}
        for state, (spent, path) in self.candidates.items():
            for after, (cost, audit) in alignments(block.turns, state, exits).items():
                way = (spent + cost, (*path, (after, cost, audit)))
                if after not in found or _order(way) < _order(found[after]):
                    found[after] = way
        least = min(cost for cost, _ in found.values())
        self.candidates = {s: way for s, way in found.items() if way[0] <= least + APART}
        out = []
        while self.waiting and len({path[0] for _, path in self.candidates.values()}) == 1:
            out.append(self.settled(next(iter(self.candidates.values()))[1][0]))
            self.candidates = {s: (cost, path[1:]) for s, (cost, path) in self.candidates.items()}
        return out

    def end(self) -> list[dict]:
        out = self.aligned(ENDS)
        cost, path = min((way for s, way in self.candidates.items() if s in ENDS), key=_order)
        return out + [self.settled(step) for step in path]

    def settled(self, step: tuple[int, int, str]) -> dict:
        """The row of the first waiting block: its edits in order, and what is counted over its turns."""
        block = self.waiting.pop(0)
        after, cost, audit = step
        state, at, edits = self.state, 0, []
        for letter in audit:
            turn = None
            if letter != "I":
                turn, at = block.turns[at], at + 1
            edit = {"edit": letter, "turn": turn and turn.turn, "fault": turn and turn.fault, "role": turn and turn.role, "text": turn.text if turn else ""}
            if letter in "IR":
                edit["role"] = ROLES[expected(state)]
            if letter != "D":
                state = ENTERED[edit["role"][:1]]
            edits.append(edit)
        self.state = after
        numbers = [t.turn for t in block.turns if t.turn is not None]
        faults = [t.fault for t in block.turns]
        row = {
            "conv_id": self.conv_id, "block": self.number, "edits": edits, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"),
            "truncated": faults.count("truncated"), "illegal": block.illegal, "cost": cost, "first_turn": min(numbers, default=None),
            "last_turn": max(numbers, default=None), "new_turns": block.new_turns,
        }
        self.number += 1
        return row


def _order(way: tuple[int, tuple]) -> tuple[int, str]:
    return way[0], "".join(audit for _, _, audit in way[1])


EDIT = pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("fault", pa.string()), ("role", pa.string()), ("text", pa.string())])
COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
BLOCKS = pa.schema(
    [("conv_id", pa.int64()), ("block", pa.int64()), ("edits", pa.list_(EDIT)), *((n, pa.int64()) for n in (*COUNTS, "first_turn", "last_turn", "new_turns"))]
)
BLOCKS_SCHEMA = "conv_id long, block long, edits array<struct<edit string, turn long, fault string, role string, text string>>, " + ", ".join(
    f"{n} long" for n in (*COUNTS, "first_turn", "last_turn", "new_turns")
)
SUMMARY = pa.schema([(n, pa.int64()) for n in ("conv_id", "gaps", *COUNTS)] + [("audit", pa.string()), ("repaired_sha256", pa.string()), ("n_turns", pa.int64())])
SUMMARY_SCHEMA = "conv_id long, gaps long, " + ", ".join(f"{n} long" for n in COUNTS) + ", audit string, repaired_sha256 string, n_turns long"
#: Characters of text and rows that leave a task together.
OUT_CHARS, OUT_ROWS = 1_000_000, 500


def _batches(rows: Iterator[dict], schema: pa.Schema, size=lambda row: 0) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += size(row)
        if len(held) >= OUT_ROWS or chars >= OUT_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def repaired(turns: DataFrame, lost: Column | None = None) -> DataFrame:
    """The edits of every conversation in blocks of turns, in order within the conversation: conv_id, block, edits
    (edit D, I, K or R, turn, fault, role, text), and over the block's turns blank, duplicate, truncated, illegal,
    cost, first_turn, last_turn, new_turns.

    turns has conv_id, turn, role, text; other columns are not read. Rows for which lost is true are no turns but
    name a conversation; one without turns has a block without edits. A null role or text counts as one space, null
    turns come first, rows of one turn are taken by role and text; repeated rows are duplicates of the first.
    Rows without conv_id make one conversation. Role and text of a deleted turn are the original ones.

    One shuffle by conversation, in which equal rows are found as well. The rows of a conversation are sorted on
    disk and stream through one task (its digest is a sequence of all its texts), which holds a block of them and
    the few blocks that are not settled, however long it is.
    """
    space = F.lit(" ")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"), F.coalesce(F.lit(False) if lost is None else lost, F.lit(False)).alias("lost"),
    )
    same = Window.partitionBy("conv_id", "role", "text", "lost").orderBy("turn")
    rows = rows.repartition("conv_id").withColumn("seen", F.row_number().over(same) > 1)
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text", "seen")

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now: Conversation | None = None
        for batch in batches:
            for conv_id, turn, role, text, lost, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield from now.end()
                    now = Conversation(conv_id)
                if not lost:
                    yield from now.add(Turn(turn, role, text, fault(text, seen)))
        if now is not None:
            yield from now.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(edited(batches), BLOCKS, lambda row: sum(len(e["text"]) for e in row["edits"]))

    return mapped(rows, run, BLOCKS_SCHEMA)


def summaries(blocks: DataFrame) -> DataFrame:
    """One row per conversation from its blocks as repaired returns them: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256 (of `role:text` of the turns that remain, joined by newlines), n_turns.

    gaps is the number of turn numbers missing between the first and the last one, 0 without numbers. Blocks
    stream in the order in which the task before left them, so nothing is shuffled and the digest grows by blocks.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        row, digest, audits, numbers, new = None, None, [], [], 0

        def ended() -> dict:
            gaps = numbers[1] - numbers[0] + 1 - new if numbers else 0
            return row | {"gaps": gaps, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            for block in batch.to_pylist():
                if block["block"] == 0:
                    if row is not None:
                        yield ended()
                    row = {"conv_id": block["conv_id"], "n_turns": 0} | dict.fromkeys(COUNTS, 0)
                    digest, audits, numbers, new = hashlib.sha256(), [], [], 0
                for name in COUNTS:
                    row[name] += block[name]
                audits.append("".join(e["edit"] for e in block["edits"]))
                for edit in block["edits"]:
                    if edit["edit"] != "D":
                        digest.update((("\n" if row["n_turns"] else "") + edit["role"] + ":" + edit["text"]).encode())
                        row["n_turns"] += 1
                ends = [x for x in (block["first_turn"], block["last_turn"]) if x is not None]
                numbers = [min(numbers + ends), max(numbers + ends)] if numbers + ends else []
                new += block["new_turns"]
        if row is not None:
            yield ended()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(told(batches), SUMMARY)

    return mapped(blocks, run, SUMMARY_SCHEMA)
