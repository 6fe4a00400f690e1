"""Cheapest repair of conversations into (system? (user assistant)+)?, streamed in turn order.

Rows are repartitioned by conversation and sorted by turn inside each partition;
``mapInPandas`` then reads one conversation after the other and carries its
dynamic program across Arrow batches. The program has four states (nothing yet,
after system, after user, after assistant). Per row it keeps the cheapest cost of
each state, an order of the four cheapest edit strings, and one packed number of
backpointers: for each state the state before and the step taken. A step is up
to two insertions and then a deletion, keep or new role for the row. Costs enter
relative to the smallest and few combinations occur, so steps are memoised.

Edit strings that end with a row's own letter are never prefixes of each other,
so ordering the strings of the row before and then the steps orders the strings:
ties go to the ASCII-least string without holding any.

Rows, backpointers and decisions of the conversation at hand are kept in spools.
A spool holds a bounded number of bytes in memory and moves to a file in the
cluster's shared folder beyond that; the file goes when the conversation ends.
So a task's memory does not grow with a conversation, only its time does: one
conversation is one task's work, by the method.

Earlier copies of a row (same role and text) are counted by a window over
(conversation, role, text) that reuses the partitioning by conversation; Spark
spills it, nothing is gathered.

Output: the edit script, in order. ``conv, place, turn, fault, was, edit, role,
text, cost``. ``edit`` is D(elete), I(nsert), K(eep) or R(erole); ``was`` is the
row's role before (null for an insertion), ``role`` and ``text`` are null for
deletions, ``text`` is empty for insertions.

Cases: nulls in role and text count as one space; a null turn comes first; rows
without a conversation id are one conversation. Rows of one turn are ordered by
role and text, so repeated rows are neighbours. A role is known by its first
letter; one that begins with none of s, u and a cannot be kept. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import files
from ledgerloom.llm.common import narrow
from ledgerloom.session import new_path

_INSERT, _DELETE, _REROLE, _CUT = 5, 2, 1, 5
_FRAME = 1 << 22  # bytes of a frame that goes back to Spark, about
_FAR = 1 << 30
_USER, _ASSISTANT = 2, 3  # states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
#: The role that must follow each state if it is not a system turn.
_NEXT = {0: _USER, 1: _USER, 2: _ASSISTANT, 3: _USER}
#: Letters of a step, in ASCII order of the strings.
STEPS = sorted(i * "I" + x for i in range(3) for x in "DKR")
SCRIPT = "place long, turn long, fault string, was string, edit string, role string, text string, cost long"
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def _moves(initial: str, fault: str | None) -> list[tuple[int, int, int, int]]:
    """(state before, step, state after, cost) of all steps over a row."""
    out = []
    for before in range(4):
        state, paid = before, 0
        for inserted in range(3):
            step = lambda letter: STEPS.index(inserted * "I" + letter)  # noqa: B023, E731
            out.append((before, step("D"), state, paid + _DELETE))
            if fault not in ("blank", "duplicate"):
                extra = paid + (_CUT if fault == "truncated" else 0)
                out.append((before, step("R"), _NEXT[state], extra + _REROLE))
                kept = {"u": _USER, "a": _ASSISTANT}.get(initial)
                if kept == _NEXT[state]:
                    out.append((before, step("K"), kept, extra))
                elif initial == "s" and state == 0:
                    out.append((before, step("K"), 1, extra))
            state, paid = _NEXT[state], paid + _INSERT
    return out


class Program:
    """The forward half: costs (relative to the least) and order of the strings; state 0 first with cost 0."""

    START = ((0, _FAR, _FAR, _FAR), (0, 0, 0, 0))

    def __init__(self):
        self.known: dict = {}
        self.moves: dict = {}

    def step(self, at: tuple, initial: str, fault: str | None) -> tuple[tuple, int]:
        """What holds after a row, and its backpointers: per state 6 bits, step * 4 + state before."""
        key = (at, initial, fault)
        if key not in self.known:
            self.known[key] = self._step(*key)
        return self.known[key]

    def _step(self, at: tuple, initial: str, fault: str | None) -> tuple[tuple, int]:
        costs, ranks = at
        kind = (initial, fault)
        if kind not in self.moves:
            self.moves[kind] = _moves(initial, fault)
        best: list = [(_FAR,)] * 4
        for before, step, after, paid in self.moves[kind]:
            if costs[before] < _FAR:
                best[after] = min(best[after], (costs[before] + paid, ranks[before], step, before))
        least = min(b[0] for b in best)
        order = sorted((b[1:3], s) for s, b in enumerate(best) if b[0] < _FAR)
        rank = {s: i for i, (_, s) in enumerate(order)}
        packed = sum((b[2] * 4 + b[3]) << (6 * s) for s, b in enumerate(best) if b[0] < _FAR)
        return (tuple(b[0] - least if b[0] < _FAR else _FAR for b in best), tuple(rank.get(s, 0) for s in range(4))), packed

    @staticmethod
    def end(at: tuple) -> tuple[int, int]:
        """The state to end from and how many insertions close it."""
        costs, ranks = at
        closing = {0: 0, 1: 2, 2: 1, 3: 0}
        _, _, state = min((costs[s] + _INSERT * closing[s], ranks[s], s) for s in range(4) if costs[s] < _FAR)
        return state, closing[state]


class Spool:
    """Pieces of bytes in order, in memory up to ``most`` bytes, then in a file of the shared folder."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most
        self.parts: list = []
        self.held, self.file, self.source = 0, None, None

    def add(self, data: bytes) -> None:
        if self.held + len(data) > self.most:
            if self.file is None:
                files.make_folder(self.folder)
                self.file = files.Output(self.folder, "spool", "bin")
            self.parts.append((self.file.write(data), len(data)))
        else:
            self.parts.append(data)
            self.held += len(data)

    def __len__(self) -> int:
        return len(self.parts)

    def get(self, i: int) -> bytes:
        """Only after the last ``add``."""
        part = self.parts[i]
        if isinstance(part, bytes):
            return part
        if self.source is None:
            self.file.close()
            self.source = files.open_input(self.file.uri)
        return self.source.read_at(part[1], part[0])

    def close(self) -> None:
        if self.file is not None:
            if self.source is None:
                self.file.close()
            else:
                self.source.close()
            files.remove(self.file.uri)


class _Conversation:
    """One conversation at a time: rows go in, the edit script comes out in bounded frames."""

    def __init__(self, program: Program, folder: str, most: int, chunk: int):
        self.program, self.chunk = program, chunk
        self.rows, self.back, self.steps = (Spool(folder, most) for _ in range(3))
        self.at, self.links, self.buffer = Program.START, array("I"), []

    def add(self, turn, was: str, text: str, fault: str | None) -> None:
        self.at, packed = self.program.step(self.at, was[:1], fault)
        self.links.append(packed)
        self.buffer.append((turn, was, text, fault))
        if len(self.links) == self.chunk or sum(map(len, self.buffer[-1][1:3])) > 1 << 20:
            self._flush()

    def _flush(self) -> None:
        if self.buffer:
            self.back.add(self.links.tobytes())
            self.rows.add(pickle.dumps(self.buffer))
            self.links, self.buffer = array("I"), []

    def script(self) -> Iterator[list[tuple]]:
        self._flush()
        state, closing = Program.end(self.at)
        for i in range(len(self.back) - 1, -1, -1):  # from the last chunk to the first
            links, steps = array("I", self.back.get(i)), bytearray()
            for packed in reversed(links):
                here = packed >> (6 * state) & 63
                steps.append(here >> 2)
                state = here & 3
            steps.reverse()
            self.steps.add(bytes(steps))
        place, state, out = 0, 0, []

        def insert() -> tuple:
            nonlocal state, place
            state, place = _NEXT[state], place + 1
            return (place - 1, None, None, None, "I", "user" if state == _USER else "assistant", "", _INSERT)

        last = len(self.steps) - 1
        for i in range(last + 1):
            for (turn, was, text, fault), step in zip(pickle.loads(self.rows.get(i)), self.steps.get(last - i)):
                letters = STEPS[step]
                out += [insert() for _ in letters[:-1]]
                edit, paid = letters[-1], _CUT if fault == "truncated" else 0
                if edit == "D":
                    out.append((place, turn, fault, was, edit, None, None, _DELETE))
                else:
                    state = 1 if edit == "K" and was[:1] == "s" else _NEXT[state]
                    role = was if edit == "K" else "user" if state == _USER else "assistant"
                    out.append((place, turn, fault, was, edit, role, text, paid + (_REROLE if edit == "R" else 0)))
                place += 1
            yield out
            out = []
        yield [insert() for _ in range(closing)]

    def close(self) -> None:
        for spool in (self.rows, self.back, self.steps):
            spool.close()


def damaged(table: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with known faults, by crc32("conv_id:turn") modulo 20; nulls count as one space.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 sets its role to user.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = table.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("f"))
    f = F.col("f")
    return rows.filter(f != 0).select(
        "conv_id", "turn",
        F.when(f == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(f == 1, "").when(f == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(f == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


#: Of a conversation that has no rows.
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def repair(table: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", held_bytes: int = 8 << 20, chunk: int = 4096) -> DataFrame:
    """The edit script of every conversation; partitions hold whole conversations, in order of ``conv`` and ``place``."""
    rows = narrow(table, conv=id, turn=turn, role=role, text=text)
    kind = rows.schema["conv"].dataType.simpleString()
    space = F.lit(" ")
    rows = rows.select("conv", F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    copies = Window.partitionBy("conv", "role", "text").orderBy("turn")
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    fault = (
        F.when(blank, "blank")
        .when(F.col("copy") > 1, "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), "truncated")
    )
    ordered = (
        rows.repartition("conv").withColumn("copy", F.row_number().over(copies)).withColumn("fault", fault)
        .sortWithinPartitions("conv", "turn", "role", "text", "copy").select("conv", "turn", "role", "text", "fault")
    )
    folder = new_path(table.sparkSession, "turn-spools")
    names = ["conv", *[f.split()[0] for f in SCRIPT.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program, held, size = Program(), [], 0
        open_, conv = None, None

        def finish() -> Iterator[pd.DataFrame]:
            nonlocal held, size
            for script in open_.script():
                held += [(conv, *row) for row in script]
                size += sum(64 + len(row[6] or "") for row in script)
                if size >= _FRAME:
                    yield pd.DataFrame(held, columns=names, dtype=object)
                    held, size = [], 0
            open_.close()

        for batch in batches:
            columns = [batch[c].where(batch[c].notna(), None).tolist() for c in ("conv", "turn", "role", "text", "fault")]
            for c, at, was, words, wrong in zip(*columns):
                if open_ is None or c != conv:
                    if open_ is not None:
                        yield from finish()
                    conv, open_ = c, _Conversation(program, folder, held_bytes, chunk)
                open_.add(None if at is None else int(at), was, words, wrong)
        if open_ is not None:
            yield from finish()
        if held:
            yield pd.DataFrame(held, columns=names, dtype=object)

    texts = ordered.select(F.col("conv").cast("string"), F.col("turn").cast("string"), "role", "text", "fault")  # nulls stay exact in pandas
    return texts.mapInPandas(run, f"conv string, {SCRIPT}").withColumn("conv", F.col("conv").cast(kind))


def digests(script: DataFrame) -> DataFrame:
    """One row per conversation of a script, read in its order: faults, cost, audit string and hash of the repaired turns."""
    kind = script.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, done = None, []
        for batch in batches:
            columns = [batch[c].where(batch[c].notna(), None).tolist() for c in ("conv", "turn", "fault", "was", "edit", "role", "text", "cost")]
            for conv, *row in zip(*columns):
                if open_ is None or conv != open_.conv:
                    if open_ is not None:
                        done.append(open_.row())
                    open_ = _Digest(conv)
                open_.add(*row)
            if done:
                yield pd.DataFrame(done, columns=_DIGEST_NAMES, dtype=object)
                done = []
        if open_ is not None:
            yield pd.DataFrame([open_.row()], columns=_DIGEST_NAMES, dtype=object)

    ordered = script.select(F.col("conv").cast("string"), F.col("turn").cast("string"), "fault", "was", "edit", "role", "text", "cost")
    return ordered.mapInPandas(run, f"conv string, {_DIGEST}").withColumn("conv", F.col("conv").cast(kind))


_DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_DIGEST_NAMES = ["conv", *[f.split()[0] for f in _DIGEST.split(", ")]]


class _Digest:
    def __init__(self, conv):
        self.conv = conv
        self.first, self.last, self.turns = None, None, 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.cost, self.audit, self.before = 0, 0, [], None
        self.hash, self.any = hashlib.sha256(), False

    def add(self, turn, fault, was, edit, role, text, cost) -> None:
        if was is not None:
            if turn is not None:
                turn = int(turn)
                if self.first is None:
                    self.first = turn
                self.turns += turn != self.last
                self.last = turn
            if fault:
                self.faults[fault] += 1
            if self.before is not None:
                self.illegal += self.before + was[:1] not in ("su", "ua", "au")
            self.before = was[:1]
        self.cost += int(cost)
        self.audit.append(edit)
        if role is not None:
            self.hash.update(("\n" * self.any + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.any = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())
