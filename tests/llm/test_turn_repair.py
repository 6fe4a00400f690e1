"""Repaired conversations against a plain search over all edits of each."""

import hashlib
import random
import re
import zlib
from functools import cache
from pathlib import Path

import brute
import duckdb
import pytest

from ledgerloom.llm import turn_repair
from ledgerloom.llm.queries import QUERIES
from ledgerloom.session import shared_folder

WORDY = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "Edit string, conv_id long, turn long, role string, text string, fault int"


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role.encode(), text.encode())


def plain(rows):
    """Of one conversation's (turn, role, text): what the contract asks for."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=order)
    faults, seen = [], set()
    for _, role, text in rows:
        marks = WORDY.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else None if marks[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @cache
    def best(i, state, inserted):
        """(cost, audit, turns) from row i on; state: role letters so far, shortened."""
        out = []
        if i == len(rows) and state in ("", "ua"):
            out.append((0, "", ()))
        follows = {"": "u", "s": "u", "u": "a", "ua": "u"}[state]
        after = {"u": "u", "a": "ua"}[follows]
        role = {"u": "user", "a": "assistant"}[follows]

        def add(cost, letter, turn, rest):
            if rest:
                out.append((cost + rest[0], letter + rest[1], (turn, *rest[2]) if turn else rest[2]))

        if inserted < 3:
            add(5, "I", (role, ""), best(i, after, inserted + 1))
        if i < len(rows):
            _, was, text = rows[i]
            add(2, "D", None, best(i + 1, state, 0))
            if faults[i] in (None, "truncated"):
                extra = 5 * (faults[i] == "truncated")
                add(1 + extra, "R", (role, text), best(i + 1, after, 0))
                if was[:1] == follows:
                    add(extra, "K", (was, text), best(i + 1, after, 0))
                if was[:1] == "s" and state == "":
                    add(extra, "K", (was, text), best(i + 1, "s", 0))
        return min(out, key=lambda o: o[:2]) if out else None

    cost, audit, turns = best(0, "", 0)
    known = [t for t, _, _ in rows if t is not None]
    letters = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in turns).encode()).hexdigest(),
    }


def damage(rows):
    """(conv_id, turn, role, text) after the faults."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        f = zlib.crc32(key.encode()) % 20
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def run(spark, rows, **options):
    table = spark.createDataFrame([("x", *r, 1) for r in rows], SCHEMA)
    return {r["conv"]: r.asDict() for r in turn_repair.digests(turn_repair.repair(table.repartition(3), **options)).collect()}


def check(got, rows):
    want = {conv: {"conv": conv, **plain(part)} for conv, part in by_conversation(rows).items()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "User", "uncle", "", " ", None, "tool"]
    texts = ["a.", "b!", "c", "d? ", " ", "", None, "e.\n", " ", "f…", "a."]
    rows = []
    for conv in range(150):
        for _ in range(rng.randrange(1, 9)):
            turn = rng.choice([None, *range(-2, 6)])
            rows.append((conv, turn, rng.choices(roles, [9, 9, 4, 1, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(99)}."))
    rows += [(None, 1, "user", "q."), (None, 0, "assistant", "a."), (-1, 2**60 + 1, "user", "q."), (-1, None, "user", "q.")]
    check(run(spark, rows), rows)


def test_spools(spark):
    """A long conversation leaves memory and leaves no file behind."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["x" * 50, "long text. " * 3, f"t{t}."])) for t in range(800)]
    rows += [(2, t, "user", f"t{t}.") for t in range(5)]
    import sys

    sys.setrecursionlimit(20_000)
    check(run(spark, rows, held_bytes=100, chunk=7), rows)
    folder = Path(shared_folder(spark).removeprefix("file://"))
    assert any(folder.glob("turn-spools-*"))
    assert not list(folder.glob("turn-spools-*/*"))


def test_script(spark):
    """The edits themselves: kept, retitled, deleted and inserted turns in order."""
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "b."), (1, 3, "user", " "), (1, 4, "user", "c"), (2, 0, "user", "only.")]
    table = spark.createDataFrame([("x", *r, 1) for r in rows], SCHEMA)
    got = turn_repair.repair(table).orderBy("conv", "place").collect()
    assert [(r["edit"], r["was"], r["role"], r["text"], r["cost"]) for r in got if r["conv"] == 1] == [
        ("K", "system", "system", "s.", 0), ("R", "assistant", "user", "a.", 1), ("K", "assistant", "assistant", "b.", 0),
        ("D", "user", None, None, 2), ("D", "user", None, None, 2),
    ]
    assert [r["edit"] for r in got if r["conv"] == 2] == ["D"]


def test_empty(spark):
    assert run(spark, []) == {}


def test_op12(spark, sf):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    rest = by_conversation(damage(rows))
    want = {conv: {"conv_id": conv, **plain(rest.get(conv, []))} for conv, *_ in rows}
    (name,) = [n for n in QUERIES if n.startswith("op12_")]
    assert {r["conv_id"]: dict(r) for r in brute.rows_of(QUERIES[name](spark, sf))} == want


def test_damage_with_nulls(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(40)) for r, x in (("user", "Hi. There!"), (None, None))]
    table = spark.createDataFrame([("x", *r, 1) for r in rows], SCHEMA)
    got = [tuple(r) for r in turn_repair.damaged(table).collect()]
    assert sorted(got, key=str) == sorted(damage(rows), key=str)
