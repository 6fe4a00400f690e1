"""Secret scan by one deterministic automaton for all rules.

The rules are regular expressions over bytes. Their reversed forms are joined
into one automaton by subset construction, minimised, and laid out as a flat
transition array over byte classes. One pass from the last byte to the first
then names every position where some rule's match *starts*. The leftmost start
at or after the end of the rule's last match is a match; its longest end comes
from the rule's own (small, forward) automaton, run over the match alone.

Offsets are code points, ends exclusive. Matches of one rule never overlap;
matches of different rules may. A match that fails its rule's length test is
dropped, yet uses up its characters.

Cases: null and empty texts have no spans; a null id stays null; repeated rows
give repeated results; texts are scanned whole, in memory bounded by the text
itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANY = frozenset(range(256))


@dataclass(frozen=True)
class SecretRule:
    """``pattern``: literals, [sets], (groups), ``|``, ``? * + {m} {m,} {m,n}``.

    Where a minimum length is a test after the match (``head``, ``least``) it costs
    no states; counting inside the joint automaton multiplies them.
    """

    name: str
    pattern: str
    base: bool = False
    head: str | None = None  # if given, what follows this start of the match must have ``least`` characters
    least: int = 0


#: The three base kinds first, then the added ones; this is also the order of ties.
RULES = (
    SecretRule(
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
        r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=\-]+",
        True,
        r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?""",
        12,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", True, "AKIA", 14),
    SecretRule("hex", r"[0-9a-f]{16,}", True),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]+", False, "gh[pousr]_", 20),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", False, "xox[abprs]-", 10),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# --- expression to tree -----------------------------------------------------------------------------------------------


def parse(pattern: str):
    """The tree of an expression: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most)."""
    at = 0

    def peek() -> str:
        return pattern[at : at + 1]

    def escaped() -> int:
        nonlocal at
        at += 1
        if pattern[at] == "x":
            code = int(pattern[at + 1 : at + 3], 16)
            at += 3
            return code
        at += 1
        return ord(pattern[at - 1])

    def literal() -> int:
        nonlocal at
        if peek() == "\\":
            return escaped()
        code = ord(pattern[at])
        if code > 127:
            raise ValueError("rules are written in ASCII")
        at += 1
        return code

    def one_set():
        nonlocal at
        at += 1
        negated = peek() == "^"
        at += negated
        found = set()
        while peek() != "]":
            low = literal()
            if peek() == "-" and pattern[at + 1] != "]":
                at += 1
                found.update(range(low, literal() + 1))
            else:
                found.add(low)
        at += 1
        return ("set", ANY - found if negated else frozenset(found))

    def atom():
        nonlocal at
        if peek() == "(":
            at += 1
            inside = either()
            at += 1
            return inside
        return one_set() if peek() == "[" else ("set", frozenset([literal()]))

    def repeated():
        nonlocal at
        part = atom()
        while peek() and peek() in "?*+{":
            sign = peek()
            if sign == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at + 1 : end].partition(",")
                least, most = int(low), int(high) if high else None if comma else int(low)
                at = end + 1
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
                at += 1
            part = ("rep", part, least, most)
        return part

    def sequence():
        parts = []
        while peek() and peek() not in "|)":
            parts.append(repeated())
        return ("cat", parts)

    def either():
        nonlocal at
        parts = [sequence()]
        while peek() == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    tree = either()
    if at != len(pattern):
        raise ValueError(f"unbalanced expression: {pattern}")
    return tree


def reverse(tree):
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    parts = [reverse(t) for t in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


# --- tree to automaton ------------------------------------------------------------------------------------------------


class Threads:
    """Nondeterministic automaton: ``free`` steps without a byte, ``steps`` with one."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.steps: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.steps.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Builds ``tree`` after ``start`` and returns the state where it ends."""
        kind = tree[0]
        if kind == "set":
            here, end = self.state(), self.state()
            self.free[start].append(here)
            self.steps[here] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "alt":
            for part in tree[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(part, start)
        self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.free[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``table[state + class]`` is the next state (already times the class count); states from ``hot`` on accept."""

    classes: bytes
    table: array
    start: int
    hot: int
    accepts: dict[int, tuple[int, ...]]
    states: int
    dead: int


def byte_classes(sets) -> tuple[bytes, list[int]]:
    """Bytes that no set tells apart share a class."""
    keys: dict[tuple, int] = {}
    table, samples = bytearray(256), []
    sets = list(sets)
    for b in range(256):
        key = tuple(b in s for s in sets)
        if key not in keys:
            keys[key] = len(keys)
            samples.append(b)
        table[b] = keys[key]
    return bytes(table), samples


def minimise(moves: list[list[int]], accepts: list[tuple[int, ...]]) -> list[int]:
    """The block of each state after partition refinement."""
    names: dict = {}
    block = [names.setdefault(a, len(names)) for a in accepts]
    while True:
        names = {}
        finer = [names.setdefault((block[s], *[block[t] for t in row]), len(names)) for s, row in enumerate(moves)]
        if len(names) == len(set(block)):
            return block
        block = finer


def build(trees, anywhere: bool) -> Automaton:
    """Subset construction over all trees at once; ``anywhere`` lets a match begin at every byte."""
    threads = Threads()
    root = threads.state()
    ends = {}
    for k, tree in enumerate(trees):
        ends[threads.add(tree, root)] = k
    classes, samples = byte_classes({s[0] for s in threads.steps if s})
    first = threads.closure([root])
    index, moves, accepts, todo = {first: 0}, [], [], [first]
    for states in todo:
        accepts.append(tuple(sorted(ends[s] for s in states if s in ends)))
        row = []
        for b in samples:
            to = [threads.steps[s][1] for s in states if threads.steps[s] and b in threads.steps[s][0]]
            nxt = threads.closure([*to, root] if anywhere else to)
            if nxt not in index:
                index[nxt] = len(index)
                todo.append(nxt)
            row.append(index[nxt])
        moves.append(row)
    block = minimise(moves, accepts)
    one_of = {b: s for s, b in reversed(list(enumerate(block)))}
    order = sorted(one_of, key=lambda b: (bool(accepts[one_of[b]]), b))
    width = len(samples)
    place = {b: i * width for i, b in enumerate(order)}
    table = array("i", (place[block[t]] for b in order for t in moves[one_of[b]]))
    quiet = sum(not accepts[one_of[b]] for b in order)
    stuck = [place[b] for b in order if not accepts[one_of[b]] and all(block[t] == b for t in moves[one_of[b]])]
    return Automaton(
        classes, table, place[block[0]], quiet * width, {place[b]: accepts[one_of[b]] for b in order[quiet:]}, len(order), stuck[0] if stuck else -1
    )


@lru_cache(maxsize=8)
def compiled(rules: tuple[SecretRule, ...]) -> tuple[Automaton, tuple[Automaton, ...]]:
    """The joint reversed automaton and each rule's forward one. Compiled once per process."""
    trees = [parse(r.pattern) for r in rules]
    return build([reverse(t) for t in trees], True), tuple(build([t], False) for t in trees)


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)

# --- scan -------------------------------------------------------------------------------------------------------------


def starts(data: bytes, joint: Automaton) -> dict[int, list[int]]:
    """For each rule, the byte positions where a match starts, from right to left."""
    table, state, hot, accepts = joint.table, joint.start, joint.hot, joint.accepts
    found: dict[int, list[int]] = {}
    last = len(data) - 1
    for i, c in enumerate(data.translate(joint.classes)[::-1]):
        state = table[state + c]
        if state >= hot:
            for rule in accepts[state]:
                found.setdefault(rule, []).append(last - i)
    return found


def longest_end(data: bytes, at: int, one: Automaton) -> int:
    table, state, hot, classes, dead = one.table, one.start, one.hot, one.classes, one.dead
    end = -1
    for i in range(at, len(data)):
        state = table[state + classes[data[i]]]
        if state >= hot:
            end = i + 1
        elif state == dead:
            break
    return end


def find_spans(text: str | None, rules: tuple[SecretRule, ...] = RULES, automata=None) -> list[tuple[int, int, int]]:
    """(start, rule number, end) of every match of a text, in code points, sorted."""
    if not text:
        return []
    joint, own = automata or compiled(rules)
    data = text.encode("utf-8", "surrogatepass")
    spans = []
    for k, places in starts(data, joint).items():
        rule, cursor = rules[k], 0
        for at in reversed(places):
            if at < cursor:
                continue
            cursor = longest_end(data, at, own[k])
            if rule.head:
                matched = data[at:cursor].decode("ascii")
                if cursor - at - re.match(rule.head, matched).end() < rule.least:
                    continue
            spans.append((at, k, cursor))
    if spans and len(data) != len(text):
        places = sorted({p for s, _, e in spans for p in (s, e)})
        at = chars = 0
        where = {}
        for p in places:
            chars += len(data[at:p].decode("utf-8", "surrogatepass"))
            at, where[p] = p, chars
        spans = [(where[s], k, where[e]) for s, k, e in spans]
    return sorted(spans)


def scan(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (kind, start, end) in order."""
    names = [r.name for r in rules]
    automata = compiled(rules)

    @F.pandas_udf(SPANS)
    def found(texts):
        return texts.map(lambda t: [{"kind": names[k], "start": s, "end": e} for s, k, e in find_spans(t, rules, automata)])

    return docs.select(docs[id].alias("doc_id"), found(docs[text]).alias("spans"))
