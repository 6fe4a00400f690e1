"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one failure bit per rule; policies (versions of "which rules reject") and
ablations are bit operations on the stored ledger and never read a text again.

Cases: a null or empty text has no words and fails ``min_words``. A null id stays
null. Repeated rows are judged each on its own, alike. Texts of any length are
read whole. An empty table gives an empty ledger. Other columns of the documents
are never touched, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import WORD, fresh

SYMBOLS = re.compile(r"[#*$%&|<>]")
MEASURES = tuple("n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper_words n_letter_words".split())


@dataclass(frozen=True)
class Rule:
    """A rule owns one bit for good; ``fails`` is SQL over the measurements."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "min_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "upper_case_words", "2 * n_upper_words > n_words"),
    Rule(5, "word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule(6, "few_letter_words", "2 * n_letter_words < n_words"),
)
BASE = ("min_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version rejects a document that fails any rule of ``rejects``."""

    version: str
    rejects: tuple[str, ...]


POLICIES = (
    Policy("base", BASE),
    Policy("v1", (*BASE, "symbols", "duplicate_lines")),
    Policy("v2", tuple(r.name for r in RULES)),
)


def mask(names, rules=RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return reduce(lambda m, n: m | bits[n], names, 0)


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            covered = 0  # end of the words already counted
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        n,
        sum(map(len, words)),
        len(SYMBOLS.findall(text)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(1 for w in words if len(w) > 1 and w.isupper()),
        sum(1 for w in words if w.isalpha() or any(map(str.isalpha, w))),
    )


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in texts], columns=MEASURES)


def failure_bits(rules=RULES, of: str = "") -> Column:
    """The failure bits from measurements; ``of`` names the struct that holds them, if any."""
    field = re.compile(r"\b(n_\w+|word_chars)\b")
    bits = [F.when(F.expr(field.sub(rf"{of}\1", r.fails)), F.lit(1 << r.bit)).otherwise(0) for r in rules]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0)).cast("long")


def ledger(docs: DataFrame, rules=RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: its id, all measurements, and ``bits``."""
    rows = docs.select(docs[id].alias("doc_id"), measured(docs[text]).alias("m"))
    return rows.select("doc_id", "m.*").withColumn("bits", failure_bits(rules))


def passes(bits: Column, policy: Policy, rules=RULES) -> Column:
    return bits.bitwiseAND(F.lit(mask(policy.rejects, rules))) == 0


def apply_policies(book: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """Adds ``kept_<version>`` for each policy to a stored ledger."""
    return book.select("*", *[passes(F.col("bits"), p, rules).alias(f"kept_{p.version}") for p in policies])


def ablations(book: DataFrame, policies=POLICIES, rules=RULES) -> DataFrame:
    """What each rule does inside each policy.

    The ledger shrinks to one row per bit pattern first, at most 2 to the number
    of rules. ``failed``: documents that fail the rule; ``only``: those that no
    other rule of the policy rejects, so they come back if the rule goes;
    ``rejected``: all that the policy rejects.
    """
    patterns = book.groupBy("bits").agg(F.count("*").alias("docs"))
    frames = []
    for p in policies:
        whole = mask(p.rejects, rules)
        hit = F.col("bits").bitwiseAND(F.lit(whole))
        for r in (r for r in rules if r.name in p.rejects):
            one = F.lit(1 << r.bit).cast("long")
            frames.append(F.struct(
                F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"),
                (hit.bitwiseAND(one) != 0).alias("failed"), (hit == one).alias("only"), (hit != 0).alias("rejected"),
            ))
    rows = patterns.select("docs", F.explode(F.array(*frames)).alias("a")).select("docs", "a.*")
    total = lambda flag: F.sum(F.when(F.col(flag), F.col("docs")).otherwise(0)).alias(flag)
    return rows.groupBy("version", "rule").agg(total("failed"), total("only"), total("rejected"))


def keep(docs: DataFrame, policy: Policy = POLICIES[-1], rules=RULES, text: str = "text") -> DataFrame:
    """The documents that a policy accepts, with their own columns and nothing else."""
    m = fresh(docs, "measures")
    judged = docs.withColumn(m, measured(docs[text]))
    return judged.filter(passes(failure_bits(rules, f"`{m}`."), policy, rules)).drop(m)
