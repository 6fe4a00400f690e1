"""PII surrogates in DataFrame functions only: keyed, type-consistent, distinct, coreferent.

Found are e-mail addresses, IPv4 addresses, card numbers, US social security
numbers, telephone numbers, and names after a title. Equal entities (whatever
their spelling: case, separators) get equal replacements in all documents.

* Digits go through a keyed permutation of the digit strings of their length and
  are put back into the original's separators. A telephone number keeps its
  country code, a card its first digit and whether its check digit is right. An IPv4 address goes
  through a permutation of all addresses.
* E-mail letters become letters and digits digits, in place; the top-level domain
  stays, and a domain gets the same replacement under every user.
* A name keeps its title; words are made of syllables of their own script, given
  names end as the title's gender asks, and a family name is replaced alike with and without
  a given name.

Collision check: all distinct entities are collected in a table with their
replacements. Where two share one, or one equals an entity of the corpus, all but
the first try the next attempt of the keyed function, until none is left. The few
entities beyond the first attempt are handed to their documents by a join; it is
a broadcast only if they are counted to be few.

Cases: a null text stays null. Null and repeated ids are fine: replacements depend on the
entity alone. Texts of any length are rewritten whole. Empty tables stay empty.
All other columns pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh
from ledgerloom.session import pin

# Titles by the gender they state, and the sounds that names are made of, by script.
MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "Senhor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Signora", "Senhora", "Госпожа", "Κυρία")
SOUNDS = {
    "Cyrillic": ("б в г д ж з к л м н п р с т ф х ч ш ст бр", "а е и о у", "а", "н"),
    "Greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ στ πρ κρ τρ δρ", "α ε η ο υ", "α", "ς"),
    "Latin": ("b c d f g h j k l m n p r s t v w st br tr", "a e i o u", "a", "n"),
}

_TITLES = "|".join(sorted(MALE + FEMALE, key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "card": r"(?<![\w.+\-])(?:\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,7}|3\d{3}[ \-]?\d{6}[ \-]?\d{5})(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": (
        r"(?:(?<![\w.+\-])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}"
        r"|(?<![\w.+\-])\(\d{3}\) ?\d{3}[ .\-]\d{4}|(?<![\w.+\-])\d{3}[.\-]\d{3}[.\-]\d{4})(?![\w])"
    ),
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.?\x20+\p{{Lu}}[\p{{L}}’'\-]+(?:\x20+\p{{Lu}}[\p{{L}}’'\-]+)?",
}
ANY = "|".join(PATTERNS.values())
#: Every entity has one of these; most texts have none and are never searched further.
HINT = rf"[@0-9]|(?:{_TITLES})\.?\x20"
ATTEMPTS = 12
_FEW = 50_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


class Surrogates:
    """The replacement expressions under one key."""

    def __init__(self, key: str):
        self.key = key

    def _number(self, *parts) -> int:
        text = "\x1f".join([self.key, *map(str, parts)])
        return int.from_bytes(hashlib.sha256(text.encode()).digest()[:12], "big")

    def _hash(self, kind: str, norm: Column, attempt: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.key}\x1f{kind}\x1f"), attempt.cast("string"), F.lit("\x1f"), norm), 256)

    def _byte(self, digest: Column, at: Column, width: int = 2) -> Column:
        """The number in ``width`` hex digits of a hash, from place ``at`` (counted from 0, going round)."""
        return F.conv(F.substring(digest, (at * width) % 60 + 1, F.lit(width)), 16, 10).cast("int")

    def permuted(self, kind: str, digits: Column, attempt: Column) -> Column:
        """A keyed permutation of the digit strings of each length up to 18: affine, reversed, affine."""

        def affine(d: Column, step: int) -> Column:
            a = [self._number(kind, step, k, "a") % 10**16 // 10 * 10 + (1, 3, 7, 9)[self._number(kind, step, k) % 4] for k in range(ATTEMPTS)]
            b = [self._number(kind, step, k, "b") % 10**16 for k in range(ATTEMPTS)]
            pick = lambda xs: F.element_at(F.array(*[F.lit(str(x)).cast("decimal(17,0)") for x in xs]), attempt + 1)
            size = F.rpad(F.lit("1"), F.length(d) + 1, F.lit("0")).cast("decimal(19,0)")
            moved = (d.cast("decimal(18,0)") * pick(a) + pick(b)) % size
            return F.lpad(moved.cast("decimal(19,0)").cast("string"), F.length(d), F.lit("0"))

        return _let(_let(digits, lambda d: F.reverse(affine(d, 0))), lambda d: affine(d, 1))

    def phone(self, norm: Column, attempt: Column) -> Column:
        """norm: country code with plus, a bar, and the other digits."""
        code, rest = F.substring_index(norm, "|", 1), F.substring_index(norm, "|", -1)
        return F.concat(code, F.lit("|"), self.permuted("phone", rest, attempt))

    def card(self, norm: Column, attempt: Column) -> Column:
        def check(body: Column) -> Column:
            def add(total: Column, i: Column) -> Column:
                digit = F.substring(body, F.length(body) - i + 1, F.lit(1)).cast("int")
                twice = digit * 2
                return total + F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

            return (F.lit(10) - F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), add) % 10) % 10

        first, middle = F.substring(norm, 1, 1), F.substring(norm, F.lit(2), F.length(norm) - 2)
        body = F.substring(norm, F.lit(1), F.length(norm) - 1)
        off = F.substring(norm, -1, 1).cast("int") - check(body) + 10
        return _let(
            F.concat(first, self.permuted("card", middle, attempt)),
            lambda new: F.concat(new, ((check(new) + off) % 10).cast("string")),
        )

    def ip(self, norm: Column, attempt: Column) -> Column:
        octet = lambda i: F.element_at(F.split(norm, r"\."), i).cast("bigint")
        address = octet(1) * (1 << 24) + octet(2) * (1 << 16) + octet(3) * (1 << 8) + octet(4)

        def affine(x: Column, step: int) -> Column:
            a = F.array(*[F.lit(self._number("ip", step, k) % (1 << 30) * 2 + 1) for k in range(ATTEMPTS)])
            b = F.array(*[F.lit(self._number("ip", step, k, "b") % (1 << 30)) for k in range(ATTEMPTS)])
            return (x * F.element_at(a, attempt + 1) + F.element_at(b, attempt + 1)).bitwiseAND(F.lit((1 << 32) - 1))

        turned = _let(affine(address, 0), lambda x: F.shiftleft(x.bitwiseAND(F.lit(0xFFFF)), 16) + F.shiftright(x, 16))
        dotted = lambda x: F.concat_ws(".", *[F.shiftright(x, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])
        return _let(affine(turned, 1), dotted)

    def _reshaped(self, text: Column, digest: Column) -> Column:
        """Letters to letters of the same case and digits to digits, in place."""

        def char(i: Column) -> Column:
            c, n = F.substring(text, i, F.lit(1)), self._byte(digest, i - 1)
            return (
                F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
                .when(c.rlike("[a-z]"), F.char(n % 26 + 97))
                .when(c.rlike("[A-Z]"), F.char(n % 26 + 65))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), char), "")

    def email(self, spelled: Column, attempt: Column) -> Column:
        norm = F.lower(spelled)
        local, domain = F.substring_index(spelled, "@", 1), F.substring_index(spelled, "@", -1)
        top = F.substring_index(domain, ".", -1)
        owner = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
        longer = lambda h: F.when(attempt > 3, F.translate(F.substring(h, F.lit(1), attempt), "0123456789", "ghijklmnop")).otherwise("")
        user = _let(self._hash("email", norm, attempt), lambda h: F.concat(self._reshaped(local, h), longer(h)))
        return F.concat(user, F.lit("@"), _let(self._hash("domain", F.lower(domain), F.lit(0)), lambda h: self._reshaped(owner, h)), F.lit("."), top)

    def name(self, norm: Column, attempt: Column) -> Column:
        """norm: f, m or s (given name of a woman or man, family name), a colon, and the word in lower case."""
        role, word = F.substring(norm, 1, 1), F.substring(norm, F.lit(3), F.length(norm))

        def made(script: str) -> Column:
            onsets, vowels, female, male = SOUNDS[script]
            sound = lambda h, i: F.concat(
                F.element_at(F.array(*map(F.lit, onsets.split())), self._byte(h, i * 2, 3) % len(onsets.split()) + 1),
                F.element_at(F.array(*map(F.lit, vowels.split())), self._byte(h, i * 2 + 1, 3) % len(vowels.split()) + 1),
            )
            ending = F.when(role == "f", female).when(role == "m", male).otherwise("")
            count = F.when(role == "s", 3).otherwise(2) + attempt
            line = lambda h: F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: sound(h, i)), "")
            stem = _let(self._hash("name", norm, attempt), line)
            return F.concat(F.when(role == "f", F.substring(stem, F.lit(1), F.length(stem) - 1)).otherwise(stem), ending)

        return F.when(word.rlike(r"\p{IsCyrillic}"), made("Cyrillic")).when(word.rlike(r"\p{IsGreek}"), made("Greek")).otherwise(made("Latin"))

    def canonical(self, kind: Column, norm: Column, attempt: Column) -> Column:
        """The replacement of an entity in its normal form."""
        return (
            F.when(kind == "email", self.email(norm, attempt))
            .when(kind == "ip", self.ip(norm, attempt))
            .when(kind == "card", self.card(norm, attempt))
            .when(kind == "ssn", self.permuted("ssn", norm, attempt))
            .when(kind == "phone", self.phone(norm, attempt))
            .otherwise(self.name(norm, attempt))
        )

    def spelled(self, found: Column, attempt_of) -> Column:
        """The replacement of a match in the match's own spelling."""
        kind = kind_of(found)
        norm = norm_of(found)
        attempt = attempt_of(kind, norm)

        def refilled(digits: Column) -> Column:
            def char(i: Column) -> Column:
                c = F.substring(found, i, F.lit(1))
                before = F.length(_digits(F.substring(found, F.lit(1), i - 1)))
                return F.when(c.rlike("[0-9]"), F.substring(digits, before + 1, F.lit(1))).otherwise(c)

            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(found)), char), "")

        number = lambda fn: _let(_digits(fn(norm, attempt)), refilled)
        word = r"\x20+(\S+)"
        first, second = F.regexp_extract(found, word, 1), F.regexp_extract(found, word + word, 2)
        gap, gap2 = F.regexp_extract(found, r"(\x20+)\S", 1), F.regexp_extract(found, r"\x20+\S+(\x20+)", 1)

        def called(w: Column, role: Column) -> Column:
            of = F.concat(role, F.lit(":"), F.lower(w))
            new = self.name(of, attempt_of(F.lit("name"), of))
            return F.when((F.length(w) > 1) & (F.upper(w) == w), F.upper(new)).otherwise(F.initcap(new))

        names = F.when(second == "", F.concat(gap, called(first, F.lit("s")))).otherwise(
            F.concat(gap, called(first, gender_of(found)), gap2, called(second, F.lit("s")))
        )
        return (
            F.when(kind == "email", self.email(found, attempt))
            .when(kind == "ip", self.ip(norm, attempt))
            .when(kind == "card", number(self.card))
            .when(kind == "ssn", number(lambda n, a: self.permuted("ssn", n, a)))
            .when(kind == "phone", number(self.phone))
            .otherwise(F.concat(F.substring_index(found, " ", 1), names))
        )


def kind_of(found: Column) -> Column:
    return (
        F.when(F.contains(found, F.lit("@")), "email")
        .when(found.rlike(r"^\p{L}"), "name")
        .when(found.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), "ip")
        .when(found.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(found.rlike(r"^[0-9 \-]+$") & (F.length(_digits(found)) >= 13), "card")
        .otherwise("phone")
    )


def gender_of(found: Column) -> Column:
    title = F.regexp_replace(F.substring_index(found, " ", 1), r"\.$", "")
    return F.when(title.isin(*FEMALE), "f").otherwise("m")


def norm_of(found: Column) -> Column:
    """The spelling-free form of a match; names have one for each word, see ``norms_of``."""
    code = F.regexp_extract(found, r"^(\+\d{1,3})(?:[ .\-(])", 1)
    rest = F.substring(_digits(found), F.when(code == "", 1).otherwise(F.length(code)), F.lit(18))
    kind = kind_of(found)
    return (
        F.when(kind == "email", F.lower(found))
        .when(kind == "ip", found)
        .when(kind.isin("card", "ssn"), _digits(found))
        .otherwise(F.concat(code, F.lit("|"), rest))
    )


def norms_of(found: Column) -> Column:
    """(kind, norm) of all entities in a match."""
    words = F.slice(F.split(found, r"\x20+"), 2, 2)
    named = F.transform(words, lambda w, i: F.struct(
        F.lit("name").alias("kind"),
        F.concat(F.when(i == F.size(words) - 1, "s").otherwise(gender_of(found)), F.lit(":"), F.lower(w)).alias("norm"),
    ))
    kind = kind_of(found)
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), norm_of(found).alias("norm"))))


def found_in(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, norm), once per document and entity."""
    rows = docs.select(docs[id].alias("doc_id"), F.explode(found_in(docs[text])).alias("found"))
    return rows.select("doc_id", F.explode(norms_of(F.col("found"))).alias("e")).select("doc_id", "e.*").distinct()


def settle(distinct: DataFrame, made: Surrogates) -> DataFrame:
    """(kind, norm, attempt) with replacements that are distinct and no entity of the corpus."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    state = distinct.withColumn("attempt", F.lit(0))
    for _ in range(ATTEMPTS):
        state = pin(state.select("kind", "norm", "attempt", F.lower(made.canonical(kind, norm, attempt)).alias("new")), "surrogates")
        owner = state.groupBy("kind", "new").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count("*").alias("n"))
        owner = owner.join(distinct.select("kind", F.col("norm").alias("new"), F.lit(True).alias("real")), ["kind", "new"], "left")
        clash = pin(owner.filter("n > 1 OR real"), "clashes")
        if clash.isEmpty():
            return state.select("kind", "norm", "attempt")
        again = F.col("real").isNotNull() | (F.col("first").isNotNull() & (F.col("first.norm") != norm))
        state = state.join(clash, ["kind", "new"], "left").select("kind", "norm", F.when(again, attempt + 1).otherwise(attempt).alias("attempt"))
    raise ValueError(f"no distinct replacements after {ATTEMPTS} attempts")


def replace(docs: DataFrame, key: str, id: str = "doc_id", text: str = "text", counted: str | None = None) -> DataFrame:
    """The documents with every entity in ``text`` replaced; ``counted`` names a column for the number of replacements."""
    made = Surrogates(key)
    held = pin(entities(docs, id, text), "entities")
    settled = settle(pin(held.select("kind", "norm").distinct(), "distinct-entities"), made)
    later = pin(settled.filter("attempt > 0"), "later-attempts")
    out, owner, tries = docs, fresh(docs, "owner_"), fresh(docs, "tries_")
    if later.isEmpty():
        attempt_of = lambda kind, norm: F.lit(0)
    else:
        entry = F.struct(F.concat_ws(":", "kind", "norm").alias("k"), F.col("attempt").alias("v"))
        by_doc = held.join(later, ["kind", "norm"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_set(entry)).alias(tries))
        by_doc = pin(by_doc.withColumnRenamed("doc_id", owner), "attempts")
        if by_doc.limit(_FEW + 1).count() <= _FEW:
            by_doc = F.broadcast(by_doc)
        out = docs.join(by_doc, docs[id].eqNullSafe(by_doc[owner]), "left").drop(owner)
        attempt_of = lambda kind, norm: F.coalesce(F.try_element_at(F.col(tries), F.concat_ws(":", kind, norm)), F.lit(0))
    source = F.col(f"`{text}`")
    found = found_in(source)
    gaps = F.split(source, ANY, -1)
    new = F.transform(found, lambda m: made.spelled(m, attempt_of))
    joined = F.zip_with(gaps, new, lambda gap, s: F.concat(gap, F.coalesce(s, F.lit(""))))
    rewritten = F.when(F.size(found) > 0, F.array_join(joined, "")).otherwise(source)
    columns = [rewritten.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, *([F.size(found).cast("long").alias(counted)] if counted else []))
