"""Plain versions of the queries' contracts, one document at a time."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = {c: c + 32 for c in range(65, 91)}


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def fingerprint(text):
    words = WORD.findall((text or "").translate(A_Z))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(docs):
    """doc_id -> (fingerprint, smallest reachable id) over all pairs."""
    prints = {d: fingerprint(t) for d, t in docs}
    parent = {f: f for f in prints.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = list(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for d, f in prints.items():
        least[root(f)].append(d)
    return {d: (f"{f:016x}", min(least[root(f)])) for d, f in prints.items()}


def base_spans(text):
    out = []
    rule = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, m.end()) for m in rule.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def held_out(d):
    return zlib.crc32(str(d).encode()) % 5 == 1


def unigram(docs):
    """(tokens in training, counts, score function) of the base word model."""
    counts = Counter()
    for d, t in docs:
        if not held_out(d):
            counts.update([*WORD.findall((t or "").translate(A_Z)), None])
    total, kinds = sum(counts.values()), len(counts)

    def score(t):
        tokens = [*WORD.findall((t or "").translate(A_Z)), None]
        return len(tokens), sum(counts[w] > 0 for w in tokens), sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)

    return total, counts, score


def token_ids(name, texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(public_tokenizers.path(name)))
    model.encode_special_tokens = True
    return [[*e.ids, end] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
