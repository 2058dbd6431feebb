"""Plain readings of the operators' contracts, for small fixtures."""

import hashlib
import random
import re
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng: random.Random, n: int) -> str:
    vocabulary = ["the", "of", "and", "in", "eaea", "thly", "ención", "über", "naïve", "日本", "x1", "on\n", "Wher.", "to", "was"]
    return " ".join(rng.choice(vocabulary) + ("" if rng.random() < 0.4 else rng.choice("abcdefgh") * rng.randrange(1, 4)) for _ in range(n))


def repeats(docs, depth=50):
    """docs: (id, text); None ids come last. Per row: n_bytes, n_removed, n_spans, sha256 of what is left."""
    first, key = {}, lambda i: (i is None, i or 0)
    for i, t in sorted(docs, key=lambda d: key(d[0])):
        b = (t or "").encode()
        for p in range(len(b) - depth + 1):
            first.setdefault(b[p : p + depth], key(i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if first[b[p : p + depth]] < key(i):
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def rule_counts(text):
    words = WORDS.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = [0] * len(words)
    for p in range(len(words) - 2):
        if windows[tuple(words[p : p + 3])] > 1:
            hit[p] = hit[p + 1] = hit[p + 2] = 1
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(words) < 50 or 100 * sum(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(hit), failed


def targets(sizes: dict):
    """sizes by source; None last. By rounds: whoever is above three times its size stops there."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def shingles(text, k=5):
    words = WORDS.findall(text or "")
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar_classes(docs, least=0.8):
    """docs: {id: text}: the least id of each class by all pairs."""
    ids = sorted(docs)
    sets = {i: shingles(docs[i]) for i in ids}
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in ids}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def pii_spans(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PII.items() for m in re.finditer(p, text or "") if ok(m[0])]


def top_k(vectors, every=50, k=5):
    import math

    own = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in own:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in own if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)
