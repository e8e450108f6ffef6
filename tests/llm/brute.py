"""Plain Python forms of the operators, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = b" \t\n\x0b\x0c\r"
LAST = 1 << 63


def data(text: str | None) -> bytes:
    return (text or "").encode()


def lines(docs):
    held = defaultdict(set)
    key = lambda line: line.strip(SPACE).lower()
    for i, t in docs:
        for line in data(t).split(b"\n"):
            if len(key(line).decode()) >= 10:
                held[key(line)].add(LAST if i is None else i)
    first = {k: min(v) for k, v in held.items() if len(v) > 1}
    out = []
    for i, t in docs:
        d = LAST if i is None else i
        every = data(t).split(b"\n")
        kept = [x for x in every if first.get(key(x), d) == d]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return out


def repeats(docs, length=200):
    seen = Counter(data(t)[k : k + length] for _, t in docs for k in range(len(data(t)) - length + 1))
    out = []
    for i, t in docs:
        x = data(t)
        hit = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                hit[k : k + length] = b"\x01" * length
        spans = len(re.findall(rb"\x01+", bytes(hit)))
        out.append((i, len(x), sum(hit), spans, hashlib.sha256(bytes(c for c, h in zip(x, hit) if not h)).hexdigest()))
    return out


def shingles(t):
    w = data(t).lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def near(docs, roots=None):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    if roots is not None:
        roots += [find(k) for k in range(len(docs)) if sets[k]]
    return [(i, len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(docs)]


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(docs, items, window=10):
    fold = lambda t: WORD.findall(data(t).lower())
    wins = defaultdict(set)
    for name, t in items:
        w = fold(t)
        if w:
            for k in range(max(1, len(w) - window + 1)):
                wins[tuple(w[k : k + window])].add("null" if name is None else str(name))
    sizes = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w = fold(t)
        hit, names = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def targets(sizes: dict[str, int], weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> dict[str, float]:
    """Budget dealt by weight in the order of the sources (null, "-", last); what is above `most` sizes is dealt again among the others."""
    order = sorted(sizes, key=lambda s: (s == "-", s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] >= most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out
