"""Plain restatements of operators, for small tables."""

import re
import struct
from collections import Counter, defaultdict

import xxhash

SPACE = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(sets, percent):
    """Labels (least index) and numbers of links of a list of sets."""
    inverted, parent, links = defaultdict(list), list(range(len(sets))), [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter()
        for g in s:
            shared.update(inverted[g])
            inverted[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], links


def normal_line(line):
    return "".join(c for c in line.lower() if c.isalnum())


def lines_gone(docs, percent=80):
    """{(id, text): line numbers that go}; documents are (id, text), repeated ones count once."""
    items = [(d, n, normal_line(x)) for d in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0, fingerprint(d[1]))) for n, x in enumerate(d[1].split("\n"))]
    items = [x for x in items if x[2]]
    forms = {}
    for x in items:
        forms.setdefault(x[2], len(forms))
    label, _ = linked([frozenset(b[i : i + 8] for i in range(len(b) - 7)) for b in forms], percent)
    seen, gone = set(), defaultdict(set)
    for d, n, form in items:
        root = label[forms[form]]
        if root in seen:
            gone[d].add(n)
        seen.add(root)
    return gone


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hashed(*values):
    """Spark's xxhash64 of longs, booleans and strings."""
    seed = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v) if isinstance(v, bool) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def fingerprint(text):
    return hashed(text)


def fill(sizes, weights=(5, 2, 1), cap=3.0):
    """Targets of sources (None last) by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    free, target, left = set(order), {}, float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def mixed(docs):
    """{(id, source, text): copies} of (id, text, source)."""
    times = Counter(docs)
    size = {d: len(words(d[1])) for d in times}
    sizes = Counter()
    for d, n in times.items():
        sizes[d[2]] += size[d] * n
    target, out = fill(sizes), {}
    for s in sizes:
        fp = lambda d: hashed(d[1] or "", d[1] is None)
        own = sorted((d for d in times if d[2] == s), key=lambda d: ((h := hashed(d[0], fp(d))) % 2**64 >> 54, h, d[0] or 0, fp(d)))
        at = 0
        for d in own:
            amount = size[d] * times[d]
            passes = target[s] / sizes[s] if sizes[s] else 0
            out[d] = int(passes) + (at + amount / 2 < (passes - int(passes)) * sizes[s]) if sizes[s] else 0
            at += amount
    return out, target
