"""Plain versions of what the operators compute, for small tables."""

import collections
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def least_members(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_documents(rows, percent=85):
    """rows: (id, text); the smallest id of each row's group."""
    sets = {i: shingles(t) for i, t in rows}
    ids = [i for i in sets if sets[i]]
    common = collections.defaultdict(list)
    for i in ids:
        for s in sets[i]:
            common[s].append(i)
    both = collections.Counter((a, b) for held in common.values() for a in held for b in held if a < b)
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return least_members(sets, links), {i: len(s) for i, s in sets.items()}


def katz(rows, discounts, spare):
    """rows: (id, text); scores of all rows by a model of those not held out."""

    def held(i):
        return zlib.crc32(str(i).encode()) % 7 == 2

    single, pair, history = collections.Counter(), collections.Counter(), collections.Counter()
    for i, text in rows:
        if not held(i):
            w = [*words(text), "\0end"]
            before = ["\0start", *w[:-1]]
            single.update(w)
            pair.update(zip(before, w))
            history.update(before)
    total, kinds = sum(single.values()), len(single)
    count_of = lambda c: [0] + [sum(1 for v in c.values() if v == r) for r in range(1, 7)]
    one, two = discounts(count_of(single)), discounts(count_of(pair))
    less = lambda c, d: c * (d[c] if c < len(d) else 1.0)
    mass = sum(less(c, one) for c in single.values()) / (total + spare)
    p = lambda w: less(single[w], one) / (total + spare) if single[w] else 1 - mass
    seen, alone = collections.Counter(), collections.Counter()
    for (a, b), c in pair.items():
        seen[a] += less(c, two) / (history[a] + spare)
        alone[a] += p(b)

    def probability(a, b):
        if pair[a, b]:
            return less(pair[a, b], two) / (history[a] + spare)
        return ((1 - seen[a]) / (1 - alone[a]) if history[a] else 1.0) * p(b)

    out = {}
    for i, text in rows:
        w = [*words(text), "\0end"]
        score = sum(math.log10(probability(a, b)) for a, b in zip(["\0start", *w[:-1]], w))
        base = sum(math.log10((single[b] + 1) / (total + kinds + 1)) for b in w)
        out[i] = (held(i), len(w), sum(single[b] > 0 for b in w), total, base, score)
    return out, probability, single
