"""Plain Python versions that several test modules use."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kept_lines(texts, min_chars, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    common = {k: max(h) for k, h in holders.items() if len(k) >= min_chars and len(h) >= min_docs}
    return [(i, "\n".join(x for x in (t or "").split("\n") if common.get(key(x), i) == i)) for i, t in texts]


def component_ids(texts):
    """The least id reachable by links, per id."""
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    known = sorted(i for i in sets if sets[i])
    for x, a in enumerate(known):
        for b in known[:x]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                comp[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}
