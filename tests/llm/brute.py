"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingle_set(text, size):
    w = words(text)
    size = min(size, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else frozenset()


def near_duplicates(docs, size, percent=80):
    """id -> (set size, component)."""
    sets, top, where = {i: shingle_set(t, size) for i, t in docs.items()}, {i: i for i in docs}, {}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sorted(sets):
        for j, n in Counter(j for g in sets[i] for j in where.get(g, ())).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
        for g in sets[i]:
            where.setdefault(g, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in docs}


def repeats(docs, length):
    """id -> (bytes, removed, spans, digest of the rest)."""
    seen, out = set(), {}
    for i in sorted(docs):
        raw = (docs[i] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)
