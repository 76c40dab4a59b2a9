"""Plain Python versions of the contracts."""

import hashlib
import re
from collections import defaultdict

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NON_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(LOWER))


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in docs:
        low = (t or "").translate(LOWER)
        keep = max(groups[low])
        out.append((i, keep, len(groups[low]), i == keep, hashlib.sha256(low.encode()).hexdigest()))
    return sorted(out)


def leaks(docs, bench):
    windows = defaultdict(set)
    for i, t in bench:
        w = words(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out.append((d, len(w), len(hit), sorted(items)))
    return sorted(out, key=str)


def shingles(text):
    w = words(text, NON_SPACE)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def _components(sets, linked):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and linked(sets[i], sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def near(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    roots = _components(sets, lambda a, b: 100 * len(a & b) >= percent * len(a | b))
    least = defaultdict(lambda: 1 << 62)
    for (i, _), r in zip(docs, roots):
        least[r] = min(least[r], i)
    return sorted((i, len(s), least[r], i == least[r]) for (i, _), s, r in zip(docs, sets, roots))


def line_classes(docs, similarity=0.8):
    rows = [(i, n, line.strip(" ")) for i, t in docs for n, line in enumerate((t or "").split("\n")) if t is not None and line.strip(" ")]
    texts = sorted({r[2] for r in rows})
    sets = [frozenset(x[i : i + 5] for i in range(len(x) - 4)) if len(x) >= 5 else frozenset([x]) for x in texts]
    roots = dict(zip(texts, _components(sets, lambda a, b: len(a & b) >= similarity * len(a | b))))
    groups = defaultdict(list)
    for i, n, x in rows:
        groups[roots[x]].append((i, n))
    return sorted((i, n, len(groups[roots[x]]), (i, n) == min(groups[roots[x]])) for i, n, x in rows)


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def pii(text):
    out = []
    for kind, pattern in PII:
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out
