"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re

from gridspark.llm import license_scan, secret_scan

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k=3):
    w = BLANK.findall(small(text))
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def components(rows, percent=90):
    """doc index -> (set size, smallest doc_id of its component)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return [(len(sets[i]), (min(least[find(i)]) if least[find(i)] else None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def groups(ids, sets, percent):
    """id -> smallest id of its component of links at ``percent``."""
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = find(a), find(ids[j])
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def contamination(rows, items, window=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(small(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add(item)
    out = []
    for doc, text in rows:
        w, hit, found = ALNUM.findall(small(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= owners
        found = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return out


def quality(text):
    text = text or ""
    w = BLANK.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def secrets(text):
    x, base, more = text or "", [], []
    for rank, (kind, pattern, group, least) in enumerate(secret_scan.BASE):
        pattern = {"hex": "[0-9a-f]+"}.get(kind, pattern.replace("(?i:", "(?ai:"))
        base += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, x) if len(m.group(group)) >= least]
    whole = lambda v: any(re.search(p, v) for p in secret_scan.ALLOWED)
    for m in re.finditer(secret_scan.CANDIDATE, x):
        if whole(m.group()) or re.search(secret_scan.ALLOWED_BEFORE, x[max(0, m.start() - 24) : m.start()]):
            continue
        left = m.group()
        for pattern, _ in secret_scan.FILLER:
            left = re.sub(pattern, lambda y: " " * len(y.group()), left)
        for piece in re.finditer(secret_scan.CANDIDATE, left):
            v, n = piece.group(), secret_scan.WINDOW
            if whole(v):
                continue
            rank, hot = next(i for i, c in enumerate(secret_scan.CLASSES) if re.search(c[1], v)), set()
            for i in range(len(v) - n + 1):
                w = v[i : i + n]
                if -sum(w.count(c) / n * math.log2(w.count(c) / n) for c in set(w)) >= secret_scan.CLASSES[rank][2] - 1e-9:
                    hot.add(i)
            ends = sorted({(i, i + n) for i in hot})
            while ends:
                a, z = ends.pop(0)
                while ends and ends[0][0] <= z:
                    z = max(z, ends.pop(0)[1])
                s = (m.start() + piece.start() + a, rank + len(secret_scan.BASE), m.start() + piece.start() + z, secret_scan.CLASSES[rank][0])
                if not any(b[0] <= s[0] and b[2] >= s[2] for b in base):
                    more.append(s)
    text_of = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return text_of(base), text_of(base + more)


def licenses(text):
    w, places = ALNUM.findall(small(text)), []
    for phrase, label in license_scan.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))
