"""Plain Python versions of what the queries return."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall(t or "")


def union(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near(docs, percent=85):
    docs = sorted(docs)
    sets = []
    for _, t in docs:
        w = words((t or "").translate(LOW))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    common = Counter()
    for i, s in enumerate(sets):
        for x in s:
            for j in by[x]:
                if j < i:
                    common[j, i] += 1
    links = [p for p, c in common.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    root = union(len(docs), links)
    return {docs[i][0]: (len(sets[i]), docs[root[i]][0], root[i] == i) for i in range(len(docs))}


def vectors(rows, cosine=0.9):
    rows = sorted(rows, key=lambda r: r[0])
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for (_, v), k in zip(rows, ok)]
    links = [(i, j) for j in range(len(rows)) for i in range(j) if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine]
    n = Counter(x for p in links for x in p)
    root = union(len(rows), links)
    return {rows[i][0]: (n[i], rows[root[i]][0], root[i] == i) for i in range(len(rows))}


def rules(t):
    w = words(t)
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def warc(pages, least=0):
    by = defaultdict(list)
    for p, h in pages:
        by[(h or "").encode()].append(p)
    out = {}
    for p, h in pages:
        raw = (h or "").encode()
        first = len(raw) < least or p == max(by[raw])
        out[p] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else max(by[raw]))
    return out


def substring(docs, n=13):
    first = {}
    for d, t in sorted(docs):
        w = words(t)
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = {i + k for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for k in range(n)}
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def base_scores(docs, end="\n"):
    toks = {d: [*words((t or "").translate(LOW)), end] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    c = Counter(w for d, ws in toks.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (held[d], len(ws), sum(c[w] > 0 for w in ws), n, sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in toks.items()}
