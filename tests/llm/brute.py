"""Slow and plain versions of what the operators compute."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np


def repeats(docs, length=100):
    """{key: (n_bytes, n_removed, n_spans, kept_sha256)} of (key, bytes) in order."""
    seen, out = set(), {}
    for key, text in docs:
        covered = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            run = text[i : i + length]
            if run in seen:
                covered[i : i + length] = True
            seen.add(run)
        left = bytes(b for b, c in zip(text, covered) if not c)
        spans = int((np.diff(covered.astype(int), prepend=0) == 1).sum())
        out[key] = (len(text), int(covered.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def near_texts(docs, n=5, percent=80):
    """{doc_id: (set size, component)} of (doc_id, text)."""
    sets = {}
    for d, text in docs:
        ws = words(text)
        sets[d] = {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()
    holders, links = defaultdict(list), []
    for d, s in sets.items():
        for e, both in Counter(e for x in s for e in holders[x]).items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                links.append((d, e))
        for x in s:
            holders[x].append(d)
    found = components(sets, links)
    return {d: (len(s), found[d]) for d, s in sets.items()}


KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def secrets(text):
    """(n_assign, n_access, n_hex, spans)"""
    found = [[(m.start(), k, m.end()) for m in re.finditer(p, text or "", re.A) if good(m)] for k, (_, p, good) in enumerate(KINDS)]
    return (*map(len, found), ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in sorted(sum(found, []))))


def toxicity(docs, labels):
    """{doc_id: score} of (doc_id, text), from labels (doc_id, toxic); the method, plainly."""
    import math
    import zlib

    cost, prior = 0.03, 10.0
    marks = {}
    for d, t in labels:
        if d is not None and t is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            marks[d] = max(marks.get(d, 0), int(t == 1))
    tokens = {d: [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", (t or "").encode())] for d, t in docs}
    features = lambda w: [w + b" ", *(w[:n] for n in (6, 5, 4) if len(w) >= n)]
    counts, rows = defaultdict(lambda: [0, 0]), [0, 0]
    for d in (d for d, _ in docs if d in marks):
        rows[marks[d]] += 1
        for f in {f for w in set(tokens[d]) for f in features(w)}:
            counts[f][marks[d]] += 1
    other, toxic = rows
    able = {f: (o, t) for f, (o, t) in counts.items() if t > 1 and t / toxic >= 1.5 * o / other}
    odds = {}
    for f, (o, t) in able.items():
        rate = (t + o) / (toxic + other)
        a, b = (prior * rate * n / (toxic + other) + 0.01 for n in (toxic, other))
        value = math.log((t + a) / max(toxic + prior - t - a, 0.5)) - math.log((o + b) / max(other + prior - o - b, 0.5))
        g = 2 * sum(n * math.log(max(n, 1e-9) / (total * rate)) for n, total in ((t, toxic), (o, other)) if n)
        if math.sqrt(max(g, 0)) >= math.sqrt(2 * math.log(max(2, len(able)))) and value >= 2.5:
            odds[f] = value

    def segments(scores):
        """The best segment, then those left and right of it."""
        out, todo = [], [(0, len(scores))]
        while todo:
            lo, hi = todo.pop()
            best, begin, total, low, at = 0.0, None, 0.0, 0.0, lo
            for k in range(lo, hi):
                total += scores[k]
                if total - low > best + 1e-12:
                    best, begin, end = total - low, at, k + 1
                if total < low:
                    low, at = total, k + 1
            if begin is not None:
                out.append(sum(scores[begin:end]))
                todo += [(lo, begin), (end, hi)] if (begin, end) != (lo, hi) else []
        return out

    found = {d: segments([next((odds[f] for f in features(w) if f in odds), 0.0) - cost for w in ws]) for d, ws in tokens.items()}
    lengths = {d: max(len(ws), 1) for d, ws in tokens.items()}
    plain = [d for d, _ in docs if marks.get(d) == 0]
    x, y = np.log([lengths[d] for d in plain]), np.array([max(found[d], default=0.0) for d in plain])
    slope = max(0.0, ((x - x.mean()) * (y - y.mean())).mean() / max(x.var(), 1e-9))
    scale = max(0.3, (y - slope * x).std() * math.sqrt(6) / math.pi)
    location = (y - slope * x).mean() - 0.5772156649 * scale

    def surprise(score, n):
        return -math.log(max(-math.expm1(-math.exp(-min(30, max(-30, (score - location - slope * math.log(n)) / scale)))), 1e-300))

    def columns(d):
        each = [surprise(s, lengths[d]) for s in found[d]]
        best, total = max(each, default=0.0), sum(e for e in each if e >= 3.0)
        return [1.0, math.log1p(best), math.log1p(total), min(best, 10) / 10]

    train = [d for d, _ in docs if d in marks]
    m, want, w = np.array([columns(d) for d in train]), np.array([marks[d] for d in train], float), np.zeros(4)
    for _ in range(200):
        p = 1 / (1 + np.exp(-(m @ w)))
        w += np.linalg.solve((m.T * (p * (1 - p))) @ m + 0.01 * np.eye(4), m.T @ (want - p) - 0.01 * w)
    return {d: 1 / (1 + math.exp(-float(np.array(columns(d)) @ w))) for d, _ in docs}
