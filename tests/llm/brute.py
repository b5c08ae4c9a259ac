"""Brute-force versions of the operators, on plain Python lists of rows."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingle_set(text: str | None, lower: bool = True, size: int = 5) -> frozenset:
    w = (text or "").encode()
    w = (w.lower() if lower else w).split()
    return frozenset(tuple(w[a:a + size]) for a in range(max(1, len(w) - size + 1))) if w else frozenset()


def near_groups(rows, percent: int = 85) -> dict:
    """doc_id -> (n_shingles, component, kept) by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in rows}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in where[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def jaccard_groups(rows, percent: int = 90, size: int = 3) -> dict:
    """doc_id -> (n_shingles, component, links) by comparing all pairs."""
    sets = {i: shingle_set(t, size=size) for i, t in rows}
    links, parent = dict.fromkeys(sets, 0), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if not a or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            if 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}


def collocations(rows, least: int = 30, top: int = 2000) -> set:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            w = [x for x in re.split(rb"[ \t]+", piece) if x]
            total[lang] += len(w)
            for s in range(1, 5):
                for i in range(len(w) - s + 1):
                    count[lang, tuple(w[i:i + s])] += 1
    found = collections.defaultdict(list)
    for (lang, p), a in count.items():
        if len(p) < 2 or a < least:
            continue
        inside = [q for (x, q), f in count.items() if x == lang and len(q) > len(p) and 100 * f >= 80 * a and f >= least
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not inside:
            cuts = [(2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang].append((-score, -a, b" ".join(p), count[lang, p[:k]], count[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, left, right, total[lang], -s)
            for lang, rows_ in found.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1)}


def hard_negatives(rows, every: int = 100, k: int = 5) -> set:
    """Rows of (vec_id, vector, label) with unique ids; labels are taken as they are."""
    vec = {i: ([int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows
           if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for i, (q, label) in vec.items():
        if i % every:
            continue
        score = {j: sum(a * b for a, b in zip(q, v)) for j, (v, _) in vec.items() if j != i and len(v) == len(q)}
        order = sorted(score, key=lambda j: (-score[j], j))
        for p in [j for j in order if vec[j][1] == label][:k]:
            fit = [j for j in order if vec[j][1] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]]
            out |= {(i, p, r, j, score[p], score[j]) for r, j in enumerate(fit[:k], 1)}
    return out


def without_repeats(rows, window: int = 20) -> dict:
    """doc_id -> (n_words, n_removed, kept) of the words not covered by a window seen before."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            x = tuple(w[s:s + window])
            if x in seen:
                gone.update(range(s, s + window))
            seen.add(x)
        kept = [a for k, a in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), b" ".join(kept).decode())
    return out


def without_lines(rows, size: int = 3) -> dict:
    """doc_id -> (n_lines, n_removed, text)."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines, gone = (t or "").split("\n"), set()
        for a in range(len(lines) - size + 1):
            x = tuple(lines[a:a + size])
            if any(y.strip(" ") for y in x):
                if x in seen:
                    gone.update(range(a, a + size))
                seen.add(x)
        out[i] = (len(lines), len(gone), "\n".join(y for k, y in enumerate(lines) if k not in gone))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def conversations(rows, loss_role: str = "assistant") -> dict:
    """conv_id -> (turns, loss text) of (conv_id, turn, role, text) rows."""
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        out[conv] = turns, "".join(t for r, t in turns if r == loss_role)
    return out


def targets(sizes: dict, weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> dict:
    """source -> target by sharing, capping and sharing the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        out = {s: most * sizes[s] for s in capped}
        out |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if out[s] > most * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


def seats(votes: dict, n: int) -> dict:
    """Sainte-Laguë, one seat at a time (ties: larger votes, then smaller key)."""
    got = dict.fromkeys(votes, 0)
    for _ in range(n if sum(votes.values()) else 0):
        best = min(votes, key=lambda k: (-votes[k] / (2 * got[k] + 1), -votes[k], k))
        got[best] += 1
    return got
