"""Plain versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text: str | None) -> int:
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(prints: list[int], ids: list[int], distance: int = 2) -> list[int]:
    """The smallest id of each one's component."""
    up = list(range(len(prints)))

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    arr = np.array(prints, np.uint64)
    for k in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[k]) <= distance):
            up[find(k)] = find(int(j))
    least: dict[int, int] = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return [least[find(k)] for k in range(len(prints))]


def contamination(docs: list[tuple], items: list[tuple], size: int = 10) -> list[tuple]:
    owner: dict[tuple, set] = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        for k in range(max(1, len(w) - size + 1)) if w else []:
            owner.setdefault(tuple(w[k : k + size]), set()).update([] if item is None else [str(item)])
    out = []
    for doc_id, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(p) for p in owner}:
            for k in range(len(w) - n + 1):
                if (ids := owner.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def base_scores(docs: list[tuple]) -> dict[int, tuple]:
    """doc_id: (n_tokens, n_known, train_tokens, base_score); ids are unique."""
    c: Counter = Counter()
    for i, t in docs:
        if crc(i) % 7 != 2:
            c.update((t or "").encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in docs:
        w = [*(t or "").encode().lower().split(), None]
        out[i] = (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    return out


def lattice_scores(docs: list[tuple], weights: dict[str, float], spread: float = 3000.0) -> dict:
    """doc_id: the score, a word and a class at a time.  docs: (id, text, lang)."""
    from lamina.llm import lattice

    counts: dict = {}
    ends: Counter = Counter()
    for i, t, lang in docs:
        if i is not None and crc(i) % 7 != 2:
            counts.setdefault(lang, Counter()).update((t or "").encode().lower().split())
            ends[lang] += 1
    langs = sorted(counts, key=lambda x: (x is None, x)) or [None]
    pooled = sum((counts.get(x, Counter()) for x in langs), Counter())
    n, all_docs = sum(pooled.values()) + sum(ends.values()), sum(ends.values())
    lat = lattice.Lattice(weights)
    seen = sorted(w.decode() for w in pooled)
    if seen:
        made, spelled, _ = lat.expect(seen)
        lat = lat.learned(made, spelled, float(len(seen)))
    once = sum(1 for x in langs for c in counts.get(x, Counter()).values() if c == 1)
    other = sum(1 for x in langs for w, c in counts.get(x, Counter()).items() if c == 1 and pooled[w] > 1)
    pool = (other + lattice.PRIOR * lattice.POOL_SHARE) / (once + lattice.PRIOR) if n else 0.0

    def p(word, x) -> float:
        c, v = counts.get(x, Counter()), len(counts.get(x, ())) + (ends[x] > 0)
        total = sum(c.values()) + ends[x]
        sub = lattice.END_SHARE if word is None else (1 - lattice.END_SHARE) * 10 ** float(lat.log10([word.decode()])[0])
        mine, all_ = (ends[x], all_docs) if word is None else (c[word], pooled[word])
        v = max(1, v)
        return (mine + v * (pool * all_ / max(1, n) + (1 - pool) * sub)) / (total + v)

    out = {}
    for i, t, _ in docs:
        words = [*(t or "").encode().lower().split(), None]
        logs = []
        for x in langs:
            used: Counter = Counter()
            s = math.log(ends[x] / all_docs) if all_docs and ends[x] else 0.0 if not all_docs else -math.inf
            for k, w in enumerate(words):  # a word after the other: the lattice's share and the text's own
                s += math.log((spread * p(w, x) + used[w]) / (spread + k))
                used[w] += 1
            logs.append(s)
        top = max(logs)
        out[i] = (top + math.log(sum(math.exp(s - top) for s in logs))) / math.log(10)
    return out


def languages(docs: list[tuple], size: int = 300) -> dict:
    """doc_id: (language, score), by profiles in plain counters.  docs: (id, text, lang)."""

    def grams(text) -> Counter:
        out: Counter = Counter()
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            padded = f" {word} "
            for n in (1, 2, 3):
                out.update(padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n].strip())
        return out

    def order(g: str) -> tuple:
        """Ties go by code points, the last letter first; what an n-gram lacks comes last, a word's edge first."""
        return tuple(reversed([*(0 if c == " " else ord(c) for c in g), *[1 << 30] * (3 - len(g))]))

    def ranked(counts: Counter) -> list[str]:
        return sorted(counts, key=lambda g: (-counts[g], order(g)))[:size]

    learned: dict = {}
    for i, t, lang in docs:
        if lang is not None and i is not None and crc(i) % 5 != 0:
            learned.setdefault(lang, Counter()).update(grams(t))
    profiles = {x: {g: r for r, g in enumerate(ranked(c))} for x, c in learned.items() if c}
    out = {}
    for i, t, _ in docs:
        mine = ranked(grams(t))
        if not mine or not profiles:
            out[i] = ("und", 0.0)
            continue
        off = {x: sum(abs(p[g] - r) if g in p else size for r, g in enumerate(mine)) for x, p in profiles.items()}
        best = min(sorted(off), key=lambda x: off[x])
        out[i] = (best, 1 - off[best] / (size * len(mine)))
    return out


def crf_score(model, text) -> float:
    """The length-weighted marginal of label 1 over a text's lines, one path at a time in
    plain loops."""
    from lamina.llm import quality

    x, size = quality.document_features(text)
    emit = [[0.0, float(((row - model.mean) / model.spread) @ model.weights + model.bias)] for row in x.astype(float)]
    n = len(emit)

    def plus(values) -> float:
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    ahead = [[float(model.start[b]) + emit[0][b] for b in (0, 1)]]
    for i in range(1, n):
        ahead.append([plus([ahead[-1][a] + float(model.step[a][b]) for a in (0, 1)]) + emit[i][b] for b in (0, 1)])
    behind = [[0.0, 0.0]]
    for i in range(n - 2, -1, -1):
        behind.append([plus([float(model.step[a][b]) + emit[i + 1][b] + behind[-1][b] for b in (0, 1)]) for a in (0, 1)])
    behind.reverse()
    z = plus(ahead[-1])
    return sum(math.exp(a[1] + b[1] - z) * s for a, b, s in zip(ahead, behind, size)) / float(size.sum())


def line_pairs(docs: list[tuple]) -> dict[int, tuple]:
    """doc_id: the text, and for each first holder of its lines the (later, first, words)
    rows with the length of their longest increasing run, by plain dynamic programming.
    Ids are unique and not null."""
    lines = {i: [x.strip() for x in (t or "").split("\n") if x.strip()] for i, t in docs}
    first: dict[tuple, tuple] = {}
    numbered = {}
    for i in sorted(lines):
        seen: Counter = Counter()
        numbered[i] = []
        for pos, x in enumerate(lines[i]):
            numbered[i].append((x, seen[x]))
            first.setdefault((x, seen[x]), (i, pos))
            seen[x] += 1
    out = {}
    for i, t in docs:
        pairs: dict[int, list] = {}
        for pos, key in enumerate(numbered[i]):
            f, fpos = first[key]
            if f != i:
                pairs.setdefault(f, []).append((pos, fpos, len(key[0].split())))
        gone = set()
        for rows in pairs.values():
            n = len(rows)
            best = [1] * n
            for a in range(n):
                for b in range(a):
                    if rows[b][1] < rows[a][1]:
                        best[a] = max(best[a], best[b] + 1)
            longest = max(best)
            gone.add((tuple(rows), longest))
        out[i] = (t, gone)
    return out
