"""Plain and slow versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def crc(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def contamination(text, items, window=10):
    w, hit, found = ALNUM.findall(low(text)), set(), set()
    for item, t in items:
        v = ALNUM.findall(low(t))
        k = min(window, len(v))
        for j in range(len(v) - k + 1) if k else ():
            for a in range(len(w) - k + 1):
                if w[a : a + k] == v[j : j + k]:
                    hit.update(range(a, a + k))
                    found.add(str(item))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def repetition(text):
    text = text or ""
    w, cover = PLAIN.findall(text), set()
    many = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    for i in range(len(w) - 7):
        if many[tuple(w[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if PLAIN.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def jaccard(docs, size=5, percent=90):
    sets = []
    for _, t in docs:
        w = PLAIN.findall(low(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    links = defaultdict(set)
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(len(docs)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((docs[i][0], len(sets[i]), len(links[i]), min(docs[j][0] for j in seen)))
    return out


def repeats(docs, size=100):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    first, out = {}, []
    body = {d: (t or "").encode() for d, t in docs}
    for d in sorted(body):
        b = body[d]
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            if s in first:
                gone[i : i + size] = b"\1" * size
            else:
                first[s] = d
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


class Katz:
    """N-grams with Good-Turing discounts up to top; learns from lists of tokens."""

    def __init__(self, texts, order=3, top=5):
        self.top, self.order = top, order
        self.uni = Counter(t for x in texts for t in x)
        self.n = sum(self.uni.values())
        self.du = self._discounts(self.uni)
        self.after, self.d = {}, {}
        for k in range(2, order + 1):
            grams = Counter((tuple((["<s>"] * (k - 1) + x)[i : i + k - 1]), w) for x in texts for i, w in enumerate(x))
            self.d[k] = self._discounts(grams)
            self.after[k] = defaultdict(dict)
            for (h, w), c in grams.items():
                self.after[k][h][w] = c

    def _discounts(self, counts):
        n = Counter(counts.values())
        d = {r: (r - 0.5) / r for r in range(1, self.top + 1)}
        if all(n[r] for r in range(1, self.top + 2)):
            a = (self.top + 1) * n[self.top + 1] / n[1]
            if a < 1:
                g = {r: ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, self.top + 1)}
                if all(0 < x < 1 for x in g.values()):
                    d = g
        return d

    def word(self, w):
        if not self.n:
            return 1.0
        left = 1 - sum(self.du.get(c, 1) * c for c in self.uni.values()) / self.n
        scale = 1
        if left <= 1e-12:
            scale, left = self.n / (self.n + 1), 1 / (self.n + 1)
        c = self.uni.get(w, 0)
        return scale * self.du.get(c, 1) * c / self.n if c else left

    def p(self, h, w):
        if not h:
            return self.word(w)
        k = len(h) + 1
        after = self.after[k].get(h)
        if not after:
            return self.p(h[1:], w)
        c, d = sum(after.values()), self.d[k]
        left = sum((1 - d.get(x, 1)) * x for x in after.values()) / c
        scale = 1
        if left * c <= 1e-12:
            scale, left = c / (c + 1), 1 / (c + 1)
        x = after.get(w, 0)
        if x:
            return scale * d.get(x, 1) * x / c
        return left / (1 - sum(self.p(h[1:], v) for v in after)) * self.p(h[1:], w)

    def score(self, tokens):
        k = self.order - 1
        x = ["<s>"] * k + tokens
        return sum(math.log10(self.p(tuple(x[i : i + k]), w)) for i, w in enumerate(tokens))

    def base(self, tokens):
        v = len(self.uni)
        return sum(math.log10((self.uni.get(t, 0) + 0.5) / (self.n + 0.5 * (v + 1))) for t in tokens)


def tokens(text):
    return [*PLAIN.findall(low(text)), None]
