"""Suffix arrays by induced sorting, with numpy: classify, sort leftmost-smaller substrings recursively, induce.

Many strings are sorted at once, each by itself. A step takes the next bucket of every string, with all entries
that the bucket induces in itself, which follow from the lengths of runs of equal symbols, and induces those in
other buckets; so there are as many steps as one string has distinct symbols, however many strings there are.
Only strings whose leftmost-smaller substrings aren't all different go on to the next level. Where a string has
too many symbols for that, as one long text has on the next level, a pass takes as many entries at once as it can:
up to the first place that one of them induces an entry at, as nothing before that place can change any more.
"""

from __future__ import annotations

import numpy as np


def ranges(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 ... many[0] of them, then starts[1] ..."""
    total = int(many.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(many) - many), many)


def _order(t: np.ndarray) -> np.ndarray:
    """A stable order; symbols of 16 bits are sorted by radix."""
    return np.argsort(t.astype(np.uint16) if len(t) and int(t.max()) < 1 << 16 else t, kind="stable")


def _ranks(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value how many equal ones come before it; the distinct values and their numbers."""
    order = _order(t)
    if not len(t):
        return order, t, order
    s = t[order]
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    head = np.flatnonzero(new)
    many = np.append(head[1:], len(s)) - head
    rank = np.empty(len(t), np.int64)
    rank[order] = np.arange(len(t)) - np.repeat(head, many)
    return rank, s[head], many


class _Strings:
    """Strings that lie one behind the other: buckets (of one string and symbol, ascending), types, runs."""

    def __init__(self, s: np.ndarray, edges: np.ndarray):
        n, self.edges = len(s), edges
        part = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        wide = int(s.max()) + 1
        if (len(edges) - 1) * wide < 4 * n + 1024:
            key = part * wide + s
            there = np.bincount(key, minlength=(len(edges) - 1) * wide)
            keys = np.flatnonzero(there)
            number = np.zeros(len(there), np.int32)
            number[keys] = np.arange(len(keys))
            self.b, many = number[key], there[keys]
        else:
            keys, b, many = np.unique(part * np.int64(wide) + s, return_inverse=True, return_counts=True)
            self.b = b.astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum(many)])
        self.first_bucket = np.searchsorted(keys // wide, np.arange(len(edges)))
        self.begins = np.zeros(n, bool)
        self.begins[edges[:-1]] = True
        differ = np.empty(n, bool)
        differ[-1] = True
        np.not_equal(s[1:], s[:-1], out=differ[:-1])
        differ[edges[1:] - 1] = True
        last = np.flatnonzero(differ)  # the last symbol of each run
        up = np.zeros(len(last), bool)
        inner = last[:-1]
        up[:-1] = s[inner] < s[inner + 1]
        up[np.searchsorted(last, edges[1:] - 1)] = False  # the end is less than any symbol
        many = np.diff(last, prepend=-1)
        self.is_s = np.repeat(up, many)
        self.run = (np.arange(n) - np.repeat(last - many + 1, many)).astype(np.int32)
        before = np.zeros(n, bool)
        before[1:] = self.is_s[:-1]
        self.lms = np.flatnonzero(self.is_s & ~before & ~self.begins)
        other = (self.run == 0) & ~self.begins
        #: the entry right before is of another bucket, and is a larger or a smaller suffix
        self.gives_l, self.gives_s = other & ~before, other & before
        self.n_s = np.bincount(self.b[self.is_s], minlength=len(many_of := np.diff(self.starts)))
        self.n_l = many_of - self.n_s
        self.n_lms = np.bincount(self.b[self.lms], minlength=len(many_of))
        self.steps = int(np.diff(self.first_bucket).max())

    def sort(self, lms: np.ndarray) -> np.ndarray:
        """The array that leftmost-smaller suffixes in the given order induce."""
        sa = np.full(len(self.b), -1, np.int32)
        b, back = self.b, lms[::-1]
        sa[self.starts[1:][b[back]] - 1 - _ranks(b[back])[0]] = back
        # the end of a string, which comes before everything, induces its last suffix: a larger one
        free, ends = self.starts[:-1].copy(), self.edges[1:] - 1
        sa[free[b[ends]]] = ends
        free[b[ends]] += 1
        if self.steps <= 300 or self.steps * 100 <= len(b):
            self._steps(sa, free)
        else:
            self._passes(sa, free)
        return sa

    def _steps(self, sa: np.ndarray, free: np.ndarray) -> None:
        """Induce bucket by bucket, in all strings at once."""
        b, starts = self.b, self.starts
        per = np.diff(self.first_bucket)
        at = np.arange(len(free)) - np.repeat(self.first_bucket[:-1], per)
        for larger in (True, False):
            when = at if larger else np.repeat(per, per) - 1 - at
            order = _order(when)
            bound = np.searchsorted(when[order], np.arange(self.steps + 1))
            if not larger:
                found = ranges(starts[1:] - self.n_lms, self.n_lms)
                sa[found] = -1
                free = starts[1:] - 1
            gives = self.gives_l if larger else self.gives_s
            for lo, hi in zip(bound[:-1], bound[1:]):
                mine = order[lo:hi]
                if larger:
                    size = free[mine] - starts[mine]
                    front = sa[ranges(starts[mine], size)]
                else:
                    size = starts[mine + 1] - 1 - free[mine]
                    front = sa[np.repeat(starts[mine + 1] - 1, size) - ranges(np.zeros(len(mine), np.int64), size)]
                # entry e induces e - 1, e - 2 ... in its own bucket, as far as its run of equal symbols reaches back
                step = self.run[front]
                total = int(step.sum())
                if total:
                    own = np.repeat(np.arange(len(front)), step)
                    k = ranges(np.zeros(len(front), np.int64), step)
                    of = np.repeat(np.arange(len(mine)), size)[own]
                    by = np.argsort(of * (int(step.max()) + 1) + k, kind="stable")  # by steps back, then as in the front
                    made = (front[own] - 1 - k)[by]
                    more = np.bincount(of, minlength=len(mine))
                    if larger:
                        sa[ranges(free[mine], more)] = made
                        free[mine] += more
                    else:
                        sa[np.repeat(free[mine], more) - ranges(np.zeros(len(mine), np.int64), more)] = made
                        free[mine] -= more
                    if larger:
                        front = sa[ranges(starts[mine], size + more)]
                    else:
                        front = sa[np.repeat(starts[mine + 1] - 1, size + more) - ranges(np.zeros(len(mine), np.int64), size + more)]
                # then those of the bucket that are of the other kind
                rest = (self.n_lms if larger else self.n_l)[mine]
                if rest.any():
                    rest = sa[ranges(starts[mine + 1] - rest, rest)] if larger else sa[np.repeat(starts[mine] + rest - 1, rest) - ranges(np.zeros(len(mine), np.int64), rest)]
                    front = np.concatenate([front, rest])
                j = front[gives[front]] - 1
                if len(j):
                    t = b[j]
                    rank, kinds, many = _ranks(t)
                    if larger:
                        sa[free[t] + rank] = j
                        free[kinds] += many
                    else:
                        sa[free[t] - rank] = j
                        free[kinds] -= many

    def _passes(self, sa: np.ndarray, free: np.ndarray) -> None:
        n, b = len(sa), self.b
        for larger in (True, False):
            if not larger:
                sa[ranges(self.starts[1:] - self.n_lms, self.n_lms)] = -1
                free = self.starts[1:] - 1
            # entries right before, also in the own bucket
            gives = ~self.begins
            gives[1:] &= self.is_s[:-1] != larger
            # strings are independent, and each one's entries are where its symbols are
            at, width = (0, 64) if larger else (n - 1, 64)
            while 0 <= at < n:
                view = sa[at : at + width] if larger else sa[max(0, at - width + 1) : at + 1][::-1]
                size = len(view)
                k = np.flatnonzero(view >= 0)
                k = k[gives[view[k]]]
                j = view[k] - 1
                if len(j):
                    t = b[j]
                    rank, kinds, many = _ranks(t)
                    place = free[t] + rank if larger else free[t] - rank
                    cut = int(place.min()) - at if larger else at - int(place.max())
                    if cut < min(size, 256) and sa[at] >= 0 and self.is_s[sa[at]] != larger:
                        size = self._bucket(sa, free, at, larger)
                        at += size if larger else -size
                        continue
                    if cut < size:
                        good = k < cut
                        j, place, size = j[good], place[good], cut
                        kinds, many = np.unique(t[good], return_counts=True)
                    sa[place] = j
                    if larger:
                        free[kinds] += many
                    else:
                        free[kinds] -= many
                width = min(1 << 20, width * 2) if size == width else max(64, 2 * size)
                at += size if larger else -size

    def _bucket(self, sa: np.ndarray, free: np.ndarray, at: int, larger: bool) -> int:
        """Settle the bucket at ``at`` at once, with what its entries induce in it, run by run."""
        b = self.b
        c = b[sa[at]]
        front = sa[at : free[c]] if larger else sa[free[c] + 1 : at + 1][::-1]
        step = self.run[front]
        total = int(step.sum())
        if total:
            own = np.repeat(np.arange(len(front)), step)
            k = ranges(np.zeros(len(front), np.int64), step)
            made = (front[own] - 1 - k)[np.argsort(k, kind="stable")]
            if larger:
                sa[free[c] : free[c] + total] = made
                free[c] += total
            else:
                sa[free[c] - total + 1 : free[c] + 1] = made[::-1]
                free[c] -= total
        zone = sa[at : free[c]] if larger else sa[free[c] + 1 : at + 1][::-1]
        j = zone[(self.gives_l if larger else self.gives_s)[zone]] - 1
        if len(j):
            rank, kinds, many = _ranks(b[j])
            if larger:
                sa[free[b[j]] + rank] = j
                free[kinds] += many
            else:
                sa[free[b[j]] - rank] = j
                free[kinds] -= many
        return len(zone)


def suffix_array(s: np.ndarray, edges: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of s, which holds integers from 0, in order; with edges (0 ... len(s), ascending) those of
    each string between two edges, one string behind the other."""
    s = np.asarray(s, np.int32)
    n = len(s)
    if n >= 1 << 31:
        raise ValueError("arrays are of less than 2^31 symbols")
    if n < 2:
        return np.arange(n)
    edges = np.array([0, n]) if edges is None else edges
    x = _Strings(s, edges)
    lms = x.lms
    if len(lms):
        sa = x.sort(lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = sa[is_lms[sa]]
        name = _names(s, order, lms, x)
        at = np.searchsorted(lms, edges)  # where each string's are
        twice = np.concatenate([[False], name[1:] == name[:-1]])
        # only strings that have a name twice go on
        own = np.searchsorted(at, np.arange(len(lms)), side="right") - 1
        on = np.zeros(len(edges) - 1, bool)
        on[own[twice]] = True
        if on.any():
            by_place = np.empty(n, np.int32)
            by_place[order] = name
            some = on[own]
            size = np.diff(at)[on]
            inner = suffix_array(by_place[lms[some]], np.concatenate([[0], np.cumsum(size)]))
            order[some] = lms[some][inner]
        lms = order
    return x.sort(lms)


def _names(s: np.ndarray, order: np.ndarray, lms: np.ndarray, x: _Strings) -> np.ndarray:
    """Names of the sorted leftmost-smaller substrings: equal ones of a string get equal names."""
    n = len(s)
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = lms[1:] - lms[:-1] + 1
    part = np.searchsorted(x.edges, lms, side="right")
    last = np.concatenate([part[1:] != part[:-1], [True]])
    length[lms[last]] = n + lms[last]  # the last one ends with the string and equals none
    a, b = order[:-1], order[1:]
    same = (length[a] == length[b]) & (x.b[a] == x.b[b])
    live = np.flatnonzero(same)
    step = 0
    while len(live):
        live = live[step < length[a[live]]]
        p, q = a[live] + step, b[live] + step
        good = (s[p] == s[q]) & (x.is_s[p] == x.is_s[q])
        same[live[~good]] = False
        live = live[good]
        step += 1
    return np.concatenate([[0], np.cumsum(~same)])


def permuted_lcp(s: np.ndarray, sa: np.ndarray, most: int, edges: np.ndarray | None = None) -> np.ndarray:
    """For each place in the text the length, up to most, that its suffix shares with the one before it in order.

    With edges, the first in order of each string shares nothing; lengths may reach beyond a string's end.

    Where both suffixes have the same symbol before them, the length is one less than at the place before; only
    the others are compared symbol by symbol, and their lengths add up to n log n at most.
    """
    n = len(s)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    begins = np.zeros(n, bool)
    if n:
        begins[0 if edges is None else edges[:-1]] = True
        phi[sa[begins]] = -1
    back = np.flatnonzero((phi > 0) & ~begins)
    back = back[~begins[phi[back]]]
    follows = np.zeros(n, bool)
    follows[back[s[back - 1] == s[phi[back] - 1]]] = True
    out = np.zeros(n, np.int32)
    live = np.flatnonzero((phi >= 0) & ~follows)
    step = 0
    while len(live):
        width = max(1, min(4096, (1 << 16) // len(live)))  # as few are left, more symbols at a time
        x, y = live + step, phi[live] + step
        room = np.minimum(n - np.maximum(x, y), width)
        ahead = np.arange(width)
        same = (s[np.minimum(x[:, None] + ahead, n - 1)] == s[np.minimum(y[:, None] + ahead, n - 1)]) & (ahead < room[:, None])
        whole = same.all(axis=1)
        out[live] = step + np.where(whole, width, np.argmin(same, axis=1))
        live = live[whole]
        step += width
    own = np.maximum.accumulate(np.where(follows, 0, np.arange(n, dtype=np.int32))) if n else out
    return np.minimum(out[own] - (np.arange(n, dtype=np.int32) - own), most) if n else out
