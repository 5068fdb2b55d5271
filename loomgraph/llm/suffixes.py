"""Removal of repeated byte strings by suffix arrays.

A byte is removed if some string of ``size`` bytes that covers it also starts earlier: in a text of lesser
id, or before it in the same text. Texts are UTF-8 bytes, and strings are judged on the input.

Equal strings of ``size`` bytes choose the same anchor, the least hash of a short substring in them, at the
same place; so only strings with equal anchors need to be held against each other.

1. Each block of texts finds the anchors of all its strings. The strings of one anchor make a region. Equal
   regions of a block are settled there; of each, the first goes to its anchor's bucket.
2. A bucket settles equal regions of different blocks. Where anchors have differing regions, groups of ``STRETCH``
   or more neighbouring strings whose core, which all strings of a group contain, other regions may have too (16
   bits of its hash came with the region) are cut out of the texts, with the whole hash of the core as their shard.
3. A shard array holds the stretches whose core occurs in several; equal stretches are settled first. Induced
   sorting orders its suffixes, and permuted common prefixes of at least ``size`` show which strings repeat.

An anchor with over ``MANY`` regions in one block, as the end of a passage has that many texts quote, is flagged: its
strings are sent one by one, as their own hash without their bytes, so that only copies of one string ever come
together, one a block. An anchor with over ``MANY`` regions in its bucket is hot. Most of those regions have nothing
but a common phrase in common, so they wait, group by group, for another one with the same bits of a core: groups of
up to ``MANY`` with the same bits are cut out, and the strings of larger ones sent one by one. Settling in blocks
before anything is shuffled and hashing wholes bounds every group; nothing is broadcast or collected.

There are as many buckets as ``BUCKET`` goes into the bytes of all texts, each a task of its own that reads its
records one by one, so neither a task's bytes nor its memory grow with the input: what it keeps is settled
whenever ``HELD`` regions have come together, and arrays are made of ``PART`` bytes of shards at a time. Texts of
over ``RUN`` bytes are looked at in pieces. What is removed travels as maximal intervals of a text.

Null and empty texts have no bytes. Rows whose id is null aren't compared with any and keep all their
bytes. Rows with the same id and text are one text; rows with one id and different texts are compared as
texts of that id, by place. Ids are integers, as they tell which text is earlier; others raise a TypeError. Other
columns aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.llm import textbuf as tb
from loomgraph.llm.common import checked, finished, fresh, map_rows, text_buckets, two, written
from loomgraph.llm.katz import pack, unpack
from loomgraph.llm.sais import permuted_lcp, suffix_array

GRAM = 24
STRETCH = 32
#: bytes of text looked at at once
RUN = 1 << 18
MANY = 256
#: bytes of all texts for each bucket; regions that a bucket keeps before it settles them; bytes of stretches in an array
BUCKET = 8 << 20
HELD = 250_000
PART = 1 << 20
ANCHORS, GONE, STRETCHES, ASK, STRINGS = range(5)
#: id and text say which text it is (text by its hash); GONE: bytes from a to b; ASK: strings from a to b, whose anchor is back after a
FLAT = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("text", T.LongType()),
    T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("back", T.IntegerType()), T.StructField("group", T.IntegerType()), T.StructField("blob", T.BinaryType()),
])


def batch(schema: pa.Schema, n: int, **cols) -> pa.RecordBatch:
    made = []
    for f in schema:
        x = cols.get(f.name)
        if x is None:
            made.append(pa.nulls(n, f.type))
        elif isinstance(x, (int, np.integer)):
            made.append(pa.array(np.full(n, x), f.type))
        else:
            made.append(pa.array(x, f.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)


def anchors(run: tb.Run, size: int) -> tuple[np.ndarray, ...]:
    """Regions of a run: first and last string, anchor's place, document."""
    n, w = len(run.data), size - GRAM + 1
    m = n - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none
    at = np.arange(m)
    bits = int(n).bit_length()
    low = (tb.U64(1) << tb.U64(bits)) - tb.U64(1)
    v = (run.span_hash(at, at + GRAM, False) & ~low) | at.astype(tb.U64)
    pad = -m % w
    v = np.concatenate([v, np.full(pad, ~tb.U64(0))]).reshape(-1, w)
    down = np.minimum.accumulate(v, axis=1).ravel()
    up = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    k = n - size + 1
    best = (np.minimum(up[:k], down[w - 1 : w - 1 + k]) & low).astype(np.int64)
    doc = np.repeat(np.arange(run.n), np.diff(run.offs))[:k]
    fits = np.arange(k) + size <= run.offs[doc + 1]
    s = np.flatnonzero(fits)
    if not len(s):
        return none, none, none, none
    p = best[s]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)])
    head = np.flatnonzero(new)
    last = np.concatenate([head[1:], [len(s)]]) - 1
    return s[head], s[last], p[head], doc[s[head]]


def pieces(column: pa.Array, more: int) -> Iterator[tuple[tb.Run, int, int]]:
    """Runs of a column of texts; of a piece of a long text also which bytes it stands for, more of which follow in it."""
    for run in tb.runs(column, RUN):
        if len(run.data) <= 2 * RUN:
            yield run, 0, len(run.data)
            continue
        for x in range(0, len(run.data), RUN):
            data = run.data[x : x + RUN + more]
            yield tb.Run(data, np.array([0, len(data)]), run.first), x, x + RUN


def lost(schema: pa.Schema, buckets: int, ids: np.ndarray, texts: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """GONE rows: the maximal intervals of each text."""
    if not len(ids):
        return batch(schema, 0)
    order = np.lexsort((a, texts, ids))
    ids, texts, a, b = ids[order], texts[order], a[order], b[order]
    own = np.cumsum(np.concatenate([[False], (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])])).astype(np.int64) << 40
    reach = np.maximum.accumulate(b + own)
    head = np.flatnonzero(np.concatenate([[True], (a + own)[1:] > reach[:-1]]))
    end = (reach - own)[np.concatenate([head[1:], [len(ids)]]) - 1]
    return batch(schema, len(head), kind=GONE, bucket=(a[head] % buckets).astype(np.int32), id=ids[head], text=texts[head], a=a[head], b=end)


def grouped(size: int) -> int:
    """How many neighbouring strings make a group: an anchor has three groups at most."""
    return max(STRETCH, -(-(size - GRAM + 1) // 3))


def cores(run: tb.Run, a: np.ndarray, b: np.ndarray, p: np.ndarray, size: int) -> np.ndarray:
    """16 bits from 1 of the core hash of each group of each region, group by group; 0 where it has no string of it."""
    g, out = grouped(size), np.zeros(len(a), tb.U64)
    for q in range(3):
        k = np.flatnonzero(((p - b) // g <= q) & ((p - a) // g >= q))
        h = run.span_hash(p[k] - q * g, p[k] - (q + 1) * g + 1 + size, False) >> tb.U64(48)
        out[k] |= np.maximum(h, tb.U64(1)) << tb.U64(16 * q)
    return out


def settle(keys: tuple[np.ndarray, ...], ids: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each group of equal keys, by id and place; and which of the others start later than theirs.

    The firsts are in the order of the keys.
    """
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    # only groups of several are sorted by id and place
    alone = new & np.concatenate([new[1:], [True]])
    some = np.flatnonzero(~alone)
    if len(some):
        group = np.cumsum(new)[some]
        mine = order[some]
        order[some] = mine[np.lexsort((a[mine], ids[mine], group))]
    head = np.flatnonzero(new)
    own = np.repeat(order[head], np.diff(np.concatenate([head, [len(order)]])))
    later = (ids[order] != ids[own]) | (a[order] != a[own])
    return order[head], order[later]


def expand(a: np.ndarray, b: np.ndarray, p: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Groups of neighbouring strings: the region's number, first and last string, and the group's place by the anchor."""
    lo, hi = (p - b) // group, (p - a) // group
    many = hi - lo + 1
    own = np.repeat(np.arange(len(a)), many)
    q = lo[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    g, anchor = group[own], p[own]
    return own, np.maximum(a[own], anchor - (q + 1) * g + 1), np.minimum(b[own], anchor - q * g), q


def stretches(run: tb.Run, a: np.ndarray, b: np.ndarray, p: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Region, first string, number of strings, shard and whole hash of each stretch, with places in the run."""
    own, first, last, q = expand(a, b, p, group)
    g, anchor = group[own], p[own]
    core = run.span_hash(anchor - q * g, anchor - (q + 1) * g + 1 + size, False)
    shard = tb.mix(core + q.astype(tb.U64) * tb.STEPS[5] + g.astype(tb.U64) * tb.STEPS[6])
    whole = run.span_hash(first, last + size, False) + (anchor - first).astype(tb.U64) * tb.STEPS[7]
    return own, first, last - first + 1, shard, whole


def cut_bytes(run: tb.Run, first: np.ndarray, many: np.ndarray, size: int) -> np.ndarray:
    n = many + size - 1
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return run.data[np.repeat(first, n) + step]


class Sender:
    """Settles equal stretches of a task and packs the rest by bucket; of groups of one string only the hashes."""

    def __init__(self, schema: pa.Schema, buckets: int, size: int):
        self.schema, self.buckets, self.size, self.rows, self.strings, self.held = schema, buckets, size, [], [], 0

    def add(self, run: tb.Run, a, b, p, group, ids, texts, base) -> None:
        """ids, texts, base: of each region; base is where its document begins in the run."""
        for one in (True, False):
            m = np.flatnonzero((group == 1) == one)
            if len(m):
                (self._strings if one else self._stretches)(run, *(x[m] for x in (a, b, p, group, ids, texts, base)))
        run.rest()

    def _strings(self, run: tb.Run, a, b, p, group, ids, texts, base) -> None:
        own, first, _, shard, _ = stretches(run, a, b, p, group, self.size)
        keep, later = settle((shard,), ids[own], first - base[own])
        at = first - base[own]
        self.strings.append(((ids[own[keep]], texts[own[keep]], at[keep], shard[keep]), (ids[own[later]], texts[own[later]], at[later], at[later] + self.size)))
        self.held += 32 * len(own)

    def _stretches(self, run: tb.Run, a, b, p, group, ids, texts, base) -> None:
        own, first, many, shard, whole = stretches(run, a, b, p, group, self.size)
        keep, later = settle((shard, whole), ids[own], first - base[own])
        late = own[later], first[later], many[later]
        own, first, many, shard, whole = (x[keep] for x in (own, first, many, shard, whole))
        data = cut_bytes(run, first, many, self.size)
        self.rows.append(((ids[own], texts[own], first - base[own], many, shard, whole, data), (ids[late[0]], texts[late[0]], late[1] - base[late[0]], late[1] - base[late[0]] + late[2] + self.size - 1)))
        self.held += len(data) + 48 * len(own) + 32 * len(later)

    def flush(self) -> Iterator[pa.RecordBatch]:
        yield from self._flush_strings()
        yield from self._flush_stretches()
        self.held = 0
        tb.release()

    def _sent(self, kind: int, bucket: np.ndarray, packed: Callable[[int, int], bytes]) -> Iterator[pa.RecordBatch]:
        """A row for each bucket, of which there are entries in the sorted column; packed gets the first and the one after the last."""
        at = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for lo in range(0, self.buckets, 64):
            rows = [(k, packed(at[k], at[k + 1])) for k in range(lo, min(lo + 64, self.buckets)) if at[k + 1] > at[k]]
            if rows:
                yield batch(self.schema, len(rows), kind=kind, bucket=[k for k, _ in rows], blob=[x for _, x in rows])

    def _flush_strings(self) -> Iterator[pa.RecordBatch]:
        if not self.strings:
            return
        ids, texts, first, shard = (np.concatenate(x) for x in zip(*(r[0] for r in self.strings)))
        gone = [np.concatenate(x) for x in zip(*(r[1] for r in self.strings))]
        self.strings = []
        keep, later = settle((shard,), ids, first)
        yield lost(self.schema, self.buckets, *(np.concatenate([x, y[later]]) for x, y in zip(gone, (ids, texts, first, first + self.size))))
        bucket = (shard[keep] % tb.U64(self.buckets)).astype(np.int64)
        order = np.lexsort((first[keep], texts[keep], ids[keep], bucket))
        bucket, mine = bucket[order], keep[order]

        def packed(i: int, j: int) -> bytes:
            m = mine[i:j]
            head = np.flatnonzero(np.concatenate([[True], (ids[m[1:]] != ids[m[:-1]]) | (texts[m[1:]] != texts[m[:-1]])]))
            return pack(ids[m[head]].view(np.uint64), texts[m[head]].view(np.uint64), np.diff(np.append(head, len(m))), first[m], shard[m])

        yield from self._sent(STRINGS, bucket, packed)

    def _flush_stretches(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        ids, texts, first, many, shard, whole, data = (np.concatenate(x) for x in zip(*(r[0] for r in self.rows)))
        gone = [np.concatenate(x) for x in zip(*(r[1] for r in self.rows))]
        self.rows = []
        n = many + self.size - 1
        keep, later = settle((shard, whole), ids, first)
        yield lost(self.schema, self.buckets, *(np.concatenate([x, y[later]]) for x, y in zip(gone, (ids, texts, first, first + n))))
        ends = np.cumsum(n)
        bucket = (shard[keep] % tb.U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, of = bucket[order], keep[order]

        def packed(i: int, j: int) -> bytes:
            mine = of[i:j]
            step = np.arange(n[mine].sum()) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
            body = data[np.repeat(ends[mine] - n[mine], n[mine]) + step]
            return pack(ids[mine].view(np.uint64), texts[mine].view(np.uint64), first[mine], many[mine], shard[mine], whole[mine], body)

        yield from self._sent(STRETCHES, bucket, packed)


def first_pass(size: int, buckets: int, block_bytes: int, most: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(FLAT)
        sender, held, runs, found = Sender(schema, buckets, size), 0, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            a, b, p, ids, texts, base, key, whole, core = (np.concatenate(x) for x in zip(*found))
            where = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            keep, later = settle((key, whole), ids, a - base)
            yield lost(schema, buckets, ids[later], texts[later], (a - base)[later], (b - base)[later] + size)
            # anchors that are flagged: too many regions in this block alone
            k = key[keep]
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            many = np.diff(np.concatenate([head, [len(k)]]))
            hot = np.repeat(many > most, many)
            for i in np.unique(where[keep[hot]]).tolist():
                mine = keep[hot][where[keep[hot]] == i]
                sender.add(runs[i], a[mine], b[mine], p[mine], np.ones(len(mine), np.int64), ids[mine], texts[mine], base[mine])
            yield from sender.flush()
            flags = key[keep[head[many > most]]] if len(head) else key[:0]
            rest = keep[~hot]
            of = (key[rest] % tb.U64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            rest, of = rest[order], of[order]
            at = np.searchsorted(of, np.arange(buckets + 1))
            flag_of = (flags % tb.U64(buckets)).astype(np.int64)
            rows = []
            for x, (i, j) in enumerate(zip(at[:-1], at[1:])):
                m, f = rest[i:j], flags[flag_of == x] if len(flags) else flags
                if len(m) or len(f):
                    pairs, which = np.unique(np.stack([ids[m], texts[m]]), axis=1, return_inverse=True)
                    rows.append((x, pack(np.diff(key[m], prepend=tb.U64(0)), whole[m], pairs[0].view(np.uint64), pairs[1].view(np.uint64), which.ravel(), (a - base)[m], (b - a)[m], (p - a)[m], core[m], f)))
            yield batch(schema, len(rows), kind=ANCHORS, bucket=[x for x, _ in rows], blob=[x for _, x in rows])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = b.column(1).to_numpy(zero_copy_only=False)
            for run, before, _ in pieces(b.column(2), size - 1):
                lo, hi, p, doc = anchors(run, size)
                key = run.span_hash(p, p + GRAM, False) >> tb.U64(16)  # unequal anchors with equal keys only cost a comparison
                whole = (run.span_hash(lo, hi + size, False) + (p - lo).astype(tb.U64) * tb.STEPS[8]) >> tb.U64(8)  # regions are equal if both agree
                found.append((lo, hi, p, ids[run.first + doc], texts[run.first + doc], run.offs[doc] - before, key, whole, cores(run, lo, hi, p, size)))
                runs.append(run.rest())
                held += len(run.data)
                if held >= block_bytes:
                    yield from flush()
                    runs, found, held = [], [], 0
                    tb.release()
        if runs:
            yield from flush()
            tb.release()

    return apply


def heads(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of a sorted column begins, and how many are in it."""
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return head, np.diff(np.append(head, len(key)))


def compare_regions(size: int, buckets: int, most: int, held: int) -> Callable:
    """A bucket of anchors: equal regions are settled, differing ones asked for; other rows pass."""
    g = grouped(size)
    none = lambda n: [np.zeros(0, tb.U64 if i in (0, 1, 7) else np.int64) for i in range(n)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(FLAT)
        hot, flagged, kept, more_, count = np.zeros(0, tb.U64), np.zeros(0, tb.U64), none(8), [], 0
        # of hot anchors, for each group: regions under code (anchor and bits of the core), whole; and codes whose strings are sent one by one
        waiting, singly = [none(7) for _ in range(3)], [np.zeros(0, tb.U64) for _ in range(3)]

        def asked(q: int, x: list[np.ndarray], group: int) -> pa.RecordBatch:
            """The strings of a group of regions, from back - (q + 1) g + 1 to back - q g, counted from the region's first."""
            ids, texts, a, more, back = x
            lo, hi = np.maximum(0, back - (q + 1) * g + 1), np.minimum(more, back - q * g)
            return batch(schema, len(ids), kind=ASK, id=ids, text=texts, a=a + lo, b=a + hi, back=back - lo, group=group)

        def coded(x: list[np.ndarray], q: int) -> list[np.ndarray]:
            mine = (x[7] >> tb.U64(16 * q)) & tb.U64((1 << 16) - 1)
            k = np.flatnonzero(mine)
            return [(x[0][k] << tb.U64(16)) | mine[k], *(c[k] for c in x[1:7])]

        def parted(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Regions of hot anchors join those that wait; codes of too many are asked for string by string, at once and from now on."""
            for q in range(3):
                w = [np.concatenate(c) for c in zip(waiting[q], coded(x, q))]
                keep, later = settle((w[0], w[1]), w[2], w[4])
                yield lost(schema, buckets, w[2][later], w[3][later], w[4][later], w[4][later] + w[5][later] + size)
                w = [c[keep] for c in w]
                head, many = heads(w[0])
                code = w[0][head]
                due = (many > most) | np.isin(code, singly[q]) | np.isin(code >> tb.U64(16), flagged)
                if len(w[0]) > 4 * held:
                    due |= many > 1
                singly[q] = np.union1d(singly[q], code[due])
                go = np.repeat(due, many)
                yield asked(q, [c[go] for c in w[2:]], 1)
                waiting[q] = [c[~go] for c in w]

        def alike(q: int, w: list[np.ndarray]) -> pa.RecordBatch:
            """Groups of strings whose core several of an anchor's regions may have."""
            order = np.argsort(w[0], kind="stable")
            _, many = heads(w[0][order])
            k = order[np.repeat(many > 1, many)]
            return asked(q, [c[k] for c in w[2:]], g)

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            """Settle what has come together; regions of hot anchors wait by their cores' bits."""
            nonlocal hot, kept, more_, count
            x = [np.concatenate(c) for c in zip(kept, *more_)]
            more_, count = [], 0
            keep, later = settle((x[0], x[1]), x[2], x[4])
            yield lost(schema, buckets, x[2][later], x[3][later], x[4][later], x[4][later] + x[5][later] + size)
            x = [c[keep] for c in x]
            k = x[0]
            head, many = heads(k)
            hot = np.union1d(hot, k[head[many > most]])
            warm = np.repeat(np.isin(k[head], hot), many)
            yield from parted([c[warm] for c in x])
            kept = [c[~warm] for c in x]
            if last:
                for q in range(3):
                    yield alike(q, waiting[q])
                    yield alike(q, coded(kept, q))
            tb.release()

        for b in batches:
            kinds = b.column(0).to_numpy()
            if (kinds != ANCHORS).any():
                yield b.filter(pa.array(kinds != ANCHORS))
            for blob in b.column(8).filter(pa.array(kinds == ANCHORS)):
                key, whole, i, t, which, a, more, back, core, flags = unpack(blob.as_py())
                which = which.astype(np.int64)
                hot, flagged = np.union1d(hot, flags), np.union1d(flagged, flags)
                more_.append((np.cumsum(key, dtype=np.uint64), whole, i[which].view(np.int64), t[which].view(np.int64), a.astype(np.int64), more.astype(np.int64), back.astype(np.int64), core))
                count += len(key)
                if count >= held:
                    yield from settled(False)
        yield from settled(True)

    return apply


def cut_out(size: int, buckets: int, block_bytes: int) -> Callable:
    """Stretches that were asked for, of texts that carry their regions."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(FLAT)
        sender = Sender(schema, buckets, size)
        for b in batches:
            lists = b.column(3)
            offs, flat = lists.offsets.to_numpy(), lists.values
            a, more, back, group = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
            last = a + more
            ids, texts = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for k in range(0, b.num_rows, 64):
                for run, before, until in pieces(unzipped(b.column(2).slice(k, 64)), 2 * size):
                    first = k + run.first
                    i, j = offs[first], offs[first + run.n]
                    row = np.repeat(np.arange(run.n), np.diff(offs[first : first + run.n + 1]))
                    mine = np.arange(i, j)
                    on = (a[i:j] >= before) & (a[i:j] < until)
                    mine, row = mine[on], row[on]
                    base = run.offs[row] - before
                    sender.add(run, a[mine] + base, last[mine] + base, a[mine] + back[mine] + base, group[mine], ids[first + row], texts[first + row], base)
                    if sender.held >= block_bytes:
                        yield from sender.flush()
        yield from sender.flush()

    return apply


def repeated(size: int, data: np.ndarray, n: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches of n bytes that lie one behind the other in data, shard by shard: each string of size bytes as its
    stretch, its place there, and a number that equal strings share."""
    size_of = n + 1  # each is followed by a 0, less than any byte
    at = np.cumsum(size_of) - size_of
    own = np.repeat(np.arange(len(n), dtype=np.int32), size_of)
    step = np.arange(len(own), dtype=np.int32) - at[own].astype(np.int32)
    real = step < n[own]
    string = np.zeros(len(own), np.int32)
    string[real] = data.astype(np.int32) + 1
    new = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    edges = np.append(at, len(own))[new]
    order = suffix_array(string, edges)
    left = (n[own] - step).astype(np.int32)
    common = np.minimum(permuted_lcp(string, order, size, edges), left)[order]
    # a run of suffixes that share size bytes with the one before is one string
    string_of = np.cumsum(common < size)
    fits = left[order] >= size
    place, string_of = order[fits], string_of[fits]
    return own[place], step[place], string_of


def shard_arrays(size: int, buckets: int, part: int, held: int) -> Callable:
    """Repeated strings of a bucket of stretches and of single strings; other rows pass."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(FLAT)
        got, alone, more, count = [], [np.zeros(0, tb.U64 if i == 3 else np.int64) for i in range(4)], [], 0

        def settled() -> pa.RecordBatch:
            """Of equal strings the first is kept."""
            nonlocal alone, more, count
            ids, texts, first, shard = x = [np.concatenate(c) for c in zip(alone, *more)]
            keep, later = settle((shard,), ids, first)
            alone, more, count = [c[keep] for c in x], [], 0
            return lost(schema, buckets, ids[later], texts[later], first[later], first[later] + size)

        for b in batches:
            kinds = b.column(0).to_numpy()
            if (kinds == GONE).any():
                yield b.filter(pa.array(kinds == GONE))
            got += [unpack(x.as_py(), as_bytes=6) for x in b.column(8).filter(pa.array(kinds == STRETCHES))]
            for x in b.column(8).filter(pa.array(kinds == STRINGS)):
                i, t, many, first, shard = unpack(x.as_py())
                own = np.repeat(np.arange(len(i)), many.astype(np.int64))
                more.append((i[own].view(np.int64), t[own].view(np.int64), first.astype(np.int64), shard))
                count += len(own)
                if count >= held:
                    yield settled()
        yield settled()
        alone = None
        if not got:
            return
        cat = lambda xs: np.concatenate(list(xs))
        ids, texts = (cat(g[i].view(np.int64) for g in got) for i in (0, 1))
        first, many = (cat(g[i].astype(np.int64) for g in got) for i in (2, 3))
        shard, whole = (cat(g[i] for g in got) for i in (4, 5))
        data = cat(g[6] for g in got)
        del got
        n = many + size - 1
        begin = np.cumsum(n) - n
        keep, later = settle((shard, whole), ids, first)
        yield lost(schema, buckets, ids[later], texts[later], first[later], first[later] + n[later])
        k = shard[keep]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        alike = np.diff(np.concatenate([head, [len(k)]]))
        keep = keep[np.repeat(alike > 1, alike)]
        k = shard[keep]
        # shards lie whole in the parts; equal strings have equal cores, so other parts can't hold them
        done = np.cumsum(n[keep])
        i = 0
        while i < len(keep):
            j = int(np.searchsorted(done, (done[i - 1] if i else 0) + part, side="right"))
            j = max(j, i + 1)
            j = int(np.searchsorted(k, k[j - 1], side="right"))
            mine = keep[i:j]
            step = np.arange(n[mine].sum()) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
            own, place, string = repeated(size, data[np.repeat(begin[mine], n[mine]) + step], n[mine], k[i:j])
            row = mine[own]
            where = first[row] + place
            _, again = settle((string,), ids[row], where)
            yield lost(schema, buckets, ids[row[again]], texts[row[again]], where[again], where[again] + size)
            i = j
        tb.release()

    return apply


def zipped(df: DataFrame, at: int) -> DataFrame:
    """df with its text column compressed, to be shuffled."""
    out = T.StructType([f if i != at else T.StructField(f.name, T.BinaryType()) for i, f in enumerate(df.schema)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, s = zstandard.ZstdCompressor(level=3), to_arrow_schema(out)
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([None if x is None else c.compress(x.encode()) for x in cols[at].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, s)], schema=s)

    return df.mapInArrow(apply, out)


def unzipped(column: pa.Array) -> pa.Array:
    d = zstandard.ZstdDecompressor()
    return pa.array([b"" if x is None else d.decompress(x) for x in column.to_pylist()], pa.large_binary())


def spans(docs: DataFrame, id_col: str, text_col: str, size: int = 100, block_bytes: int = 5 << 20, most: int = MANY, bucket_bytes: int = BUCKET, held: int = HELD, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Texts as id, text (their hash), body (compressed), a row for each row; and for those that lose bytes id, text, gone (a, b)."""
    if size <= GRAM:
        raise ValueError(f"strings must have over {GRAM} bytes")
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold integers, not {docs.schema[id_col].dataType.simpleString()}")
    rows = two(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("text"), F.col("text").alias("body"))
    return zipped(rows, 2), finished(docs.sparkSession, lambda: _gone(rows, size, block_bytes, most, bucket_bytes, held, part), "gone")


def _gone(rows: DataFrame, size: int, block_bytes: int, most: int, bucket_bytes: int, held: int, part: int) -> DataFrame:
    buckets = text_buckets(rows, "body", bucket_bytes)
    known = rows.where("id is not null and body is not null")
    first = known.mapInArrow(first_pass(size, buckets, block_bytes, most), FLAT)
    settled = written(first.repartitionById(buckets, F.col("bucket")).mapInArrow(compare_regions(size, buckets, most, held), FLAT), "regions")
    asked = settled.where(F.col("kind") == ASK).repartition(buckets, "id", "text").groupBy("id", "text").agg(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), (F.col("b") - F.col("a")).cast("int").alias("more"), "back", "group")).alias("ask"))
    wanted = checked(settled.where(F.col("kind") == ASK).select("id", "text").distinct())
    cut = zipped(rows.where("id is not null and body is not null").join(wanted, ["id", "text"], "left_semi").select("id", "text", "body"), 2).repartition(buckets, "id", "text").join(asked, ["id", "text"]).select("id", "text", "body", "ask").mapInArrow(cut_out(size, buckets, block_bytes), FLAT)
    # stretches lie on disk once, as what is shuffled; what was lost before passes
    late = cut.unionByName(settled.where(F.col("kind").isin(STRETCHES, STRINGS)))
    shards = late.repartitionById(buckets, F.col("bucket")).mapInArrow(shard_arrays(size, buckets, part, held), FLAT)
    take = lambda d: d.where(F.col("kind") == GONE).select("id", "text", "a", "b")
    every = take(settled).unionByName(take(shards))
    return every.groupBy("id", "text").agg(F.collect_list(F.struct("a", "b")).alias("gone"))


def merged(pairs: np.ndarray) -> np.ndarray:
    """Maximal runs of intervals, two of which that touch are one."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    head = np.flatnonzero(new)
    return np.stack([pairs[head, 0], reach[np.concatenate([head[1:], [len(pairs)]]) - 1]], axis=1)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, **options) -> DataFrame:
    """For each row n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), spans removed (start, end)."""
    texts, gone = spans(docs, id_col, text_col, size, **options)
    both = texts.join(gone, ["id", "text"], "left").select("id", "body", "gone")
    key = docs.schema[id_col].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([
        T.StructField("id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
        T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", span),
    ])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, d = to_arrow_schema(out), zstandard.ZstdDecompressor()
        for b in batches:
            lists = b.column(2)
            offs = lists.offsets.to_numpy()
            pairs = np.stack([lists.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
            has = lists.is_valid().to_numpy(zero_copy_only=False)
            cols = [[] for _ in range(6)]
            for k, body in enumerate(b.column(1).to_pylist()):
                raw = b"" if body is None else d.decompress(body)
                cut = merged(pairs[offs[k] : offs[k + 1]]) if has[k] and offs[k + 1] > offs[k] else np.zeros((0, 2), np.int64)
                kept, at = [], 0
                for i, j in cut.tolist():
                    kept.append(raw[at:i])
                    at = j
                kept = b"".join([*kept, raw[at:]])
                values = len(raw), len(raw) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), kept, [{"start": i, "end": j} for i, j in cut.tolist()]
                for c, x in zip(cols, values):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(s)[1:]))], schema=s)

    made = both.mapInArrow(apply, out)
    return made.select(F.col("id").cast(key).alias(id_col), *made.columns[1:])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100) -> DataFrame:
    """docs, with all columns, its texts less the repeated bytes and less what is left of characters cut by that; n_chars, if there, follows."""
    _, gone = spans(docs, id_col, text_col, size)
    a, b, c = fresh(docs, "id", "text", "gone")
    gone = gone.select(F.col("id").alias(a), F.col("text").alias(b), F.col("gone").alias(c))
    same = (F.col(f"`{id_col}`").cast("long") == F.col(a)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(b))
    keys = checked(gone.select(a, b))
    # only texts that lose bytes meet their intervals; the rest of the table isn't shuffled while these are few
    both = docs.join(keys, same, "left_semi").join(gone, same).drop(a, b).union(docs.join(keys, same, "left_anti").withColumn(c, F.lit(None).cast(gone.schema[c].dataType)))
    at, docs_schema = docs.columns.index(text_col), docs.schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(docs_schema)
        for b in batches:
            lists = b.column(b.num_columns - 1)
            new = b.column(at).to_pylist()
            for k in pc.indices_nonzero(lists.is_valid()).to_pylist():
                t, cut = new[k], lists[k].values
                if t:
                    raw, kept, x = t.encode(), [], 0
                    for i, j in merged(np.stack([cut.field(f).to_numpy() for f in (0, 1)], axis=1)).tolist():
                        kept.append(raw[x:i])
                        x = j
                    new[k] = b"".join([*kept, raw[x:]]).decode("utf-8", "ignore")
            cols = list(b.columns)[:-1]
            cols[at] = pa.array(new, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    made = map_rows(both, apply, docs.schema)
    return made.withColumn("n_chars", F.char_length(F.col(f"`{text_col}`")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made
