"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the windows of ``window`` consecutive words of each benchmark item; an item of
fewer words is one shorter window. Windows of one length make one search: a shift table over blocks of
two words says how far a text position may skip, positions with shift 0 look their last words up in
suffix-hash buckets, and what a bucket holds is compared word by word and byte by byte. All stretches of
a batch advance side by side in numpy.

The benchmark is cut into blocks of about ``block_bytes``. The driver makes the tables of one block after the other
and broadcasts them; a worker holds those of one block at a time, and goes through the blocks for each few MB of text,
in one pass over the documents without a shuffle. So neither's memory grows with the benchmark.

Null and empty texts have no words; long ones are searched whole. The words of an item with a null id count as hits,
but it isn't named among the items; the SQL leaves such items out. Repeated rows of documents give repeated rows;
repeated items count once; an empty benchmark contaminates nothing, and an empty table of documents gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.llm import textbuf as tb
from loomgraph.llm.common import keep_runs, two

STRETCH = 512
NOTHING = hashlib.sha256(b"").hexdigest()
_MUL = tb.U64(0x9E3779B97F4A7C15)


@dataclass
class Search:
    """Tables for the windows of one length."""

    size: int
    shift: np.ndarray
    bits: int
    starts: np.ndarray
    suffixes: np.ndarray
    items: np.ndarray
    item_offs: np.ndarray


class Patterns:
    """Words of a block of items as numbers from 1, and the searches for its windows."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        self.names = sorted({i for i, _ in items}, key=lambda x: (x is None, x))
        number = {x: i for i, x in enumerate(self.names)}
        owner = np.array([number[i] for i, _ in items], np.int64)
        hashes, spans, counts = [], [], []
        for run in tb.runs(texts):
            w = run.words(tb.ALNUM)
            hashes.append(w.hashes(True))
            counts.append(w.counts)
            low = tb.LOWER[run.data].tobytes()
            spans += [low[a:b] for a, b in zip(w.starts, w.ends)]
        h = np.concatenate(hashes) if hashes else np.zeros(0, tb.U64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        ids: dict[bytes, int] = {}
        self.stream = np.array([ids.setdefault(x, len(ids) + 1) for x in spans], np.int32)
        vocab = list(ids)
        keys = np.zeros(len(vocab), tb.U64)
        keys[self.stream - 1] = h
        order = np.argsort(keys, kind="stable")
        self.keys, self.numbers = keys[order], (order + 1).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(vocab), np.uint8)
        self.byte_offs = np.concatenate([[0], np.cumsum([len(x) for x in vocab], dtype=np.int64)]).astype(np.int64)
        offs = np.concatenate([[0], np.cumsum(n)])
        groups: dict[int, list[np.ndarray]] = defaultdict(list)
        for i, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
            k = min(window, int(b - a))
            if k:
                at = np.arange(a, b - k + 1)
                groups[k].append(np.stack([at, np.full(len(at), owner[i])]))
        self.searches = [self._search(k, np.concatenate(g, axis=1)) for k, g in sorted(groups.items())]

    def _search(self, k: int, found: np.ndarray) -> Search:
        starts, owners = found
        stream = self.stream
        full = tb.windows(np.concatenate([stream.astype(tb.U64), np.zeros(k, tb.U64)]), k)[starts]
        _, first, inverse = np.unique(full, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([inverse, owners]), axis=1)
        starts = starts[first]
        bits = max(12, min(22, int(np.ceil(np.log2(max(2, 8 * len(starts)))))))
        shift = np.full(1 << bits, max(1, k - 1), np.int8 if k < 120 else np.int32)
        for j in range(1, k):
            np.minimum.at(shift, block(stream[starts + j - 1], stream[starts + j], bits), k - 1 - j)
        if k == 1:
            shift[block(np.zeros(len(starts), np.int32), stream[starts], bits)] = 0
        suffixes = self.suffix(stream, starts + k - 1, k)
        order = np.argsort(suffixes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs[0] = rank[pairs[0]]
        pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
        item_offs = np.searchsorted(pairs[0], np.arange(len(starts) + 1))
        return Search(k, shift, bits, starts[order], suffixes[order], pairs[1], item_offs)

    @staticmethod
    def suffix(words: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
        """Hash of the last words, four at most, of windows that end at these places."""
        h = words[ends].astype(tb.U64) * tb.STEPS[0]
        for j in range(1, min(4, k)):
            h += words[ends - j].astype(tb.U64) * tb.STEPS[j]
        return tb.mix(h)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The item word that has the hash, 0 if none has."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int32)
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, self.numbers[at], 0)

    def same(self, run: tb.Run, w: tb.Words, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Direct comparison, byte by byte, of document words with item words."""
        a, n = w.starts[at], w.ends[at] - w.starts[at]
        b = self.byte_offs[ids - 1]
        good = n == self.byte_offs[ids] - b
        if not good.any():
            return good
        a, b, n = a[good], b[good], n[good]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = tb.LOWER[run.data[np.repeat(a, n) + step]] == self.bytes[np.repeat(b, n) + step]
        good[good] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return good

    def find(self, run: tb.Run, w: tb.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hit words (a flag each), and pairs of a document and an item with a window in it."""
        ids = self.number(w.hashes(True))
        hit = np.zeros(len(w) + 1, np.int64)
        docs, items = [], []
        for s in self.searches:
            ends, which = self._matches(s, ids, w)
            if not len(ends):
                continue
            at = np.unique((ends[:, None] + np.arange(1 - s.size, 1)).ravel())
            wrong = np.zeros(len(w) + 1, np.int64)
            wrong[at[~self.same(run, w, at, ids[at])] + 1] = 1
            np.cumsum(wrong, out=wrong)
            sure = wrong[ends + 1] == wrong[ends - s.size + 1]
            ends, which = ends[sure], which[sure]
            hit += np.bincount(ends - s.size + 1, minlength=len(w) + 1) - np.bincount(ends + 1, minlength=len(w) + 1)
            doc = np.searchsorted(w.offs, ends, side="right") - 1
            n = s.item_offs[which + 1] - s.item_offs[which]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            docs.append(np.repeat(doc, n))
            items.append(s.items[np.repeat(s.item_offs[which], n) + step])
        if not docs:
            return np.zeros(len(w), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1)
        return np.cumsum(hit[:-1]) > 0, pairs[0], pairs[1]

    def _matches(self, s: Search, ids: np.ndarray, w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ends of windows in documents, and the pattern of each."""
        k = s.size
        lo, hi = w.offs[:-1] + k - 1, w.offs[1:]
        longer = hi > lo
        lo, hi = lo[longer], hi[longer]
        n = -(-(hi - lo) // STRETCH)
        step = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        at = np.repeat(lo, n) + step
        stop = np.minimum(at + STRETCH, np.repeat(hi, n))
        zeros = []
        while len(at):
            last = ids[at]
            jump = s.shift[block(ids[at - 1] if k > 1 else np.zeros(len(at), np.int32), last, s.bits)].astype(np.int64)
            jump[last == 0] = k
            here = jump == 0
            zeros.append(at[here])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        ends = np.concatenate(zeros) if zeros else np.zeros(0, np.int64)
        if not len(ends):
            return ends, ends
        key = self.suffix(ids, ends, k)
        a = np.searchsorted(s.suffixes, key)
        n = np.searchsorted(s.suffixes, key, side="right") - a
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ends, which = np.repeat(ends, n), np.repeat(a, n) + step
        for j in range(k):
            good = ids[ends - j] == self.stream[s.starts[which] + k - 1 - j]
            ends, which = ends[good], which[good]
        return ends, which


def block(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    h = (a.astype(tb.U64) * tb.U64(0x100000001B3) + b.astype(tb.U64)) * _MUL
    return (h >> tb.U64(64 - bits)).astype(np.int64)


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Patterns]:
    """The benchmark in parts of about block_bytes; longer items are cut into overlapping pieces first."""
    b = two(benchmark, item_col, text_col).where("text is not null")
    piece = max(1000, block_bytes // 32)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids, texts = [], []
            names = x.column(0).to_pylist()
            for run in tb.runs(x.column(1)):
                w = run.words(tb.ALNUM)
                for d in range(run.n):
                    lo, hi = int(w.offs[d]), int(w.offs[d + 1])
                    for i in range(lo, max(lo + 1, hi - window + 1), piece):
                        j = min(hi, i + piece + window - 1)
                        if j > i:
                            ids.append(names[run.first + d])
                            texts.append(tb.LOWER[run.data[w.starts[i] : w.ends[j - 1]]].tobytes().decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["id", "text"])

    pieces = b.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(cut, "id string, text string")
    held, size = [], 0
    for r in pieces.toLocalIterator():
        held.append((r["id"], r["text"]))
        size += len(r["text"])
        if size >= block_bytes:
            yield Patterns(held, window)
            held, size = [], 0
    if held:
        yield Patterns(held, window)


def searched(shared: list, run: tb.Run, w: tb.Words) -> tuple[np.ndarray, list[tuple[int, str | None]]]:
    """Hit words of a run, and pairs of a document and an item; of several blocks one is held at a time."""
    hit, found = np.zeros(len(w), bool), []
    for s in shared:
        patterns = s.value
        mine, docs, items = patterns.find(run, w)
        hit |= mine
        found += [(d, patterns.names[i]) for d, i in zip(docs.tolist(), items.tolist())]
        if len(shared) > 1:
            s.__dict__.pop("_value", None)
    return hit, found


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """For each row of docs: n_words, n_hit, n_items, the items found (sorted as strings), the hit spans of words."""
    share = docs.sparkSession.sparkContext.broadcast
    shared = [share(x) for x in blocks(benchmark, item_col, item_text, window, block_bytes)]
    small = two(docs, id_col, text_col)
    final = T.StructType([T.StructField(id_col, small.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPAN)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(final)
        for b in batches:
            for run in tb.runs(b.column(1), 1 << 20 if len(shared) < 2 else 1 << 22):
                w = run.words(tb.ALNUM)
                hit, found = searched(shared, run, w)
                items = [set() for _ in range(run.n)]
                for d, name in found:
                    if name is not None:
                        items[d].add(name)
                starts, ends = _spans(hit, w.offs)
                doc = np.searchsorted(w.offs, starts, side="right") - 1
                cut = np.searchsorted(doc, np.arange(run.n + 1))
                pairs = pa.StructArray.from_arrays([pa.array(starts - w.offs[doc], pa.int64()), pa.array(ends - w.offs[doc], pa.int64())], fields=list(schema.field("spans").type.value_type))
                made = [
                    b.column(0).slice(run.first, run.n), pa.array(w.counts, pa.int64()),
                    pa.array(np.bincount(w.docs[hit], minlength=run.n), pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()), pa.array([sorted(x) for x in items], schema.field("items").type),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pairs).cast(schema.field("spans").type),
                ]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, schema)], schema=schema)
        tb.release()

    return small.mapInArrow(apply, final)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs without a hit word, with all their columns, in one pass without a shuffle."""
    share = docs.sparkSession.sparkContext.broadcast
    shared = [share(x) for x in blocks(benchmark, item_col, item_text, window, block_bytes)]

    def clean(run: tb.Run) -> np.ndarray:
        w = run.words(tb.ALNUM)
        return np.bincount(w.docs[searched(shared, run, w)[0]], minlength=run.n) == 0

    return keep_runs(docs, text_col, clean)


def _spans(hit: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of hit words that don't cross from one document to the next."""
    n = len(hit)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = hit[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after[:-1] = hit[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    return np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
