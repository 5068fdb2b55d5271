"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, n-grams over words.

P(w | h) is d c(h w) / c(h) for an n-gram of the training texts, else a(h) P(w | h'), where h' is h without its
first word; a(h) gives the words that never follow h exactly what the discounts left. P(w) is d c(w) / N, and an
unknown word gets what is left there. Before a text stand starts, and each text ends with an end token. ``order`` is
the length of the longest n-grams; the recursion goes from single words up to it, token by token.

The tables are as large as the corpus's vocabulary and n-grams, so nothing of them is broadcast. Texts are packed in
blocks; each block sends its distinct words to the buckets of the word table, which add up the counts and
answer with the words' ranks by frequency, from which a small table tells the counts. Then, for each length, it
sends its distinct n-grams, whose contexts occur in the training texts, to the buckets of that length's table, by
context, with what the count of the shorter n-gram was; and gets their counts and, for contexts that it has to back
off from, the context's sums. Then it scores its own tokens. What moves is the distinct words and n-grams of blocks,
packed and compressed, not tokens. There are as many buckets as ``BUCKET`` goes into the bytes of all texts.
A context with over one ``HOT``-th of all tokens is spread over all buckets, and its sums, which Spark adds up, are
broadcast: there are at most HOT of them for each length. Also broadcast is how many words have each count: as many
numbers as there are distinct counts, at most the root of twice the number of tokens.

Null and empty texts are just an end token. Rows with a null id have a null remainder, so they are scored
and not learnt from. Repeated rows count as often as they occur, rows with one id and different texts each for
itself. Texts of any length are scored whole. Without training texts every probability is 1. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.llm import textbuf as tb
from loomgraph.llm.common import crc_mod, finished, text_buckets, written

END = tb.U64(0x1D872B41C6E5F037)
HOT = 4096
TOP = 5
BUCKET = 8 << 20
TOKENS, WORDS, OFFSETS, RANKS, ASKED, SPREAD = range(6)
#: answers of n-grams of length k have kind COUNTS + k
COUNTS = 10


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as compressed byte planes."""
    parts = []
    for a in arrays:
        if isinstance(a, np.ndarray) and a.dtype == np.uint8:
            parts += [np.array([len(a), 1], np.uint64).tobytes(), a.tobytes()]
            continue
        a = np.ascontiguousarray(a, dtype=np.uint64)
        wide = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        planes = a.view(np.uint8).reshape(-1, 8)[:, :wide].T
        parts += [np.array([len(a), wide], np.uint64).tobytes(), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, as_bytes: int = -1) -> list[np.ndarray]:
    """The packed arrays; the one of that number, which holds bytes, as such."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, wide = (int(x) for x in np.frombuffer(raw, np.uint64, 2, at))
        if len(out) == as_bytes:
            out.append(np.frombuffer(raw, np.uint8, n, at + 16))
            at += 16 + n * wide
            continue
        a = np.zeros((n, 8), np.uint8)
        a[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, at + 16).reshape(wide, n).T
        out.append(a.reshape(-1).view(np.uint64))
        at += 16 + n * wide
    return out


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As numpy's unique with the first place and the number of each, of integers from 0; places are sorted along with small ones."""
    bits = max(1, (len(key) - 1).bit_length()) if len(key) else 1
    if not len(key) or int(key.max()) >> (63 - bits):
        return np.unique(key, return_index=True, return_inverse=True)
    both = np.sort((key.astype(np.int64) << bits) | np.arange(len(key)))
    at = both & ((1 << bits) - 1)
    both >>= bits
    new = np.empty(len(key), bool)
    new[0] = True
    np.not_equal(both[1:], both[:-1], out=new[1:])
    place = np.empty(len(key), np.int64)
    place[at] = np.cumsum(new) - 1
    return both[new], at[new], place


def schema(key: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()),
        T.StructField("ids", T.ArrayType(key)), T.StructField("nums", T.ArrayType(T.LongType())), T.StructField("blob", T.BinaryType()),
    ])


def record(rows: list[tuple], s: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), s)] if rows else [pa.array([], f.type) for f in s], schema=s)


def texts(docs: DataFrame, buckets: int, block_bytes: int, made: T.StructType) -> DataFrame:
    """Blocks of tokens, and each block's distinct words with their training counts, by bucket."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, part, n = to_arrow_schema(made), TaskContext.get().partitionId() << 32, 0
        edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
        ids, hashes, sizes, trains, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            h, size, train = np.concatenate(hashes), np.concatenate(sizes), np.concatenate(trains)
            word, place, many = np.unique(h, return_inverse=True, return_counts=True)
            known = np.bincount(place[np.repeat(train, size)], minlength=len(word))
            at = np.concatenate([[0], np.searchsorted(word, edges), [len(word)]])
            order = np.argsort(-many, kind="stable")  # tokens are told by their words' places by frequency
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            rows = [(TOKENS, part + n, None, [x for i in ids for x in i.to_pylist()], None, pack(many, rank[place], size, train))]
            rows += [(WORDS, part + n, k, None, None, pack(np.diff(word[a:b], prepend=tb.U64(0)), known[a:b])) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
            return record(rows, s)

        for b in batches:
            learn = b.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            for run in tb.runs(b.column(1), 1 << 20):
                w = run.words(tb.PLAIN)
                ids.append(b.column(0).slice(run.first, run.n))
                hashes.append(np.insert(w.hashes(True), w.offs[1:], END))
                sizes.append(w.counts + 1)
                trains.append(learn[run.first : run.first + run.n])
                held += len(run.data)
                if held >= block_bytes:
                    yield flush()
                    n += 1
                    ids, hashes, sizes, trains, held = [], [], [], [], 0
                    tb.release()
        if ids:
            yield flush()
            tb.release()

    return docs.mapInArrow(apply, made)


def by_block(df: DataFrame, out: T.StructType, fn: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """fn makes rows of a block's rows."""

    def apply(t: pa.Table) -> pa.Table:
        s = to_arrow_schema(out)
        made = pa.Table.from_batches([record(fn(t.to_pylist()), s)], schema=s)
        tb.release()
        return made

    return df.groupBy("block").applyInArrow(apply, out)


def by_bucket(df: DataFrame, buckets: int, out: T.StructType, fn: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """fn makes rows of a bucket's rows; a task for each bucket."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, rows = to_arrow_schema(out), [r for b in batches for r in b.to_pylist()]
        if rows:
            made = fn(rows)
            for i in range(0, len(made), 1000):
                yield record(made[i : i + 1000], s)
        tb.release()

    return df.repartitionById(buckets, F.col("bucket")).mapInArrow(apply, out)


def added(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct words of a bucket, their training counts, and the places of each row's words among them."""
    hashes, many = zip(*((np.cumsum(d, dtype=np.uint64), c) for d, c in (unpack(r["blob"]) for r in rows)))
    word, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, np.concatenate(many).astype(float), len(word)).astype(np.int64)
    return word, total, np.split(place, np.cumsum([len(h) for h in hashes])[:-1])


@dataclass
class Ranks:
    """Training counts that occur, descending, and how many words have one at least as large; discounts of small counts."""

    counts: np.ndarray
    upto: np.ndarray
    discount: np.ndarray
    texts: int = 0

    @property
    def total(self) -> int:
        return int((self.counts * np.diff(self.upto, prepend=0)).sum())

    @property
    def words(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    @property
    def start(self) -> int:
        """The rank that stands for a text's start, as often as there are training texts."""
        return self.words + 1

    def count(self, rank: np.ndarray) -> np.ndarray:
        """Training count of a word's rank from 1; 0 for rank 0, that of unknown words."""
        if not len(self.counts):
            return np.where(rank == self.start, self.texts, 0)
        at = np.minimum(np.searchsorted(self.upto, rank), len(self.counts) - 1)
        return np.where(rank == self.start, self.texts, np.where((rank > 0) & (rank <= self.words), self.counts[at], 0))

    def chance(self, rank: np.ndarray) -> np.ndarray:
        """P(w)."""
        if not self.total:
            return np.ones(len(rank))
        c = self.count(rank)
        seen = self.counts * kept(self.discount, self.counts)
        left = 1 - (seen * np.diff(self.upto, prepend=0)).sum() / self.total
        scale = 1.0
        if left <= 1e-12:  # no small counts: make room for one unknown token
            scale, left = self.total / (self.total + 1), 1 / (self.total + 1)
        return np.where(c > 0, scale * c * kept(self.discount, c) / self.total, left)


def kept(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The share of counts that discounting leaves."""
    return np.where(c <= TOP, d[np.minimum(c, TOP)], 1.0)


def seen(d: np.ndarray, c: np.ndarray, context: np.ndarray, bare: np.ndarray) -> np.ndarray:
    """P of n-grams that occur c times after a context; bare: no n-gram of the context is discounted, so room is made for one more."""
    return c * kept(d, c) / (context + bare)


def discounts(n: dict[int, int]) -> np.ndarray:
    """Katz's discounts of counts 0 to TOP from the numbers of types with each count; absolute ones where those don't exist."""
    d = np.array([1.0, *((r - 0.5) / r for r in range(1, TOP + 1))])
    if all(n.get(r) for r in range(1, TOP + 2)):
        a = (TOP + 1) * n[TOP + 1] / n[1]
        if a < 1:
            good = np.array([1.0, *(((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, TOP + 1))])
            if ((good[1:] > 0) & (good[1:] < 1)).all():
                d = good
    return d


@dataclass
class Level:
    """What all blocks know of the n-grams of one length: discounts, and the sums of hot contexts."""

    discount: np.ndarray
    hot: dict[tuple[int, ...], np.ndarray] = field(default_factory=dict)


@dataclass
class Grams:
    """N-grams of a length in a block: a column of ranks for each place, how often each occurs in all training texts, whether
    its probability has room made for one more; each token's n-gram, -1 if its context is unknown; each token's probability."""

    cols: list[np.ndarray]
    total: np.ndarray
    bare: np.ndarray
    of: np.ndarray
    p: np.ndarray


@dataclass
class Asked:
    """The distinct n-grams of the next length whose contexts are known, in order: places of their contexts, ranks, training counts."""

    context: np.ndarray
    cols: list[np.ndarray]
    many: np.ndarray
    known: np.ndarray
    hot: np.ndarray
    first: np.ndarray
    of: np.ndarray
    order: np.ndarray
    at: np.ndarray


class State:
    """A block's tokens, and its n-grams, length by length."""

    def __init__(self, rows: list[dict], ranks: Ranks, hot: int = HOT):
        blob = next(r["blob"] for r in rows if r["kind"] == TOKENS)
        many, place, size, train = unpack(blob)
        rank = np.concatenate([x[0] for x in replies(rows, RANKS)]).astype(np.int64)
        order = np.argsort(-many.astype(np.int64), kind="stable")
        self.ranks, self.hot, self.size, self.train = ranks, hot, size.astype(np.int64), np.repeat(train.astype(bool), size.astype(np.int64))
        word, _, which = distinct(rank)  # words by rank; all unknown ones are one
        self.token = which[order][place.astype(np.int64)]
        self.starts = np.cumsum(self.size) - self.size
        self.words = word
        self.grams = Grams([word], ranks.count(word), np.zeros(len(word), bool), self.token, ranks.chance(word)[self.token])

    def ask(self, buckets: int) -> Asked:
        g, n = self.grams, len(self.token)
        length = len(g.cols)
        context = np.empty(n, np.int64)
        context[1:] = g.of[:-1]
        context[self.starts] = len(g.total)  # as many starts as the context is long
        times = np.append(g.total, self.ranks.texts)
        known = context >= 0
        known[known] = times[context[known]] > 0
        wide = len(self.words)
        gram, first, place = distinct(context[known] * wide + self.token[known])
        many = np.bincount(place, self.train[known].astype(float), len(gram)).astype(np.int64)
        context, word = gram // wide, gram % wide
        cols = [*(np.append(c, self.ranks.start)[context] for c in g.cols), self.words[word]]
        hot = times[context] > self.ranks.total // self.hot
        spread = np.where(hot, cols[-1], 0).astype(tb.U64) * tb.STEPS[0]
        for j in range(length):
            spread += cols[j].astype(tb.U64) * tb.STEPS[j + 1]
        bucket = (tb.mix(spread) % tb.U64(buckets)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        of = np.full(n, -1)
        of[known] = place
        return Asked(context, cols, many, times[context], hot, np.flatnonzero(known)[first], of, order, np.searchsorted(bucket[order], np.arange(buckets + 1)))

    def requests(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """For each bucket the contexts and words of its n-grams, their training counts with a bit for hot contexts, the
        counts of the n-grams without the first word, with a bit for bare contexts, and those of the contexts without it."""
        q, g = self.ask(buckets), self.grams
        length = len(g.cols)
        low = q.first * 0
        if length > 1:
            short = g.of[q.first]
            low = np.where((q.many > 0) & (short >= 0), g.total[short] * 2 + g.bare[short], 0)
        for k in np.flatnonzero(np.diff(q.at)).tolist():
            mine = q.order[q.at[k] : q.at[k + 1]]
            cols = [c[mine] for c in q.cols]
            more = [low[mine]] if length > 1 else []
            if length > 2:
                more.append(np.where(low[mine] > 0, self.short_context[q.first[mine]], 0))
            yield k, pack(np.diff(cols[0], prepend=0), *cols[1:], q.many[mine] * 2 + q.hot[mine], *more)

    def take(self, rows: list[dict], buckets: int, level: Level) -> None:
        """The answers of the next length."""
        q, g = self.ask(buckets), self.grams
        length, n = len(g.cols) + 1, len(q.many)
        total, sums, bare = np.zeros(n, np.int64), np.zeros((n, TOP + 1)), np.zeros(n, bool)
        got = replies(rows, COUNTS + length)
        for k, x in zip(np.flatnonzero(np.diff(q.at)).tolist(), got):
            mine = q.order[q.at[k] : q.at[k + 1]]
            total[mine] = x[0]
            context = q.context[mine]
            head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            size = np.append(head[1:], len(mine)) - head
            bare[mine] = np.repeat(x[1].astype(bool), size)
            back = np.add.reduceat((x[0] == 0).astype(np.int64), head) > 0
            some = np.zeros((len(head), TOP + 1))
            some[back, :TOP] = np.stack([y.astype(float) for y in x[2:-1]], axis=1)
            some[back, TOP] = x[-1].view(np.float64)
            sums[mine] = np.repeat(some, size, axis=0)
        hot = np.flatnonzero(q.hot)
        if len(hot):
            context, which = np.unique(q.context[hot], return_inverse=True)
            one = hot[np.unique(which, return_index=True)[1]]
            found = np.array([level.hot.get(t, np.zeros(TOP + 1)) for t in zip(*(c[one].tolist() for c in q.cols[:-1]))]).reshape(len(context), TOP + 1)
            sums[hot] = found[which]
            bare[hot] = ~found[which, :TOP].any(axis=1)
        d, c = level.discount, q.known.astype(float)
        left = (sums[:, :TOP] * (np.arange(1, TOP + 1) * (1 - d[1:]))).sum(axis=1) / c
        left = np.where(bare, 1 / (c + 1), left)
        there = seen(d, total, c, bare)
        weight = left / np.maximum(1 - sums[:, TOP], 1e-15)
        p, mine = g.p.copy(), q.of >= 0
        o = q.of[mine]
        p[mine] = np.where(total[o] > 0, there[o], weight[o] * g.p[mine])
        #: how often each token's context occurs, for the next length
        self.short_context = np.zeros(len(q.of), np.int64)
        self.short_context[mine] = q.known[o]
        self.grams = Grams(q.cols, total, bare, q.of, p)


def replies(rows: list[dict], kind: int) -> list[list[np.ndarray]]:
    return [unpack(r["blob"]) for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["bucket"])]


def answer(rows: list[dict], length: int, ranks: Ranks, lower: Level | None) -> list[tuple]:
    """The counts of a bucket's n-grams, row by row; for each context of a row whether no count of it is small; for those
    with an n-gram that the training texts lack, how many have each small count, and the sum of the lower probabilities."""
    got = [unpack(r["blob"]) for r in rows]
    ends = np.cumsum([len(x[0]) for x in got])
    cols = [np.concatenate([np.cumsum(x[0].astype(np.int64)) for x in got]), *(np.concatenate([x[j] for x in got]).astype(np.int64) for j in range(1, length))]
    wide = ranks.words + 2
    context = distinct(cols[0])[2]
    for c in cols[1:-1]:
        context = distinct(context * wide + c)[2]
    gram, first, place = distinct(context * wide + cols[-1])
    many = np.concatenate([x[length] for x in got]).astype(np.int64)
    hot, total = many & 1 > 0, np.bincount(place, (many >> 1).astype(float), len(gram)).astype(np.int64)
    of, n = gram // wide, int(context.max()) + 1
    there = total > 0
    if length == 2:
        low = ranks.chance(cols[-1][first])
    else:
        # the same in every row that has a training count
        told = np.flatnonzero(many >> 1)
        value, c = np.zeros(len(gram), np.int64), np.ones(len(gram), np.int64)
        value[place[told]] = np.concatenate([x[length + 1] for x in got]).astype(np.int64)[told]
        c[place[told]] = ranks.count(cols[-2][told]) if length == 3 else np.concatenate([x[length + 2] for x in got]).astype(np.int64)[told]
        low = seen(lower.discount, value >> 1, np.maximum(c, 1), value & 1)
    sums = np.stack([np.bincount(of[total == r], minlength=n) for r in range(1, TOP + 1)])
    mass = np.bincount(of[there], low[there], n)
    bare = ~sums.any(axis=0)
    out = []
    for r, a, b in zip(rows, [0, *ends], ends):
        mine = total[place[a:b]]
        own = context[a:b]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        back = own[head[np.add.reduceat((mine == 0).astype(np.int64), head) > 0]]
        out.append((COUNTS + length, r["block"], r["bucket"], None, None, pack(mine, bare[own[head]], *(s[back] for s in sums), mass[back].view(np.uint64))))
    types = np.bincount(np.minimum(total[there], TOP + 2), minlength=TOP + 3)
    warm, at = np.unique(context[hot], return_index=True)
    at = np.flatnonzero(hot)[at]
    out.append((SPREAD, None, rows[0]["bucket"], None, types.tolist(), pack(*(c[at] for c in cols[:-1]), *(s[warm] for s in sums), mass[warm].view(np.uint64))))
    return out


def spread_sums(df: DataFrame, length: int) -> DataFrame:
    """context (ranks) and s0 ... of each bucket's hot contexts."""
    out = T.StructType([T.StructField("context", T.ArrayType(T.LongType())), *(T.StructField(f"s{i}", T.DoubleType()) for i in range(TOP + 1))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = to_arrow_schema(out)
        for b in batches:
            for blob in b.column(0).to_pylist():
                x = unpack(blob)
                cols, sums, mass = x[: length - 1], x[length - 1 : -1], x[-1].view(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.stack(cols, axis=1).astype(np.int64).tolist(), s.field(0).type), *(pa.array(y.astype(float)) for y in sums), pa.array(mass)], schema=s)

    return df.select("blob").mapInArrow(apply, out)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 5, rest: int = 1, block_bytes: int = 4 << 20, train: Column | None = None, order: int = 3, bucket_bytes: int = BUCKET, hot: int = HOT) -> DataFrame:
    """Scores of every row; learns from the rows whose id's crc32 modulo ``mod`` isn't ``rest``, or for which train holds."""
    if order < 1:
        raise ValueError("order is 1 at least")
    return finished(docs.sparkSession, lambda: _score(docs, id_col, text_col, mod, rest, block_bytes, train, order, bucket_bytes, hot), "scores")


def _score(docs: DataFrame, id_col: str, text_col: str, mod: int, rest: int, block_bytes: int, train: Column | None, order: int, bucket_bytes: int, hot: int) -> DataFrame:
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    held = crc_mod(F.col(id_col), mod) == rest
    small = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (~held if train is None else train).alias("learn"))
    key = small.schema["id"].dataType
    made = schema(key)
    buckets = text_buckets(small, "text", bucket_bytes)
    stored = written(texts(small, buckets, block_bytes, made), "blocks")
    tokens, words = stored.where(F.col("kind") == TOKENS), stored.where(F.col("kind") == WORDS)

    # word counts: how many words of each bucket have each count, so that each bucket knows its words' ranks
    hist = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("c", T.LongType()), T.StructField("n", T.LongType())])

    def histogram(rows: list[dict]) -> list[tuple]:
        c, n = np.unique(added(rows)[1], return_counts=True)
        return [(rows[0]["bucket"], int(x), int(y)) for x, y in zip(c, n) if x]

    found = written(by_bucket(words, buckets, hist, histogram).repartition("c"), "histograms")
    per = sorted(((r["c"], r["n"]) for r in found.groupBy("c").agg(F.sum("n").alias("n")).collect()), reverse=True)  # distinct counts
    counts, many = (np.array(x, np.int64) for x in zip(*per)) if per else (np.zeros(0, np.int64),) * 2
    ranks = Ranks(counts, np.cumsum(many), discounts({int(c): int(n) for c, n in per}), small.where(F.col("learn")).count())
    ranks_b = share(ranks)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = found.select("bucket", "c", before.alias("before")).groupBy("bucket").agg(F.flatten(F.sort_array(F.collect_list(F.array("c", "before")))).alias("nums"))
    none = {"block": "bigint", "ids": made["ids"].dataType, "blob": "binary"}
    offsets = offsets.select(F.lit(OFFSETS).alias("kind"), "bucket", "nums", *(F.lit(None).cast(t).alias(c) for c, t in none.items())).select(*made.names)

    def answer_words(rows: list[dict]) -> list[tuple]:
        mine = [r for r in rows if r["kind"] == WORDS]
        values, base = np.array(next((r["nums"] for r in rows if r["kind"] == OFFSETS), []), np.int64).reshape(-1, 2)[::-1].T
        base = base + np.concatenate([[0], ranks_b.value.upto])[np.searchsorted(-ranks_b.value.counts, -values)]
        word, total, places = added(mine)
        order = np.argsort(-total, kind="stable")
        order = order[total[order] > 0]
        rank = np.zeros(len(word), np.int64)
        rank[order] = base[np.searchsorted(-values, -total[order])] + 1 + np.arange(len(order)) - np.searchsorted(-total[order], -total[order])
        return [(RANKS, r["block"], r["bucket"], None, None, pack(rank[p])) for r, p in zip(mine, places)]

    known = tokens.unionByName(written(by_bucket(words.unionByName(offsets), buckets, made, answer_words), "ranks"))
    levels: list[Level] = []

    def replay(rows: list[dict]) -> State:
        state = State(rows, ranks_b.value, hot)
        for level in levels_b.value:
            state.take(rows, buckets, level)
        return state

    for length in range(2, order + 1):
        levels_b = share(list(levels))

        def ask(rows: list[dict], replay=replay) -> list[tuple]:
            return [(ASKED, rows[0]["block"], k, None, None, blob) for k, blob in replay(rows).requests(buckets)]

        def reply(rows: list[dict], length=length, lower=levels[-1] if levels else None) -> list[tuple]:
            return answer(rows, length, ranks_b.value, lower)

        answered = written(by_bucket(by_block(known, made, ask), buckets, made, reply), f"counts{length}")
        told = answered.where(F.col("kind") == SPREAD)
        types = told.select(F.posexplode("nums").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
        sums = spread_sums(told, length).groupBy("context").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(TOP + 1))).collect()  # HOT contexts at most
        levels.append(Level(discounts({r["r"]: r["n"] for r in types}), {tuple(r["context"]): np.array(r[1:], float) for r in sums}))
        known = known.unionByName(answered.where(F.col("kind") == COUNTS + length))

    levels_b = share(list(levels))
    result = T.StructType([
        T.StructField("id", key), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def evaluate(rows: list[dict]) -> list[tuple]:
        ids = next(r["ids"] for r in rows if r["kind"] == TOKENS)
        state, ranks = replay(rows), ranks_b.value
        c = ranks.count(state.words)
        base = np.log10((c + 0.5) / (ranks.total + 0.5 * (ranks.words + 1)))[state.token]
        # sums of the tokens of each text by itself, so that they don't depend on what else is in the block
        by = lambda x: np.add.reduceat(x, state.starts) if len(state.starts) else np.zeros(0)
        got = by((c > 0).astype(np.int64)[state.token]), by(base), by(np.log10(state.grams.p))
        return list(zip(ids, state.size.tolist(), got[0].tolist(), [ranks.total] * len(ids), got[1].tolist(), got[2].tolist()))

    rows = by_block(known, result, evaluate)
    return rows.select(F.col("id").alias(id_col), (crc_mod(F.col("id"), mod) == rest).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
