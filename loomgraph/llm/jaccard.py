"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set is that of its distinct word shingles; two documents link when their Jaccard similarity
reaches the threshold. Documents with equal sets form a class, and only one of each class is joined.

Shingles are ordered by their hash. If two sets are similar enough, then for any l their l-prefixes, which
hold l - 1 shingles more than the usual prefix, have l shingles in common. Each document chooses its own l
by the estimated cost of its candidates: a longer prefix allows it to leave aside the shingles that many
documents have, as long as fewer than l of the prefix are left aside, so that some of the common ones must
be among the rest. ``level`` is the logarithm of the largest document frequency that it doesn't leave
aside, and ``need`` says how many of the rest have to be common. A shingle rarer than its level is
"natural" to a document, others in its prefix are "secondary". Two documents meet at the natural shingles
of either, so a shingle of a passage that a third of all documents quote is paired only with the few
documents that have nothing rarer. Candidates that meet often enough are verified on their whole sets.

Results: one row for each row of the input. Null and empty texts have empty sets, are linked with nothing
and are components of their own. Rows count as documents; of rows with equal ids each counts. Rows with a
null id are in classes but can't stand for them; alone, they have a null component. Other columns aren't
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.llm import textbuf as tb
from loomgraph.llm.common import checked, finished, forget, fresh, two, written
from loomgraph.llm.katz import pack, unpack

_OTHER = tb.U64(0xA24BAED4963EE407)
#: a prefix may be twice as long as the usual one and so much more
LONGER = 64
#: cost of verifying a pair, in pairs that meet
VERIFY = 40.0
#: documents in a cell of the verification
CELL = 128
SKETCH, PREFIXES, COUNTED = range(3)
#: levels that a document may choose: document frequencies up to 2, 4, 8 ... and any
LEVELS = [*range(1, 41), 99]


def shingles(run: tb.Run, size: int) -> Iterator[np.ndarray]:
    """The set of each document, sorted."""
    w = run.words(tb.PLAIN)
    h = w.hashes(True)
    all_windows = tb.windows(h, size)
    for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist()):
        if b - a >= size:
            yield np.unique(all_windows[a : b - size + 1])
        elif b > a:
            yield tb.windows(h[a:b], b - a)
        else:
            yield np.zeros(0, tb.U64)


def least_common(n: int, percent: int) -> int:
    """How many shingles a set of n must have in common with any that is similar enough."""
    return -(-n * percent // 100)


def flat(key: T.DataType) -> T.StructType:
    long = T.LongType()
    return T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("block", long), T.StructField("bucket", T.IntegerType()), T.StructField("id", key),
        T.StructField("n", long), T.StructField("k1", long), T.StructField("k2", long), T.StructField("blob", T.BinaryType()),
    ])


def cols(s: pa.Schema, rows: int, /, **given) -> pa.RecordBatch:
    made = []
    for f in s:
        x = given.get(f.name)
        made.append(pa.nulls(rows, f.type) if x is None else x.cast(f.type) if isinstance(x, pa.Array) else pa.array(np.full(rows, x) if np.isscalar(x) else x, f.type))
    return pa.RecordBatch.from_arrays(made, schema=s)


def sketched(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, buckets: int, block_bytes: int) -> DataFrame:
    """SKETCH: id, n and the 128-bit key of each row's set. Of the sets of a block of texts, each once, PREFIXES: the
    longest prefix that may be used. COUNTED: the distinct prefix shingles of a block, by bucket."""
    small = two(docs, id_col, text_col)
    made = flat(small.schema["id"].dataType)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, block, held = to_arrow_schema(made), TaskContext.get().partitionId() << 32, 0
        seen: dict[tuple[int, int, int], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if not seen:
                return
            n, k1, k2 = (np.array(x, np.int64) for x in zip(*seen))
            lists = list(seen.values())
            yield cols(s, 1, kind=PREFIXES, block=block, blob=[pack(n, k1.view(tb.U64), k2.view(tb.U64), [len(x) for x in lists], np.concatenate([np.diff(x, prepend=tb.U64(0)) for x in lists]))])
            token, many = np.unique(np.concatenate(lists), return_counts=True)
            bucket = (token % tb.U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            asked = [(k, pack(np.diff(token[order[a:b]], prepend=tb.U64(0)), many[order[a:b]])) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
            yield cols(s, len(asked), kind=COUNTED, block=block, bucket=[k for k, _ in asked], blob=[x for _, x in asked])

        for b in batches:
            for run in tb.runs(b.column(1)):
                sets = list(shingles(run, size))
                n = np.array([len(x) for x in sets], np.int64)
                k1 = np.array([x.sum(dtype=tb.U64) for x in sets], tb.U64).view(np.int64)
                k2 = np.array([tb.mix(x ^ _OTHER).sum(dtype=tb.U64) for x in sets], tb.U64).view(np.int64)
                yield cols(s, run.n, kind=SKETCH, block=block, id=b.column(0).slice(run.first, run.n), n=n, k1=k1, k2=k2)
                for key, x in zip(zip(n.tolist(), k1.tolist(), k2.tolist()), sets):
                    if len(x) and key not in seen:
                        seen[key] = x[: longest(len(x), percent)] >> tb.U64(16)
                held += len(run.data)
                if held >= block_bytes:
                    yield from flush()
                    seen, held = {}, 0
                    block += 1
                    tb.release()
        yield from flush()

    return small.mapInArrow(apply, made)


def longest(n: int, percent: int) -> int:
    return min(n, 2 * (n - least_common(n, percent) + 1) + LONGER)


def choose(n: np.ndarray, edge: np.ndarray, df: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, prefix length and need with the least estimated cost of each document: of n shingles in all, of which those
    from edge to edge, with frequencies df, may be in its prefix. Shingles that nobody else has (df 1) cost nothing."""
    docs = len(n)
    common = -(-n * percent // 100)
    base, most = n - common + 1, np.minimum(n, 2 * (n - common + 1) + LONGER)
    shared, rare, begin = df > 1, rarity(df), edge[:-1]
    best, level_of, length_of, need_of = np.full(docs, np.inf), np.full(docs, LEVELS[-1]), base.copy(), np.ones(docs, np.int64)
    top = int(rare[shared].max()) if shared.any() else 1
    for level in range(1, top + 1):
        # places of the shingles left aside; a prefix of base + l - 1 of which at most l - need are left aside will do
        aside = np.concatenate([[0], np.cumsum(shared & (rare > level))])
        cost_upto = np.concatenate([[0], np.cumsum(np.where(shared & (rare <= level), df, 0))])
        for need in (1, 2, 4, 8, 16, 32, 64, 128):
            l = np.full(docs, need, np.int64)  # noqa: E741
            fits = (base + l - 1 <= most) & (l <= common)
            todo = np.flatnonzero(fits)
            while len(todo):
                h = aside[begin[todo] + base[todo] + l[todo] - 1] - aside[begin[todo]]
                todo, h = todo[l[todo] - h < need], h[l[todo] - h < need]
                l[todo] = h + need
                good = (base[todo] + l[todo] - 1 <= most[todo]) & (l[todo] <= common[todo])
                fits[todo[~good]] = False
                todo = todo[good]
            if not fits.any():
                break
            k = np.flatnonzero(fits)
            met = (cost_upto[begin[k] + base[k] + l[k] - 1] - cost_upto[begin[k]]).astype(float)
            # the pairs that meet, and those to verify: fewer, the more often they have to meet
            cost = met + VERIFY * met / need
            less = cost < best[k]
            k, cost = k[less], cost[less]
            best[k], level_of[k], length_of[k], need_of[k] = cost, level, base[k] + l[k] - 1, need
    return level_of, length_of, need_of


def rarity(df: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(df, 2))).astype(np.int64)


def emitted(stored: DataFrame, classes: DataFrame, key: T.DataType, percent: int) -> DataFrame:
    """Each representative's shingles within its prefix that others have too, natural or secondary."""
    made = stored.schema
    long = T.LongType()
    out = T.StructType([T.StructField("rep", key), T.StructField("n", long), T.StructField("need", long), T.StructField("token", long), T.StructField("df", long), T.StructField("natural", T.BooleanType())])

    def count(t: pa.Table) -> pa.Table:
        s = to_arrow_schema(made)
        got = [unpack(x) for x in t["blob"].to_pylist()]
        tokens = [np.cumsum(g[0], dtype=np.uint64) for g in got]
        token, place = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(place, np.concatenate([g[1] for g in got]).astype(float), len(token)).astype(np.int64)
        ends = np.cumsum([len(x) for x in tokens])
        blobs = [pack(total[place[a:b]]) for a, b in zip([0, *ends], ends)]
        del got, tokens, token, place
        tb.release()
        return pa.Table.from_batches([cols(s, len(blobs), kind=COUNTED, block=t["block"].combine_chunks(), bucket=t["bucket"].combine_chunks(), blob=blobs)], schema=s)

    def emit(t: pa.Table) -> pa.Table:
        s = to_arrow_schema(out)
        kind = t["kind"].to_numpy()
        blobs = t["blob"].to_pylist()
        reps = t["id"].filter(pa.array(kind == SKETCH)).combine_chunks()
        if not len(reps):
            return s.empty_table()
        k1, k2 = (t[c].filter(pa.array(kind == SKETCH)).to_numpy() for c in ("k1", "k2"))
        mine = {k: i for i, k in enumerate(zip(k1.tolist(), k2.tolist()))}
        n, a1, a2, size, step = unpack(blobs[int(np.flatnonzero(kind == PREFIXES)[0])])
        n, size = n.astype(np.int64), size.astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(size)])
        sums = np.cumsum(step, dtype=np.uint64)
        before = np.where(edge[:-1] > 0, sums[edge[:-1] - 1], tb.U64(0)).astype(tb.U64)
        token = sums - np.repeat(before, size)
        distinct = np.unique(token)
        counts = sorted((b, i) for b, i in zip(t["bucket"].to_pylist(), np.arange(len(kind))) if kind[i] == COUNTED)
        buckets = (distinct % tb.U64(BUCKETS)).astype(np.int64)
        df = np.empty(len(distinct), np.int64)
        df[np.argsort(buckets, kind="stable")] = np.concatenate([unpack(blobs[i])[0] for _, i in counts]).astype(np.int64)
        df = df[np.searchsorted(distinct, token)]
        level, length, need = choose(n, edge, df, percent)
        rep = np.array([mine.get(k, -1) for k in zip(a1.view(np.int64).tolist(), a2.view(np.int64).tolist())], np.int64)
        doc = np.repeat(np.arange(len(n)), size)
        on = np.flatnonzero((df > 1) & (np.arange(len(df)) - edge[doc] < length[doc]) & (rep[doc] >= 0))
        doc, d = doc[on], df[on]
        tb.release()
        made = (n[doc], need[doc], token[on].view(np.int64), d, rarity(d) <= level[doc])
        return pa.Table.from_arrays([reps.take(pa.array(rep[doc])).cast(s.field(0).type), *(pa.array(x, f.type) for x, f in zip(made, list(s)[1:]))], schema=s)

    BUCKETS = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = stored.where(F.col("kind") == COUNTED).groupBy("bucket").applyInArrow(count, made)
    here = classes.where("rep is not null").select(F.lit(SKETCH).alias("kind"), F.col("home").alias("block"), F.lit(None).cast("int").alias("bucket"), F.col("rep").alias("id"), "n", "k1", "k2", F.lit(None).cast("binary").alias("blob"))
    return stored.where(F.col("kind") == PREFIXES).unionByName(counted).unionByName(here).groupBy("block").applyInArrow(emit, out)


def candidates(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of class representatives that meet often enough; a superset of the links between classes."""
    a = met.where("natural").select("token", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("need").alias("px"))
    side = lambda d: d.select("token", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("need").alias("py"))
    near = F.expr(f"least(nx, ny) * 100 >= greatest(nx, ny) * {percent}")
    both = a.join(side(met.where("natural")), "token").where(F.col("x") < F.col("y")).where(near)
    one = a.join(side(met.where("not natural")), "token").where(F.col("x") != F.col("y")).where(near)
    swap = F.col("x") > F.col("y")
    pick = lambda p, q, n: F.when(swap, F.col(q)).otherwise(F.col(p)).alias(n)
    one = one.select(pick("x", "y", "x"), pick("y", "x", "y"), pick("nx", "ny", "nx"), pick("ny", "nx", "ny"), F.least("px", "py").alias("need"))
    both = both.select("x", "y", "nx", "ny", F.least("px", "py").alias("need"))
    return both.unionByName(one).groupBy("x", "y", "nx", "ny").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need")).where("shared >= need").select("x", "y", "nx", "ny")


def verified(pairs: DataFrame, met: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs whose whole sets are similar enough, and the tables that they are made of; met is deleted.

    Documents lie in cells by their most frequent natural shingle, about CELL of them in one. A pair is verified where the
    cell of the larger group is, so the many pairs of a group need each set once for each of its cells, not once a pair.
    """
    spark = docs.sparkSession
    ids = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    hub = met.groupBy(F.col("rep").alias("id")).agg(F.max(F.struct(F.col("natural"), "df", "token")).alias("hub")).join(ids, "id", "left_semi").select("id", F.col("hub.token").alias("hub"))
    many = hub.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("long").alias("cells"))
    cell = written(hub.join(many, "hub").select("id", F.struct("cells", F.xxhash64("hub", F.pmod(F.xxhash64("id"), F.col("cells"))).alias("h")).alias("cell")), "cells")
    at = lambda c: cell.select(F.col("id").alias(c), F.col("cell").alias(f"c{c}"))
    shelves = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 20_000)
    placed = pairs.join(at("x"), "x").join(at("y"), "y").withColumn("shelf", F.pmod(F.greatest("cx", "cy")["h"], F.lit(shelves)))
    placed = written(placed.select("shelf", "x", "y", "nx", "ny"), "placed")
    forget(met)
    wanted = placed.select("shelf", F.col("x").alias("id")).unionByName(placed.select("shelf", F.col("y").alias("id"))).distinct()
    texts = two(docs, id_col, text_col)
    key = texts.schema["id"].dataType
    texts = texts.join(checked(ids), "id", "left_semi")
    packed = T.StructType([T.StructField("id", key), T.StructField("blob", T.BinaryType())])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = to_arrow_schema(packed)
        for b in batches:
            for run in tb.runs(b.column(1)):
                yield cols(s, run.n, id=b.column(0).slice(run.first, run.n), blob=[pack(np.diff(x, prepend=tb.U64(0))) for x in shingles(run, size)])
        tb.release()

    sets = texts.select("id", "text").mapInArrow(sets_of, packed).dropDuplicates(["id"])
    one = wanted.join(sets, "id").select("shelf", F.col("id").alias("x"), F.lit(None).cast(key).alias("y"), "blob")
    rows = one.unionByName(placed.select("shelf", "x", "y", F.lit(None).cast("binary").alias("blob")))
    out = T.StructType([T.StructField("x", key), T.StructField("y", key)])

    def check(t: pa.Table) -> pa.Table:
        s = to_arrow_schema(out)
        xs, ys, blobs = (t[c].to_pylist() for c in ("x", "y", "blob"))
        got = {x: np.cumsum(unpack(b)[0], dtype=np.uint64) for x, b in zip(xs, blobs) if b is not None}
        keep = []
        for x, y in sorted((x, y) for x, y, b in zip(xs, ys, blobs) if b is None):
            p, q = got[x], got[y]
            if len(p) > len(q):
                p, q = q, p
            i = np.searchsorted(q, p)
            i[i == len(q)] = 0
            both = int((q[i] == p).sum()) if len(q) else 0
            if both * 100 >= (len(p) + len(q) - both) * percent:
                keep.append((x, y))
        got.clear()
        tb.release()
        return pa.Table.from_arrays([pa.array([k[i] for k in keep], f.type) for i, f in enumerate(s)], schema=s)

    return rows.groupBy("shelf").applyInArrow(check, out), [cell, placed]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component: the least node that links (x, y) reach, by alternating large and small stars."""
    edges = links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    mark = None
    for _ in range(rounds):
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v")))
        before, edges = edges, written(small.distinct(), "stars")
        if mark is not None:
            forget(before)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 90, block_bytes: int = 4 << 20) -> DataFrame:
    """For each row: n_shingles, class_id (least id with an equal set), n_similar, component_id."""
    return finished(docs.sparkSession, lambda: _similar(docs, id_col, text_col, size, percent, block_bytes), "similar")


def _similar(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, block_bytes: int) -> DataFrame:
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = written(sketched(docs, id_col, text_col, size, percent, buckets, block_bytes), "sketches")
    known = written(stored.where(F.col("kind") == SKETCH).select("id", "n", "k1", "k2", "block"), "sets")
    classes = written(known.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("block").alias("home")), "classes")
    met = written(emitted(stored, classes, stored.schema["id"].dataType, percent), "prefixes")
    forget(stored)
    pairs = written(candidates(met, percent), "candidates")
    made, tables = verified(pairs, met, docs, id_col, text_col, size, percent)
    links = written(made, "links")
    forget(pairs, *tables)
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    copies = classes.groupBy("rep").agg(F.sum("copies").alias("c"))
    degree = both.join(copies.withColumnRenamed("rep", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.sum("c").alias("others"))
    around = degree.join(components(links), "node", "full")
    told = classes.join(around, F.col("rep") == F.col("node"), "left").select("k1", "k2", "n", "rep", "copies", "others", "component")
    rows = known.join(told, ["k1", "k2", "n"], "left")
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long").alias("n_similar"),
        F.coalesce("component", "rep", "id").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 90) -> DataFrame:
    """The rows of docs, with all their columns, less those whose component has a lesser id; equal ids stay together."""
    (name,) = fresh(docs, "gone")
    gone = similar(docs, id_col, text_col, size, percent).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(checked(gone), F.col(f"`{id_col}`") == F.col(name), "left_anti")
