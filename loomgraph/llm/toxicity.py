"""Toxicity by non-negative positive-unlabelled learning.

A linear model over hashed words and word beginnings (their first ``STEM`` bytes) learns from confirmed toxic
texts and from texts of unknown kind. The risk of the unknown ones contains that of the toxic ones among them,
which the class prior says how many they are; subtracting it may not make the negatives' risk negative, and where
a batch would, the step goes against it (the non-negative estimator). The features that count are those whose share
of toxic texts differs from their share of unknown ones by ``sure`` standard errors, at most ``keep`` of them, so
that long texts don't add up noise; the more labels, the rarer a feature can be and still count.

Fitting uses at most ``max_positive`` toxic and ``max_unlabelled`` other texts, those with the least hash
of their id; of several texts of one id, the least. Features are counted by Spark, and what the driver gets is at most
``keep`` features of these texts. Every row is scored, over the whole text, however long. Null and empty texts get
the score of no words; repeated rows get equal scores. Repeated labels count by majority, a tie as toxic; null labels
don't count; without toxic examples every score is 0. An empty table of documents gives an empty result.
Other columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.llm import textbuf as tb
from loomgraph.llm.common import columns, map_runs, temporary, two, written
from loomgraph.llm.quality import labelled

BITS = 20
STEM = 4


def words(run: tb.Run) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the distinct words and word beginnings of each document, and where each document's begin."""
    w = run.words(tb.ALNUM)
    long = np.flatnonzero(w.ends - w.starts > STEM)
    stems = run.span_hash(w.starts[long], w.starts[long] + STEM, True) * tb.STEPS[STEM] + tb.STEPS[STEM + 1]
    docs = w.docs.astype(np.int64) << BITS
    shift = tb.U64(64 - BITS)
    key = np.unique(np.concatenate([docs | (w.hashes(True) >> shift).astype(np.int64), docs[long] | (stems >> shift).astype(np.int64)]))
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(run.n + 1))


@dataclass
class Linear:
    weights: np.ndarray
    base: float

    def score(self, run: tb.Run) -> np.ndarray:
        at, offs = words(run)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[at], dtype=float)])
        return 1 / (1 + np.exp(-np.clip(sums[offs[1:]] - sums[offs[:-1]] + self.base, -40, 40)))


def choose(n: int, m: int, bucket: np.ndarray, p: np.ndarray, u: np.ndarray, keep: int, sure: float) -> np.ndarray:
    """The buckets that count, of those with their numbers of toxic texts (p of n) and of unknown ones (u of m)."""
    both = (p + u) / (n + m)
    z = np.abs(p / n - u / m) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n + 1 / m))
    order = np.lexsort((bucket, -z))[:keep]
    chosen = order[z[order] >= sure]
    return np.sort(bucket[chosen if len(chosen) else order[:50]])


def fit(positive: list[np.ndarray], unknown: list[np.ndarray], prior: float, chosen: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Linear:
    """Weights of the chosen buckets that minimise the non-negative risk; the texts hold places among the chosen; loss: logistic."""
    weights = np.zeros(1 << BITS, np.float32)
    if not positive or not unknown:
        return Linear(weights, -40.0)
    prior = min(0.9, max(1e-3, prior))
    n, m, k = len(positive), len(unknown), len(chosen)

    def matrix(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(c) for c in rows])

    (pc, pr), (uc, ur) = matrix(positive), matrix(unknown)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        fp = np.bincount(pr, w[pc], n) + b
        fu = np.bincount(ur, w[uc], m) + b
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # gradients of the risks: toxic as toxic, unknown as harmless, toxic as harmless
        as_toxic = prior * np.concatenate([np.bincount(pc, (sp - 1)[pr], k), [(sp - 1).sum()]]) / n
        harmless = np.concatenate([np.bincount(uc, su[ur], k), [su.sum()]]) / m - prior * np.concatenate([np.bincount(pc, sp[pr], k), [sp.sum()]]) / n
        g = as_toxic + harmless if negative >= 0 else -harmless
        g[:-1] += decay * w * prior
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weights[chosen] = w
    return Linear(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_positive: int = 6_000, max_unlabelled: int = 12_000, usable: Column | None = None, prior: float | None = None, keep: int = 4096, sure: float = 4.0) -> Linear:
    """Fit to confirmed toxic texts and to texts of any kind; prior: their share of toxic ones, else that of the labels."""
    spark = docs.sparkSession
    fold = labels if usable is None else labels.where(usable)
    if prior is None:
        prior = fold.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"] or 0.0
    toxic = labelled(docs, fold, label, id_col, text_col, max_positive, only=1)
    ids = docs.where(F.col(id_col).isNotNull())
    some = (ids if usable is None else ids.where(usable)).select(F.col(id_col).alias("k")).distinct().orderBy(F.xxhash64("k", F.lit(1)), "k").limit(max_unlabelled)
    other = two(docs, id_col, text_col).join(F.broadcast(some), F.col("id") == F.col("k")).groupBy("id").agg(F.min("text").alias("text"))  # max_unlabelled bounds it
    out = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])
    long = T.LongType()
    counts = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("p", long), T.StructField("u", long)])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for b in batches:
            for run in tb.runs(b.column(0)):
                at, offs = words(run)
                yield columns(b.column(1).slice(run.first, run.n), {"x": pa.array([at[i:j].tobytes() for i, j in zip(offs[:-1], offs[1:])], pa.binary())}, schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[y, np.frombuffer(x, np.int32)] += 1
        bucket = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((bucket, total[1, bucket], total[0, bucket]), to_arrow_schema(counts))], schema=to_arrow_schema(counts))

    with temporary(spark):
        rows = written(toxic.select("text", F.lit(1).alias("y")).unionByName(other.select("text", F.lit(0).alias("y"))).mapInArrow(hashed, out), "features")
        many = dict(rows.groupBy("y").count().collect())
        if len(many) < 2:
            return fit([], [], prior, np.zeros(0, np.int64))
        found = rows.mapInArrow(counted, counts).groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toPandas()  # 2^BITS rows at most
        chosen = choose(many[1], many[0], *(found[c].to_numpy() for c in ("bucket", "p", "u")), keep, sure)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = np.full(1 << BITS, -1, np.int32)
            place[chosen] = np.arange(len(chosen))
            for b in batches:
                made = [(c := place[np.frombuffer(x, np.int32)])[c >= 0].astype(np.int32).tobytes() for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], schema=to_arrow_schema(out))

        got = [(r["y"], bytes(r["x"])) for r in rows.mapInArrow(places, out).collect()]
    got.sort()  # any order of the rows gives the same model
    one, rest = ([np.frombuffer(x, np.int32) for y, x in got if y == k] for k in (1, 0))
    return fit(one, rest, prior, chosen)


def score(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_runs(docs, id_col, text_col, lambda run: {"score": shared.value.score(run)}, [("score", T.DoubleType())])
