"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits a shallow tree to one feature's bins and adds
its leaves to that feature's lookup table, and then likewise for the pairs of features that explain most
of what is left. A document's score is the logistic of a sum of looked-up values, so scoring is a few
vectorised additions of bins and needs nothing of the training but the tables.

The features describe a text's form: lengths, shares of kinds of characters, repetition. Fitting uses at
most ``max_rows`` labelled rows, those with the least hash of their id, and of several texts of one id the least;
scoring covers every row, over the whole text, however long. Null and empty texts get the score of the bins that
hold no words; repeated rows get equal scores. Of repeated labels of one id the majority counts, a tie as 1;
labels and ids that are null don't. Without labels of both kinds every score is the share of label 1, or
0.5 without any. An empty table of documents gives an empty result. Other columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.llm import textbuf as tb
from loomgraph.llm.common import columns, map_runs, two
from loomgraph.llm.repetition import DOC_STEP, SYMBOLS, covered, repeated, repeated_windows

KINDS = {
    "upper": [range(65, 91)],
    "digit": [range(48, 58)],
    "shout": [range(33, 34)],
    "pipe": [range(124, 125)],
    "stop": [range(44, 45), range(46, 47), range(58, 60), range(63, 64)],
    "wide": [range(128, 256)],
    "line": [range(10, 11)],
    "brace": [range(60, 63), range(91, 96), range(123, 124), range(125, 127)],
}
FEATURES = ["words", "length", "symbols", *KINDS, "short", "same", "distinct", "gram5", "lines"]


def features(run: tb.Run) -> np.ndarray:
    """A row of FEATURES for each document."""
    w = run.words(tb.PLAIN)
    h, n = w.hashes(True), len(w)
    count, size = w.counts, np.maximum(1, np.diff(run.offs))
    per = np.maximum(1, count)
    long = w.ends - w.starts

    def by_doc(x: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1)
        np.cumsum(x, out=sums[1:])
        return sums[w.offs[1:]] - sums[w.offs[:-1]]

    letters = by_doc(long)
    cols = [np.log1p(count), letters / per, run.per_doc(SYMBOLS[run.data]) / per]
    for spans in KINDS.values():
        kind = np.zeros(256, bool)
        for s in spans:
            kind[s.start : s.stop] = True
        cols.append(run.per_doc(kind[run.data]) / size)
    cols.append(by_doc(long <= 3) / per)
    same = np.zeros(n, bool)
    same[1:] = h[1:] == h[:-1]
    same[w.offs[:-1][w.offs[:-1] < n]] = False
    cols.append(by_doc(same) / per)
    cols.append(1 - by_doc(repeated(tb.mix(h + w.docs.astype(tb.U64) * DOC_STEP), later=True)) / per)
    for k, at in repeated_windows(w, h, [5]):
        cols.append(by_doc(np.where(covered(at, k, n), long, 0)) / np.maximum(1, letters))
    starts, ends, doc = run.lines()
    full = ends > starts
    starts, ends, doc = starts[full], ends[full], doc[full]
    again = repeated(tb.mix(run.span_hash(starts, ends, False) + doc.astype(tb.U64) * DOC_STEP), later=True)
    cols.append(np.bincount(doc[again], weights=(ends - starts)[again], minlength=run.n) / size)
    return np.stack(cols, axis=1)


@dataclass
class Additive:
    """Bin edges of each feature, a table for each feature and for some pairs, and a constant."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Leaf values, bin by bin, of the best tree of so many leaves over ordered bins."""
    cuts, out = [(0, len(g))], np.zeros(len(g))
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1)
    while len(cuts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(cuts):
            c = np.arange(a + 1, b)
            c = c[(hs[c] - hs[a] > least) & (hs[b] - hs[c] > least)]
            if len(c):
                more = gain(a, c) + gain(c, b) - gain(a, b)
                i = int(np.argmax(more))
                if more[i] > best[0]:
                    best = (more[i], k, int(c[i]))
        if best[1] is None:
            break
        a, b = cuts.pop(best[1])
        cuts += [(a, best[2]), (best[2], b)]
    for a, b in cuts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + 1)
    return out


def _plane(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best cut of a plane of bins into four."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, c = G[:-1, :-1], H[:-1, :-1]
    if not a.size:
        return 0.0, np.zeros_like(g)
    quads = [(a, c), (G[:-1, -1:] - a, H[:-1, -1:] - c), (G[-1:, :-1] - a, H[-1:, :-1] - c)]
    quads.append((G[-1, -1] - sum(q[0] for q in quads), H[-1, -1] - sum(q[1] for q in quads)))
    total = sum(x * x / (y + 1) for x, y in quads)
    i, j = np.unravel_index(int(np.argmax(total)), total.shape)
    out = np.empty_like(g)
    values = [(x + 0 * a)[i, j] / ((y + 0 * a)[i, j] + 1) for x, y in quads]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(total[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 40, max_pairs: int = 6, bins: int = 48, rate: float = 0.1) -> Additive:
    y = np.asarray(y, float)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    p = y.mean() if len(y) else 0.5
    if not len(y) or p in (0.0, 1.0):
        p = min(1 - 1e-6, max(1e-6, p))
        return Additive(edges, float(np.log(p / (1 - p))), [np.zeros(len(e) + 1) for e in edges])
    model = Additive(edges, float(np.log(p / (1 - p))), [np.zeros(len(e) + 1) for e in edges])
    b = model.bins(x)
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            q = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(b[:, j], y - q, len(t)), np.bincount(b[:, j], q * (1 - q), len(t)), 3, 2.0)
            t += step
            z += step[b[:, j]]
    shape = [len(t) for t in model.tables]

    def plane(i: int, j: int) -> tuple[float, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        cell, n = b[:, i] * shape[j] + b[:, j], shape[i] * shape[j]
        return _plane(np.bincount(cell, y - q, n).reshape(shape[i], shape[j]), np.bincount(cell, q * (1 - q), n).reshape(shape[i], shape[j]))

    ranked = sorted(combinations(range(len(shape)), 2), key=lambda ij: -plane(*ij)[0])
    model.pairs = ranked[:max_pairs]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            step = rate * plane(i, j)[1]
            t += step
            z += step[b[:, i], b[:, j]]
    return model


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, max_rows: int, usable: Column | None = None, only: int | None = None) -> DataFrame:
    """id, text, y of at most max_rows labelled documents (with only: labelled so), those with the least hash of their id."""
    got = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        got = got.where(usable)
    got = got.groupBy(F.col(id_col).alias("k")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    if only is not None:
        got = got.where(F.col("y") == only)
    some = got.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    texts = two(docs, id_col, text_col).join(F.broadcast(some), F.col("id") == F.col("k"))  # max_rows bounds it
    return texts.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000, usable: Column | None = None) -> Additive:
    some = labelled(docs, labels, label, id_col, text_col, max_rows, usable)
    out = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for b in batches:
            for run in tb.runs(b.column(0)):
                yield columns(b.column(1).slice(run.first, run.n), {"x": pa.array([r.tobytes() for r in features(run)], pa.binary())}, schema)

    rows = some.select("text", "y").mapInArrow(apply, out).collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["y"]))  # any order of the rows gives the same model
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows]))


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_runs(docs, id_col, text_col, lambda run: {"score": shared.value.score(features(run))}, [("score", T.DoubleType())])
