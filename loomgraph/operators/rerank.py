"""TF-IDF over character trigrams, counted in numpy over runs of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.shared import written

#: bytes of texts whose grams are counted at once
RUN = 1 << 20
#: stands for a value in a table of grams, whose numbers aren't negative
VALUE = -1


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each window of three characters; shorter texts are one gram, empty ones none.

    A gram is a number of three times 21 bits, a character's code and one, or 0 where there's none.
    """
    n = np.asarray(pc.fill_null(pc.utf8_length(texts), 0), np.int64)
    at = np.frombuffer("".join(x for x in texts.to_pylist() if x).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(at))  # characters from here to the text's end
    second, third = np.append(at[1:], 0), np.append(at[2:], [0, 0])[: len(at)]
    gram = at | np.where(left > 1, second, 0) << 21 | np.where(left > 2, third, 0) << 42
    whole = (left > 2) | (left == n[row]) if len(at) else np.zeros(0, bool)
    return row[whole], gram[whole]


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, place of the gram among the distinct ones, occurrences; and the distinct grams."""
    row, gram = grams(texts)
    code, distinct = pd.factorize(gram)
    key, tf = np.unique(row * max(1, len(distinct)) + code, return_counts=True)
    return key // max(1, len(distinct)), key % max(1, len(distinct)), tf, distinct


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has at most RUN bytes of texts (the last column), or one row."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0), np.int64)
        end, k = np.cumsum(size), 0
        while k < b.num_rows:
            to = max(k + 1, int(np.searchsorted(end, (end[k - 1] if k else 0) + RUN, "right")))
            yield b.slice(k, to - k)
            k = to


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram and the number of texts with it, and the number of texts; a task's are added up before they leave it."""
    have = pd.Series(dtype=np.int64)
    parts, rows, size = [], 0, 0
    for b in runs(batches):
        _, code, _, distinct = counted(b.column(0))
        parts.append(pd.Series(np.bincount(code, minlength=len(distinct)), distinct))
        rows, size = rows + b.num_rows, size + len(distinct)
        if size > max(1_000_000, 2 * len(have)):
            have = pd.concat([have, *parts]).groupby(level=0).sum()
            parts, size = [], 0
    have = pd.concat([have, *parts]).groupby(level=0).sum()
    gram, df = np.append(have.index.to_numpy(np.int64), VALUE), np.append(have.to_numpy(np.int64), rows)
    for k in range(0, len(gram), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(gram[k : k + 100_000]), pa.array(df[k : k + 100_000])], ["gram", "df"])


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, gram, tf."""
    for b in runs(batches):
        row, code, tf, distinct = counted(b.column(1))
        for k in range(0, len(row), 100_000):
            part = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[part])), pa.array(np.asarray(distinct, np.int64)[code[part]]), pa.array(tf[part].astype(np.int64))], ["id", "gram", "tf"])


def scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id and cosine of each text with a broadcast vector: sorted grams, their idf, and the vector, NaN where it has none."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf, vector = model.value
        for b in runs(batches):
            row, code, tf, distinct = counted(b.column(1))
            at = np.searchsorted(known, distinct)[code] if len(known) else np.zeros(0, int)
            w, v = tf * idf[at], vector[at]
            met, n = ~np.isnan(v), b.num_rows
            dot = np.bincount(row[met], w[met] * v[met], n)
            with np.errstate(invalid="ignore"):
                made = dot / np.sqrt(np.bincount(row, w * w, n))
            keep = np.bincount(row[met], minlength=n) > 0
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(made[keep])], ["id", "score"])

    return score


def score(values: DataFrame, matches: DataFrame, id_col: str, text_col: str, primary: int | None = None, most: int = 1_000_000) -> DataFrame:
    """id and score of values with unique ids: the mean over the match texts (m, text) of their cosine with the value; matches
    from primary on count 0.9; values without a gram in common with any are left out.

    The mean of cosines is the cosine with the mean of the matches' vectors, so the matches become one vector, and no
    pair of a value and a match is made. A text's grams are counted where it is; only numbers of texts a gram are
    shuffled. The grams' table is broadcast up to ``most`` grams and joined by shuffle beyond.
    """
    two = lambda df, key, text: df.select(F.col(key).alias("id"), F.lower(F.col(text).cast("string")).alias("text"))
    placed, asked = two(values, id_col, text_col), two(matches, "m", "text")
    id_type = lambda df: df.schema["id"].dataType
    long, double = T.LongType(), T.DoubleType()
    tf_of = lambda df: df.mapInArrow(occurrences, T.StructType([T.StructField("id", id_type(df)), T.StructField("gram", long), T.StructField("tf", long)]))
    df = placed.select("text").mapInArrow(frequencies, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))
    df = written(df, "frequencies")
    n, m = df.where(F.col("gram") == VALUE).agg(F.sum("df")).first()[0] or 0, matches.count()
    idf = df.where(F.col("gram") != VALUE).select("gram", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    q = tf_of(asked).join(idf, "gram").select("id", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    size = q.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    share = F.lit(1.0) if primary is None else F.when(F.col("id") >= primary, 0.9).otherwise(1.0)
    v = q.join(size, "id").groupBy("gram").agg((F.sum(F.col("w") / F.col("size") * share) / m).alias("v"))
    model = written(idf.join(v, "gram", "left"), "grams")
    schema = T.StructType([T.StructField("id", id_type(placed)), T.StructField("score", double)])
    if model.count() <= most:
        t = model.orderBy("gram").toArrow()
        known, weight, vector = (np.asarray(t.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in ("gram", "idf", "v"))
        sent = values.sparkSession.sparkContext.broadcast((known, weight.astype(float), vector.astype(float)))
        return placed.mapInArrow(scorer(sent), schema).select(F.col("id").alias(id_col), "score")
    tf = tf_of(placed).join(model, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    both = tf.groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return both.where("dot is not null").select(F.col("id").alias(id_col), (F.col("dot") / F.col("size")).alias("score"))
