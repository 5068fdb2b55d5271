"""Reranking of all statements against brute force."""

import math
import random
from collections import Counter

import pytest

from loomgraph.operators import rerank
from loomgraph.plans import all_queries


def brute(values, matches):
    """id: mean cosine over the matches, for ids that share a gram with one."""
    grams = lambda t: Counter(x for x in (t.lower()[i : i + 3] for i in range(max(1, len(t) - 2))) if x)
    df = Counter(g for t in values.values() for g in grams(t))
    idf = {g: math.log((1 + len(values)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(t):
        w = {g: n * idf[g] for g, n in grams(t).items() if g in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / size for g, x in w.items()}

    asked = [unit(t) for t in matches]
    out = {}
    for i, t in values.items():
        w = unit(t)
        if any(w.keys() & q.keys() for q in asked):
            out[i] = sum(sum(w[g] * q[g] for g in w.keys() & q.keys()) for q in asked) / len(asked)
    return out


@pytest.mark.parametrize("most", [1_000_000, 1])
def test_many(spark, most):
    r = random.Random(5)
    text = lambda k: " ".join("".join(r.choice("abcé") for _ in range(r.randrange(1, 5))) for _ in range(k))
    values = {i: text(r.randrange(1, 12)) for i in range(80)} | {100: "zzz", 101: "", 102: "ab", 103: "aaaaaaaa"}
    matches = [text(9) for _ in range(60)] + ["0123", ""]
    got = rerank.score(spark.createDataFrame(list(values.items()), "id long, text string"), spark.createDataFrame(list(enumerate(matches)), "m long, text string"), "id", "text", most=most)
    got = {x["id"]: x["score"] for x in got.collect()}
    assert got == pytest.approx(brute(values, matches))


def test_statements_are_what_is_reranked(spark, tmp_path):
    spark.createDataFrame([(1, "Alpha river flows. Stone delta stands\nMarket signal", "en", "s", 10), (2, "quiet engine", "de", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the river flows"), (2, "a market signal")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(x["score"] for x in all_queries()["statement_rerank"](spark, str(tmp_path)).collect())
    assert len(got) >= 3 and got[-1] > 0.2
