"""The token budget per topic against the walk it stands for, with more topics than the budget pays for."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import processors


def walk(rows, budget):
    by = defaultdict(lambda: defaultdict(list))
    for s, t, x, score, cost in rows:
        by[s][t].append((-score, x, cost))
    best = {s: max(sum(-r[0] for r in x) / len(x) for x in ts.values()) for s, ts in by.items()}
    part, left, kept = budget // sum(map(len, by.values())), budget, set()
    for s in sorted(by, key=lambda s: (-best[s], s)):
        for t in sorted(by[s]):
            spent = 0
            for k, (_, x, cost) in enumerate(sorted(by[s][t])):
                if left <= 0 or k and (spent + cost > part or cost > left):
                    break
                spent, left = spent + cost, left - cost
                kept.add((s, t, x))
    return kept


@pytest.mark.parametrize("budget", [1, 7, 40, 150, 400, 1500, 10_000])
def test_ceiling(spark, budget):
    r = random.Random(3)
    rows = [(f"s{s:02}", f"t{t}", f"x{k}", r.randrange(0, 32) / 16, r.choice([0, 1, 3, 9, 20])) for s in range(25) for t in range(r.randrange(1, 5)) for k in range(r.randrange(1, 5))]
    df = spark.createDataFrame(rows, "source_id string, topic string, statement string, score double, c long").repartition(3)
    got = processors.token_budget_per_topic(df, budget, F.col("c")).collect()
    assert {(x["source_id"], x["topic"], x["statement"]) for x in got} == walk(rows, budget)
    assert set(got[0].asDict()) == {"source_id", "topic", "statement", "score", "c", "cost"}


def test_many_topics(spark):
    df = spark.range(500).select(F.format_string("s%03d", "id").alias("source_id"), F.lit("t").alias("topic"), F.lit("x").alias("statement"), (1000 - F.col("id")).cast("double").alias("score"))
    got = processors.token_budget_per_topic(df, 100, F.lit(10)).collect()
    assert sorted(x["source_id"] for x in got) == [f"s{i:03}" for i in range(10)]
