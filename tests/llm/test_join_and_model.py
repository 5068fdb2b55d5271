"""The Jaccard join and the language model against brute force."""

import random
from collections import defaultdict

import pytest

import brute
from loomgraph.llm import jaccard, katz


def near_copies(seed, n=60):
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = []
    for i in range(n):
        kind = r.random()
        if kind < 0.45 and docs:
            w = (docs[r.randrange(len(docs))][1] or "x").split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(["new", "words", "put", "in"])
            docs.append((i, r.choice([str, str.upper])(" ".join(w))))
        else:
            t = " ".join(f"w{r.randrange(400)}" for _ in range(r.choice([1, 3, 5, 6, 30, 90, 250])))
            docs.append((i, passage + "\n" + t if r.random() < 0.6 else t))
    return docs + [(n, ""), (n + 1, None), (n + 2, "  \n"), (n + 3, "one word"), (n + 4, "One word")]


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_is_the_brute_force(make, seed):
    docs = near_copies(seed)
    got = {r["doc_id"]: r for r in jaccard.similar(make(docs)).collect()}
    assert len(got) == len(docs)
    for i, n, links, least in brute.jaccard(docs):
        r = got[i]
        assert (r["n_shingles"], r["n_similar"], r["component_id"]) == (n, links, least), i


def test_similar_of_nothing_and_of_repeated_rows(make):
    assert jaccard.similar(make([])).collect() == []
    rows = jaccard.similar(make([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_similar"]) for r in rows) == [(0, 0), (0, 2), (1, 2), (1, 2)]


def test_keep_one_keeps_the_least_of_each_group(make):
    docs = near_copies(3)
    kept = {r["doc_id"] for r in jaccard.keep_one(make(docs)).collect()}
    assert kept == {i for i, _, _, least in brute.jaccard(docs) if i == least}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "x long, y long")
    got = {r["node"]: r["component"] for r in jaccard.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


@pytest.mark.parametrize(("seed", "order", "hot"), [(1, 3, 4096), (2, 3, 20), (3, 2, 20), (4, 1, 4096), (5, 4, 50)])
def test_katz_is_the_brute_force(make, seed, order, hot):
    r = random.Random(seed)
    vocab = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(30))
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 7, 60, 300]))) + (" " + passage if i % 4 == 0 else "")) for i in range(80)]
    docs += [(90, None), (91, "unheard Of\nwords w1 W1"), (92, docs[8][1]), (93, passage + " " + passage), (93, "w1"), (94, "same " * 3000)]
    model = brute.Katz([brute.tokens(t) for i, t in docs if brute.crc(i, 5) != 1], order)
    got = defaultdict(list)
    for x in katz.score(make(docs), block_bytes=3000, bucket_bytes=9000, order=order, hot=hot).collect():
        got[x["doc_id"]].append(x)
    assert sum(map(len, got.values())) == len(docs)
    for i, t in docs:
        k = brute.tokens(t)
        x = next(x for x in got[i] if x["n_tokens"] == len(k))
        assert (x["held_out"], x["n_known"], x["train_tokens"]) == (brute.crc(i, 5) == 1, sum(v in model.uni for v in k), model.n)
        assert x["base_score"] == pytest.approx(model.base(k), rel=1e-9)
        assert x["score"] == pytest.approx(model.score(k), rel=1e-9)
    words = [*model.uni, "never seen"]
    for h in [("<s>",) * (order - 1), ("w1",) * (order - 1), *(tuple(passage.split()[j : j + order - 1]) for j in range(5))]:
        assert sum(model.p(h, w) for w in words) == pytest.approx(1)


def test_katz_of_nothing(make):
    assert katz.score(make([])).collect() == []
    (x,) = katz.score(make([(None, "some words")])).collect()
    assert (x["held_out"], x["train_tokens"], x["score"], x["base_score"]) == (None, 0, 0, 0)
