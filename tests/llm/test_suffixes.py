"""Suffix arrays and the removal of repeated strings against brute force."""

import random

import numpy as np
import pytest

import brute
from loomgraph.llm import suffixes
from loomgraph.llm.sais import permuted_lcp, suffix_array


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(1)
    for _ in range(400):
        s = r.integers(0, int(r.integers(1, 5)), int(r.integers(0, 60)))
        n = len(s)
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        common = permuted_lcp(s, sa, 10)
        for a, b in zip(sa[:-1], sa[1:]):
            k = 0
            while max(a, b) + k < n and s[a + k] == s[b + k] and k < 10:
                k += 1
            assert common[b] == k


def test_suffix_arrays_of_repetitive_strings():
    r = np.random.default_rng(2)
    for k in range(300):
        s = np.repeat(r.integers(0, 3, 30), r.integers(1, 8, 30)) if k % 2 else np.tile(r.integers(0, 4, int(r.integers(1, 9))), 20)
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    n = 200_000
    assert suffix_array(np.ones(n)).tolist() == list(range(n))[::-1]
    saw = np.arange(n) % 7
    order = suffix_array(saw)
    assert (saw[order][1:] >= saw[order][:-1]).all() and permuted_lcp(saw, order, 100).max() == 100


def texts(seed, many=False):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéü") for _ in range(r.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(k)) for k in (18, 25, 60)]
    out = []
    for i in range(400 if many else 60):
        kind = r.random()
        if kind < 0.2 and out:
            t = list(out[r.randrange(len(out))][1] or "x")
            for _ in range(r.choice([0, 1, 3])):
                t[r.randrange(len(t))] = "#"
            out.append((i, "".join(t)))
        elif kind < 0.25:
            out.append((i, r.choice(["a", "ab", "é"]) * r.randrange(1, 400)))
        else:
            parts = [" ".join(word() for _ in range(r.randrange(0, 12))) for _ in range(3)]
            out.append((i, parts[0] + r.choice([*passages, passages[0]]) + parts[1] + r.choice(["", passages[2]]) + parts[2]))
    r.shuffle(out)
    return out + [(1000, ""), (1001, None), (1002, "é" * 49 + "x"), (1003, "é" * 50), (1004, "é" * 50)]


@pytest.mark.parametrize(("seed", "many", "most"), [(1, False, 256), (2, False, 2), (3, True, 256), (4, True, 5)])
def test_deduplicate_is_the_brute_force(make, seed, many, most):
    docs = texts(seed, many)
    got = {r["doc_id"]: r for r in suffixes.deduplicate(make(docs), most=most, block_bytes=20_000).collect()}
    assert len(got) == len(docs)
    for i, n, gone, spans, sha in brute.repeats(docs):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, sha), i
        assert sum(s["end"] - s["start"] for s in r["spans"]) == gone


@pytest.mark.parametrize("seed", [5, 6])
def test_small_buckets_parts_and_states_change_nothing(make, seed):
    docs = texts(seed, True)
    got = {r["doc_id"]: r for r in suffixes.deduplicate(make(docs), most=3, block_bytes=9_000, bucket_bytes=20_000, held=40, part=500).collect()}
    for i, n, gone, spans, sha in brute.repeats(docs):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, sha), i


def test_a_long_text_is_looked_at_in_pieces(make):
    r = np.random.default_rng(8)
    long = bytes(r.integers(97, 123, 3 * suffixes.RUN, np.uint8)).decode()
    cuts = [0, suffixes.RUN - 150, suffixes.RUN - 50, 2 * suffixes.RUN - 100, len(long) - 300]
    docs = [(1, long + long[5:300]), *((10 + k, "#" + long[c : c + 250]) for k, c in enumerate(cuts)), (20, long[: suffixes.RUN * 2] + "!" + long[suffixes.RUN * 2 :])]
    got = {x["doc_id"]: x["spans"] for x in suffixes.deduplicate(make(docs)).collect()}
    assert got[1] == [(len(long), len(long) + 295)]
    assert all(got[10 + k] == [(1, 251)] for k in range(5))
    assert got[20] == [(0, 2 * suffixes.RUN), (2 * suffixes.RUN + 1, len(long) + 1)]


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        suffixes.deduplicate(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x" * 200, "u", 1), (2, "x" * 200, "v", 2)], "doc_id long, text string, __gone string, `_Gone` int").withColumn("gone", suffixes.F.lit(3)).withColumn("a.b", suffixes.F.lit(4))
    out = suffixes.without_repeats(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["__gone"], r["gone"]) for r in out.collect()) == [(1, "x", "u", 3), (2, "", "v", 3)]


def test_nothing_null_ids_and_repeated_rows(make):
    assert suffixes.deduplicate(make([])).collect() == []
    rows = suffixes.deduplicate(make([(1, "xy" * 10 + "z" * 90), (1, "xy" * 10 + "z" * 90), (None, "xy" * 10 + "z" * 90), (2, "xy" * 10 + "z" * 90), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 0, 0), (0, 110, 0), (1, 110, 0), (1, 110, 0), (2, 110, 110)]


def test_without_repeats_keeps_rows_and_columns(make):
    docs = texts(4)
    df = make(docs)
    out = suffixes.without_repeats(df)
    assert out.columns == df.columns
    left = {i: n - gone for i, n, gone, _, _ in brute.repeats(docs)}
    for r in out.collect():
        assert r["text"] is None or left[r["doc_id"]] - 6 <= len(r["text"].encode()) <= left[r["doc_id"]]
