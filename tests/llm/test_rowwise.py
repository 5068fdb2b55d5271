"""Operators that look at one text at a time, and chat formatting, against brute force and round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from loomgraph.llm import chat, decontam, licenses, quality, repetition, sentpiece, toxicity
from loomgraph.llm import textbuf as tb
from loomgraph.llm.common import crc_mod

TEXTS = ["", None, " \n\t", "One", "A b " * 3000, "Ünï cÖdé — dash\n\n\nline\nline\nline", "a" * 200_000, "x y z " * 40 + "end", "# $ % & | < > *", "\x00\x01 é　ü"]


def many(seed, n=80):
    r = random.Random(seed)
    return [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "\n".join(" ".join(r.choice(["aa", "Bb", "c,", "d!", "éé", "f"]) for _ in range(r.randrange(0, 40))) for _ in range(r.randrange(1, 6)))) for i in range(n)]


def test_words_and_lines():
    texts = [t for _, t in many(1)]
    for size in (1, 100, 1 << 20):
        for run in tb.runs(pa.array(texts), size):
            for table, rule in ((tb.PLAIN, brute.PLAIN), (tb.ALNUM, brute.ALNUM)):
                w = run.words(table)
                for d in range(run.n):
                    t = texts[run.first + d] or ""
                    got = [bytes(run.data[a:b]).decode() for a, b in zip(w.starts[w.offs[d] : w.offs[d + 1]], w.ends[w.offs[d] : w.offs[d + 1]])]
                    assert got == rule.findall(brute.low(t) if table is tb.ALNUM else t) or brute.low(" ".join(got)) == " ".join(rule.findall(brute.low(t)))
            a, b, doc = run.lines()
            for d in range(run.n):
                assert [bytes(run.data[x:y]).decode() for x, y in zip(a[doc == d], b[doc == d])] == (texts[run.first + d] or "").split("\n")


def test_repetition(make):
    docs = many(2)
    got = {r["doc_id"]: r for r in repetition.repetition(make(docs)).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.repetition(t), i
        assert not (r["kept"] and r["base_failed"])
    df = make(docs)
    kept = repetition.keep_good(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert repetition.repetition(make([])).collect() == []


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_decontamination(spark, make, block_bytes):
    r = random.Random(5)
    docs = many(3, 60) + [(900, " ".join(r.choice("abc") for _ in range(1500)))]
    items = [(i, " ".join(r.choice(["aa", "Bb", "c", "d", "éé", "f"]) for _ in range(r.choice([0, 1, 2, 5, 9, 10, 12, 30])))) for i in range(12)] + [(12, None), (12, "f aa"), (3, "Bb c d")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x for x in decontam.decontaminate(make(docs), bench, block_bytes=block_bytes).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        x = got[i]
        want = brute.contamination(t, items)
        assert (x["n_words"], x["n_hit"], x["n_items"], brute.sha(",".join(x["items"])), x["n_hit"] > 0) == want, i
        assert sum(s["end"] - s["start"] for s in x["spans"]) == x["n_hit"]
    clean = decontam.drop_contaminated(make(docs), bench, block_bytes=block_bytes)
    assert {x["doc_id"] for x in clean.collect()} == {i for i, x in got.items() if not x["n_hit"]}
    nothing = decontam.decontaminate(make(docs), bench.limit(0)).collect()
    assert len(nothing) == len(docs) and not any(x["n_hit"] for x in nothing)


def test_sentencepiece_is_the_library(make):
    import public_tokenizers
    import sentencepiece as library

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = library.SentencePieceProcessor(model_file=path)
    r = random.Random(4)
    alphabet = list("aabcdeeno st\n\t.▁éß") + ["  ", "the", "Ａ", "😀", "中", "\x00", "<s>", "<0x41>"]
    docs = many(4, 20) + [(500 + i, "".join(r.choice(alphabet) for _ in range(r.choice([1, 5, 80, 3000])))) for i in range(60)] + [(600, " " * 999), (601, "中文" * 999)]
    got = {x["doc_id"]: x for x in sentpiece.digests(make(docs), path).collect()}
    for i, t in docs:
        ids = sp.encode(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(sp.decode(ids))), i
    for x in sentpiece.encode(make(docs[:15]), path).collect():
        t = dict(docs)[x["doc_id"]] or ""
        assert x["ids"] == sp.encode(t) and x["decoded"] == sp.decode(x["ids"])
    assert sentpiece.digests(make([]), path).collect() == []


def test_sentencepiece_of_long_words_and_occurrences_that_wait():
    import time

    import public_tokenizers
    import sentencepiece as library

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, codec = library.SentencePieceProcessor(model_file=path), sentpiece.Codec(path)
    r = random.Random(14)
    words = [p.replace("▁", " ") for p in codec.model.pieces[300:]]
    texts = ["".join(r.choice("eteaho") for _ in range(r.choice([3, 20, 200, 900]))) for _ in range(100)]
    texts += ["".join(r.choice(words) for _ in range(r.choice([3, 30, 300]))) for _ in range(100)]
    texts += [r.choice(["e", "the", "tion", "ing", "aa", "==", "в", "an"]) * r.choice([3, 70, 500, 1500]) + r.choice(["", "x", "e "]) for _ in range(60)]
    assert codec.encode(texts) == sp.encode(texts)
    for t in ("e" * 200_000, "the" * 80_000, "".join(r.choice("abcdefghij0123456789+/") for _ in range(150_000))):
        began = time.time()
        got = codec.encode([t])[0]
        assert time.time() - began < 5 and got == sp.encode(t)  # some tenths of a second; quadratic time would be minutes


def test_quality_learns_a_form(spark, make):
    r = random.Random(6)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(60))
    docs = [(i, good() if i % 2 else " ".join(w + "###" for w in good().split())) for i in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, None), (7, 1)], "doc_id long, quality int")
    model = quality.train(make(docs), labels)
    got = {x["doc_id"]: x["score"] for x in quality.score(make(docs), model).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.7) == (i % 2 == 1) for i in range(200, 300)]) > 0.95
    none = quality.train(make(docs), labels.limit(0))
    assert {x["score"] for x in quality.score(make(docs), none).collect()} == {0.5}


def test_toxicity_learns_words_from_unlabelled_texts(spark, make):
    r = random.Random(7)
    text = lambda bad: " ".join(r.choice(["vile", "nasty"]) if bad and k in (3, 9) else f"w{r.randrange(300)}" for k in range(40))
    docs = [(i, text(i % 5 == 0)) for i in range(600)] + [(900, None)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(make(docs), labels)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(make(docs), model).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 5 == 0) for i in range(400, 600)]) > 0.95
    none = toxicity.train(make(docs), labels.limit(0))
    assert max(x["score"] for x in toxicity.score(make(docs), none).collect()) < 1e-9


def logistic(z):
    return 1 / (1 + np.exp(-min(40, max(-40, z))))


def test_toxicity_is_the_plain_computation(spark, make):
    """Counts, choice of features, weights and scores, text by text on one machine."""
    r = random.Random(17)
    text = lambda bad: " ".join(r.choice(["vileness", "nasty", "vilest"]) if bad and k in (3, 9) else f"w{r.randrange(90)}é" for k in range(r.choice([3, 40])))
    docs = [(i, text(i % 5 == 0)) for i in range(300)] + [(900, None), (901, ""), (902, "vileness " * 60_000), (903, "vilest"), (903, "Vilest")]
    labels = [(i, int(i % 5 == 0)) for i in range(200)] + [(3, 1), (4, 1), (4, 0), (4, 0), (7, None), (None, 1)]
    model = toxicity.train(make(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), usable=crc_mod(F.col("doc_id"), 3) != 1)
    features = lambda t: toxicity.words(next(tb.runs(pa.array([t or ""]))))[0]
    assert len(features("ab abcd abcde abcdf")) == 5  # four words and one beginning
    vote = {}
    for i, y in labels:
        if i is not None and y is not None and brute.crc(i, 3) != 1:
            vote.setdefault(i, []).append(y)
    least = {}
    for i, t in docs:
        least[i] = min(x for x in (least.get(i), t) if x is not None) if t is not None or least.get(i) is not None else None
    toxic = sorted(features(least[i]).tobytes() for i, ys in vote.items() if sum(ys) * 2 >= len(ys) and i in least)
    other = sorted(features(least[i]).tobytes() for i in least if brute.crc(i, 3) != 1)
    toxic, other = ([np.frombuffer(x, np.int32) for x in xs] for xs in (toxic, other))
    p, u = (np.bincount(np.concatenate(x), minlength=1 << toxicity.BITS) for x in (toxic, other))
    chosen = toxicity.choose(len(toxic), len(other), np.arange(len(p)), p, u, 4096, 4.0)
    place = {c: k for k, c in enumerate(chosen.tolist())}
    rows = [sorted(([place[c] for c in x.tolist() if c in place] for x in xs), key=lambda v: np.array(v, np.int32).tobytes()) for xs in (toxic, other)]
    ys = [y for ys in vote.values() for y in ys]
    plain = toxicity.fit(*([np.array(v, np.int32) for v in x] for x in rows), sum(ys) / len(ys), chosen)
    for x in toxicity.score(make(docs), model).collect():
        texts = [t for i, t in docs if i == x["doc_id"]]
        assert any(x["score"] == pytest.approx(logistic(sum(float(plain.weights[c]) for c in features(t)) + plain.base), abs=1e-6) for t in texts)
    assert toxicity.score(make([]), model).collect() == []


def test_quality_is_the_plain_computation(spark, make):
    """The fitted tables are those of the plain list of labelled texts, and a score is a sum of looked-up values."""
    r = random.Random(16)
    docs = [(i, " ".join(r.choice(["aa", "b#", "ccc", "d,"][: 2 + i % 3]) for _ in range(r.randrange(1, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "aa b# " * 40_000), (3, "zz")]
    labels = [(i, i % 3 // 2) for i in range(120)] + [(7, None), (None, 1), (9, 0), (9, 1)]
    model = quality.train(make(docs), spark.createDataFrame(labels, "doc_id long, quality int"), usable=crc_mod(F.col("doc_id"), 4) != 2)
    row = lambda t: quality.features(next(tb.runs(pa.array([t]))))[0]
    vote, least = {}, {}
    for i, y in labels:
        if i is not None and y is not None and brute.crc(i, 4) != 2:
            vote.setdefault(i, []).append(y)
    for i, t in docs:
        if t is not None:
            least[i] = min(least.get(i, t), t)
    rows = sorted((row(least[i]).tobytes(), int(sum(ys) / len(ys) >= 0.5)) for i, ys in vote.items() if i in least)
    plain = quality.fit(np.array([np.frombuffer(x) for x, _ in rows]), np.array([y for _, y in rows]))
    for x in quality.score(make(docs), model).collect():
        found = []
        for i, t in docs:
            if i == x["doc_id"]:
                f = row(t or "")
                at = [sum(e <= v for e in edges) for v, edges in zip(f.tolist(), plain.edges)]
                z = plain.base + sum(float(t[k]) for t, k in zip(plain.tables, at))
                z += sum(float(t[at[i], at[j]]) for (i, j), t in zip(plain.pairs, plain.pair_tables))
                found.append(z)
        assert any(x["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9) for z in found)
    assert quality.score(make([]), model).collect() == []


def test_licenses(make):
    docs = [(1, "text\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Released under the MIT License."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, "my driving license is old"), (6, None), (7, ""), (8, "This work is licensed under the GNU General Public License, version 2."), (9, "Licensed under CC BY 4.0."), (10, "no " * 50_000), (11, "Licensed under CC BY-NC-ND 4.0.")]
    got = {x["doc_id"]: x["licenses"] for x in licenses.scan(make(docs)).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["MIT"], 3: ["GPL-3.0"], 4: ["CC-BY-NC-4.0"], 5: [], 6: [], 7: [], 8: ["GPL-2.0"], 9: ["CC-BY-4.0"], 10: [], 11: []}
    assert licenses.scan(make([])).collect() == []


def conversations(seed):
    r = random.Random(seed)
    out, all_ = [], []
    for c in range(40):
        turns = list(all_[r.randrange(len(all_))])[: r.choice([1, 2, 300, 999])] if all_ and r.random() < 0.5 else []
        turns += [(r.choice(["user", "assistant"]), r.choice(["x", "y", "<|im_end|>", ""])) for _ in range(r.choice([0, 1, 3, 400]) if c % 9 == 0 else r.randrange(0, 3))]
        all_.append(turns)
        out += [(c, k * 3, *t) for k, t in enumerate(turns)]
    return out, all_


def test_chat_collapse(spark):
    turns, all_ = conversations(8)
    turns += [(None, 1, "user", "lost"), (50, None, None, None), turns[0]]
    all_ += [[]] * 10 + [[("", "")]]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pos", chat.F.lit(1)).repartition(3)
    got = sorted((r["conv_id"], r["part"], r["n_turns"], r["text"]) for r in chat.render(df).collect())
    want = []
    for c, t in enumerate(all_):
        if t and not any(u[: len(t)] == t and (len(u) > len(t) or d < c) for d, u in enumerate(all_) if d != c):
            said = [f"<|im_start|>{a}\n{b.replace('<|im_', '<| im_')}<|im_end|>\n" for a, b in t]
            want += [(c, k // 64, len(t), "".join(said[k : k + 64])) for k in range(0, len(t), 64)]
    assert got == sorted(want)
    assert chat.render(df.limit(0)).collect() == []


def test_a_hash_of_bytes_is_sha256():
    assert brute.sha("x") == hashlib.sha256(b"x").hexdigest()
