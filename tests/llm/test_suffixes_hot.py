"""Anchors of very many regions: what is asked for and sent follows what repeats, and results stay those of brute force."""

import random

import pyarrow as pa
import pytest

import brute
from loomgraph.llm import suffixes as s


def passed(texts, most_in_block, most, held=10**6):
    """The rows that leave the buckets of anchors of one block."""
    ids = pa.array(range(len(texts)), pa.int64())
    rows = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["id", "text", "body"])
    first = list(s.first_pass(100, 1, 5 << 20, most_in_block)(iter([rows])))
    return [r for b in s.compare_regions(100, 1, most, held)(iter(first)) for r in b.to_pylist()]


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("held", [10**6, 100])
def test_a_common_phrase_alone_asks_for_no_text(held):
    r = random.Random(1)
    phrase = words(r, 8)
    texts = [words(r, 30) + " " + phrase + " " + words(r, 30) for _ in range(400)]
    asked = lambda: {x["id"] for x in passed(texts, 10**6, 256, held) if x["kind"] == s.ASK}
    assert len(asked()) < 20  # some agree in 16 bits by chance
    # two of them share more than the phrase
    texts[7] = texts[300][:150] + words(r, 30) + phrase + texts[300][-100:]
    assert {7, 300} <= asked() and len(asked()) < 20


def test_single_strings_are_sent_without_their_bytes():
    r = random.Random(2)
    quote = words(r, 40)
    texts = [words(r, 20) + quote + words(r, 20) for _ in range(300)]
    sent = [x for x in passed(texts, 20, 20) if x["kind"] not in (s.ASK, s.GONE)]
    strings = 300 * 99  # about as many begin before the quote and end in it, or after
    assert sent and sum(len(x["blob"]) for x in sent) < 14 * strings


@pytest.mark.parametrize(("seed", "most", "held", "block"), [(1, 2, 25, 4_000), (2, 6, 60, 4_000), (3, 12, 10**6, 4_000), (4, 12, 30, 10**6), (5, 40, 90, 12_000)])
def test_quotes_of_every_frequency_are_the_brute_force(make, seed, most, held, block):
    r = random.Random(seed)
    quotes = [words(r, k) for k in (3, 6, 13, 16, 30)]
    docs = []
    for i in range(160):
        tail = words(r, r.choice([4, 15]))
        docs.append((i, words(r, r.choice([2, 15])) + r.choice([*quotes, quotes[4]]) + r.choice(["", ".", "!"]) + r.choice([tail, quotes[1] + tail, docs[-1][1][-90:] if docs else tail])))
    r.shuffle(docs)
    got = {x["doc_id"]: x for x in s.deduplicate(make(docs), most=most, held=held, block_bytes=block, bucket_bytes=30_000).collect()}
    for i, n, gone, spans, sha in brute.repeats(docs):
        x = got[i]
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) == (n, gone, spans, sha), i
