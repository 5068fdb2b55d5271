"""The pipeline's stages look at little text at once, whatever the size of a batch."""

import numpy as np

import corpus_pipeline
from loomgraph.llm import sentpiece
from loomgraph.llm.common import keep_runs


def test_rows_are_kept_by_small_runs(make):
    def most(run):
        assert run.n == 1 or len(run.data) <= 1 << 18
        return np.ones(run.n, bool)

    df = make([(i, "word " * 1_000) for i in range(300)])
    assert keep_runs(df, "text", most).count() == 300


def test_few_rows_are_encoded_at_once(make, monkeypatch):
    df = make([(i, f"some words and {i}") for i in range(1_000)])
    path = corpus_pipeline.tokenizer(corpus_pipeline.MODEL)
    encode = sentpiece.Codec.encode

    def few(self, texts):
        assert len(texts) <= 100
        return encode(self, texts)

    class Fn:
        schema = sentpiece.two(df, "doc_id", "text").schema
        mapInArrow = staticmethod(lambda fn, out: fn)  # noqa: N815

    monkeypatch.setattr(sentpiece.Codec, "encode", few)
    monkeypatch.setattr(sentpiece, "two", lambda *_: Fn)
    rows = df.select("doc_id", "text").toArrow().combine_chunks().to_batches()
    made = list(sentpiece.encode(df, path)(iter(rows)))
    assert sum(b.num_rows for b in made) == 1_000 and max(b.num_rows for b in made) <= 100
