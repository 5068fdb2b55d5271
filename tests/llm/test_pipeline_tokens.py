"""The pipeline's last stage gives what it is named for."""


def test_ids_and_text(make):
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline
    from loomgraph.llm import sentpiece
    from loomgraph.llm.queries import MODEL

    docs = {1: "One  two\n three", 2: None, 3: "", 4: "Ünï cÖdé — 日本 \x01", 5: "a b " * 700}
    path = public_tokenizers.path(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = make(list(docs.items()))
    got = {x["doc_id"]: x for x in corpus_pipeline.tokens(table.sparkSession, table, "").collect()}
    assert {i: x["ids"] for i, x in got.items()} == {i: sp.encode(t or "") for i, t in docs.items()}
    assert {i: x["decoded"] for i, x in got.items()} == {i: sp.decode(sp.encode(t or "")) for i, t in docs.items()}
    want = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in sentpiece.digests(table, path).collect()}
    assert {i: (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for i, x in got.items()} == want
