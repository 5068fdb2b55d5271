"""The pipeline's stages against brute force, each on what its predecessor kept, and the whole."""

import random

import brute


def test_stages_and_whole(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline
    from loomgraph.llm.queries import MODEL

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 7)))
    passage, item = " ".join(word() for _ in range(40)), " ".join(word() for _ in range(14))
    docs = []
    for i in range(80):
        t = " ".join(word() for _ in range(r.choice([5, 40, 120])))
        if i % 7 == 0:
            t += " " + passage
        if i % 11 == 0:
            t += "\n" + item.upper()
        if i % 13 == 0:
            t = "same words again and again here now " * 10
        if i % 17 == 0 and docs:
            t = (docs[r.randrange(len(docs))][1] or "") + " tail"
        docs.append((i, t, "en", "s", len(t)))
    docs += [(90, None, None, None, None), (91, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    by = {d[0]: d[1] for d in docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left = {x["doc_id"]: x["text"] for x in now.collect()}
        if name == "quality_rules":
            assert all(not brute.repetition(by[i])[-1] for i in left)
            assert all(brute.repetition(by[i])[-1] or brute.repetition(by[i])[4] for i in by if i not in left)
        if name == "near_duplicates":
            assert set(left) == {i for i, _, _, c in brute.jaccard(sorted(by.items())) if i == c}
        if name == "repeated_strings":
            assert set(left) == set(by)
            gone = {i: g for i, _, g, _, _ in brute.repeats(sorted(by.items()))}
            assert all(len((by[i] or "").encode()) - gone[i] == len((left[i] or "").encode()) for i in by)
        if name == "decontamination":
            assert set(left) == {i for i in by if not brute.contamination(by[i], [(1, item)])[-1]}
        by = left
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    want = {i: brute.sha(",".join(map(str, sp.encode(t or "")))) for i, t in by.items()}
    assert {x["doc_id"]: x["ids_sha256"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
