"""Benchmark items without an id."""

from loomgraph.llm import decontam


def test_null_id_hits_without_a_name(make, spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = make([(1, "so " + item.upper() + " it ends"), (2, "nothing of it"), (3, "a b c d e f g h i j")])
    bench = spark.createDataFrame([(None, item), (7, "a b c d e f g h i j"), (None, "a b c d e f g h i j")], "item_id long, text string")
    for size in (8 << 20, 30):
        got = {x["doc_id"]: (x["n_hit"], x["items"]) for x in decontam.decontaminate(docs, bench, block_bytes=size).collect()}
        assert got == {1: (11, []), 2: (0, []), 3: (10, ["7"])}
        assert [x["doc_id"] for x in decontam.drop_contaminated(docs, bench, block_bytes=size).collect()] == [2]
