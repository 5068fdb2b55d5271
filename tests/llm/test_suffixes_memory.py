"""What a task of the repeated strings stage holds at once."""

import random
import tracemalloc

import pyarrow as pa
import zstandard

from loomgraph.llm import suffixes as s


def peak(fn, rows):
    fn = fn(iter([rows]))
    tracemalloc.start()
    try:
        for _ in fn:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def text(r, n):
    return "".join(r.choice("abcdefgh ") for _ in range(n))


def test_strings_of_very_common_anchors_take_no_bytes():
    r, n = random.Random(1), 100_000
    asks = [{"a": a, "more": 49, "back": 60, "group": 1} for a in range(0, n - 200, 50)]
    kind = pa.struct([(c, pa.int32()) for c in ("a", "more", "back", "group")])
    rows = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([zstandard.compress(text(r, n).encode())]), pa.array([asks], pa.list_(kind))], names=["id", "text", "body", "ask"])
    assert peak(s.cut_out(100, 4, 5 << 20), rows) < 60


def test_blocks_are_looked_at_in_small_runs():
    r = random.Random(2)
    texts = [text(r, 4_000) for _ in range(800)]
    ids = pa.array(range(len(texts)))
    assert peak(s.first_pass(100, 4, 5 << 20, 256), pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["id", "text", "body"])) < 90
