"""Values of a filter in SQL are bound where they stand, however many there are."""

import pytest

from loomgraph.operators import dialects
from loomgraph.operators import filters as f


@pytest.mark.parametrize("n", [1, 2, 3, 10])
def test_values_keep_their_places(spark, n):
    rows = spark.createDataFrame([(f"l{i % 7}", f"s{i % 5}", i) for i in range(200)], "lang string, source string, n long")
    tree = f.all_of(f.any_of(f.Leaf("lang", "IN", [f"l{k}" for k in range(n)]), f.Leaf("source", "TEXT_MATCH", "S2")), f.Leaf("n", "GTE", 20), f.Leaf("n", "LT", 150), f.none_of(f.all_of(f.Leaf("source", "EQ", "s1"))))
    want = [i for i in range(20, 150) if (i % 7 < n or i % 5 == 2) and i % 5 != 1]
    assert sorted(r["n"] for r in dialects.where_sql(rows, tree).collect()) == want


def test_marks_are_numbered_in_the_order_of_the_text():
    tree = f.all_of(f.Leaf("a", "IN", ["x", "y"]), f.Leaf("b", "IS_EMPTY"), f.none_of(f.all_of(f.Leaf("c", "EQ", 3))))
    text, values = dialects.to_sql(tree, mark=lambda k: f":v{k}")
    assert values == ["x", "y", 3] and text.index(":v0") < text.index(":v1") < text.index(":v2")
    assert dialects.to_sql(tree)[0].count("?") == 3
