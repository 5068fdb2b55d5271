import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def make(spark):
    """A table of doc_id and text, with columns beside them whose names clash with the operators' own."""

    def table(rows, clash=True):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        if clash:
            df = df.selectExpr("doc_id", "text", "1 as id", "2 as n", "3 as token", "4 as rep", "5 as kept", "6 as score", "7 as n_words", "8 as tokens", "9 as learn", "10 as block")
        return df.repartition(3)

    return table
