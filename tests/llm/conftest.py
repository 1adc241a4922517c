import pandas as pd
import pytest

#: Null, empty, blank, repeated, tied and long texts, with columns whose names the operators use themselves.
ODD = [
    (1, "a b c d e f g", "s1"), (1, "a b c d e f g", "s1"), (2, "a b c d e f g", None), (3, None, "s1"), (4, "", "s2"), (5, " \n\t ", "s2"),
    (None, "no id here at all", "s3"), (None, None, None), (6, "x", "s3"), (7, "the same line\nthe same line\nthe same line", "s2"),
    (8, " ".join(f"w{i}" for i in range(3000)), "s1"), (9, " ".join(f"w{i}" for i in range(3000)) + " end", "s2"), (10, "é中 \U0001f600 café", "s4"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, s, 5, "k", 2, "z") for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, j_tk int, d_tk string, m_h int, s_shard string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")
