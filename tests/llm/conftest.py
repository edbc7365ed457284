import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


#: Texts that every text operator must take: null, empty, white space, one word, very long, repeated.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "Wort"), (5, "a b"), (6, "word " * 30000), (7, "Wort"), (None, "no id here at all"), (8, "é ß   x"), (9, "\x00\x1c mixed \x85 blanks")]


@pytest.fixture
def odd(spark):
    rows = [(i, t, "clash") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string").withColumnRenamed("id", "bucket")
