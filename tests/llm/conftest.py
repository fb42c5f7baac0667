import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"word{i % 700}" for i in range(30_000))
    plain = "the cat sat on the mat and then the dog came in to look at it again"
    rows = [(1, plain, "en", "a", 10), (1, plain, "en", "a", 10), (2, None, "en", None, None), (3, "", None, "a", 0),
            (4, " \t\n", "en", "a", 3), (None, plain, None, None, None), (5, long, "en", "a", len(long)),
            (6, "one", "de", "b", 3), (7, "12 34 --", "de", "b", 8), (8, plain, "en", "c", 10), (None, None, None, None, None)]
    names = ["score", "held_out", "node", "predicted", "_label", "item", "block"]
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"{n} string" for n in names)).repartition(3)


@pytest.fixture(scope="session")
def hard_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (5, 0, 1), (5, 1, 1), (6, 0, 0), (7, 1, 0), (99, 0, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture()
def tables(spark):
    return lambda name, sf=SMALL: spark.read.parquet(f"{sf}/{name}.parquet")
