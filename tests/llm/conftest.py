import pytest

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, near copies, a clashing column."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood at night"
    near = base.replace("lazy", "idle") + " " + base
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    rows = [
        (0, base, "en", "a", "x"), (1, base.upper(), "en", "a", "x"), (2, None, None, None, "x"), (3, "", "en", "b", "x"), (4, "one two", None, "b", "x"), (5, "one  two", "en", None, "x"),
        (6, near + " " + base, "en", "a", "x"), (7, base + " " + near, "fr", "a", "x"), (8, long, "fr", "c", "x"), (8, long, "fr", "c", "x"), (9, long + " tail", "fr", "c", "x"), (10, "12 34 !!", "en", "a", "x"),
        (None, "lost id", "en", "a", "x"), (11, "été où ça été où ça " * 3, "fr", "a", "x"), (12, "▁odd\tspaces \n 😀 end", "en", "a", "x"), (13, "password = hunter22 and AKIA" + "Q" * 16 + " " + "deadbeef" * 4, "en", "a", "x"), (14, "token=short: API_KEY: abcdef", "en", "a", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, member string").withColumn("n_chars", __import__("pyspark.sql.functions", fromlist=["length"]).length("text").cast("long"))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
