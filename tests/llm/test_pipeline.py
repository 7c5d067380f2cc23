from collections import Counter

import corpus_pipeline as cp
from emberwake.llm import jaccard, pieces
from emberwake.llm.queries import ORACLES, QUERIES
from tests.conftest import rows


def test_queries_have_their_names():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


def test_oracles(spark, duck, sf_dir):
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(sql).df()
        assert rows(got[sorted(want.columns)]) == rows(want), name


def test_stages(spark, sf_dir, docs):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = cp.keep_known_language(spark, table, sf_dir)
    assert known.columns == table.columns and known.count() >= 0.99 * table.where("length(text) > 20").count()
    one = cp.keep_one_of_copies(spark, known, sf_dir)
    want = {r.component_id for r in jaccard.jaccard_classes(known).collect()}
    assert {r.doc_id for r in one.select("doc_id").collect()} == want
    masked = cp.mask_secrets(spark, docs, sf_dir)
    assert masked.count() == docs.count() and masked.columns == docs.columns
    mixed = cp.mix_sources(spark, masked, sf_dir)
    assert mixed.columns == docs.columns
    assert cp.keep_one_of_copies(spark, docs.where("doc_id = 8"), sf_dir).count() == 1


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert out.columns == pieces.piece_digests(table, cp.tokenizer_file(cp.PIECES)).columns
    ids = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert ids and max(ids.values()) <= 2 and set(ids) <= {r.doc_id for r in table.select("doc_id").collect()}


def test_copies_without_or_with_repeated_ids(spark):
    """Null and repeated ids lose no text: one row of each class stays, whatever its id."""
    words = lambda a, n=60: " ".join(f"{a}{i}" for i in range(n))
    near = words("p") + " end"
    rows = [(None, words("a")), (None, words("b")), (None, words("b")), (None, None), (None, None), (1, words("c")), (1, words("d")), (1, words("d")), (2, words("p")), (1, near), (3, words("q")), (None, words("q")), (4, ""), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, cp.keep_one_of_copies(spark, df, "").collect()))
    want = [(None, words("a")), (None, words("b")), (None, None), (None, None), (1, words("c")), (1, words("d")), (1, near), (3, words("q")), (4, "")]
    assert got == Counter(want)


def test_links_of_sets_without_ids(spark):
    """Sets that only rows without an id hold, or rows of a repeated id, are verified and carry links on."""
    words = [f"w{i}" for i in range(80)]
    chain = [" ".join(words[:60]), " ".join(words[:68]), " ".join(words[:77])]
    df = spark.createDataFrame([(1, chain[0]), (None, chain[1]), (2, chain[2]), (1, " ".join(words[::-1]))], "doc_id long, text string")
    got = Counter(map(tuple, jaccard.jaccard_classes(df).collect()))
    assert got == Counter([(1, 56, 1), (None, 64, 1), (2, 73, 1), (1, 76, 1)])
