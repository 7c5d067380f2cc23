"""Columns of docs with the operators' own names, in any case, and words of any length."""

import numpy as np
import pytest

import corpus_pipeline as cp
from emberwake.llm import language, mixing, secrets, words
from emberwake.llm.queries import tokenizer_file

NAMES = ["lang_pred", "score", "_address", "_blob", "_spans", "_i", "_s", "_n", "play", "Finish", "_text_key", "_id", "_key"]


def test_clashing_columns(spark, docs):
    more = docs.select("*", *[docs["doc_id"].alias(n) for n in NAMES])
    masked = secrets.redact(more)
    assert masked.columns == more.columns and masked.count() == more.count()
    mixed = mixing.mix(more)
    assert mixed.columns == [*more.columns, "play_", "finish_"]
    found = language.identify(more, language.train(docs, tokenizer_file(cp.PIECES)), keep=True)
    assert found.columns == [*more.columns, "lang_pred_", "score_"] and found.count() == more.count()
    known = cp.keep_known_language(spark, more, "")
    assert known.columns == more.columns and 0 < known.count() <= more.count()
    one = cp.keep_one_of_copies(spark, more, "")
    assert one.columns == more.columns and one.count() == cp.keep_one_of_copies(spark, docs, "").count()


def test_long_words_are_summed_whole():
    """In logs as in plain numbers, and without a cut or underflow at any length."""
    lattice = language.lattice_of(tokenizer_file(cp.PIECES))
    p = np.random.default_rng(3).random((lattice.size + 1, 2)) / 10
    own = ["▁" + "thequickbrownéfox" * k for k in (1, 2, 3)]
    plain = lattice.edges(own)
    assert lattice.log_totals(own, p) == pytest.approx(np.log(lattice.forward(plain, p)[1]))
    weights = np.array([[1.0, 0], [2, 3], [0, 4]])
    assert lattice.expected_counts(own, weights, p) == pytest.approx(lattice.expected(own, weights, p))
    tiny = np.full((lattice.size + 1, 2), 1e-6)
    assert np.isfinite(lattice.log_totals(["▁" + "x" * 5000], tiny)).all()


def test_scores_do_not_depend_on_the_memo(monkeypatch):
    p = np.random.default_rng(4).random((language.lattice_of(tokenizer_file(cp.PIECES)).size + 1, 2)) / 10
    model = language.LanguageModel(tokenizer_file(cp.PIECES), ("a", "b"), p)
    texts = [("word%d-été x%d " % (i, i % 7) * 3).encode() for i in range(300)] + [b"", b"12", b"long " * 3000]
    want = language.Scorer(model).totals(texts)
    monkeypatch.setattr(words, "RUN", 64)
    monkeypatch.setattr(language, "RUN", 64)
    scorer = language.Scorer(model)
    scorer.table = words.WordTable(7)
    scorer.forget()
    got = scorer.totals(texts)
    assert [x is None for x in got] == [x is None for x in want]
    assert np.array([x for x in got if x is not None]) == pytest.approx(np.array([x for x in want if x is not None]))
