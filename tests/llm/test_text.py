import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as hs
from tokenizers import Tokenizer

from emberwake.llm import jaccard, language, lm_score, mixing, pieces, quality, secrets, tokens
from emberwake.llm.queries import tokenizer_file

PIECES, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.text(max_size=40), max_size=8))
def test_pieces_equal_the_library(batch):
    bpe, sp = pieces.load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    batch = [t.encode("utf-8", "ignore").decode() for t in batch]
    for t, ids in zip(batch, bpe.encode_all(batch), strict=True):
        assert ids == sp.encode(t) + [2]
        assert bpe.decode(ids) == sp.decode(sp.encode(t))


@pytest.mark.parametrize("text", ["a" * 3000, "=-" * 900, "  lead  and   runs   ", "\n\n a\n", "xyz" * 50 + " " + "the" * 40])
def test_pieces_without_spaces(text):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert pieces.load(PIECES).encode(text) == sp.encode(text) + [2]


def test_piece_digests(spark, docs, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = sp.encode(r.text or "")
        want.append((r.doc_id, len(ids) + 1, sha(" ".join(map(str, ids + [2]))), sha(sp.decode(ids))))
    assert Counter(map(tuple, pieces.piece_digests(docs, PIECES).collect())) == Counter(want)
    back = pieces.decode_pieces(pieces.encode_pieces(docs, PIECES), PIECES)
    assert Counter(map(tuple, back.collect())) == Counter((r.doc_id, sp.decode(sp.encode(r.text or ""))) for r in docs.collect())
    assert pieces.piece_digests(empty, PIECES).count() == 0


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    sets = [shingles(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r.doc_id)
    return Counter((r.doc_id, len(sets[i]), min((d for d in groups[find(i)] if d is not None), default=None)) for i, r in enumerate(rows))


def test_jaccard_classes(spark, docs, empty):
    assert Counter(map(tuple, jaccard.jaccard_classes(docs).collect())) == brute_classes(docs.collect())
    assert jaccard.jaccard_classes(empty).count() == 0


def test_jaccard_chains_and_common_passages(spark):
    """Chains whose ends do not link, copies, and a passage shared by texts that do not link."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(6):
        t = [word() for _ in range(150)]
        for _ in range(8):
            texts.append(" ".join(t))
            at = rng.randrange(0, 140)
            t = t[:at] + [word() for _ in range(5)] + t[at + 5 :]
    texts += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(rng.randrange(3, 40))]) for _ in range(20)] + texts[:5] + [" ".join(passage)] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(map(tuple, jaccard.jaccard_classes(df).collect())) == brute_classes(df.collect())


def test_jaccard_family_near_the_threshold(spark):
    """Many texts of one base, whose pairs fall on both sides of the threshold: what the bounds let through is exact."""
    import random

    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(80):
        t = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 4)):
            t[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_classes(df.collect())
    assert 1 < len({c for _, _, c in want}) < 80
    assert Counter(map(tuple, jaccard.jaccard_classes(df).collect())) == want


def test_mixing_matches_its_definition(spark, docs, empty):
    rows = [r.asDict() for r in mixing.mix_report(docs).collect()]
    assert len(rows) == docs.count() and mixing.mix_report(empty).count() == 0
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    by_id = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert r["target"] == pytest.approx(target[by_id[r["doc_id"]]]) and r["source_size"] == sizes[by_id[r["doc_id"]]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert Counter(map(str, rows)) == Counter(str(r.asDict()) for r in mixing.mix_report(docs.repartition(5)).collect())
    mixed = mixing.mix(docs)
    assert mixed.selectExpr("sum(size(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)))").first()[0] == sum(r["taken"] for r in rows)


def test_mixing_comes_near_its_targets(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i * 37 % 50), "abcd"[min(3, i % 7)]) for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix_report(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg({"target": "first", "taken": "sum"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] / r["first(target)"] - 1) < 0.03


def test_language(spark, docs, empty):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the dog with this water", "en"), ("la maison et le chien avec cette eau", "fr"), ("das haus und der hund mit diesem wasser", "de")] * 12)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(train, PIECES)
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame([(1, "the dog and this"), (2, "le chien et la"), (3, "1234 ?!"), (4, None), (5, ""), (6, "½ ²"), (7, "DER HUND")], "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["en", "fr", "und", "und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.language_report(docs, PIECES).count() == docs.count() and language.language_report(empty, PIECES).count() == 0
    kept = language.identify(docs, model, keep=True)
    assert kept.columns == [*docs.columns, "lang_pred", "score"] and kept.count() == docs.count()


def test_forward_sums_all_segmentations():
    lattice = language.lattice_of(PIECES)
    rng = np.random.default_rng(1)
    p = rng.random((lattice.size + 1, 2))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}

    def total(w, k):
        if not w:
            return 1.0
        out = 0.0
        for n in range(1, len(w) + 1):
            i = own.get(w[:n], lattice.size if n == 1 else None)
            if i is not None:
                out += p[i, k] * total(w[n:], k)
        return out

    words = ["▁the", "▁thing", "▁ça☃x", "▁a"]
    got = lattice.forward(lattice.edges(words), p)[1]
    assert got == pytest.approx(np.array([[total(w, k) for k in range(2)] for w in words]))
    weights = np.array([[2.0, 0], [1, 1], [0, 3], [5, 0]])
    expected = lattice.expected(words, weights, p)
    step = 1e-6
    for i in (own["▁th"], own["e"], lattice.size):  # d log Z / d log p
        q = p.copy()
        q[i] *= 1 + step
        change = (weights * (np.log(lattice.forward(lattice.edges(words), q)[1]) - np.log(got))).sum(0) / np.log1p(step)
        assert expected[i] == pytest.approx(change, rel=1e-3, abs=1e-6)


def test_token_files(spark, docs, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 500)
    t, start = Tokenizer.from_file(WORDS), 0
    got = sorted(map(tuple, tokens.token_report(docs, WORDS, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    for r, g in zip(rows, got, strict=True):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert g == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.token_report(empty, WORDS, str(tmp_path / "e")).count() == 0


@settings(max_examples=60, deadline=None)
@given(hs.lists(hs.integers(0, 6), max_size=400), hs.integers(0, 400), hs.integers(0, 400))
def test_grammar_round_trip(ids, a, b):
    ids = np.array(ids * 8, np.int64)
    g = tokens.Grammar(tokens.compress(ids, 7))
    assert (g.decode() == ids).all() and (g.decode(a, b) == ids[a:b]).all()


@settings(max_examples=150, deadline=None)
@given(hs.lists(hs.text(max_size=30), max_size=6))
def test_words_equal_the_library(batch):
    batch = [t.encode("utf-8", "ignore").decode() for t in batch] + ["It's <|endoftext|>don't 'll\x1c!ﬁ Ωσς"]
    w, t = tokens.words_of(WORDS), Tokenizer.from_file(WORDS)
    assert [np.frombuffer(x, w.kind).tolist() for x in w.encode(batch)] == [t.encode(x, add_special_tokens=False).ids for x in batch]


def test_secrets(spark, docs, empty):
    kinds = [("assign", 0, re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 6), ("access", 1, re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", 2, re.compile("[0-9a-f]+"), 0, 24)]
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.secret_report(docs).collect())
    want = Counter()
    for r in docs.collect():
        s = sorted((m.start(), k, n, m.end()) for n, k, p, g, least in kinds for m in p.finditer(r.text or "") if len(m[g]) >= least)
        c = Counter(x[2] for x in s)
        want[r.doc_id, c["assign"], c["access"], c["hex"], hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in s).encode()).hexdigest()] += 1
    assert got == want and secrets.secret_report(empty).count() == 0
    text = secrets.redact(docs).where("doc_id = 13").first().text
    assert text == "[SECRET] and [SECRET] [SECRET]" and secrets.redact(docs).count() == docs.count()


def test_ledger_scans_only_what_is_new(spark, docs):
    paths, first = secrets.scan(docs)
    ledger = spark.createDataFrame(first.collect(), first.schema)
    assert secrets.scan(docs, ledger)[1].count() == 0
    raised = tuple(secrets.Rule(r.kind, r.rank, 2, r.pattern, r.group, r.least, r.base) if r.kind == "hex" else r for r in secrets.RULES)
    again = secrets.scan(docs, ledger, raised)[1]
    assert {(r.kind, r.version) for r in again.select("kind", "version").distinct().collect()} == {("hex", 2)}
    # repeated rows are scanned together and bring equal rows
    assert again.distinct().count() == paths.select("blob").distinct().count()
    assert Counter(map(tuple, secrets.secret_report(docs, ledger).collect())) == Counter(map(tuple, secrets.secret_report(docs).collect()))


def test_quality(spark, docs, empty):
    rows = [(i, ("plain words in a row here " * 4) if i % 2 else ("BAD!! WORDS!! " * (3 + i % 5)), i % 2) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.quality_report(d, d.select("doc_id", "quality")).join(d, "doc_id")
    assert got.where("predicted != quality").count() == 0 and got.where("score < 0 or score > 1").count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_report(docs, none).count() == docs.count() and quality.quality_report(empty, none).count() == 0
    assert quality.quality_report(docs, spark.createDataFrame([(0, None), (None, 1), (1, 1), (1, 0)], "doc_id long, quality int")).count() == docs.count()


def test_lm_score_matches_a_plain_model(spark, docs, empty, monkeypatch):
    import math

    monkeypatch.setattr(lm_score, "BLOCK", 5000)
    good = spark.createDataFrame([(0,), (6,), (None,), (99,)], "doc_id long")
    got = lm_score.score_documents(docs, good, PIECES).collect()
    enc, size = lm_score.pieces_of(PIECES).encode, lm_score.pieces_of(PIECES).size
    rows = docs.collect()

    def model(texts):
        c = Counter(p for t in texts for p in zip(enc(t or "").tolist(), enc(t or "").tolist()[1:], strict=False))
        ctx, fol, tok = Counter(), Counter(), Counter()
        for (a, b), n in c.items():
            ctx[a] += n
            fol[a] += 1
            tok[b] += n
        whole = sum(tok.values())

        def loss(t):
            ids = enc(t or "").tolist()
            out = 0.0
            for a, b in zip(ids, ids[1:], strict=False):
                u = (tok[b] + 0.5) / (whole + 0.5 * size)
                out -= math.log(max(c[a, b] - 0.75, 0) / max(ctx[a], 1) + (0.75 * fol[a] / ctx[a] if ctx[a] else 1.0) * u)
            return out / (len(ids) - 1)

        return loss

    target, base = model([r.text for r in rows if r.doc_id in (0, 6)]), model([r.text for r in rows])
    want = sorted((str(r.doc_id), target(r.text), base(r.text)) for r in rows)
    found = sorted((str(r.doc_id), r.target_loss, r.background_loss) for r in got)
    assert [w[0] for w in want] == [f[0] for f in found]
    assert np.array([f[1:] for f in found]) == pytest.approx(np.array([w[1:] for w in want]))
    assert lm_score.score_documents(empty, good, PIECES).count() == 0


def test_quality_does_not_depend_on_the_order_of_rows(spark):
    """Many rows of one labelled id, with different texts."""
    rows = [(i % 40, f"text {i} " + "word " * (i % 7) + "! " * (i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    one, two = (quality.train(d, labels) for d in (df, df.repartition(7, "text")))
    assert np.array_equal(one.feature, two.feature) and np.array_equal(one.leaf, two.leaf)


def test_a_worker_drops_a_model_before_it_makes_the_next(monkeypatch):
    """Also a model that is part of a cycle, as those with a memo of their own method are."""
    import gc
    import weakref

    from emberwake.llm import arrow

    class Model:
        def __init__(self):
            self.memo = arrow.Memo(self.make)

        def make(self, key):
            return key

    monkeypatch.setattr(arrow, "_models", {})
    first = arrow.held(lambda file: Model())
    gone = weakref.ref(first("a"))
    second = arrow.held(lambda file: gone())
    gc.disable()
    try:
        assert second("b") is None
    finally:
        gc.enable()


def test_memos_of_the_piece_encoder_are_bounded(monkeypatch):
    """Pairs asked in bulk are not kept twice, and forgotten segments are encoded as before."""
    texts = [f"word{i} other{i * 7919} und so weiter {'x' * (i % 90)}" for i in range(60)]
    bpe = pieces.PieceBpe(PIECES)
    bpe._fill(["▁" + w for w in "several plain words that no one has seen".split()])
    assert not bpe.compatible
    whole = bpe.encode_all(texts)
    monkeypatch.setattr(pieces, "MOST", 20)
    small = pieces.PieceBpe(PIECES)
    assert [small.encode_all([t])[0] for t in texts] == whole and len(small.segments) < 60 and len(small.compatible) < 60
