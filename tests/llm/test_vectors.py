import numpy as np
import pytest

from emberwake.llm import ann, neardup


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = []
    centers = rng.normal(size=(12, 8))
    for i in range(400):
        v = centers[i % 12] + rng.normal(size=8) * (0.05 if i % 3 else 0.6)
        rows.append((i, [float(x) for x in v.astype(np.float32)], None if i % 41 == 0 else int(i % 2)))
    rows += [(400, rows[1][1], 1), (401, rows[1][1], 1), (402, None, 1), (403, [0.0] * 8, 1), (404, [float("nan")] + [1.0] * 7, 1), (405, [float("inf")] + [1.0] * 7, 0), (406, [None] + [1.0] * 7, 0), (407, [], 0), (None, rows[2][1], 0), (408, [1.0, 2.0], 0), (409, [2.0, 4.0], 0), (5, rows[5][1], 1), (410, [-0.0, 1.0], 1), (411, [0.0, 1.0], 1), (420, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def fine(r):
    return r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)


@pytest.mark.parametrize("tile,block", [(4096, 256), (25, 7)])
def test_near_duplicates(vectors, monkeypatch, tile, block):
    monkeypatch.setattr(neardup, "TILE", tile)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = {r.vec_id: r for r in vectors.collect() if fine(r) and r.label is not None}
    links = {i: set() for i in rows}
    for a in rows.values():
        for b in rows.values():
            if a.vec_id != b.vec_id and a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding, float), np.array(b.embedding, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98 - 1e-12:
                    links[a.vec_id].add(b.vec_id)

    def component(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min(seen)

    got = neardup.near_duplicates(vectors).collect()
    assert len(got) == vectors.count()
    for r in got:
        if r.vec_id in links:
            assert (r.n_links, r.component_id) == (len(links[r.vec_id]), component(r.vec_id))
        else:
            assert (r.n_links, r.component_id) == (0, r.vec_id)
        assert r.kept == (r.vec_id is None or r.vec_id == r.component_id)
    assert neardup.near_duplicates(vectors.limit(0)).count() == 0
    assert neardup.near_duplicates(vectors.where("vec_id in (402, 403)")).count() == 2


@pytest.mark.parametrize("shard", [16_384, 90])
def test_nearest(vectors, monkeypatch, shard):
    monkeypatch.setattr(ann, "SHARD", shard)
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect() if fine(r)}
    got = {}
    for r in ann.nearest(vectors, k=20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    queries = [i for i in rows if i % 20 == 0]
    assert set(got) == set(queries)
    hits = total = 0
    for q in queries:
        mine = sorted(((-float(v @ rows[q]), i) for i, v in rows.items() if i != q and len(v) == len(rows[q])))[:20]
        assert sorted(got[q]) == list(range(1, len(mine) + 1))
        found = [got[q][k] for k in sorted(got[q])]
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)
        for i, s in found:
            assert s == pytest.approx(float(rows[i] @ rows[q]))
        hits += len({i for _, i in mine} & {i for i, _ in found})
        total += len(mine)
    assert hits / total >= 0.9
    assert ann.nearest(vectors.limit(0)).count() == 0
