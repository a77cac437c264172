"""Whitening and vector codes against plain numpy, with nulls, odd rows, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import queries, vector_codes, whitening
from gridspark.llm import vectors as vs
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("x", "ids", "code", "error", "of", "dims", "count", "part", "at", "value", "n")})


@pytest.fixture(scope="module")
def rows():
    """Clusters, copies, bad vectors, odd lengths, repeated rows and rows without id or label."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 8))
    out = [(i, [float(np.float32(v)) for v in centres[i % 6] + rng.normal(0, 0.05 if i % 2 else 0.4, 8)], i % 3) for i in range(420)]
    out += [(1000 + i, out[7][1], 1) for i in range(60)] + [out[3], out[3]]
    out += [(5, None, 1), (2000, [1.0] * 7 + [None], 1), (2001, [float("nan")] + [1.0] * 7, 2), (2002, [float("inf")] * 8, 2), (2003, [], 1), (2004, [1.0, 2.0], 1)]
    return [*out, (None, out[9][1], None), (2005, out[10][1], None)]


def stay(rows):
    return [(i, v, label) for i, v, label in rows if v and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v)]


def integers(rows):
    return np.floor(np.array([[float(np.float32(c)) for c in v] for _, v, _ in rows]) * 1024).astype(np.int64)


def test_whitening(spark, rows):
    kept = stay(rows)
    x = integers(kept) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    want = centred @ basis / np.sqrt(values)
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    for k in range(8):
        mine = [r for r in got if r.component == k + 1]
        said = sorted((r.vec_id is not None, r.vec_id, r.deviation, r.whitened) for r in mine)
        for sign in (1, -1):
            plain = sorted((i is not None, i, d, sign * w) for (i, _, _), d, w in zip(kept, deviation, want[:, k], strict=True))
            if np.allclose([a[3] for a in said], [a[3] for a in plain], atol=1e-8):
                break
        assert [a[:3] for a in said] == [a[:3] for a in plain] and np.allclose([a[3] for a in said], [a[3] for a in plain], atol=1e-8)
        assert np.allclose({r.explained for r in mine}.pop(), values[k] / values.sum(), rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9 and max(r.residual for r in got) < 1e-11


def test_whitening_without_variance(spark):
    for few in ([], [(1, [1.0, 2.0], 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], [(1, None, 1)]):
        assert whitening.whiten(table(spark, few)).count() == 0
    flat = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i], 1) for i in range(5)])).collect()  # one dimension only
    assert {r.component for r in flat} == {1} and len(flat) == 5 and flat[0].explained == pytest.approx(1, abs=1e-9)


def test_large_entries(spark):
    """Deviations are exact as long as they are longs, else null; integers end at 2^52."""
    got = whitening.whiten(table(spark, [(1, [1e30, 0.0], 1), (2, [-1e30, 1.0], 1), (3, [0.0, 0.5], 1)])).collect()
    assert all(r.deviation is None for r in got if r.vec_id < 3) and {r.vec_id for r in got} == {1, 2, 3}
    x = np.array([[10**9, 5], [-(10**9), 7]], np.int64)
    assert whitening._deviations(x, 2, x.sum(0)) == [4 * 10**18 + 4, 4 * 10**18 + 4]
    assert whitening._deviations(x * 2, 2, x.sum(0) * 2) == [None, None]


def test_clustered_spectrum(spark):
    """A cluster of eigenvalues wider than the block, and passes that are fewer than a solver without a filter takes."""
    rng = np.random.default_rng(1)
    dims = 96
    scale = np.concatenate([[3.0, 2.5], np.full(60, 1.0), np.full(dims - 62, 0.2)])
    data = table(spark, [(i, [float(v) for v in row], 1) for i, row in enumerate(rng.normal(0, 1, (1500, dims)) * scale)])
    held, width = whitening.integer_vectors(data)
    model = whitening.fit(held, width)
    x = np.array([r.x for r in held.collect()], np.float64)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:8]
    assert np.allclose(model.values, values, rtol=1e-10) and model.residuals.max() < 1e-11 and model.passes < 300


def test_sums_beyond_the_bound_are_shuffled(spark, rows, monkeypatch):
    want = {(r.vec_id, r.code) for r in vector_codes.compress(table(spark, rows))[0].collect()}
    monkeypatch.setattr(vs, "GATHERED", 0)
    assert {(r.vec_id, r.code) for r in vector_codes.compress(table(spark, rows))[0].collect()} == want
    assert max(r.identity_error for r in whitening.whiten(table(spark, rows)).collect()) < 1e-9


def plain_codes(kept, entries=256):
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = integers(kept)
    w = x.shape[1] // 4
    books = [x[:entries, p * w : (p + 1) * w].copy() for p in range(4)]

    def near(p):
        d = np.square(x[:, None, p * w : (p + 1) * w] - books[p][None]).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(4):
        for p in range(4):
            code = near(p)[0]
            for e in set(code.tolist()):
                books[p][e] = x[code == e, p * w : (p + 1) * w].sum(0) // (code == e).sum()
    codes, errors = zip(*(near(p) for p in range(4)), strict=True)
    error = sum(errors)
    by = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return [(r[0], "".join(f"{c[i]:02x}" for c in codes), int(error[i]), by[r[2]], digest) for i, r in enumerate(kept)]


def key(r):
    return (r[0] is not None, *(v or 0 for v in r[:1]), *r[1:])


@pytest.mark.parametrize("entries", [256, 5, 1])
def test_codes(spark, rows, entries, monkeypatch):
    monkeypatch.setattr(vector_codes, "ENTRIES", entries)
    monkeypatch.setattr(vector_codes, "CHUNK", 100)
    got = vector_codes.with_label_errors(*vector_codes.compress(table(spark, rows)))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_codes(stay(rows), entries), key=key)


def test_codes_of_few_vectors(spark):
    assert vector_codes.with_label_errors(*vector_codes.compress(table(spark, []))).count() == 0
    one = vector_codes.with_label_errors(*vector_codes.compress(table(spark, [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1)]))).collect()  # padded
    assert [(r.code, r.error, r.label_error) for r in one] == [("00000000", 0, 0)]
    far = vector_codes.compress(table(spark, [(1, [3e38] * 4, 1), (2, [-3e38] * 4, 1), (3, [1.0] * 4, None)]))[0].collect()
    assert {(r.vec_id, r.code, r.error) for r in far} == {(1, "00000000", 0), (2, "01010101", 0), (3, "02020202", 0)}


def test_trees_hold_their_invariants():
    rng = random.Random(2)
    points = np.unique(np.array([[rng.randrange(-40, 40) * (50 if i % 7 == 0 else 1) for _ in range(3)] for i in range(500)]), axis=0)
    order, level, parent = vector_codes._net(points.astype(float))
    distance = lambda a, b: np.linalg.norm(points[a] - points[b])
    for t, p in enumerate(order[1:], 1):
        assert all(distance(p, q) >= 2.0 ** level[p] for q in order[:t])
        assert distance(p, parent[p]) <= 2.0 ** (level[p] + 1) and (parent[p] == order[0] or level[parent[p]] > level[p])
    tree, place = vector_codes.cover_tree(points)
    assert (tree.points[place] == points).all()
    for centre, start, end, child, past in tree.nodes:
        assert start <= centre < end
        if child < past:  # children share the node's points out among them
            assert tree.nodes[child, 1] == start and tree.nodes[past - 1, 2] == end and (tree.nodes[child + 1 : past, 1] == tree.nodes[child : past - 1, 2]).all()
    of = {i: np.linalg.norm(tree.points[s:e] - tree.points[c], axis=1).max() for i, (c, s, e, _, _) in enumerate(tree.nodes)}
    assert np.allclose(tree.radii, [of[i] for i in range(len(tree.nodes))])
    book = points[rng.sample(range(len(points)), 12)]
    weights = np.arange(1, len(points) + 1)
    code, total, compared = vector_codes.assign(tree, weights, book)
    plain = np.square(tree.points[:, None] - book[None]).sum(2).argmin(1)
    assert (code == plain).all()
    assert all((total[e] == np.append(weights[plain == e].sum(), (tree.points * weights[:, None])[plain == e].sum(0))).all() for e in range(12))


def test_whole_subtrees_are_given_away():
    """Clusters far apart: most points are never compared with the entries."""
    rng = np.random.default_rng(7)
    centres = rng.integers(-50_000, 50_000, (20, 4))
    points = np.unique(np.vstack([c + rng.integers(-60, 60, (50, 4)) for c in centres]), axis=0)
    tree, _ = vector_codes.cover_tree(points)
    code, _, compared = vector_codes.assign(tree, np.ones(len(points), np.int64), centres)
    assert (code == np.square(tree.points[:, None] - centres[None]).sum(2).argmin(1)).all() and compared < len(points) / 5


def test_contract_columns(spark):
    assert set("vec_id component n deviation whitened explained identity_error".split()) <= set(queries.QUERIES["op11_embedding_whitening"](spark, SF).columns)
    assert queries.QUERIES["op12_vector_codes"](spark, SF).columns == "vec_id code error label_error codebooks_sha256".split()
