"""The quality classifier: held-out accuracy, scores by plain Python, gradients by differences, odd rows."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gridspark.llm import quality_model as qm
from gridspark.llm import queries
from tests.conftest import SF
from tests.llm import brute
from tests.llm.test_operators import table


def text(rng, low, n=200):
    """A document; a low one has one stretch of junk somewhere among good passages."""
    words = [f"{rng.choice('bcdfg')}a{rng.choice('lmnr')}o{rng.choice('xyz')}{rng.choice('aeiou')}" for _ in range(n)]
    if low:
        at = rng.randrange(n - 60)
        words[at : at + 60] = [w.upper() + "!!" for w in words[at : at + 60]]
    return " ".join(words)


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, i % 4 == 0, rng.randrange(130, 700)), "s") for i in range(400)] + [(None, text(rng, True), "s"), (401, None, "s"), (402, " \n ", "s"), (403, "é!", "s"), (3, "again", "s"), (3, "again", "s"), (404, text(rng, True, 40_000), "s")]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(None, 0), (401, None), (402, 0), (402, 1), (404, 0), (3, 1), (999, 1)], "doc_id long, quality int")
    docs = table(spark, rows)
    return rows, docs, labels, qm.fit(docs, labels)


def test_one_bad_passage_is_found(spark, learned):
    rows, docs, labels, model = learned
    rng = random.Random(9)
    fresh = [(i, text(rng, i % 2 == 0, rng.randrange(130, 700)), "s") for i in range(1000, 1200)]
    assert sum(r.predicted == r.doc_id % 2 for r in qm.scores(table(spark, fresh), model).collect()) >= 190
    weight = {}
    for r in qm.passage_weights(table(spark, fresh), model).collect():
        weight.setdefault(r.doc_id, []).append((r.first_word, r.weight))
    assert all(sum(w for _, w in v) == pytest.approx(1) for v in weight.values())
    of, found = dict((d, t.split(" ")) for d, t, _ in fresh), 0
    for d in range(1000, 1200, 2):  # most weight goes to a passage with junk
        first = max(weight[d], key=lambda v: v[1])[0]
        found += any(w.endswith("!!") for w in of[d][first : first + qm.PASSAGE_WORDS])
    assert found >= 90


def test_rows_and_scores(spark, learned):
    rows, docs, labels, model = learned
    got = qm.scores(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    by = {}
    for d, t, _ in rows:
        by.setdefault((d, max(1, -(-len(brute.BLANK.findall(t or "")) // qm.PASSAGE_WORDS))), []).append(plain_score(t or "", model))
    for r in got:
        assert min(abs(r.score - s) for s in by[r.doc_id, r.n_passages]) < 2e-3


def plain_score(text, model):
    """Features, gates and score of one text in plain Python."""
    spans = [m.span() for m in brute.BLANK.finditer(text)]
    words = [text[a:b] for a, b in spans]
    small = [brute.small(w) for w in words]
    windows = [tuple(small[i : i + qm.WINDOW]) for i in range(len(words) - qm.WINDOW + 1)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w in windows if False}
    if len(windows) >= 3000:
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        twice = {w for w, n in seen.items() if n > 1}
    in_twice = {i + k for i, w in enumerate(windows) if w in twice for k in range(qm.WINDOW)}
    kind = lambda c: 0 if c.isascii() and c.isdigit() else 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else 3 if ord(c) > 127 else 5 if c == "\n" else 6 if c in " \t" else 8 + int(np.flatnonzero(np.flatnonzero(qm._SIGN) == ord(c))[0]) if qm._SIGN[ord(c)] else 7
    sign = lambda c: ord(c) < 128 and bool(qm._SIGN[ord(c)])
    upper, lower = (lambda w: sum("A" <= c <= "Z" for c in w)), (lambda w: sum("a" <= c <= "z" for c in w))
    rows = []
    for first in range(0, max(1, len(words)), qm.PASSAGE_WORDS):
        own = words[first : first + qm.PASSAGE_WORDS]
        start = spans[first][0] if first else 0
        end = spans[first + qm.PASSAGE_WORDS][0] if first + qm.PASSAGE_WORDS < len(words) else len(text)
        counts = np.zeros(qm._KINDS)
        for c in text[start:end]:
            counts[kind(c)] += 1
        n = max(1, len(own))
        share = lambda flags, n=n: sum(map(bool, flags)) / n
        signs = lambda w: sum(map(sign, w))
        lengths = [len(w) for w in own]
        mean = sum(lengths) / n
        rows.append(
            [
                *np.sqrt(counts / max(1, counts.sum())),
                share(upper(w) >= 2 and not lower(w) for w in own),
                share("A" <= w[0] <= "Z" and lower(w) for w in own),
                share(any(c in "0123456789" for c in w) for w in own),
                share(not upper(w) and not lower(w) and all(ord(c) < 128 for c in w) for w in own),
                share(signs(w) > sign(w[-1]) for w in own),
                share(sign(w[-1]) for w in own),
                share(first + i and small[first + i] == small[first + i - 1] for i in range(len(own))),
                share(first + i in in_twice for i in range(len(own))),
                len(set(small[first : first + qm.PASSAGE_WORDS])) / n,
                *np.log1p([mean, math.sqrt(max(0, sum(v * v for v in lengths) / n - mean * mean)), len(own), len(words)]),
            ]
        )
    x = qm.standard(np.array(rows), model.mean, model.scale)
    h = np.tanh(x @ model.encode[:-1] + model.encode[-1])
    gate = np.tanh(h @ model.tanh[:-1] + model.tanh[-1]) / (1 + np.exp(-(h @ model.sigmoid[:-1] + model.sigmoid[-1])))
    a = np.exp(gate @ model.weigh)
    return 1 / (1 + math.exp(-(float((a / a.sum()) @ h @ model.decide[:-1]) + model.decide[-1])))


def test_gradients():
    rng = np.random.default_rng(3)
    x, ptr, y = rng.normal(0, 1, (9, qm.FEATURES)), np.array([0, 1, 5, 9]), np.array([1.0, 0.0, 1.0])
    model = qm.train(x, ptr, np.array([1.0, 1.0, 1.0]))
    model.decide[:] = rng.normal(0, 1, qm.HIDDEN + 1)

    def loss():
        logit = qm._forward(model, x, ptr)[-1]
        return float(np.mean(np.log1p(np.exp(-logit)) + (1 - y) * logit))

    for layer, grad in zip(model.layers(), qm._step(model, x, ptr, y), strict=True):
        for at in list(np.ndindex(layer.shape))[:: max(1, layer.size // 7)]:
            was = layer[at]
            layer[at] = was + 1e-5
            up = loss()
            layer[at] = was - 1e-5
            assert grad[at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
            layer[at] = was


def test_slices_do_not_matter():
    rng = random.Random(4)
    texts = ["", "a", " ", text(rng, True, 200), "", text(rng, False, 129), "x y " * 40, "", ""]
    whole = qm.passages(*_buffers(texts))
    for i, t in enumerate(texts):
        alone = qm.passages(*_buffers([t]))
        a, b = whole[1][i : i + 2]
        assert np.allclose(whole[0][a:b], alone[0]) and (whole[2][a:b] == alone[2]).all()


def _buffers(texts):
    from gridspark.llm import textscan as ts

    return ts.buffers(pa.array(texts))


def test_few_labels(spark):
    docs = table(spark, [(1, "good text", "s"), (2, None, "s")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.predicted for r in qm.scores(docs, qm.fit(docs, none)).collect()} == {1}
    low = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, quality int")
    assert {r.predicted for r in qm.scores(docs, qm.fit(docs, low)).collect()} == {0}
    assert qm.scores(table(spark, []), qm.fit(table(spark, []), low)).count() == 0


def test_held_out_rows_of_the_table(spark):
    """On sf0.01: sf0.001 has some ten low documents to learn from."""
    folder = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = queries.QUERIES["op13_quality_classifier"](spark, folder)
    assert set("doc_id held_out score predicted".split()) <= set(got.columns)
    judged = [r for r in got.collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted != labels[r.doc_id] for r in judged) <= 0.05 * len(judged)
