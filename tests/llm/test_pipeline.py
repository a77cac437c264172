"""Each stage of the pipeline against a brute-force version, on the smallest documents."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from gridspark.llm.storage import materialize, read_table
from tests.conftest import SF
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark):
    docs = read_table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), "test"))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxic_documents_go(spark):
    """On a table with some hundreds of labels; the smallest has too few to learn from."""
    sf = SF.replace("0.001", "0.01")
    docs = read_table(spark, sf, "documents")
    left = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}
    toxic = {r.doc_id: bool(r.toxic) for r in read_table(spark, sf, "labels").collect()}
    wrong = [d for d in (r.doc_id for r in docs.collect()) if d in toxic and (d not in left) != toxic[d]]
    assert len(wrong) <= 0.03 * len(toxic)


def test_line_dedup_stage(stages):
    """Against plain sets of lines and sites."""
    from tests.llm.test_operators import plain_line_dedup

    want = plain_line_dedup([(r.doc_id, r.text, r.source) for r in stages[1].collect()])
    assert sorted((r.doc_id, r.text) for r in stages[2].collect()) == [(d, t) for d, t, _, _ in want]


def test_near_duplicates(stages):
    """Of each component at a Jaccard of 0.8 on five words the smallest id stays; texts without words all stay."""
    before = {r.doc_id: brute.shingle_set(r.text, 5) for r in stages[2].collect()}
    want = {root for d, root in brute.groups(list(before), list(before.values()), 80).items()}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_mixing_stage(stages):
    """Against the mix by its definition: weights by temperature, budgets, and blocks in the order of md5."""
    import collections
    import hashlib
    import math

    rows = [(r.doc_id, r.source, len(brute.BLANK.findall(r.text or ""))) for r in stages[4].collect()]
    total, blank = collections.Counter(), collections.Counter()
    for _, s, n in rows:
        total[s] += n
        blank[s] += n == 0
    lo, hi = min(x for x in total.values() if x), max(total.values())
    a = 0.0 if hi <= 4 * lo else 1 - math.log(4) / math.log(hi / lo)
    z = sum(x**a for x in total.values() if x)
    whole = max(x ** (1 - a) for x in total.values() if x) * z
    n_blocks = max(1, math.ceil(whole / 200_000), math.ceil(sum(blank.values()) / 10_000))
    want = []
    for s in total:
        budget = round(total[s] ** a / z * whole) if total[s] else 0
        parts = max(1, math.ceil(total[s] / 200_000), math.ceil(blank[s] / 10_000))
        start = 0
        for epoch in range(math.ceil(budget / total[s]) if total[s] else 1):
            turns = sorted((int((t := int(hashlib.md5(f"1|{epoch}|{d}|{n}".encode()).hexdigest()[:13], 16) / 16**13) * parts), t, d, n) for d, of, n in rows if of == s and (n or not epoch))
            for _, t, d, n in turns:
                if start < budget or not n:
                    share = min(start / max(1, budget), 1.0) if n else t
                    want.append((d, s, epoch, min(math.floor(share * n_blocks), n_blocks - 1)))
                start += n
    assert sorted((r.doc_id, r.source, r.epoch, r.block) for r in stages[5].collect()) == sorted(want)


def test_stages_on_an_empty_table_and_null_ids(spark):
    sf = SF
    docs = read_table(spark, sf, "documents")
    for df, n in ((docs.limit(0), 0), (docs.limit(3).selectExpr("cast(null as bigint) AS doc_id", "cast(null as string) AS text", "lang", "source", "n_chars"), 3)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, sf).count() == n, name


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    want = {w[0] for w in brute.contamination([(r.doc_id, r.text) for r in stages[3].collect()], items) if not w[5]}
    assert {r.doc_id for r in stages[4].collect()} == want


def test_mix_keeps_every_document(stages):
    assert {r.doc_id for r in stages[5].collect()} == {r.doc_id for r in stages[4].collect()}
    assert {r.doc_id for r in stages[2].collect()} == {r.doc_id for r in stages[1].collect()}


def test_near_duplicates_at_five_words_and_80_percent(spark):
    """About 10 % of the text added: under 0.9 on three words, at least 0.8 on five."""
    rng = random.Random(21)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = []
    for i in range(30):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 200))]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + [f"x{rng.randrange(500)}" for _ in range(int(len(base) * rng.choice([0.12, 0.2, 0.3])))]))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], schema)
    sets = {d: brute.shingle_set(t, 5) for d, t in rows}
    want = {d for d, _ in rows if not any(e < d and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]) for e in sets)}
    assert 30 < len(want) < 60
    assert {r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, docs, SF).collect()} == want


def test_short_pages_between_boilerplate_are_cleaned(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    head, foot = "Home | About | Contact us today | Imprint", "All rights reserved by the owners of this site"
    rows = [(i, f"{head}\nown {i}\n{foot}", f"site{i}") for i in range(6)] + [(10, f"{head}\n{foot}", "site1"), (11, f"{head}\n \n{foot}", "site2")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.remove_boilerplate(spark, spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], schema), SF).collect()}
    assert got == {d: (f"own {d}", 5) if d < 10 else (t, len(t)) for d, t, _ in rows}
