"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its share of tokens to the power of an exponent, normalised. The exponent is bisected to meet a
target entropy of the weights, or the flattest mix within a repetition limit. The weights are realised as budgeted block
permutations: every pass over a source deals its documents into blocks by a hash of seed, pass and document; blocks
follow each other until the source's token budget is met, and the sources' streams are interleaved in proportion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .storage import materialize

#: A source is passed over at most this many times.
REPEATS = 4.0
#: Tokens of a block, so of the largest group of rows that is ordered together.
BLOCK_TOKENS = 200_000
#: Documents without tokens in a block, on average.
BLOCK_ROWS = 10_000
#: Bisection steps; each job evaluates the middles of this many steps ahead.
STEPS, AHEAD = 40, 5
SEED = 1

_WORDS = r"[^\x20\x09-\x0D]+"


def token_rows(docs: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens); tokens are blank-separated words, a null source is one source named by null."""
    n = F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n.alias("n_tokens"))


def _measures(totals: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent the entropy of the weights in bits, and the most passes over a source when every source gets
    at least one. Sums over all sources, so any number of them stays distributed."""
    grid = totals.select(F.log("total").alias("x"), F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
    # Shares relative to the largest source's, so that no power overflows.
    top = totals.agg(F.max(F.log("total"))).first()[0]
    power = F.exp(F.col("a") * (F.col("x") - top))
    sums = grid.groupBy("a").agg(
        F.sum(power).alias("z"),
        F.sum(power * F.col("a") * (F.col("x") - top)).alias("zx"),
        (F.max((F.col("a") - 1) * F.col("x")) - F.min((F.col("a") - 1) * F.col("x"))).alias("spread"),
    )
    return {r.a: ((math.log(r.z) - r.zx / r.z) / math.log(2), math.exp(r.spread)) for r in sums.collect()}


def exponent(totals: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None) -> float:
    """The exponent in [0, 1] for (source, total) rows: the one whose weights have ``entropy`` bits, or else the
    smallest (the flattest mix) at which no source needs more than ``repeats`` passes. 1 keeps the shares as they are;
    an entropy out of reach gives the nearest end. Both measures fall as the exponent grows, so bisection finds it."""
    if totals.isEmpty():
        return 1.0
    too_flat = (lambda m: m[0] > entropy) if entropy is not None else (lambda m: m[1] > repeats)
    low, high = 0.0, 1.0
    if not too_flat(_measures(totals, [0.0])[0.0]):
        return 0.0
    for _ in range(-(-STEPS // AHEAD)):
        middles = [low + (high - low) * k / 2**AHEAD for k in range(1, 2**AHEAD)]
        found = _measures(totals, middles)
        for _ in range(AHEAD):
            middle = min(middles, key=lambda m: abs(m - (low + high) / 2))
            low, high = (middle, high) if too_flat(found[middle]) else (low, middle)
    return high


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from the text of the parts, the same in every engine that has md5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def mix(docs: DataFrame, source: str = "source", repeats: float | None = REPEATS, entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """The mixed stream as rows (doc_id, source, epoch, block, place, n_tokens, weight): read in order of block, then
    place. epoch counts the passes over a source from 0; a document comes once for each pass it is in.

    Without ``budget`` the stream is just long enough for every document to come at least once; with it, each source
    gets ``budget`` tokens times its weight, to within its last document. Documents without tokens come once, dealt
    over all blocks by their hash, and cost nothing. A null source is a source; null ids stay null; repeated rows are documents of their
    own; an empty table gives an empty stream. Only blocks are ordered, so a source of a third of all rows is many
    groups; the running sums over a source's blocks are sums of few rows.
    """
    rows = materialize(token_rows(docs, source), "tokens")
    totals = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count_if(F.col("n_tokens") == 0).alias("blank")), "totals")
    worded = totals.where("total > 0")
    a = exponent(worded, repeats, entropy)
    norm = worded.agg(F.sum(F.pow("total", F.lit(a))).alias("z"), F.max(F.pow("total", F.lit(1 - a))).alias("most")).first()
    if norm.z is None:
        norm_z, all_tokens = 1.0, 0.0
    else:
        norm_z, all_tokens = norm.z, float(budget) if budget is not None else norm.most * norm.z
    blank = totals.agg(F.sum("blank")).first()[0] or 0
    n_blocks = max(1, math.ceil(all_tokens / block_tokens), math.ceil(blank / block_rows))
    weight = F.when(F.col("total") > 0, F.pow("total", F.lit(a)) / norm_z).otherwise(F.lit(0.0))
    plan = totals.select(F.col("source").alias("of"), "total", "blank", weight.alias("weight"))
    plan = plan.withColumn("budget", F.round(F.col("weight") * all_tokens).cast("long"))
    plan = plan.withColumn("passes", F.when(F.col("total") > 0, F.ceil(F.col("budget") / F.col("total"))).otherwise(F.lit(1)).cast("int"))
    plan = plan.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens), F.ceil(F.col("blank") / block_rows)).cast("int")).drop("blank")

    dealt = rows.join(plan, rows.source.eqNullSafe(plan["of"])).drop("of")
    passes = F.when(F.col("n_tokens") > 0, F.col("passes")).otherwise(F.lit(1))
    dealt = dealt.where(passes > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    dealt = dealt.withColumn("turn", _unit(F.lit(seed), F.col("epoch"), F.col("doc_id"), F.col("n_tokens")))
    dealt = dealt.withColumn("part", F.floor(F.col("turn") * F.col("parts")).cast("int"))

    sums = dealt.groupBy("source", "epoch", "part").agg(F.sum("n_tokens").alias("held"))
    before = W.partitionBy("source").orderBy("epoch", "part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("of"), F.col("epoch").alias("e"), F.col("part").alias("b"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("source", "epoch", "part").orderBy("turn", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("run", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.join(offsets, placed.source.eqNullSafe(offsets["of"]) & (placed.epoch == offsets.e) & (placed.part == offsets.b))
    placed = placed.withColumn("start", F.col("offset") + F.col("run"))
    # Where a pass ends before the budget, a document without tokens that follows it still comes.
    kept = placed.where((F.col("start") < F.col("budget")) | (F.col("n_tokens") == 0))
    share = F.least(F.col("start") / F.greatest(F.lit(1), F.col("budget")), F.lit(1.0))
    share = F.when(F.col("n_tokens") > 0, share).otherwise(F.col("turn"))
    kept = kept.withColumn("block", F.least(F.floor(share * n_blocks), F.lit(n_blocks - 1)).cast("long"))
    order = W.partitionBy("block").orderBy("turn", "doc_id", "epoch", "source")
    return kept.select("doc_id", "source", F.col("epoch").cast("long").alias("epoch"), "block", F.row_number().over(order).cast("long").alias("place"), "n_tokens", F.round("weight", 9).alias("weight"))


def sql(repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> str:
    """mix(documents) in DuckDB SQL; the exponent of a repetition limit has a closed form."""
    unit = "('0x' || substr(md5(concat_ws('|', '{seed}', epoch::VARCHAR, coalesce(doc_id::VARCHAR, ''), n_tokens::VARCHAR)), 1, 13))::BIGINT / {top}::DOUBLE".format(seed=seed, top=16**13)
    return f"""
    WITH r AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
    t AS (SELECT source, sum(n_tokens)::DOUBLE AS total, count(*) FILTER (n_tokens = 0) AS blank FROM r GROUP BY source),
    m AS (SELECT max(total) / min(total) AS ratio FROM t WHERE total > 0),
    a AS (SELECT CASE WHEN ratio <= {repeats} THEN 0.0 ELSE 1 - ln({repeats}) / ln(ratio) END AS a FROM m),
    z AS (SELECT a, sum(pow(total, a)) AS z, max(pow(total, 1 - a)) AS most FROM t, a WHERE total > 0 GROUP BY a),
    g AS (SELECT greatest(1, ceil(most * z / {block_tokens}), (SELECT ceil(sum(blank) / {block_rows}) FROM t))::BIGINT AS n_blocks FROM z),
    p AS (SELECT source, total, CASE WHEN total > 0 THEN pow(total, a) / z ELSE 0 END AS weight,
      round(CASE WHEN total > 0 THEN pow(total, a) * most ELSE 0 END)::BIGINT AS budget, greatest(1, ceil(total / {block_tokens}), ceil(blank / {block_rows}))::INT AS parts FROM t, z),
    q AS (SELECT *, CASE WHEN total > 0 THEN ceil(budget / total)::INT ELSE 1 END AS passes FROM p),
    d AS (SELECT r.doc_id, r.source, n_tokens, weight, budget, parts, unnest(range(CASE WHEN n_tokens > 0 THEN passes ELSE 1 END)) AS epoch
      FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source),
    e AS (SELECT *, {unit} AS turn FROM d),
    f AS (SELECT *, floor(turn * parts)::INT AS part FROM e),
    s AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY epoch, part, turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f),
    k AS (SELECT *, least(floor(CASE WHEN n_tokens > 0 THEN least(start / greatest(1, budget), 1.0) ELSE turn END * n_blocks), n_blocks - 1)::BIGINT AS block FROM s, g WHERE start < budget OR n_tokens = 0)
    SELECT doc_id, source, epoch::BIGINT AS epoch, block, row_number() OVER (PARTITION BY block ORDER BY turn, doc_id, epoch, source) AS place, n_tokens, round(weight, 9) AS weight FROM k"""
