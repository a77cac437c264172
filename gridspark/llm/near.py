"""Links between classes of equal token sets, from keys that similar classes must share.

Shared by the paragraph MinHash and the prefix join; keys are tokens of prefixes. A key's classes are never paired with
each other all at once:

1. in a few rounds every class meets one hub of its keys (a star), so a group of copies costs a check each a round;
   after each round the confirmed stars form components;
2. only classes of *different* components that share enough keys are paired and checked.

Every pair that shares enough keys is then either checked or already in one component, so the components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import connected_components
from .storage import discard, materialize, small_or_shuffled

#: Longest prefix extension, and the cost of checking a candidate against that of meeting it.
MOST_MATCHES, CHECK_COST = 8, 50.0
#: Classes assumed to share a token that isn't known to be frequent.
RARE_PARTNERS = 1.0
#: Keys of a class that are compared under each of its keys; a class with more is compared later, by all of them.
KEYS = 48
#: Most star rounds, and the share of a round's checks that must confirm for another.
ROUNDS, WORTHWHILE = 4, 0.1


def least_shared(n: int, percent: int) -> int:
    """Tokens that a partner at ``percent`` must share with a set of n at least."""
    return -(-percent * n // 100)


def demand(partners: np.ndarray, base: int) -> int:
    """How many shared tokens a set should ask of its partners: ``base`` tokens of its prefix may be missing, and
    ``partners`` has the classes under each of the tokens that come first."""
    best, need = np.inf, 1
    met = np.cumsum(partners)
    for m in range(1, len(partners) - base + 1):
        size = base + m
        # Partners met at the prefix's tokens, and checks. By chance ever fewer partners share m tokens; through a
        # common passage as many as its m-th rarest token has.
        chance = met[size - 1] / math.factorial(m)
        passage = np.partition(partners[:size], -m)[-m] - RARE_PARTNERS
        cost = size + met[size - 1] + CHECK_COST * (chance + passage)
        if cost < best:
            best, need = cost, m
    return need


def _prefixes(percent: int):
    """Task: (key, cls, need, n, rest) of the shared tokens in each class's prefix, from its tokens by count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for cls, n, counts, tokens in zip(*(batch.column(c).to_pylist() for c in ("cls", "n", "counts", "tokens")), strict=True):
                base, lone = n - least_shared(n, percent), n - len(tokens)
                want = min(n, base + MOST_MATCHES)
                partners = np.concatenate([np.full(min(lone, want), RARE_PARTNERS), counts[: max(want - lone, 0)]])
                need = demand(partners, base)
                held = tokens[: max(base + need - lone, 0)]
                for column, x in zip(out, (held, [cls] * len(held), [need] * len(held), [n] * len(held), range(n - lone, n - lone - len(held), -1)), strict=True):
                    column.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["key", "cls", "need", "n", "rest"])

    return run


def prefix_keys(sets: DataFrame, percent: int) -> DataFrame:
    """Keys for link_classes from (cls, tokens): each class's shared tokens of the prefix that its partners must meet,
    the rarest first. A token of many classes is counted in each task first and then joined, so AQE can split it."""
    each = sets.select("cls", F.size("tokens").alias("n"), F.explode("tokens").alias("key"))
    counted = materialize(each.groupBy("key").agg(F.count("*").alias("count")).where("count > 1"), "token-counts")
    held = each.join(small_or_shuffled(counted), "key").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("x"))
    held = held.select("cls", "n", F.col("x.count").alias("counts"), F.col("x.key").alias("tokens"))
    return held.mapInArrow(_prefixes(percent), "key long, cls long, need int, n int, rest int")


def _accepted(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (a + b - shared)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b) of ``pairs`` whose token sets have a Jaccard similarity of ``percent`` or more. The sets of b are
    joined first: a is the side that may stand in many pairs, where AQE splits its rows."""
    tokens = lambda side: sets.select(F.col("cls").alias(side), F.col("tokens").alias(f"t{side}"))
    held = pairs.join(tokens("b"), "b").join(tokens("a"), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    return held.where(_accepted(shared, F.size("ta"), F.size("tb"), percent)).select("a", "b")


def _fitting(a: Column, b: Column, percent: int) -> Column:
    """Whether two set sizes allow the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _reach(rest_a: Column, rest_b: Column, a: Column, b: Column, percent: int) -> Column:
    """Whether two sets of sizes a, b can be similar if they share at most the smaller rest."""
    return (100 + percent) * F.least(rest_a, rest_b) >= percent * (a + b)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()


def _stars(shared: DataFrame, round_: int, percent: int) -> DataFrame:
    """(a, b): for each class b the hub a, of another component, of most of its keys. The hub of a key is the class
    with the most keys at first (the one with the fewest shingles of its own), then one by chance."""
    rank = F.struct(F.col("weight") if round_ == 0 else F.xxhash64(F.lit(round_), "cls"), "cls", "comp", "n", "need")
    hubs = shared.groupBy("key").agg(F.max(rank).alias("hub"))
    met = shared.join(hubs, "key").where((F.col("comp") != F.col("hub.comp")) & _fitting(F.col("n"), F.col("hub.n"), percent))
    votes = met.groupBy(F.col("cls").alias("b"), F.col("hub.cls").alias("a")).agg(F.count("*").alias("count"), F.first("need").alias("need"), F.first("hub.need").alias("hub_need"))
    # Likely ones only; pairs that share enough keys by way of other classes are met later.
    votes = votes.where(F.col("count") >= F.least("need", "hub_need"))
    return votes.groupBy("b").agg(F.max(F.struct("count", "a"))["a"].alias("a"))


def link_classes(keys: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(id, root) of every class linked with another.

    ``keys``: (key, cls, need, n, rest) - the classes under each key, the size n of a class's set, and how many of its
    tokens do not come before the key. A pair of classes is a candidate when it shares at least the smaller ``need`` of
    the two, and sizes and rests allow the similarity. ``fetch(classes)``: (cls, tokens) for the classes in ``cls``.
    """
    spans = materialize(keys.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key"), "spans")
    shared = materialize(keys.join(small_or_shuffled(spans), "key", "left_semi").distinct(), "keys")
    discard(spans)
    weights = shared.groupBy("cls").agg(F.count("*").alias("weight"))
    of = shared.join(weights, "cls").withColumn("comp", F.col("cls"))
    linked, links = None, None
    held = shared
    for round_ in range(ROUNDS):
        of = materialize(of, "members")
        discard(held)
        held = of
        stars = materialize(_stars(of, round_, percent), "stars")
        sets = materialize(fetch(_ends(stars)), "sets")
        found = materialize(confirm(stars, sets, percent), "confirmed")
        tried, new = stars.count(), found.count()
        discard(stars, sets)
        if new:
            links = found if links is None else links.union(found)
            linked = materialize(connected_components(links), "linked")
            discard(found)
            links = linked.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))
            of = of.drop("comp").join(linked.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
            mixed = of.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
            of = of.join(mixed, "key", "left_semi")
        if new < WORTHWHILE * tried or not tried:
            break
    of = materialize(of, "members")
    discard(held)
    # Pairs of components under a key first, then their classes: no pair inside a component is ever made. Two components
    # of one class each meet at the first key they share only, and only if they share enough, as far as KEYS keys tell.
    c = F.col
    whole = W.partitionBy("cls").orderBy(F.desc("rest"), "key")
    own = of.withColumns({"earlier": F.collect_list("key").over(whole.rowsBetween(-KEYS, -1)), "held": F.collect_list("key").over(W.partitionBy("cls").orderBy(F.desc("rest"), "key").rowsBetween(-KEYS, KEYS)), "all": F.count("*").over(W.partitionBy("cls"))})
    own = own.where(_reach(c("rest"), c("rest"), c("n"), F.ceil(c("n") * percent / 100), percent))
    groups = own.groupBy("key", "comp").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.min("need").alias("need"), F.count("*").alias("size"), F.first("earlier").alias("earlier"), F.first(F.when(c("all") <= KEYS, c("held"))).alias("held")
    )
    lone = c("size") == 1
    groups = groups.withColumns({"earlier": F.when(lone, c("earlier")).otherwise(F.array().cast("array<long>")), "held": F.when(lone, c("held"))}).drop("size")
    group = lambda x: groups.select("key", *(c(y).alias(f"{y}{x}") for y in ("comp", "least", "most", "rest", "need", "earlier", "held")))
    fit = (100 * c("mosta") >= percent * c("leastb")) & (100 * c("mostb") >= percent * c("leasta")) & _reach(c("resta"), c("restb"), c("leasta"), c("leastb"), percent)
    fit = fit & ~F.arrays_overlap("earliera", "earlierb")
    fit = fit & (c("helda").isNull() | c("heldb").isNull() | (F.size(F.array_intersect("helda", "heldb")) >= F.least("needa", "needb")))
    met = group("a").join(group("b"), "key").where((c("compa") < c("compb")) & fit).select("key", "compa", "compb", "leastb", "mostb", c("restb").alias("mostrestb"))
    member = lambda x: of.select("key", c("comp").alias(f"comp{x}"), c("cls").alias(x), *(c(y).alias(f"{y}{x}") for y in ("n", "rest")))
    # A class of a is kept if it suits the group of b, and a pair if its two classes suit each other.
    suits = (100 * c("na") >= percent * c("leastb")) & (100 * c("mostb") >= percent * c("na")) & _reach(c("resta"), c("mostrestb"), c("na"), c("leastb"), percent)
    pairs = met.join(member("a"), ["key", "compa"]).where(suits).join(member("b"), ["key", "compb"])
    pairs = pairs.where(_fitting(c("na"), c("nb"), percent) & _reach(c("resta"), c("restb"), c("na"), c("nb"), percent)).select("a", "b").distinct()
    all_keys = of.groupBy("cls").agg(F.collect_set("key").alias("keys"), F.first("need").alias("need"))
    side = lambda x: all_keys.select(c("cls").alias(x), c("keys").alias(f"keys{x}"), c("need").alias(f"need{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(F.size(F.array_intersect("keysa", "keysb")) >= F.least("needa", "needb"))
    pairs = materialize(pairs.select("a", "b"), "pairs")
    discard(of)
    if not pairs.isEmpty():
        more = confirm(pairs, materialize(fetch(_ends(pairs)), "sets"), percent)
        linked = materialize(connected_components(more if links is None else links.union(more)), "linked")
    return linked if linked is not None else pairs.select(c("a").alias("id"), c("b").alias("root"))
