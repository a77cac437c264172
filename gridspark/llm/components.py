"""Connected components by alternating large-star and small-star steps, each a shuffle over the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(near: DataFrame, large: bool) -> DataFrame:
    """``near``: (a, b) with b a neighbour of a. Each neighbour (larger ones, or smaller ones and a itself) is
    linked to the smallest of a and its neighbours."""
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    held = near.join(least, "a")
    if large:
        out = held.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = held.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b): root is the smallest id of its component.

    Null ends and loops are ignored (a loop's id has no row). Rounds grow with the logarithm of the number of ids;
    each round's links are a table in the shared folder, so an executor's loss costs one round at most. Minima are
    pre-aggregated, so a hub costs a row for each task; its other rows are an equi-join that AQE can split.
    """
    now = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    if now.isEmpty():
        return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    before = None
    while True:
        large = _star(_both(now), large=True)
        turned = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        old, now = now, materialize(_star(turned, large=False), "links")
        discard(old)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    # All links now point from an id to its root.
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
