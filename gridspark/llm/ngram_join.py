"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct 3-word shingles. If two sets of sizes n, m have a Jaccard similarity of at least
p, then under any common order of shingles the first ``n - ceil(p n) + l`` of one and ``m - ceil(p m) + l`` of the
other share l shingles, for every l. The order here puts shingles of many documents last (then by hash). Each
document picks its own l: where its prefix still holds frequent shingles, the estimated cost of scanning and checking
candidates is lowest for a longer prefix that demands more shared shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .near import MOST_MATCHES, RARE_PARTNERS, demand, least_shared, link_classes
from .storage import free_names, materialize, prepare_tasks, small_or_shuffled

PERCENT = 90
SHINGLE_WORDS = 3
#: A shingle under more prefix pools than this is frequent. Only the order of shingles, so speed, depends on it.
FREQUENT = 2
#: At most so many of the frequent shingles (the most frequent) are sent to the tasks: 48 MB. Only speed depends on it.
FREQUENT_ROWS = 4_000_000
#: Shingles that a task gathers before it counts them: 16 MB.
COUNTED_TOKENS = 2_000_000

_CLS = "doc_id long, n_shingles long, cls long, need int, prefix array<long>"


def _class_of(s: np.ndarray) -> int:
    """Equal sets have equal ids: a hash of the size and the sorted shingles."""
    with np.errstate(over="ignore"):
        x = ts.mix(s).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (ts.mix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1)).sum(dtype=np.uint64)
        return int(ts.signed(ts.mix(np.array([x + np.uint64(len(s))], dtype=np.uint64)))[0])


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, raw, off in ts.slices(texts):
        yield from ts.document_shingles(ts.scan(raw, off, ts.BLANK_SEPARATED), k)


def _counted(tokens: list[np.ndarray], pooled: list[np.ndarray]) -> pa.RecordBatch:
    """(token, n) of what a task has gathered: shingles of pools, and any others that it has met more than once."""
    token, n = np.unique(np.concatenate(tokens), return_counts=True)
    keep = n > 1
    keep[np.searchsorted(token, np.concatenate(pooled))] = True
    return pa.RecordBatch.from_arrays([pa.array(ts.signed(token[keep])), pa.array(n[keep].astype(np.int64))], ["token", "n"])


def _pools(percent: int, k: int):
    """Task: counts of shingles that can come into a prefix. A set's pool is the part of it that comes first by hash; a
    shingle beyond all pools can come into a prefix where rare ones are few, so it counts where copies stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pooled, size = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], 0
        for batch in batches:
            for s in _sets(batch.column("text"), k):
                tokens.append(s)
                pooled.append(s[: len(s) - least_shared(len(s), percent) + len(s) // 20 + MOST_MATCHES])
                size += len(s)
            if size > COUNTED_TOKENS:
                yield _counted(tokens, pooled)
                tokens, pooled, size = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], 0
        yield _counted(tokens, pooled)

    return run


def _prefix(s: np.ndarray, tokens: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The chosen prefix of a set and the matches it demands. tokens, counts: the frequent shingles, ascending."""
    base = len(s) - least_shared(len(s), percent)
    want = min(len(s), base + MOST_MATCHES)
    # Rare shingles by hash come first; look only as far as is needed to find enough of them.
    upto, rare, frequent, df = 0, [], [], []
    found = 0
    while found < want and upto < len(s):
        part = s[upto : upto + 2 * want + 16]
        at = np.minimum(np.searchsorted(tokens, part), max(len(tokens) - 1, 0))
        hot = tokens[at] == part if len(tokens) else np.zeros(len(part), bool)
        rare.append(part[~hot])
        frequent.append(part[hot])
        df.append(counts[at[hot]] if len(tokens) else np.empty(0, np.int64))
        found += int((~hot).sum())
        upto += len(part)
    late, times = np.concatenate(frequent), np.concatenate(df)
    if found < want:  # by count, then by hash
        by = np.lexsort((late, times))
        late, times = late[by], times[by]
    order = np.concatenate([*rare, late])[:want]
    partners = np.concatenate([np.full(found, RARE_PARTNERS), times])[:want]
    need = demand(partners, base)
    return order[: base + need], need


def _prefixes(percent: int, k: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = frequent.value
        for batch in batches:
            n, cls, need, prefix = [], [], [], []
            for s in _sets(batch.column("text"), k):
                p, m = _prefix(s, tokens, counts, percent) if len(s) else (s, 1)
                n.append(len(s))
                cls.append(_class_of(s) if len(s) else None)
                need.append(m)
                prefix.append(p)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(need, pa.int32()), ts.list_array(prefix)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "cls", "need", "prefix"])

    return run


def _token_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, parts = [], []
            for s in _sets(batch.column("text"), k):
                if len(s):
                    cls.append(_class_of(s))
                    parts.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), ts.list_array(parts)], ["cls", "tokens"])

    return run


def _frequent(texts: DataFrame, percent: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and their counts over all documents, ascending by hash; bounded by FREQUENT_ROWS."""
    counted = texts.mapInArrow(_pools(percent, k), "token long, n long").groupBy("token").agg(F.sum("n").alias("count")).where(F.col("count") > FREQUENT)
    counted = materialize(counted, "frequent")
    if counted.limit(FREQUENT_ROWS + 1).count() > FREQUENT_ROWS:
        counted = counted.orderBy(F.desc("count"), "token").limit(FREQUENT_ROWS)
    rows = counted.toArrow()
    tokens = rows.column("token").combine_chunks().to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("count").combine_chunks().to_numpy()[order].astype(np.int32)


def ngram_components(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_shingles, cls (a hash of the
    set, null if empty), group_cls (the same for all documents of a component) and component_id.

    component_id is the smallest doc_id reachable by links, the document's own where it has none. Null and blank texts
    have no shingles and no links; a null doc_id keeps its row, links like any other and is never a component_id
    unless the whole component has none. Repeated rows each keep a row. Empty tables give empty results. A set
    held by many documents is one class, so groups of copies cost one row for each task in every shuffle.
    """
    spark = docs.sparkSession
    prepare_tasks(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = spark.sparkContext.broadcast(_frequent(texts.select("text"), percent, k))
    rows = materialize(texts.mapInArrow(_prefixes(percent, k, frequent), _CLS), "prefixes")
    frequent.destroy()
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))

    # Where ids stand on one row each, a class is fetched once and needs no shuffle to be told from its copies.
    unique = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()

    def fetch(wanted: DataFrame) -> DataFrame:
        ids = materialize(classes.join(wanted, "cls", "left_semi").select(F.col("first_id").alias("doc_id")).distinct(), "fetch")
        held = texts.join(small_or_shuffled(ids), texts.doc_id.eqNullSafe(ids.doc_id), "left_semi").select("text")
        sets = held.mapInArrow(_token_sets(k), "cls long, tokens array<long>")
        return sets if unique else sets.groupBy("cls").agg(F.first("tokens").alias("tokens"))

    size = F.col("n_shingles").cast("int")
    keys = rows.select(F.posexplode("prefix").alias("at", "key"), "cls", "need", size.alias("n")).select("key", "cls", "need", "n", (F.col("n") - F.col("at")).alias("rest"))
    linked = link_classes(keys, fetch, percent)
    grouped = classes.join(linked.withColumnRenamed("id", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("group_cls"), "first_id", "copies", F.col("root").isNotNull().alias("linked"))
    named = grouped.where("linked").groupBy("group_cls").agg(F.min("first_id").alias("least_id"))
    # Only classes of several documents or with links need a row; a lone document is its own component.
    lookup = grouped.where("linked or copies > 1").join(named, "group_cls", "left").select("cls", "group_cls", F.coalesce("least_id", "first_id").alias("component_id"))
    lookup = small_or_shuffled(materialize(lookup, "components"))
    out = rows.select("doc_id", "n_shingles", "cls").join(lookup, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "cls", F.coalesce("group_cls", "cls").alias("group_cls"))


def _with_class(k: int, place: int, name: str):
    """Task: every column as it is, and the class of the text as the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = [_class_of(s) if len(s) else None for s in _sets(batch.column(place), k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cls, pa.int64())], [*batch.schema.names, name])

    return run


def keep_one(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id (null ids last; of repeated rows
    one). Documents without words all stay. Columns are those of ``docs``."""
    found = ngram_components(docs, percent, k)
    lone = found.where("group_cls is null").select("doc_id", "cls")
    first = found.where("group_cls is not null").groupBy("group_cls")
    first = first.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "cls")).alias("x")).select("x.doc_id", "x.cls")
    kept = materialize(lone.union(first).distinct(), "kept")
    several = materialize(found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "several")
    if several.isEmpty():
        return docs.join(small_or_shuffled(kept.select("doc_id")), "doc_id", "left_semi").select(docs.columns)
    # Ids that stand on several rows, or none: their rows are told apart by their classes.
    again = F.broadcast if several.count() <= 1000 else (lambda x: x)
    single = kept.join(again(several), kept.doc_id.eqNullSafe(several.doc_id), "left_anti").select("doc_id")
    out = docs.join(small_or_shuffled(materialize(single, "single")), "doc_id", "left_semi").select(docs.columns)
    rest = docs.join(again(several), docs.doc_id.eqNullSafe(several.doc_id), "left_semi")
    of, nth = free_names(docs, "cls", "first")
    rest = rest.mapInArrow(_with_class(k, docs.columns.index("text"), of), T.StructType([*docs.schema.fields, T.StructField(of, T.LongType())]))
    rest = rest.join(kept, rest.doc_id.eqNullSafe(kept.doc_id) & rest[of].eqNullSafe(kept.cls), "left_semi")
    # Of texts with one id and one set (they differ in case or blanks at most) the first in the order of texts stays.
    worded = rest.where(F.col(of).isNotNull()).groupBy("doc_id", of).agg(F.min_by(F.struct(*docs.columns), "text").alias(nth)).select(f"{nth}.*")
    return out.union(worded.select(docs.columns)).union(rest.where(F.col(of).isNull()).select(docs.columns))
