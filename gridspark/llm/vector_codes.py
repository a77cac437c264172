"""Compression of vectors to four-byte codes by Lloyd's algorithm over cover trees.

Every task gathers its vectors into chunks, and each chunk has a cover tree for each part of the vectors: nodes are
nested balls around points, their points stand together, so the sum over a subtree is a difference of two cumulative
sums. Trees are written once. In a round a node whose nearest entry stays nearest anywhere in its ball, by the triangle
inequality, gives it its whole subtree; only other nodes descend, at last to exact comparisons of single points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .storage import discard, materialize, prepare_tasks, small_or_shuffled

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors in a chunk, and points under which a node is not split.
CHUNK, LEAF = 1024, 8
#: Integers end here: squared distances of parts of up to 64 entries stay longs.
MOST = 2**27 - 1

_CHUNKS = "ids array<bigint>, labels array<string>, points array<binary>, places array<binary>, nodes array<binary>, radii array<binary>"


@dataclass
class Tree:
    """Distinct points in the order of the tree. Nodes: centre, first point, past last point, first child, past last
    child (equal: a leaf)."""

    points: np.ndarray
    nodes: np.ndarray
    radii: np.ndarray


def _net(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points in the order of a farthest-first traversal, their levels, and their parents: with level l, a point is
    at least 2^l from all before it, and at most 2^(l + 1) from its parent, the nearest of those of higher levels."""
    n = len(points)
    order, level, parent = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1)
    near, nearest = np.square(points - points[0]).sum(1), np.zeros(n, np.int64)
    above, at = nearest.copy(), None
    for t in range(1, n):
        p = int(near.argmax())
        own = int(np.floor(np.log2(near[p]) / 2))
        if own != at:
            above, at = nearest.copy(), own
        order[t], level[p], parent[p] = p, own, above[p]
        away = np.square(points - points[p]).sum(1)
        closer = away < near
        near[closer], nearest[closer] = away[closer], p
        near[p] = 0
    return order, level, parent


def cover_tree(points: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of distinct integer points, and the place of each of them in its order."""
    real = points.astype(np.float64)
    order, level, parent = _net(real)
    below: list[list[int]] = [[] for _ in points]
    for p in order[1:]:
        below[parent[p]].append(int(p))  # by falling level, as in the order
    size = np.ones(len(points), np.int64)
    for p in order[:0:-1]:
        size[parent[p]] += size[p]
    # Nodes, breadth first: a point with those of its children that no node above has taken.
    nodes, waiting = [[0, 0, len(points), 0, 0]], [(0, 0, 0)]
    sequence = np.zeros(len(points), np.int64)
    for node, p, taken in waiting:
        start, end = nodes[node][1:3]
        left = below[p][taken:]
        if not left:
            sequence[start] = p
        elif end - start <= LEAF:
            own, to = [p], 0
            rest = [*left]
            while to < len(rest):
                own.append(rest[to])
                rest += below[rest[to]]
                to += 1
            sequence[start:end] = own
        else:
            same = [q for q in left if level[q] == level[left[0]]]
            nodes[node][3:] = [len(nodes), len(nodes) + len(same) + 1]
            at = start
            for q, skip in [*((q, 0) for q in same), (p, taken + len(same))]:
                to = end if q == p else at + int(size[q])
                waiting.append((len(nodes), q, skip))
                nodes.append([q, at, to, 0, 0])
                at = to
    place = np.empty(len(points), np.int64)
    place[sequence] = np.arange(len(points))
    table = np.array(nodes, np.int64)
    table[:, 0] = place[table[:, 0]]
    moved = real[sequence]
    of = np.repeat(np.arange(len(table)), table[:, 2] - table[:, 1])
    inside = np.arange(len(of)) - np.repeat(np.cumsum(table[:, 2] - table[:, 1]) - (table[:, 2] - table[:, 1]), table[:, 2] - table[:, 1]) + table[of, 1]
    away = np.sqrt(np.square(moved[inside] - moved[table[of, 0]]).sum(1))
    radii = np.maximum.reduceat(away, np.concatenate([[0], np.cumsum(table[:, 2] - table[:, 1])[:-1]]))
    return Tree(points[sequence], table, radii), place


def _distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x entries."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * points.shape[1] * most * most < 1 << 53:
        p, b = points.astype(np.float64), book.astype(np.float64)
        return (np.square(p).sum(1)[:, None] + np.square(b).sum(1)) - 2 * (p @ b.T)
    out = np.empty((len(points), len(book)), np.int64)
    for e, entry in enumerate(book):
        out[:, e] = np.square(points - entry).sum(1)
    return out


def assign(tree: Tree, weights: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry of each point, points and sums of each entry, how many points were compared with the entries)."""
    entries, first = np.unique(book, axis=0, return_index=True)
    entries, first = entries[np.argsort(first)], np.sort(first)  # of equal entries the lowest index counts
    weighted = np.hstack([weights[:, None], tree.points * weights[:, None]])
    running = np.vstack([np.zeros((1, weighted.shape[1]), np.int64), np.cumsum(weighted, 0)])
    code, total = np.empty(len(tree.points), np.int64), np.zeros((len(book), weighted.shape[1]), np.int64)
    single, at, compared = [np.empty(0, np.int64)], np.zeros(1, np.int64), 1
    away = _distances(tree.points[tree.nodes[at, 0]], entries)
    while len(at):
        centre, start, end, child, past = tree.nodes[at].T
        best = away.argmin(1)
        if len(entries) > 1:
            two = np.sqrt(np.partition(away, 1, axis=1)[:, :2].astype(np.float64))
            radius = tree.radii[at]
            whole = two[:, 0] + 2 * radius < two[:, 1] - 1e-9 * (two[:, 1] + radius)
        else:
            whole = np.ones(len(at), bool)
        given = first[best[whole]]
        code[_ranges(start[whole], end[whole])] = np.repeat(given, end[whole] - start[whole])
        np.add.at(total, given, running[end[whole]] - running[start[whole]])
        leaf = np.flatnonzero(~whole & (child == past))
        code[centre[leaf]] = first[best[leaf]]  # a leaf's centre has been compared just now
        np.add.at(total, first[best[leaf]], weighted[centre[leaf]])
        points = _ranges(start[leaf], end[leaf])
        single.append(points[points != np.repeat(centre[leaf], end[leaf] - start[leaf])])
        inner = np.flatnonzero(~whole & (child < past))
        at = _ranges(child[inner], past[inner])
        of = np.repeat(inner, past[inner] - child[inner])
        own = tree.nodes[at, 0] == centre[of]  # a node's last child has its centre: the distances are known
        known, away = away, np.empty((len(at), len(entries)), away.dtype)
        away[own] = known[of[own]]
        away[~own] = _distances(tree.points[tree.nodes[at[~own], 0]], entries)
        compared += int((~own).sum())
    alone = np.concatenate(single)
    if len(alone):
        given = first[_distances(tree.points[alone], entries).argmin(1)]
        code[alone] = given
        np.add.at(total, given, weighted[alone])
    return code, total, compared + len(alone)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _chunks(dims: int):
    """Task: chunks of vectors with the trees of their parts."""
    width = -(-dims // PARTS)

    def made(ids: list, labels: list, x: np.ndarray) -> pa.RecordBatch:
        full = np.zeros((len(x), width * PARTS), np.int64)
        full[:, :dims] = x
        points, places, nodes, radii = [], [], [], []
        for part in range(PARTS):
            distinct, of = np.unique(full[:, part * width : (part + 1) * width], axis=0, return_inverse=True)
            tree, place = cover_tree(distinct)
            points.append(tree.points.astype(np.int32).tobytes())
            places.append(place[of.ravel()].astype(np.int32).tobytes())
            nodes.append(tree.nodes.astype(np.int32).tobytes())
            radii.append(tree.radii.tobytes())
        lists = [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), *(pa.array([c], pa.list_(pa.binary())) for c in (points, places, nodes, radii))]
        return pa.RecordBatch.from_arrays(lists, [c.split()[0] for c in _CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, held = [], [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            labels += batch.column("label").to_pylist()
            held.append(vectors.matrix(batch.column("embedding"), dims))
            while len(ids) >= CHUNK:
                x = np.concatenate(held)
                yield made(ids[:CHUNK], labels[:CHUNK], x[:CHUNK])
                ids, labels, held = ids[CHUNK:], labels[CHUNK:], [x[CHUNK:]]
        if ids:
            yield made(ids, labels, np.concatenate(held))

    return run


def _trees(batch: pa.RecordBatch, row: int, width: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """Trees of a chunk's parts, and the place of each of its vectors in their order."""
    points, places, nodes, radii = (batch.column(c)[row] for c in ("points", "places", "nodes", "radii"))
    for part in range(PARTS):
        tree = Tree(
            np.frombuffer(points[part].as_py(), np.int32).reshape(-1, width).astype(np.int64),
            np.frombuffer(nodes[part].as_py(), np.int32).reshape(-1, 5).astype(np.int64),
            np.frombuffer(radii[part].as_py(), np.float64),
        )
        yield tree, np.frombuffer(places[part].as_py(), np.int32).astype(np.int64)


def _round(books: np.ndarray):
    """Task: points and sums of each entry of each part's codebook."""

    def partial(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for row in range(batch.num_rows):
            for part, (tree, place) in enumerate(_trees(batch, row, books.shape[2])):
                out[part] += assign(tree, np.bincount(place, minlength=len(tree.points)), books[part])[1]
        return out.ravel()

    return partial


def _coded(books: np.ndarray):
    """Task: code and error of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch.column("ids")[row].values, batch.column("labels")[row].values
                codes, error = np.empty((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for part, (tree, place) in enumerate(_trees(batch, row, books.shape[2])):
                    code = assign(tree, np.bincount(place, minlength=len(tree.points)), books[part])[0]
                    codes[:, part] = code[place]
                    error += np.square(tree.points - books[part][code]).sum(1)[place]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def _first_books(held: DataFrame, dims: int) -> np.ndarray:
    """The parts of the first ``ENTRIES`` vectors by id; rows without an id come after all others."""
    last = held.select("vec_id").orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES).agg(F.max("vec_id").alias("last"), F.count(F.when(F.col("vec_id").isNull(), 1)).alias("without")).first()
    early = held if last.without else held.where(F.col("vec_id") <= last.last)
    rows = early.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    width = -(-dims // PARTS)
    full = np.zeros((len(rows), width * PARTS), np.int64)
    full[:, :dims] = [r.embedding for r in rows]
    return np.ascontiguousarray(full.reshape(len(rows), PARTS, width).transpose(1, 0, 2))


def compress(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label as string, code, error of each row of ``rows`` (vec_id, embedding, label; other columns are
    ignored), codebooks of parts x entries x width).

    Vectors stay and become integers as in ``vectors.whole_vectors``, ended at ``MOST``; where their length is no
    multiple of four, zeros are added. Repeated rows each keep a row; of rows with equal ids the smaller vector comes
    first into the codebooks. With fewer vectors than entries the codebooks are shorter; without any there is no row."""
    spark = rows.sparkSession
    prepare_tasks(spark)
    held, dims = vectors.whole_vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"), MOST)
    if not dims:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), np.empty((PARTS, 0, 0), np.int64)
    books = _first_books(held, dims)
    chunks = materialize(held.select("vec_id", "label", "embedding").mapInArrow(_chunks(dims), _CHUNKS), "vector-trees")
    tasks = chunks.rdd.getNumPartitions()
    for _ in range(ROUNDS):
        got = vectors.summed(chunks, tasks, _round(books), books[..., 0].size * (books.shape[2] + 1), "long").reshape(*books.shape[:2], -1)
        count, total = got[..., :1], got[..., 1:]
        books = np.where(count > 0, total // np.maximum(count, 1), books)
    coded = materialize(chunks.mapInArrow(_coded(books), "vec_id long, label string, code string, error long"), "vector-codes")
    discard(chunks)
    return coded, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with the sum of errors over equal labels (nulls together) and the digest of the codebooks."""
    if not books.size:
        return coded.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "vector-labels")
    joined = coded.join(small_or_shuffled(sums), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql() -> str:
    """DuckDB SQL for ``with_label_errors(*compress(embeddings))``, for whole vectors whose length is a multiple of four."""
    square = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"p AS MATERIALIZED (SELECT r, i AS part, x[i * len(x) // {PARTS} + 1 : (i + 1) * len(x) // {PARTS}] AS v FROM k, range({PARTS}) t(i))",
        f"b0 AS MATERIALIZED (SELECT part, r AS entry, v AS c FROM p WHERE r < {ENTRIES})",
    ]
    for t in range(ROUNDS + 1):
        steps.append(f"d{t} AS MATERIALIZED (SELECT r, part, v, min({{'e': {square}, 'entry': entry}}) AS near FROM p JOIN b{t} USING (part) GROUP BY r, part, v)")
        if t < ROUNDS:
            steps += [
                f"s{t} AS (SELECT part, near.entry AS entry, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM d{t}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM p) + 1)) AS j) GROUP BY part, near.entry, j)",
                f"n{t} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{t} GROUP BY part, entry)",
                f"b{t + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n{t}.c, b{t}.c) AS c FROM b{t} LEFT JOIN n{t} USING (part, entry))",
            ]
    steps.append(f"f AS (SELECT vec_id, label, string_agg(printf('%02x', near.entry), '' ORDER BY part) AS code, sum(near.e)::BIGINT AS error FROM d{ROUNDS} JOIN k USING (r) GROUP BY r, vec_id, label)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f, h"
