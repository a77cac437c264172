"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of ten consecutive words of every benchmark item (a shorter item is one window). For each
pattern length a shift table over blocks of two words says how far a search position can move without missing a
pattern; where it says zero, the bucket of the block's hash holds the patterns that end with it, and direct comparison
of their words confirms an occurrence. Many stretches of text advance together, so a step of the search is a numpy
operation over all of them. Spark deals out the documents; patterns reach the tasks in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .storage import discard, materialize, prepare_tasks

WINDOW = 10
#: Item words in one broadcast block of patterns, about 30 MB of tables. A larger benchmark takes several passes.
BLOCK_WORDS = 200_000
#: Blocks that tasks hold at once. After so many the rows are written, and these blocks are freed everywhere.
BLOCKS_AT_ONCE = 4
#: Search positions in one of the stretches that advance together.
STRETCH = 512

_WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _block(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of one or two words at each place."""
    return ts.mix(h[at] * _A + h[at + 1] * _B) if size == 2 else ts.mix(h[at] * _B)


class Patterns:
    """Tables for the distinct patterns of one length."""

    def __init__(self, length: int, words: list[tuple[bytes, ...]], owners: list[set[str]]):
        self.length, self.size, self.owners = length, min(2, length), owners
        self.words = [b" ".join(w) for w in words]
        flat = [x for w in words for x in w]
        lengths = np.array([len(x) for x in flat], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        data = np.frombuffer(b"".join(flat) + bytes(8), np.uint8)
        self.hashes = ts.word_hashes(data, starts, lengths).reshape(len(words), length)
        bits = max(12, int(np.ceil(np.log2(len(words) * length + 1))) + 3)
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.size + 1, np.int16)
        flat_h = self.hashes.reshape(-1)
        row = np.arange(len(words)) * length
        for end in range(self.size, length + 1):  # the shift of a block that ends there in some pattern
            slot = _block(flat_h, row + end - self.size, self.size) & self.mask
            np.minimum.at(self.shift, slot.astype(np.int64), length - end)
        suffix = _block(flat_h, row + length - self.size, self.size)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix, first = np.unique(suffix[self.order], return_index=True)
        self.bucket = np.append(first, len(words))

    def candidates(self, h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Places where the shift is zero."""
        first, past = ptr[:-1], ptr[1:] - self.length + 1
        has = past > first
        first, past = first[has], past[has]
        n = -(-(past - first) // STRETCH)
        at = np.repeat(first, n) + STRETCH * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(at + STRETCH, np.repeat(past, n))
        found = []
        while len(at):
            step = self.shift[(_block(h, at + self.length - self.size, self.size) & self.mask).astype(np.int64)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < end
            at, end = at[on], end[on]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def occurrences(self, w: ts.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of every occurrence."""
        at = self.candidates(h, w.ptr)
        if not len(at):
            return at, at
        ends = _block(h, at + self.length - self.size, self.size)
        slot = np.minimum(np.searchsorted(self.suffix, ends), len(self.suffix) - 1)
        known = self.suffix[slot] == ends
        at, slot = at[known], slot[known]
        n = self.bucket[slot + 1] - self.bucket[slot]
        which = self.order[np.repeat(self.bucket[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at = np.repeat(at, n)
        for j in range(self.length):
            same = h[at + j] == self.hashes[which, j]
            at, which = at[same], which[same]
        # Equal hashes; now the words themselves. A spelling with its separators is compared once.
        seen: dict[tuple[int, bytes], bool] = {}
        sure = np.zeros(len(at), bool)
        for i, (p, k) in enumerate(zip(at.tolist(), which.tolist(), strict=True)):
            raw = w.data[w.starts[p] : w.ends[p + self.length - 1]].tobytes()
            if (ok := seen.get((k, raw))) is None:
                ok = seen[k, raw] = b" ".join(re.findall(_WORD, raw)) == self.words[k]
            sure[i] = ok
        return at[sure], which[sure]


def patterns(items: list[tuple[str | None, str | None]], window: int) -> list[Patterns]:
    """Tables of all windows of (item id, text) rows; windows of an item without id hit, but name no item."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    lower = bytes(ts.LOWER)
    for item, text in items:
        words = re.findall(_WORD, (text or "").encode().translate(lower))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners[tuple(words[i : i + window])] |= {item} - {None}
    by_length = defaultdict(list)
    for words in owners:
        by_length[len(words)].append(words)
    return [Patterns(n, words, [owners[w] for w in words]) for n, words in sorted(by_length.items())]


def _search(tables):
    """Task: adds the occurrences of one block of patterns to (doc_id, text, spans, items). A span is its first word
    times 64 plus its length; lengths are at most 63."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = batch.column("spans").to_pylist(), [set(x) for x in batch.column("items").to_pylist()]
            for first, _, raw, off in ts.slices(batch.column("text")):
                w = ts.scan(raw, off, ts.ALPHANUMERIC)
                h = w.hashes()
                for table in tables.value:
                    at, which = table.occurrences(w, h)
                    doc = np.searchsorted(w.ptr, at, side="right") - 1
                    for d, p, k in zip(doc.tolist(), at.tolist(), which.tolist(), strict=True):
                        spans[first + d].append((p - int(w.ptr[d])) * 64 + table.length)
                        items[first + d] |= table.owners[k]
            columns = [batch.column("doc_id"), batch.column("text"), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "spans", "items"])

    return run


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: counts per document from its spans and items."""
    for batch in batches:
        n_words = np.concatenate([np.diff(ts.scan(raw, off, ts.ALPHANUMERIC).ptr) for _, _, raw, off in ts.slices(batch.column("text"))] or [np.empty(0, np.int64)])
        n_hit = []
        for spans in batch.column("spans").to_pylist():
            hit, upto = 0, 0
            for s in sorted(spans):
                first, past = s // 64, s // 64 + s % 64
                hit += max(0, past - max(first, upto))
                upto = max(upto, past)
            n_hit.append(hit)
        items = [sorted(x) for x in batch.column("items").to_pylist()]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(digest), pa.array([n > 0 for n in n_hit]), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Broadcast]:
    """The patterns of the benchmark in broadcast blocks of about ``block_words`` item words each."""
    if not 1 <= window <= 63:
        raise ValueError("window is from 1 to 63 words")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\u0080-\U0010ffff]+")))).first()[0] or 0
    blocks = -(-size // block_words) or 1
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield benchmark.sparkSession.sparkContext.broadcast(patterns([(r.item_id, r.text) for r in part.toLocalIterator()], window))


def _through(df: DataFrame, blocks: Iterator[Broadcast], step: Callable[[DataFrame, Broadcast], DataFrame]) -> DataFrame:
    """``df`` after ``step`` with every block. The driver and the tasks hold a few blocks at a time, however large the
    benchmark is."""
    held, last = [], None
    for tables in blocks:
        if len(held) == BLOCKS_AT_ONCE:
            done = materialize(df, "searched")
            discard(last)
            for x in held:
                x.destroy()
            df, held, last = done, [], done
        held.append(tables)
        df = step(df, tables)
    return df


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_words, n_hit (words inside an
    occurrence of a window), n_items, items_sha256, contaminated (n_hit > 0), items (array of the item ids found).

    ``benchmark``: item_id, text. Null and blank texts have no words and no windows; an item without id counts for
    hits and names no item; rows of one id are one item; repeated documents each keep their row. An empty benchmark
    hits nothing. Words of one document are searched in its own task only, so no key or group is gathered.
    """
    prepare_tasks(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    search = lambda df, tables: df.mapInArrow(_search(tables), "doc_id long, text string, spans array<long>, items array<string>")
    out = _through(out, _blocks(benchmark, window, block_words), search)
    return out.mapInArrow(_verdicts, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def _without_hits(tables, place: int):
    """Task: the rows, with all their columns, whose text holds no pattern of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for first, _, raw, off in ts.slices(batch.column(place)):
                w = ts.scan(raw, off, ts.ALPHANUMERIC)
                h = w.hashes()
                for table in tables.value:
                    clean[first + np.searchsorted(w.ptr, table.occurrences(w, h)[0], side="right") - 1] = False
            yield batch.filter(pa.array(clean))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs``, with all its columns, without the rows whose text holds a window of the benchmark. Each block of
    patterns filters what the one before has left; nothing is shuffled."""
    prepare_tasks(docs.sparkSession)
    return _through(docs, _blocks(benchmark, window, block_words), lambda df, tables: df.mapInArrow(_without_hits(tables, docs.columns.index("text")), docs.schema))
