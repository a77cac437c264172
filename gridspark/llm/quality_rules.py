"""Quality rules: per-text counts, and lines that too many documents of a host share.

One pass over the texts counts words, symbols and repetitions and hashes every normalised line. Spark counts the
distinct documents of each (host, line); lines above the host's limit are removed, and a document that loses most of
its words with them is rejected. Only hashes and counts are shuffled, never text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import textscan as ts
from .storage import materialize, prepare_tasks, small_or_shuffled

#: A line is removed if more documents of its host have it than this many and this share of the host's documents: a host
#: sets its own limit, and a small one is not let off.
LIMIT_DOCS, LIMIT_SHARE = 4, 0.01
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.3
#: Base rules.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_BEGINS = (np.arange(256) & 0xC0) != 0x80
#: Normalised lines: letters A-Z small, every digit 0, one blank between words.
_PLAIN = np.where((ts.LOWER >= 0x30) & (ts.LOWER <= 0x39), 0x30, ts.LOWER).astype(np.uint8)
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "key long, doc_id long, host string, print long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", lines array<long>, line_words array<int>"


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])


def _again(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values within documents: whether the document has it twice or more, and whether it had it before."""
    key = h ^ ts.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, before = np.zeros(len(h), bool), np.zeros(len(h), bool)
    before[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, before


def _measure(raw: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """The five counts, and for each text its distinct normalised lines with the words that stand on them."""
    n = len(off) - 1
    w = ts.scan(raw, off, ts.BLANK_SEPARATED, lower=False)
    counts = [np.diff(w.ptr), _per_text(ts.BLANK_SEPARATED[raw] & _BEGINS[raw], off), _per_text(_SYMBOL[raw], off)]
    doc_of_word = np.repeat(np.arange(n), counts[0])

    breaks = np.flatnonzero(raw == 0x0A)
    starts = np.union1d(off[:-1], breaks + 1)
    starts = starts[starts < len(raw)]
    line_doc = np.searchsorted(off, starts, side="right") - 1
    ends = np.minimum(np.append(breaks, len(raw))[np.searchsorted(breaks, starts)], off[line_doc + 1])
    first, past = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    worded = past > first
    starts, ends, first, past, line_doc = (x[worded] for x in (starts, ends, first, past, line_doc))
    line_hash = ts.word_hashes(w.data, starts, ends - starts)
    counts.append(np.bincount(line_doc, _again(line_hash, line_doc)[1], n).astype(np.int64) if len(starts) else np.zeros(n, np.int64))

    h = w.hashes()
    windows = ts.shingles(h, WINDOW)
    at = np.arange(len(windows))
    at = at[doc_of_word[at] == doc_of_word[at + WINDOW - 1]] if len(windows) else at
    at = at[_again(windows[at], doc_of_word[at])[0]]
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    counts.append(np.diff(np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])[w.ptr]))

    plain = np.concatenate([_PLAIN[raw], np.zeros(8, np.uint8)])
    h = ts.word_hashes(plain, w.starts, w.ends - w.starts)
    place = np.arange(len(h)) - np.repeat(first, past - first) if len(first) else np.arange(0)
    folded = np.add.reduceat(ts.mix(h + ts.mix(place.astype(np.uint64))), first) if len(first) else np.empty(0, np.uint64)
    lines, words = [], []
    bounds = np.searchsorted(line_doc, np.arange(n + 1))
    size = past - first
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        distinct, inverse = np.unique(folded[a:b], return_inverse=True)
        lines.append(distinct)
        words.append(np.bincount(inverse, size[a:b], len(distinct)).astype(np.int32))
    return counts, lines, words


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = TaskContext.get().partitionId() << 40
    for batch in batches:
        counts, lines, words = [], [], []
        for _, _, raw, off in ts.slices(batch.column("text")):
            c, x, y = _measure(raw, off)
            counts.append(np.stack(c))
            lines += x
            words += y
        table = np.concatenate(counts, 1) if counts else np.zeros((len(_COUNTS), 0), np.int64)
        columns = [pa.array(np.arange(key, key + batch.num_rows)), batch.column("doc_id"), batch.column("host"), batch.column("print"), *(pa.array(c.astype(np.int64)) for c in table), ts.list_array(lines), pa.array(words, pa.list_(pa.int32()))]
        key += batch.num_rows
        yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "host", "print", *_COUNTS, "lines", "line_words"])


def quality_verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text and the host column; others are ignored): doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words.

    Rows of one host with equal texts count as one document: a copied text is not boilerplate of its host. A null host is a host of its own. Null
    and blank texts have no words and fail. Lines without words are never counted. A document whose words left are
    fewer than LEAST_LEFT of all is rejected. Counts are pre-aggregated, so a host or line of a third of all rows
    costs a row for each task.
    """
    prepare_tasks(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), "text")
    rows = materialize(texts.mapInArrow(_rows, _SCHEMA), "quality")
    each = rows.select("key", "host", "print", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("key", "host", "print", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    limits = rows.groupBy("host").agg(F.greatest(F.lit(LIMIT_DOCS), LIMIT_SHARE * F.count_distinct("print")).alias("limit"))
    frequent = each.groupBy("host", "line").agg(F.count_distinct("print").alias("count")).where(F.col("count") > LIMIT_DOCS).withColumnRenamed("host", "of")
    frequent = frequent.join(limits, frequent["of"].eqNullSafe(limits["host"])).where("count > limit").select("of", F.col("line").alias("above"))
    frequent = small_or_shuffled(materialize(frequent, "frequent-lines"))
    lost = each.join(frequent, (each.line == frequent.above) & each.host.eqNullSafe(frequent["of"])).groupBy("key").agg(F.sum("words").alias("n_removed_words"))
    out = rows.drop("lines", "line_words", "print").join(lost, "key", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words") >= LEAST_LEFT * F.col("n_words")
    return out.select("doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & left).alias("kept"), "n_removed_words")
