"""Substring deduplication: near-equal paragraphs by MinHash banding, and equal passages wherever they stand.

Paragraphs (lines of enough words) get MinHash bands over their five-word shingles. Paragraphs that collide in a band
are dealt anew by their rarest shingles, so that a band of many near copies is not all paired: two sets of the asked
similarity must share some of these. Pairs that do are joined, their exact Jaccard similarity is checked, and the
components of links are clusters. A passage that stands inside a longer paragraph has no paragraph of its own, so every
text also gets anchored sub-paragraphs: windows of 25 words chosen by winnowing, such that any 50 words that two texts
have in common hold at least one window that both have chosen. Equal windows (two hashes of their words) grow, word by
word, to the whole match. The first paragraph of a cluster stays; of passages each window's first place stays, and the
others are removals. Hashes are shuffled, not text.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.taskcontext import TaskContext

from . import textscan as ts
from .components import connected_components
from .near import confirm, link_classes, prefix_keys
from .storage import discard, materialize, materialize_parts, prepare_tasks, small_or_shuffled

SHINGLE_WORDS, PERCENT = 5, 80
#: Paragraphs of fewer words are left to line deduplication.
LEAST_WORDS = 20
RECALL = 0.995
#: Classes of a band that are paired with each other; a larger band's are compared under their rarest shingles.
SMALL_BAND = 4
#: Words of a window, and how many neighbouring windows choose one: 50 common words always share a chosen window.
WINDOW, CHOICE = 25, 26
#: A repeated passage has at least so many words; shorter ones, but for whole paragraphs, are left alone.
LEAST_PASSAGE = 50
#: Windows looked up in all texts at once: 16 MB.
LOOKED_UP = 2_000_000

#: What tells windows from each other.
_SAME = ["print", "proof"]
_UNITS = "part int, key long, doc_id long, sig long, starts array<int>, sizes array<int>, classes array<long>, bands array<array<long>>, places array<int>, prints array<long>, proofs array<long>"
#: Columns of the paragraphs' rows of these, part 0, and of the windows' rows, part 1.
_PARTS = ["key", "doc_id", "starts", "sizes", "classes", "bands"], ["key", "doc_id", "sig", "places", "prints", "proofs"]


def tune(similarity: float, recall: float, rows: int = 3) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` hashes that find a pair at ``similarity`` with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows


def _winnow(h: np.ndarray) -> np.ndarray:
    """Places of the chosen windows of one text: the least hash of every CHOICE neighbours, the last of equals."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= CHOICE:
        return np.array([n - 1 - int(h[::-1].argmin())])
    view = np.lib.stride_tricks.sliding_window_view(h, CHOICE)
    return np.unique(np.arange(len(view)) + CHOICE - 1 - view[:, ::-1].argmin(1))


def _proofs(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A second hash of the words of the windows at these places: windows are equal only if both agree."""
    out = np.full(len(at), WINDOW, np.uint64)
    for j in range(WINDOW):
        out = ts.mix(out + (h[at + j] ^ np.uint64(0xA0761D6478BD642F)))
    return out


def _signatures(s: np.ndarray, cut: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (paragraphs x bands) of shingles ``s``; paragraph i's begin at cut[i]."""
    out = np.empty((len(cut), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(cut), b + 1, np.uint64)
        for r in range(rows):
            k = np.uint64(b * rows + r + 1)
            key = ts.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((s ^ ts.mix(k[None])[0]) * np.uint64(0xD6E8FEB86659FD93), cut))
        out[:, b] = key
    return out


def _paragraphs(raw: np.ndarray, off: np.ndarray) -> tuple[ts.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, and for each paragraph of enough words: its text, first word, words, and first shingle of
    it among all five-word shingles."""
    w = ts.scan(raw, off, ts.ALPHANUMERIC)
    h = w.hashes()
    breaks = np.union1d(np.flatnonzero(raw == 0x0A), off)
    first = np.searchsorted(w.starts, breaks[:-1])
    past = np.searchsorted(w.starts, breaks[1:])
    long = past - first >= LEAST_WORDS
    first, past = first[long], past[long]
    doc = np.searchsorted(w.ptr, first, side="right") - 1
    return w, h, doc, first, past - first, ts.shingles(h, SHINGLE_WORDS)


def _sets(s: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    return [np.unique(s[a : a + n - SHINGLE_WORDS + 1]) for a, n in zip(first.tolist(), size.tolist(), strict=True)]


def _classes(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set: of its sum, size and least shingle."""
    if not sets:
        return np.empty(0, np.uint64)
    cut = np.cumsum([0, *[len(x) for x in sets[:-1]]])
    flat = np.concatenate(sets)
    return ts.mix(np.add.reduceat(ts.mix(flat), cut) * np.uint64(0x9E3779B97F4A7C15) + np.add.reduceat(ts.mix(flat ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1), cut) + np.array([len(x) for x in sets], np.uint64))


def _units(bands: int, rows: int):
    """Task: for each text a row of its paragraphs and one of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for _, _, raw, off in ts.slices(batch.column("text")):
                w, h, doc, first, size, s = _paragraphs(raw, off)
                sets = _sets(s, first, size)
                classes = ts.signed(_classes(sets))
                keys = ts.signed(_signatures(np.concatenate(sets), np.cumsum([0, *[len(x) for x in sets[:-1]]]), bands, rows)) if sets else np.empty((0, bands), np.int64)
                windows = ts.shingles(h, WINDOW)
                bounds = np.searchsorted(doc, np.arange(len(off)))
                ptr = w.ptr.tolist()
                places = [_winnow(windows[at : max(at, past - WINDOW + 1)]) for at, past in zip(ptr[:-1], ptr[1:], strict=True)]
                cuts = np.cumsum([0, *map(len, places)]).tolist()
                every = np.concatenate([x + at for x, at in zip(places, ptr[:-1], strict=True)]) if places else np.empty(0, np.int64)
                prints, proofs = ts.signed(windows[every]), ts.signed(_proofs(h, every))
                for d, (at, chosen) in enumerate(zip(ptr[:-1], places, strict=True)):
                    a, b, i, j = bounds[d], bounds[d + 1], cuts[d], cuts[d + 1]
                    for column, x in zip(out, ((first[a:b] - at).astype(np.int32), size[a:b].astype(np.int32), classes[a:b], list(keys[a:b]), chosen.astype(np.int32), prints[i:j], proofs[i:j]), strict=True):
                        column.append(x)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64()]
            names = ["key", "doc_id", "sig", "starts", "sizes", "classes", "bands", "places", "prints", "proofs"]
            columns = [pa.array(np.arange(key, key + batch.num_rows)), batch.column("doc_id"), batch.column("sig"), *(pa.array(x, pa.list_(t)) for x, t in zip(out, kinds, strict=True))]
            key += batch.num_rows
            for part, held in enumerate(_PARTS):
                own = [x if name in held else pa.nulls(batch.num_rows, x.type) for name, x in zip(names, columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), *own], ["part", *names])

    return run


def _paragraph_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets: list[np.ndarray] = []
        for _, _, raw, off in ts.slices(batch.column("text")):
            _, _, _, first, size, s = _paragraphs(raw, off)
            sets += _sets(s, first, size)
        yield pa.RecordBatch.from_arrays([pa.array(ts.signed(_classes(sets))), ts.list_array(sets)], ["cls", "tokens"])


def _near_paragraphs(units: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, doc_id, first_word, past_word, cluster) of paragraphs that another document has, or nearly has."""
    each = units.select("key", "doc_id", F.explode(F.arrays_zip("starts", "sizes", "classes")).alias("x"))
    each = each.select("key", "doc_id", F.col("x.starts").alias("first_word"), (F.col("x.starts") + F.col("x.sizes")).alias("past_word"), F.col("x.classes").alias("cls"))
    classes = materialize(each.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("lo"), F.max("key").alias("hi")), "paragraph-classes")
    banded = units.select(F.explode(F.arrays_zip("classes", "bands")).alias("x")).select(F.explode("x.bands").alias("band"), F.col("x.classes").alias("cls"))
    # Bands of two classes or more, and the classes that collide in them.
    met = materialize(banded.groupBy("band").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("band"), "bands")
    hits = materialize(banded.join(small_or_shuffled(met), "band", "left_semi").distinct(), "collisions")
    colliding = materialize(hits.select("cls").distinct(), "colliding")
    sizes = materialize(hits.groupBy("band").count(), "band-sizes")
    ids = materialize(classes.join(small_or_shuffled(colliding), "cls", "left_semi").select(F.col("first_id").alias("doc_id")).distinct(), "fetch")
    held = texts.join(small_or_shuffled(ids), texts.doc_id.eqNullSafe(ids.doc_id), "left_semi").select("text")
    sets = held.mapInArrow(_paragraph_sets, "cls long, tokens array<long>").join(small_or_shuffled(colliding), "cls", "left_semi")
    sets = materialize(sets.groupBy("cls").agg(F.first("tokens").alias("tokens")), "paragraph-sets")
    discard(met, colliding, ids)

    # A small band's classes are paired; those of larger ones are dealt anew by their rarest shingles.
    small = hits.join(small_or_shuffled(sizes.where(F.col("count") <= SMALL_BAND).select("band")), "band")
    pairs = materialize(small.select("band", F.col("cls").alias("a")).join(small.select("band", F.col("cls").alias("b")), "band").where("a < b").select("a", "b").distinct(), "pairs")
    large = materialize(hits.join(small_or_shuffled(sizes.where(F.col("count") > SMALL_BAND).select("band")), "band", "left_semi").select("cls").distinct(), "large")
    # The few sets that larger bands ask for, by themselves: each round looks among them.
    large_sets = materialize(sets.join(small_or_shuffled(large), "cls", "left_semi"), "large-sets")
    keys = materialize(prefix_keys(large_sets, PERCENT), "prefix-keys")
    linked = link_classes(keys, lambda wanted: large_sets.join(wanted, "cls", "left_semi"), PERCENT)
    links = confirm(pairs, sets, PERCENT).union(linked.select(F.col("root").alias("a"), F.col("id").alias("b")))
    linked = materialize(connected_components(links), "linked")
    discard(hits, sizes, pairs, large, large_sets, keys, sets)
    shared = classes.join(linked.withColumnRenamed("id", "cls"), "cls", "left").where("root is not null or lo < hi")
    shared = materialize(shared.select("cls", F.coalesce("root", "cls").alias("cluster")), "paragraph-clusters")
    discard(classes, linked)
    out = materialize(each.join(small_or_shuffled(shared), "cls").select("key", "doc_id", "first_word", "past_word", "cluster"), "paragraphs")
    discard(shared)
    return out


def _hits(prints):
    """Task: (sig, at, print, proof) of every window of a text, chosen or not, that is among ``prints`` (ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = prints.value
        for batch in batches:
            sigs, sig, place, found, proof = batch.column("sig").to_numpy(), [], [], [], []
            for begin, _, raw, off in ts.slices(batch.column("text")):
                w = ts.scan(raw, off, ts.ALPHANUMERIC)
                h = w.hashes()
                windows = ts.shingles(h, WINDOW)
                at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, windows), len(wanted) - 1)] == windows)
                doc = np.searchsorted(w.ptr, at, side="right") - 1
                inside = at + WINDOW <= w.ptr[doc + 1]
                at, doc = at[inside], doc[inside]
                sig.append(sigs[begin + doc])
                place.append((at - w.ptr[doc]).astype(np.int32))
                found.append(ts.signed(windows[at]))
                proof.append(ts.signed(_proofs(h, at)))
            if sum(map(len, sig)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sig, place, found, proof)], ["sig", "at", "print", "proof"])

    return run


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, at, later, words) of the windows in ``ats``: hashes of the words before a window, or of those after it where
    it is the later end, the nearest first."""
    reach = CHOICE - 1
    for batch in batches:
        sigs, ats = batch.column("sig").to_pylist(), batch.column("ats").to_pylist()
        sig, place, late, words = [], [], [], []
        for begin, _, raw, off in ts.slices(batch.column("text")):
            w = ts.scan(raw, off, ts.ALPHANUMERIC)
            h = w.hashes()
            for d in range(len(off) - 1):
                own = h[w.ptr[d] : w.ptr[d + 1]]
                for x in ats[begin + d]:
                    at, later = x["at"], x["later"]
                    sig.append(sigs[begin + d])
                    place.append(at)
                    late.append(later)
                    words.append(own[at + WINDOW : at + WINDOW + reach] if later else own[max(at - reach, 0) : at][::-1])
        yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(place, pa.int32()), pa.array(late, pa.bool_()), ts.list_array(words)], ["sig", "at", "later", "words"])


def _grown(ends: DataFrame, texts: DataFrame) -> DataFrame:
    """``ends`` (sig, at, keep_sig, keep_at, later: whether the run ends here, else it begins) with ``more``: the words
    beyond the window in which the text and its keeper agree. Chosen windows are at most CHOICE apart, so a match goes
    on for less than CHOICE words beyond the last window that both have chosen. Of equal texts one is read, that of
    doc_id or keep_doc_id, and of a window the words on the side where the run ends."""
    both = ends.select("sig", "doc_id", "at", "later").union(ends.select("keep_sig", "keep_doc_id", "keep_at", "later"))
    wanted = materialize(both.groupBy("sig").agg(F.min("doc_id").alias("of"), F.collect_set(F.struct("at", "later")).alias("ats")), "wanted-ends")
    ends = materialize(ends.drop("doc_id", "keep_doc_id").distinct(), "ends")
    read = texts.join(small_or_shuffled(wanted.withColumnRenamed("sig", "own")), (F.col("sig") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("of")))
    around = read.select("sig", "text", "ats").mapInArrow(_around, "sig long, at int, later boolean, words array<long>")
    around = materialize(around.groupBy("sig", "at", "later").agg(F.first("words").alias("words")), "around")
    looked_up = small_or_shuffled(around)
    side = lambda x, y: looked_up.select(F.col("sig").alias(x), F.col("at").alias(y), "later", F.col("words").alias(f"words_{x}"))
    both = ends.join(side("sig", "at"), ["sig", "at", "later"]).join(side("keep_sig", "keep_at"), ["keep_sig", "keep_at", "later"])
    # zip_with pads the shorter one with nulls, which equal no word.
    differs = F.array_position(F.transform(F.zip_with("words_sig", "words_keep_sig", lambda a, b: a.eqNullSafe(b)), lambda x: F.when(x, 1).otherwise(0)), 0)
    out = materialize(both.select("sig", "at", "keep_sig", "keep_at", "later", F.when(differs > 0, differs - 1).otherwise(F.size("words_sig")).cast("int").alias("more")), "grown")
    discard(ends, wanted, around)
    return out


def _left(first: int, past: int, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a span without ``cuts``, which are disjoint and ascending."""
    for a, b in cuts[max(bisect.bisect(cuts, (first,)) - 1, 0) :]:
        if a >= past:
            break
        if first < a:
            yield first, a
        first = max(first, b)
    if first < past:
        yield first, past


def _merged(spans: list[tuple]) -> list[list]:
    """Overlapping and touching spans (first, past, *more) as one, with what the first of them has."""
    out: list[list] = []
    for first, past, *more in sorted(spans, key=lambda x: x[:2]):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], past)
        else:
            out.append([first, past, *more])
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of one text in each row: removed spans without the windows that are safe, and the kept windows that stand
    whole, merged."""
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            by = [[x for x in r["spans"] if x["kind"] == kind] for kind in range(3)]
            safe = [(a, b) for a, b in _merged([(x["first"], x["past"]) for x in by[2]])]
            gone = [(a, b, x) for x in by[0] for a, b in _left(x["first"], x["past"], safe)]
            gone.sort(key=lambda x: x[:2])
            cuts = [(a, b) for a, b, _ in gone]
            whole = [(x["first"], x["past"], x) for x in by[1] if list(_left(x["at"], x["at"] + WINDOW, cuts)) == [(x["at"], x["at"] + WINDOW)]]
            out += [(r["key"], r["doc_id"], a, b, x["keep_doc_id"], x["node"], True) for a, b, x in gone]
            out += [(r["key"], r["doc_id"], a, b, r["doc_id"], x["node"], False) for first, past, x in _merged(whole) for a, b in _left(first, past, cuts)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["key", "doc_id", "first_word", "past_word", "keep_doc_id", "node", "removed"])


def _cut(places: DataFrame, gone: DataFrame) -> DataFrame:
    """``places`` (key, at, ..) with ``cut``: whether a removed span takes a word of their window."""
    spans = gone.groupBy("key").agg(F.collect_list(F.struct("first", "past")).alias("spans"))
    meets = F.exists("spans", lambda x: (x["first"] < F.col("at") + WINDOW) & (x["past"] > F.col("at")))
    return places.join(spans, "key", "left").withColumn("cut", F.coalesce(meets, F.lit(False))).drop("spans")


def _unsafe(kept: DataFrame, gone: DataFrame, texts: DataFrame, units: DataFrame) -> DataFrame:
    """(key, doc_id, at) of the kept windows that a removed span cuts and that stand whole nowhere else."""
    cut = materialize(_cut(kept, gone).where("cut").select("key", "doc_id", "at", "print", "proof"), "cut")
    blocks = -(-cut.count() // LOOKED_UP)
    for b in range(blocks):
        rows = cut.where(F.pmod(F.xxhash64("print"), F.lit(blocks)) == b).select("print").toArrow()
        prints = texts.sparkSession.sparkContext.broadcast(np.sort(rows.column("print").to_numpy().view(np.uint64)))
        hits = materialize(texts.select("sig", "text").mapInArrow(_hits(prints), "sig long, at int, print long, proof long").distinct(), "hits") if len(rows) else None
        if hits is not None:
            # Of equal texts the first one has the fewest removals.
            order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
            found = units.join(hits.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.min(order)["key"].alias("key"))
            whole = materialize(_cut(hits.join(found, "sig"), gone).where("not cut").select("print", "proof").distinct(), "whole")
            cut = materialize(cut.join(small_or_shuffled(whole), ["print", "proof"], "left_anti"), "unsafe")
            discard(hits)
        prints.destroy()
    return cut.select("key", "doc_id", "at")


def _equal_passages(units: DataFrame, texts: DataFrame) -> DataFrame:
    """The same for windows that another document has chosen too, with keep_doc_id and removed.

    Each print has one keeper, its first place. The other places of the print are removed, neighbouring ones as one, with the
    words at both ends in which the text and its keeper agree. A
    keeper whose words other removals would take stays whole unless the same words stand whole elsewhere, so every
    common window is left in one place at least. Components of maximal runs are a label only.
    """
    each = units.select("key", "doc_id", "sig", F.explode(F.arrays_zip("places", "prints", "proofs")).alias("x")).select("key", "doc_id", "sig", F.col("x.places").alias("at"), F.col("x.prints").alias("print"), F.col("x.proofs").alias("proof"))
    # Written before they are joined: a join of two plain shuffles is one that AQE can split at a hot window.
    common = materialize(each.groupBy(*_SAME).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select(*_SAME), "common")
    held = materialize(each.join(small_or_shuffled(common), _SAME, "left_semi"), "windows")
    by = W.partitionBy("key").orderBy("at")
    upto = F.lag("at").over(by) + WINDOW
    runs = held.withColumn("run", F.sum(F.when(F.col("at") <= upto + 1, 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    runs = materialize(runs.withColumn("node", F.xxhash64("key", "run")).drop("run"), "passage-windows")
    discard(common, held)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key", "at", "sig")
    first = materialize(runs.groupBy(*_SAME).agg(F.min("node").alias("a"), F.min(order).alias("keep")), "keepers")
    windows = runs.join(small_or_shuffled(first), _SAME).withColumn("kept", (F.col("keep.key") == F.col("key")) & (F.col("keep.at") == F.col("at")))
    # In the order of texts, which the join loses: what a text's windows have in common is packed then.
    windows = materialize(windows.sortWithinPartitions("key", "at"), "kept-windows")
    discard(runs, first)
    clusters = connected_components(windows.select("a", F.col("node").alias("b")).distinct()).withColumnRenamed("root", "cluster")

    apart = F.sum(F.when(F.col("at") <= upto, 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0))
    ends = F.struct("at", "keep", "node")
    copies = materialize(windows.where("not kept").drop("a", "kept").withColumn("run", apart), "copied-windows")
    runs = materialize(copies.groupBy("key", "doc_id", "sig", "run").agg(F.min(ends).alias("head"), F.max(ends).alias("tail")), "removed-runs")
    end = lambda x, later: runs.select("sig", "doc_id", F.col(f"{x}.at").alias("at"), F.col(f"{x}.keep.sig").alias("keep_sig"), F.col(f"{x}.keep.doc_id").alias("keep_doc_id"), F.col(f"{x}.keep.at").alias("keep_at"), F.lit(later).alias("later"))
    grown = _grown(end("head", False).union(end("tail", True)), texts)
    more = lambda x, y, later, name: grown.where(F.col("later") == later).groupBy(F.col(x).alias("sig"), F.col(y).alias("at")).agg(F.max("more").alias(name))
    gone = runs.withColumn("at", F.col("head.at")).join(small_or_shuffled(more("sig", "at", False, "before")), ["sig", "at"])
    gone = gone.withColumn("at", F.col("tail.at")).join(small_or_shuffled(more("sig", "at", True, "after")), ["sig", "at"])
    gone = gone.select("key", "doc_id", F.col("run").alias("of"), (F.col("head.at") - F.col("before")).alias("first"), (F.col("tail.at") + WINDOW + F.col("after")).alias("past"), F.col("head.keep.doc_id").alias("keep_doc_id"), F.col("head.node").alias("node"))
    gone = materialize(gone.where(F.col("past") - F.col("first") >= LEAST_PASSAGE), "grown-runs")
    # Of the kept windows those count of which a copy is removed.
    needed = materialize(copies.join(gone.select("key", F.col("of").alias("run")), ["key", "run"], "left_semi").select(*_SAME).distinct(), "needed")
    discard(copies, runs)
    # Runs with a word or two between them, or none, may have grown into each other.
    by_first = W.partitionBy("key").orderBy("first", "past").rowsBetween(W.unboundedPreceding, -1)
    gone = gone.withColumn("new", F.when(F.col("first") <= F.max("past").over(by_first), 0).otherwise(1))
    gone = gone.withColumn("run", F.sum("new").over(W.partitionBy("key").orderBy("first", "past").rowsBetween(W.unboundedPreceding, 0)))
    gone = gone.groupBy("key", "doc_id", "run").agg(F.min(F.struct("first", "keep_doc_id", "node")).alias("head"), F.max("past").alias("past"))
    gone = materialize(gone.select("key", "doc_id", "head.first", "past", "head.keep_doc_id", "head.node"), "gone")
    kept = windows.where("kept").join(small_or_shuffled(needed), _SAME, "left_semi").select("key", "doc_id", "sig", "at", *_SAME, "node")
    kept = kept.join(small_or_shuffled(more("keep_sig", "keep_at", False, "before")), ["sig", "at"], "left").join(small_or_shuffled(more("keep_sig", "keep_at", True, "after")), ["sig", "at"], "left")
    kept = kept.select("key", "doc_id", "at", *_SAME, "node", (F.col("at") - F.coalesce("before", F.lit(0))).alias("first"), (F.col("at") + WINDOW + F.coalesce("after", F.lit(0))).alias("past"))

    safe = _unsafe(kept.select("key", "doc_id", "at", *_SAME), gone, texts, units)
    span = lambda df, kind, **x: df.select("key", "doc_id", F.struct(F.lit(kind).alias("kind"), *(F.expr(x.get(c, c)).cast(t).alias(c) for c, t in (("first", "int"), ("past", "int"), ("at", "int"), ("keep_doc_id", "long"), ("node", "long")))).alias("span"))
    spans = span(gone, 0, at="first").union(span(kept, 1, keep_doc_id="doc_id")).union(span(safe, 2, first="at", past=f"at + {WINDOW}", keep_doc_id="doc_id", node="null"))
    places = spans.groupBy("key", "doc_id").agg(F.collect_list("span").alias("spans")).mapInArrow(_settle, "key long, doc_id long, first_word int, past_word int, keep_doc_id long, node long, removed boolean")
    # A run may meet its likes in its own text only, where a print also stands in another text by way of another run.
    places = places.join(clusters, places.node == clusters.id, "left").withColumn("cluster", F.coalesce("cluster", "node")).drop("node", "id")
    places = materialize(places, "passages")
    discard(windows, grown, gone)
    sizes = materialize(places.groupBy("cluster").agg(F.count("*").alias("n_places")), "passage-clusters")
    return places.join(small_or_shuffled(sizes), "cluster")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per repeated place of ``docs`` (doc_id, text; other columns are ignored): doc_id, kind ('paragraph' or
    'passage'), first_word, past_word (words of letters and digits, from 0), cluster, keep_doc_id, n_places, removed.

    Each row of docs is a document, so repeated rows repeat each other. The first paragraph of a cluster in the order of
    doc_id (nulls last), then word, stays; the others are removed. Of passages of LEAST_PASSAGE words or more, the first
    place of each window stays; a cluster of passages may keep several places, and keep_doc_id is the document that
    keeps the place's first window. What one document alone repeats has no places, nor have null and blank texts and
    texts of fewer than 20 words. A cluster of any size is sums and minima, pre-aggregated for each task; prints, bands and
    classes of many documents cost a row for each document, never a pair.
    """
    prepare_tasks(docs.sparkSession)
    # Equal texts have equal windows at equal places: sig tells texts from each other.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("sig"))
    parts = materialize_parts(texts.mapInArrow(_units(*tune(PERCENT / 100, RECALL)), _UNITS), "units", "part", range(len(_PARTS)))
    each, units = (x.select(*held) for x, held in zip(parts, _PARTS, strict=True))
    paragraphs = _near_paragraphs(each, texts)
    discard(parts[0])
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key", "first_word")
    # A line that one text alone repeats, in this or a like form, is not shared by documents.
    clusters = paragraphs.groupBy("cluster").agg(F.min(order).alias("keep"), F.count("*").alias("n_places"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").drop("lo", "hi")
    out = paragraphs.join(small_or_shuffled(materialize(clusters, "clusters")), "cluster")
    stays = (F.col("keep.key") == F.col("key")) & (F.col("keep.first_word") == F.col("first_word"))
    row = lambda df, kind, keep, removed: df.select("doc_id", F.lit(kind).alias("kind"), F.col("first_word").cast("long").alias("first_word"), F.col("past_word").cast("long").alias("past_word"), "cluster", F.col(keep).alias("keep_doc_id"), "n_places", removed.alias("removed"))
    return row(out, "paragraph", "keep.doc_id", ~stays).union(row(_equal_passages(units, texts), "passage", "keep_doc_id", F.col("removed")))
