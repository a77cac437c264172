"""Toxicity by a bag of subword embeddings, averaged into a linear softmax and trained jointly in numpy.

The features of a text are the character n-grams of its words (with the word's borders), hashed into a table of
embeddings. Their mean goes into a two-class softmax; embeddings and softmax weights are trained together, so a spelling
never seen in training still has the vectors of the n-grams it shares with known words. Half-way, slots that hardly say
anything are dropped and training goes on without them; how many is chosen by a split of the training sample. For
scoring, an embedding's product with the softmax weights is one number per slot, so a text's score is a mean over a small
table. Training runs in a task over a sample of bounded size; the driver gets the table alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .storage import prepare_tasks

#: Bound of the training sample: so many labelled rows that are clean, toxic; the first by a hash of their ids.
SAMPLE_ROWS = (4000, 1500)
#: Hash slots of the embedding table; also the most features that one training text can have.
SLOT_BITS = 18
NGRAMS = (3, 4, 5)
DIMENSIONS, BATCH, RATE, DECAY = 4, 64, 0.15, 1e-4
#: Passes over the sample: as many as make this many steps, within bounds.
STEPS, EPOCHS = 500, (4, 20)
#: The mean is multiplied by this before the softmax: a few words in a hundred must be able to decide.
GAIN = 100.0
#: N-grams without a vector that every text has besides its own: a few chance ones cannot decide a short text.
PRIOR = 150
#: A slot in fewer training texts than this share of them, and than three, keeps no vector: it could only be learned by
#: heart.
LEAST_SHARE = 0.0025
#: Slots whose say is under this share of the strongest one's are dropped half-way. The share with the fewest errors on
#: one in VALIDATION rows of the training sample counts; of equals the first.
NOISE, VALIDATION = (0.2, 0.1, 0.3), 5



_BAG = pa.schema([("toxic", pa.int32()), ("print", pa.int64()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("n", pa.int64())])


@dataclass
class Model:
    slots: np.ndarray  #: float32, GAIN * embedding . (weights of class 1 - weights of class 0)
    bias: float
    bits: int = SLOT_BITS


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that training never reads; rows without an id are never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _spaced(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with every other byte than a word's as a space, a space around each text; its offsets. Of a
    word said several times running, the first stays."""
    n = len(off) - 1
    place = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(off))
    w = ts.scan(raw, off, ts.ALPHANUMERIC)
    low = w.data[: len(raw)]
    low = np.where(ts.ALPHANUMERIC[low], low, 0x20)
    h = w.hashes()
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[w.ptr[:-1][w.ptr[:-1] < len(h)]] = False
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[w.starts[again]] = 1
    edge[w.ends[again]] -= 1
    low[np.cumsum(edge[: len(raw)], dtype=np.int8) > 0] = 0x20
    out = np.full(len(raw) + n + 1 + 8, 0x20, np.uint8)
    out[place] = low
    return out, off + np.arange(n + 1)


def _features(data: np.ndarray, off: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: first bytes of the n-grams, and their slots."""
    end = int(off[-1]) + 1
    inside = data[:end] != 0x20
    # Bytes from here to the next space, up to 8.
    run = np.zeros(end + 1, np.int8)
    step = np.zeros(end + 8, bool)
    step[:end] = inside
    alive = inside.copy()
    run[:end] = alive
    for k in range(1, max(NGRAMS)):
        alive &= step[k : k + end]
        run[:end] += alive
    reach = np.where(inside, run[:end], np.where(step[1 : end + 1], run[1 : end + 1] + 1, 0))
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    for n in NGRAMS:
        at = np.flatnonzero(reach >= n - 1) if n > 2 else np.flatnonzero(reach >= n)
        value = (eight[at] & ts._MASK[n]) + np.uint64(n)
        yield at, ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _bags(bits: int):
    """Task: (label, print, slots, counts, n) of each text: a hash of its bytes, its distinct slots, how often it has
    each, and all its n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, counts, total, prints = [], [], [], []
            for _, _, raw, off in ts.slices(batch.column("text")):
                data, at = _spaced(raw, off)
                found = list(_features(data, at, bits))
                for d in range(len(off) - 1):
                    own = [s[np.searchsorted(p, at[d]) : np.searchsorted(p, at[d + 1])] for p, s in found]
                    slot, count = np.unique(np.concatenate(own), return_counts=True)
                    slots.append(slot.astype(np.int32))
                    counts.append(count.astype(np.int32))
                    total.append(int(count.sum()))
                    prints.append(xxhash.xxh64_intdigest(raw[off[d] : off[d + 1]].tobytes()) >> 1)
            columns = [batch.column("toxic"), pa.array(prints, pa.int64()), pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "print", "slots", "counts", "n"])

    return run


@dataclass
class Bags:
    """Texts as bags of slots, one after the other: text i has ``ptr[i]:ptr[i + 1]``."""

    labels: np.ndarray
    slots: np.ndarray
    shares: np.ndarray  #: float32, how often the text has a slot, of all its n-grams and PRIOR more
    ptr: np.ndarray

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots and shares of these texts, and which of them each is from."""
        size = self.ptr[rows + 1] - self.ptr[rows]
        at = np.repeat(self.ptr[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return self.slots[at], self.shares[at], np.repeat(np.arange(len(rows)), size)

    def only(self, rows: np.ndarray, used: np.ndarray) -> Bags:
        """These texts with the slots in ``used``."""
        slots, shares, of = self.take(rows)
        keep = used[slots]
        return Bags(self.labels[rows], slots[keep], shares[keep], np.searchsorted(of[keep], np.arange(len(rows) + 1)))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Bags:
    """All bags of the sample, in an order that does not depend on the partitions."""
    rows = list(batches)
    held = (pa.Table.from_batches(rows) if rows else _BAG.empty_table()).sort_by([("print", "ascending"), ("toxic", "ascending")]).combine_chunks()
    lists = held.column("slots").combine_chunks()
    ptr = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(ptr)
    counts = held.column("counts").combine_chunks().flatten().to_numpy()
    shares = counts / np.repeat(held.column("n").to_numpy() + PRIOR, size)
    return Bags(held.column("toxic").to_numpy().astype(np.int64), lists.flatten().to_numpy(), shares.astype(np.float32), ptr - ptr[0])


def _say(table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return table @ (weights[:, 1] - weights[:, 0]) * np.float32(GAIN)


def train(bags: Bags, noise: float, bits: int = SLOT_BITS, seed: int = 7) -> Model:
    """Fit embeddings and softmax weights by Adagrad; from half of the epochs on without the slots that say little.
    The trained bias leans to the larger class, so at last it is set anew over the training texts: the score is the
    trained softmax's but for this one number."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-0.05, 0.05, (1 << bits, DIMENSIONS)).astype(np.float32)
    weights, bias = rng.uniform(-0.05, 0.05, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    g_table, g_weights, g_bias = np.full(1 << bits, 1e-8, np.float32), np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    n = len(bags.labels)
    every = np.arange(n)
    used = np.bincount(bags.slots, minlength=1 << bits) >= max(3, LEAST_SHARE * n)
    bags = bags.only(every, used)
    epochs = min(EPOCHS[1], max(EPOCHS[0], -(-STEPS * BATCH // n))) if n else 0
    for epoch in range(epochs):
        if epoch == epochs // 2:
            say = np.abs(_say(table, weights))
            used &= say >= noise * say[used].max(initial=0.0)
            bags = bags.only(every, used)
        rate = RATE * (1 - epoch / epochs) + 0.01
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            own = order[at : at + BATCH]
            slots, shares, row = bags.take(own)
            hidden = np.stack([np.bincount(row, shares * table[slots, j], len(own)) for j in range(DIMENSIONS)], 1).astype(np.float32) * GAIN
            logit = hidden @ weights + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), bags.labels[own]] -= 1
            back = (p @ weights.T) * GAIN / len(own)
            change = p / len(own)
            grad_w, grad_b = hidden.T @ change, change.sum(0)
            slot, place = np.unique(slots, return_inverse=True)
            grad = np.stack([np.bincount(place, shares * back[row, j], len(slot)) for j in range(DIMENSIONS)], 1).astype(np.float32)
            g_table[slot] += (grad * grad).mean(1)
            table[slot] -= rate * (grad / np.sqrt(g_table[slot])[:, None] + DECAY * table[slot])
            g_weights += grad_w * grad_w
            g_bias += grad_b * grad_b
            weights -= rate * grad_w / np.sqrt(g_weights)
            bias -= rate * grad_b / np.sqrt(g_bias)
    model = Model(np.where(used, _say(table, weights), 0).astype(np.float32), float(bias[1] - bias[0]), bits)
    model.bias = -_cut(_sums(model, bags), bags.labels) if n else -1.0
    return model


def _sums(model: Model, bags: Bags) -> np.ndarray:
    _, shares, row = bags.take(np.arange(len(bags.labels)))
    return np.bincount(row, shares * model.slots[bags.slots], len(bags.labels))


def _errors(model: Model, bags: Bags) -> int:
    return int(((model.bias + _sums(model, bags) >= 0) != (bags.labels == 1)).sum())


def _cut(said: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest place between training texts where a threshold makes the fewest errors."""
    order = np.argsort(said, kind="stable")
    x, y = said[order], labels[order]
    errors = np.concatenate([[0], np.cumsum(y == 1)]) + (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])
    edges = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    width = np.where(errors == errors[np.diff(edges) > 0].min(), np.diff(edges), -1)
    at = int(width.argmax())
    return float((edges[at] + edges[at + 1]) / 2)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the model of the whole sample, its noise threshold chosen by a split of the sample."""
    bags = _gathered(batches)
    n, everything = len(bags.labels), np.ones(1 << SLOT_BITS, bool)
    aside = np.arange(n) % VALIDATION == 0  # bags are in the order of a hash
    if aside.any() and not aside.all():
        learn, judge = (bags.only(np.flatnonzero(x), everything) for x in (~aside, aside))
        wrong = [_errors(train(learn, noise), judge) for noise in NOISE]
    else:
        wrong = [0] * len(NOISE)
    model = train(bags, NOISE[int(np.argmin(wrong))])
    yield pa.RecordBatch.from_arrays([pa.array([model.slots.tobytes()], pa.binary()), pa.array([model.bias])], ["slots", "bias"])


def _logits(texts: pa.Array, model: Model) -> np.ndarray:
    out = [np.empty(0)]
    for _, _, raw, off in ts.slices(texts):
        data, at = _spaced(raw, off)
        total, count = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
        for place, slot in _features(data, at, model.bits):
            sums = np.concatenate([[0.0], np.cumsum(model.slots[slot], dtype=np.float64)])
            cut = np.searchsorted(place, at)
            total += np.diff(sums[cut])
            count += np.diff(cut)
        out.append(model.bias + total / (count + PRIOR))
    return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: tuple[int, int] = SAMPLE_ROWS) -> Model:
    """Train on a bounded sample of labelled rows outside the held-out fold: at most ``sample_rows`` of each class.
    Without any usable label nothing is called toxic; null texts train as empty ones. The sample's bags
    meet in one task, a few kilobytes for each text whatever the size of the table; the driver gets the model."""
    prepare_tasks(docs.sparkSession)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    picked = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows[c]) for c in (0, 1)]
    sample = F.broadcast(picked[0].union(picked[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bags = texts.join(sample, "doc_id").select("toxic", "text").mapInArrow(_bags(SLOT_BITS), "toxic int, print long, slots array<int>, counts array<int>, n long")
    row = bags.repartition(1).mapInArrow(_fitted, "slots binary, bias double").first()
    if row is None:  # an empty sample may have no task at all
        return train(_gathered(iter(())), NOISE[0])
    return Model(np.frombuffer(row.slots, np.float32), row.bias)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, held_out, score, predicted.

    A null or blank text has no n-grams and the score of the bias alone; a null doc_id keeps its row with held_out
    false. Repeated rows each keep a row."""
    prepare_tasks(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(_logits(batch.column("text"), shared.value), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    ids = F.col("doc_id").cast("long")
    return docs.select(ids.alias("doc_id"), held_out(ids).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, with all its columns, without the rows that the model calls toxic."""
    prepare_tasks(docs.sparkSession)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_logits(batch.column(place), shared.value) < 0))

    return docs.mapInArrow(run, docs.schema)
