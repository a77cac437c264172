"""Quality by attention-based multiple-instance learning: a document is a bag of passages, only the bag has a label.

A passage of 64 words becomes a vector of shares (kinds of bytes and words, repetition, lengths). A layer encodes it; a
gate, the product of a tanh and a sigmoid layer, weighs it against the other passages of its document; the score is the
logistic of the weighted mean of the encodings. All layers learn together from document labels, in numpy, in one task
over a sample of bounded size. Scoring runs where the texts are, and can say how much weight each passage had.
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

PASSAGE_WORDS = 64
#: Bound of the training sample: so many labelled rows of quality 0, 1, the first by a hash of their ids, and so many
#: passages in all: documents beyond that, in the order of a hash of their texts, are not learned from. Nor are those
#: of more passages than the last number; they are scored as all others.
SAMPLE_ROWS, SAMPLE_PASSAGES, LEARNED_PASSAGES = (2000, 4000), 200_000, 500
#: Word windows whose repetition inside the text counts.
WINDOW = 5
HIDDEN, GATE = 24, 12
EPOCHS, STEPS, BATCH, RATE, DECAY = (10, 60), 1500, 64, 0.01, 1e-3
#: Standardised shares end here on either side.
MOST_DEVIATION = 4.0

_byte = np.arange(256)
_DIGIT, _UPPER, _LOWER = ((_byte >= a) & (_byte <= b) for a, b in ((48, 57), (65, 90), (97, 122)))
_FIRST, _NEXT = _byte >= 0xC0, (_byte >= 0x80) & (_byte < 0xC0)
_SIGN = (_byte > 32) & (_byte < 127) & ~_DIGIT & ~_UPPER & ~_LOWER
#: Kinds of bytes: each ASCII sign has its own; digits, upper case, lower case, characters beyond ASCII (their first
#: bytes, the others count as nothing), blanks, line ends, controls.
_KINDS = 8 + int(_SIGN.sum())
_KIND = np.select([_DIGIT, _UPPER, _LOWER, _FIRST, _NEXT, _byte == 10, (_byte == 32) | (_byte == 9)], [0, 1, 2, 3, 4, 5, 6], 7)
_KIND[_SIGN] = 8 + np.arange(_SIGN.sum())
_WORD_SHARES = 9
FEATURES = _KINDS + _WORD_SHARES + 4

_BAG = pa.schema([("label", pa.int32()), ("print", pa.int64()), ("passages", pa.list_(pa.float32()))])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  #: (features + 1) x hidden, the last row is the bias
    tanh: np.ndarray  #: (hidden + 1) x gate
    sigmoid: np.ndarray
    weigh: np.ndarray  #: gate
    decide: np.ndarray  #: hidden + 1

    def layers(self) -> list[np.ndarray]:
        return [self.encode, self.tanh, self.sigmoid, self.weigh, self.decide]


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that training never reads; rows without an id are never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _repeated(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each word is in a window of ``WINDOW`` words that its text has twice or more. of: text of each word."""
    out = np.zeros(len(h), bool)
    if len(h) < WINDOW:
        return out
    s = ts.shingles(h, WINDOW)
    inside = of[: len(s)] == of[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.lexsort((s[at], of[at]))]
    same = (s[order[1:]] == s[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    edge = np.zeros(len(h) + 1, np.int64)
    edge[order[again]] += 1
    edge[order[again] + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def passages(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: features of all passages, where each text's passages begin (one more at the end), and their
    first words, numbered from 0 in each text. A text without words has one passage."""
    n = len(off) - 1
    w = ts.scan(raw, off, ts.BLANK_SEPARATED, lower=False)
    lowered = ts.scan(raw, off, ts.BLANK_SEPARATED)
    h, words = lowered.hashes(), np.diff(w.ptr)
    of = np.repeat(np.arange(n), words)
    count = np.maximum(1, -(-words // PASSAGE_WORDS))
    ptr = np.concatenate([[0], np.cumsum(count)])
    total = int(ptr[-1])
    # Passage of each word, and of each byte: a passage's bytes reach to the first word of the next one.
    rank = np.arange(len(h)) - w.ptr[:-1][of]
    passage = ptr[of] + rank // PASSAGE_WORDS
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, off[1:-1], 1)
    np.add.at(edge, w.starts[(rank % PASSAGE_WORDS == 0) & (rank > 0)], 1)
    # A text of no bytes still has a passage: its step falls on the next text's first byte, as np.add.at adds both.
    byte_passage = np.cumsum(edge[:-1])
    kinds = np.bincount(byte_passage * _KINDS + _KIND[raw], minlength=total * _KINDS).reshape(total, _KINDS).astype(np.float64)
    kinds[:, 4] = 0
    chars = np.maximum(kinds.sum(1), 1)

    def running(flag: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flag[raw])])

    def held(run: np.ndarray) -> np.ndarray:
        return run[w.ends] - run[w.starts]

    upper, lower, digit, sign, more = (held(running(f)) for f in (_UPPER, _LOWER, _DIGIT, _SIGN, _NEXT))
    letters = upper + lower + held(running(_FIRST))
    length = (w.ends - w.starts) - more
    bytes_of = raw if len(raw) else np.zeros(1, np.uint8)
    first_upper = _UPPER[bytes_of[w.starts]] if len(h) else np.empty(0, bool)
    last_sign = _SIGN[bytes_of[w.ends - 1]] if len(h) else np.empty(0, bool)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, passage))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (passage[order[1:]] != passage[order[:-1]])
    shares = [(upper >= 2) & (lower == 0), first_upper & (lower > 0), digit > 0, letters == 0, sign - last_sign > 0, last_sign, again, _repeated(h, of)]
    size = np.bincount(passage, minlength=total).astype(np.float64)
    many = np.maximum(size, 1)
    columns = [np.sqrt(kinds / chars[:, None])]
    columns += [(np.bincount(passage, s, total) / many)[:, None] for s in shares]
    columns.append((np.bincount(passage[order], new, total) / many)[:, None])
    mean = np.bincount(passage, length, total) / many
    spread = np.sqrt(np.maximum(np.bincount(passage, length.astype(np.float64) ** 2, total) / many - mean**2, 0))
    columns += [np.log1p(x)[:, None] for x in (mean, spread, size, np.repeat(words, count).astype(np.float64))]
    return np.hstack(columns).astype(np.float32), ptr, (np.arange(total) - np.repeat(ptr[:-1], count)) * PASSAGE_WORDS


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: (label, hash of the text, its passages one after the other) of each text that is not too long."""
    for batch in batches:
        bags, prints, labels, at = [], [], batch.column("label").to_pylist(), 0
        kept = []
        for _, _, raw, off in ts.slices(batch.column("text")):
            found, ptr, _ = passages(raw, off)
            for d in np.flatnonzero(np.diff(ptr) <= LEARNED_PASSAGES):
                bags.append(found[ptr[d] : ptr[d + 1]].ravel())
                prints.append(xxhash.xxh64_intdigest(raw[off[d] : off[d + 1]].tobytes()) >> 1)
                kept.append(labels[at + d])
            at += len(off) - 1
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(prints, pa.int64()), pa.array(bags, pa.list_(pa.float32()))], schema=_BAG)


def _sums(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums over the bags; each bag has a passage at least."""
    return np.add.reduceat(x, ptr[:-1], axis=0)


def _forward(model: Model, x: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, ...]:
    of = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    hidden = np.tanh(x @ model.encode[:-1] + model.encode[-1])
    left = np.tanh(hidden @ model.tanh[:-1] + model.tanh[-1])
    right = 1 / (1 + np.exp(-(hidden @ model.sigmoid[:-1] + model.sigmoid[-1])))
    raised = (left * right) @ model.weigh
    raised = np.exp(raised - np.maximum.reduceat(raised, ptr[:-1])[of])
    weight = raised / _sums(raised, ptr)[of]
    held = _sums(hidden * weight[:, None], ptr)
    return of, hidden, left, right, weight, held, held @ model.decide[:-1] + model.decide[-1]


def _step(model: Model, x: np.ndarray, ptr: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss over the bags, for each layer."""
    of, hidden, left, right, weight, held, logit = _forward(model, x, ptr)
    d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
    back = (d[:, None] * model.decide[:-1])[of]  # d loss / d weighted mean, at each passage
    d_weight = ((hidden - held[of]) * back).sum(1) * weight
    gated = d_weight[:, None] * model.weigh
    d_left, d_right = gated * right * (1 - left**2), gated * left * right * (1 - right)
    d_hidden = back * weight[:, None] + d_left @ model.tanh[:-1].T + d_right @ model.sigmoid[:-1].T
    d_in = d_hidden * (1 - hidden**2)

    def layer(inputs: np.ndarray, grad: np.ndarray) -> np.ndarray:
        return np.vstack([inputs.T @ grad, grad.sum(0)])

    return [layer(x, d_in), layer(hidden, d_left), layer(hidden, d_right), (left * right).T @ d_weight, np.append(held.T @ d, d.sum())]


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -MOST_DEVIATION, MOST_DEVIATION)


def train(x: np.ndarray, ptr: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Fit by Adam over batches of bags. Without bags of both labels only the bias of the score is set: to the label
    there is, or to 1 without any."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    wide = lambda a, b: np.vstack([rng.normal(0, a**-0.5, (a, b)), np.zeros(b)])
    model = Model(mean, scale, wide(FEATURES, HIDDEN), wide(HIDDEN, GATE), wide(HIDDEN, GATE), rng.normal(0, GATE**-0.5, GATE), np.append(rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0))
    if len(y) == 0 or y.min() == y.max():
        model.decide[:] = 0
        model.decide[-1] = 2.0 if len(y) == 0 or y[0] else -2.0
        return model
    x = standard(x, mean, scale)
    n, t = len(y), 0
    first, second = [np.zeros_like(p) for p in model.layers()], [np.zeros_like(p) for p in model.layers()]
    epochs = min(EPOCHS[1], max(EPOCHS[0], -(-STEPS * BATCH // n)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + RATE / 50
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            own, t = order[at : at + BATCH], t + 1
            size = ptr[own + 1] - ptr[own]
            begin = np.concatenate([[0], np.cumsum(size)])
            rows = np.arange(begin[-1]) + np.repeat(ptr[own] - begin[:-1], size)
            for p, g, a, b in zip(model.layers(), _step(model, x[rows], begin, y[own]), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**t) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8) + DECAY * p)
    return model


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the model of the sample, whose rows come in the order of their hash."""
    bags, labels, total = [], [], 0
    for batch in batches:
        for bag, label in zip(batch.column("passages"), batch.column("label").to_pylist(), strict=True):
            size = len(bag) // FEATURES
            if total + size <= SAMPLE_PASSAGES:
                bags.append(bag.values.to_numpy())
                labels.append(label)
                total += size
    sizes = [len(b) // FEATURES for b in bags]
    x = np.concatenate(bags).reshape(-1, FEATURES).astype(np.float64) if bags else np.empty((0, FEATURES))
    model = train(x, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array(labels, np.float64))
    flat = np.concatenate([p.ravel() for p in (model.mean, model.scale, *model.layers())])
    yield pa.RecordBatch.from_arrays([pa.array([flat], pa.list_(pa.float64()))], ["model"])


def _unpacked(flat: np.ndarray) -> Model:
    shapes = [(FEATURES,), (FEATURES,), (FEATURES + 1, HIDDEN), (HIDDEN + 1, GATE), (HIDDEN + 1, GATE), (GATE,), (HIDDEN + 1,)]
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return Model(*(part.reshape(s) for part, s in zip(np.split(flat, cuts), shapes, strict=True)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: tuple[int, int] = SAMPLE_ROWS) -> Model:
    """Train on labelled rows outside the held-out fold, at most ``sample_rows`` of each class and ``SAMPLE_PASSAGES``
    passages. Repeated labelled rows count once; an id with both labels counts as both, a labelled id on several rows
    brings each of them, within the bounds; null texts train as empty ones. Without any usable label every document has
    quality. The driver gets the layers alone."""
    prepare_tasks(docs.sparkSession)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    picked = [rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows[c]) for c in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bags = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("label", "text").mapInArrow(_bags, "label int, print long, passages array<float>")
    ordered = bags.orderBy("print", "label").limit(sum(sample_rows)).coalesce(1)
    row = ordered.mapInArrow(_fitted, "model array<double>").first()
    if row is None:  # an empty sample may have no task at all
        return train(np.empty((0, FEATURES)), np.zeros(1, np.int64), np.empty(0))
    return _unpacked(np.array(row.model))


def _scored(texts: pa.Array, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: scores, where passages begin, their first words and weights."""
    for _, _, raw, off in ts.slices(texts):
        found, ptr, first = passages(raw, off)
        *_, weight, _, logit = _forward(model, standard(found, model.mean, model.scale), ptr)
        yield 1 / (1 + np.exp(-np.clip(logit, -500, 500))), ptr, first, weight


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, held_out, score, predicted, and
    n_passages, how many passages the text was read in.

    A null or blank text is one passage without words. A null doc_id keeps its row with held_out false; repeated rows
    each keep a row."""
    prepare_tasks(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(_scored(batch.column("text"), shared.value))
            score = np.concatenate([np.empty(0), *(s for s, *_ in got)])
            count = np.concatenate([np.empty(0, np.int64), *(np.diff(p) for _, p, *_ in got)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count)], ["doc_id", "held_out", "score", "predicted", "n_passages"])

    ids = F.col("doc_id").cast("long")
    return docs.select(ids.alias("doc_id"), held_out(ids).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long")


def passage_weights(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, first_word, weight): how much weight each passage had in its document's score; weights sum to 1."""
    prepare_tasks(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for score, ptr, first, weight in _scored(batch.column("text"), shared.value):
                of = pa.array(done + np.repeat(np.arange(len(score)), np.diff(ptr)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), pa.array(first), pa.array(weight)], ["doc_id", "first_word", "weight"])
                done += len(score)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, first_word long, weight double")
