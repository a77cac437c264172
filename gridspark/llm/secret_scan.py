"""Secret scans with SQL functions only: fixed patterns, and sliding-window entropy of candidate strings.

Candidates are long runs of key characters. A window slides over each; its character counts, and from them the Shannon
entropy, change by the one character that enters and the one that leaves. Windows above the limit of the candidate's
character class mark spans, one for all that overlap. An allow-list keeps identifiers and digests out, and cuts samples
and filler from candidates. Texts never leave their row, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_names

#: Fixed patterns, in the order of their kinds: name, expression, group whose length counts, least characters of it.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Characters of the sliding window, and what a candidate is.
WINDOW = 20
#: Counts of a window's characters stand in longs, so many of so many bits in each.
DIGITS, DIGIT_BITS = 12, 5
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character classes: kind, expression for the whole candidate, least entropy in bits. The first that fits counts.
CLASSES = (
    ("entropy_hex", r"^[0-9a-fA-F]+$", 3.0),
    ("entropy_alnum", r"^[A-Za-z0-9]+$", 3.75),
    ("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", 3.9),
)
#: Candidates that are no secrets: without a digit or without a letter, and UUIDs.
ALLOWED = (
    r"^[^0-9]+$",
    r"^[^A-Za-z]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: Parts of candidates that are none, and their lengths: filler, sequences, words of samples. They are cut out, and what
#: is left of a candidate is scanned piece by piece.
FILLER = (
    (r"(.)\1{7}", 8),
    (r"(?i)0123456789|abcdefghij|qwertyuiop", 10),
    (r"(?i)placeholder", 11),
    (r"(?i)changeme", 8),
    (r"(?i)example", 7),
    (r"(?i)sample", 6),
    (r"(?i)dummy|your[_-]", 5),
)
#: What may stand before a digest that is public.
ALLOWED_BEFORE = r"(?i)(sha-?(1|224|256|384|512)|md5|commit|revision|integrity|etag)[\"']?[ :=-]*[\"']?$"

_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running results of ``step`` over an array of integers, each place's value included: in stretches of about the
    root of their number, since an array that grows in a fold is copied at every step."""

    def stretch(x: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(x, none, lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(step(F.element_at(acc, -1), v)))))

    def joined(parts: Column) -> Column:
        lasts = stretch(F.transform(parts, lambda p: F.element_at(p, -1)))
        return _let(lasts, lambda t: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda v: step(F.get(t, i - 1), v))))))

    def cut(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / size).cast("int") - 1), lambda i: stretch(F.slice(x, i * size + 1, size))), joined)

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(_let(values.cast("array<bigint>"), cut))


def _places(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, value, before>> of the leftmost non-overlapping matches, in code points.

    The parts between matches and the matches alternate, so running sums of lengths are places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("before"), hits.alias("hit"), values.alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

    def placed(x: Column) -> Column:
        ends = _running(F.transform(x, lambda p: F.length(p["before"]) + F.length(p["hit"])), lambda a, b: a + b)
        return _let(ends, lambda e: F.transform(x, lambda p, i: F.struct((F.get(e, i).cast("int") - F.length(p["hit"])).alias("start"), F.get(e, i).cast("int").alias("end"), p["value"].alias("value"), p["before"].alias("before"))))

    # The last part has no match.
    return F.when(text.rlike(pattern), _let(F.filter(parts, lambda x: x["hit"].isNotNull()), placed)).otherwise(empty)


def _base_spans(text: Column, rank: int) -> Column:
    kind, pattern, group, least = BASE[rank]
    long_enough = F.filter(_places(text, pattern, group), lambda x: F.length(x["value"]) >= least)
    return F.transform(long_enough, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


#: n log2 n, the part of a count in the entropy.
_WEIGHTS = [0.0, 0.0, *[n * math.log2(n) for n in range(2, WINDOW + 1)]]


def _hot_ranges(x: Column) -> Column:
    """array<struct<first, past>>: stretches of windows of a piece that are above its limit and overlap or touch."""
    points, none = x["points"], F.lit(None).cast("int")
    weights = F.array(*[F.lit(w) for w in _WEIGHTS])
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), x["longs"]).alias("counts"), F.lit(0.0).alias("weight"), none.alias("first"), none.alias("past"), F.array().cast("array<struct<first:int,past:int>>").alias("done"))
    count = lambda counts, c: (F.call_function("div", F.get(counts, c["word"]), c["unit"]) % (1 << DIGIT_BITS)).cast("int")
    closed = lambda acc: F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["past"].alias("past"))))

    def step(acc: Column, i: Column) -> Column:
        enters, leaves = F.get(points, i), F.get(points, i - WINDOW)
        same = F.coalesce(enters == leaves, F.lit(False))
        # How often the window before has the character that enters, and the one that leaves.
        up, down = count(acc["counts"], enters), F.when(leaves.isNull(), 0).otherwise(count(acc["counts"], leaves))
        change = F.get(weights, up + 1) - F.get(weights, up) + F.when(leaves.isNull(), 0.0).otherwise(F.get(weights, down - 1) - F.get(weights, down))
        counts = F.transform(acc["counts"], lambda v, k: v + F.when(k == enters["word"], enters["unit"]).otherwise(0) - F.when(k == leaves["word"], leaves["unit"]).otherwise(0))
        return F.struct(F.when(same, acc["counts"]).otherwise(counts).alias("counts"), F.when(same, acc["weight"]).otherwise(acc["weight"] + change).alias("weight"), acc["first"].alias("first"), acc["past"].alias("past"), acc["done"].alias("done"))

    def spans(acc: Column, i: Column) -> Column:
        hot = (i >= WINDOW - 1) & (F.log2(F.lit(float(WINDOW))) - acc["weight"] / WINDOW >= x["limit"] - 1e-9)
        apart = hot & acc["first"].isNotNull() & (i - (WINDOW - 1) > acc["past"])
        begins = hot & (acc["first"].isNull() | apart)
        return F.struct(acc["counts"].alias("counts"), acc["weight"].alias("weight"), F.when(begins, i - (WINDOW - 1)).otherwise(acc["first"]).alias("first"), F.when(hot, i + 1).otherwise(acc["past"]).alias("past"), F.when(apart, closed(acc)).otherwise(acc["done"]).alias("done"))

    return F.aggregate(F.sequence(F.lit(0), F.size(points) - 1), zero, lambda acc, i: _let(step(acc, i), lambda after: spans(after, i)), lambda acc: F.when(acc["first"].isNull(), acc["done"]).otherwise(closed(acc)))


def _allowed(value: Column) -> Column:
    out = F.lit(False)
    for p in ALLOWED:
        out = out | value.rlike(p)
    return out


def _candidates(text: Column) -> Column:
    """array<struct<start, left>>: candidates that the allow-list leaves, with blanks for their filler."""
    suspects = F.filter(_places(text, CANDIDATE, 0), lambda x: ~(_allowed(x["value"]) | F.substring(x["before"], -24, 24).rlike(ALLOWED_BEFORE)))

    def without_filler(value: Column) -> Column:
        for pattern, n in FILLER:
            value = F.regexp_replace(value, pattern, " " * n)
        return value

    return F.transform(suspects, lambda x: F.struct(x["start"].alias("start"), without_filler(x["value"]).alias("left")))


def _pieces(candidates: Column) -> Column:
    """array<struct<start, value>>: what is long enough of the candidates' rests."""
    of = F.flatten(F.transform(candidates, lambda x: F.transform(_places(x["left"], CANDIDATE, 0), lambda p: F.struct((x["start"] + p["start"]).alias("start"), p["value"].alias("value")))))
    return F.filter(of, lambda p: ~_allowed(p["value"]))


def _coded(pieces: Column) -> Column:
    """The pieces with class and limit, and each character's place among the counts: a long, and a digit's unit in it."""
    units = F.array(*[F.lit(1 << DIGIT_BITS * d).cast("long") for d in range(DIGITS)])

    def coded(p: Column) -> Column:
        rank = F.coalesce(*[F.when(p["value"].rlike(e), F.lit(i)) for i, (_, e, _) in enumerate(CLASSES)])
        pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in CLASSES]), rank + 1)
        chars = F.regexp_extract_all(p["value"], F.lit("."), F.lit(0))
        kinds = F.array_distinct(chars)
        point = lambda n: F.struct(F.floor(n / DIGITS).cast("int").alias("word"), F.get(units, (n % DIGITS).cast("int")).alias("unit"))
        points = _let(kinds, lambda d: F.transform(chars, lambda c: point(F.array_position(d, c).cast("int") - 1)))
        return F.struct(p["start"].alias("start"), (rank + len(BASE)).alias("rank"), pick(0).alias("kind"), pick(2).alias("limit"), F.ceil(F.size(kinds) / DIGITS).cast("int").alias("longs"), points.alias("points"))

    return F.transform(pieces, coded)


def _entropy_spans(coded: Column) -> Column:
    return F.flatten(F.transform(coded, lambda x: F.transform(_hot_ranges(x), lambda r: F.struct((x["start"] + r["first"]).alias("start"), x["rank"].alias("rank"), (x["start"] + r["past"]).alias("end"), x["kind"].alias("kind")))))


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` (text; other columns stay as they are) plus base_spans and spans, arrays of struct<start, rank, end,
    kind> by start, then kind; places are code points, ends exclusive.

    spans adds to base_spans the entropy spans that no base span contains. A null or empty text has no spans; repeated
    rows each keep theirs; an empty table gives none. Cost grows with a text's length, and with the root of its matches
    more; a candidate of any length is one fold over its characters. Columns of docs named base_spans or spans are
    replaced.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.sort_array(F.concat(*[_base_spans(text, i) for i in range(len(BASE))]).cast(_SPAN))
    (found,) = free_names(docs, "found")
    steps = docs.withColumn(found, _candidates(text)).withColumn(found, _pieces(F.col(found))).withColumn(found, _coded(F.col(found)))
    more = _entropy_spans(F.col(found)).cast(_SPAN)

    def fresh(spans: Column) -> Column:
        """Without the entropy spans inside a base span; by start, base spans of one start come first."""
        reach = _running(F.transform(spans, lambda s: F.when(s["rank"] < len(BASE), s["end"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b))
        return _let(reach, lambda r: F.filter(spans, lambda s, i: (s["rank"] < len(BASE)) | (F.get(r, i) < s["end"])))

    added = _let(base, lambda b: F.struct(b.alias("base_spans"), _let(F.sort_array(F.concat(b, more)), fresh).alias("spans")))
    return steps.withColumn(found, added).select(*[c for c in docs.columns if c not in ("base_spans", "spans")], f"{found}.base_spans", f"{found}.spans")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans are one.

    Finding a place in a text costs as much as the text before it, so groups of about the root of the spans are cut out
    first, and the spans of a group from there."""

    def cut(upto: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(upto, i - 1)).cast("int")
        size = F.ceil(F.sqrt(F.size(upto))).cast("int")

        def group(g: Column) -> Column:
            first, last = g * size, F.least((g + 1) * size, F.size(upto)) - 1
            base = before(first)
            part = F.substring(text, base + 1, F.get(upto, last).cast("int") - base)

            def piece(s: Column, i: Column, part: Column) -> Column:
                at = before(first + i)
                return F.when(s["start"] >= at, F.concat(F.substring(part, at - base + 1, s["start"] - at), F.lit(mark))).otherwise(F.lit(""))

            return _let(part, lambda p: F.array_join(F.transform(F.slice(spans, first + 1, size), lambda s, i: piece(s, i, p)), ""))

        groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size(upto) / size).cast("int") - 1), group)
        return F.concat(F.array_join(groups, ""), F.substring(text, F.element_at(upto, -1).cast("int") + 1, F.length(text)))

    ends = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) == 0, text).otherwise(_let(ends, cut))
