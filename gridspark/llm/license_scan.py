"""License scans by diagonal voting, with DataFrame functions only.

The rolling word 3-gram hashes of every text join the 3-grams of known notices. A match at text place p and notice
place t votes for the diagonal p - t; neighbouring diagonals (an inserted or missing word moves the diagonal) merge, and
a span is verified by the share of the notice's words it covers and by its length. Only matches are shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .notices import NOTICES

# Phrases whose places are always reported, with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
GRAM = 3
#: Diagonals at most this far apart belong to one alignment.
DRIFT = 3
#: A verified span covers this share of the notice's words and is at most this many times as long.
LEAST_COVER, MOST_LENGTH = 0.6, 2.0
#: Score of a text with base phrases alone; a verified span scores the share of the notice that it covers.
BASE_SCORE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = "".join(chr(c) for c in range(128) if not (chr(c).isalnum() and chr(c) not in _UPPER))
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KEY = ["__k1", "__k2"]


def _small(text: Column) -> Column:
    """A-Z small; other letters stay as they are (lower() would make a k of the Kelvin sign)."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _words(text: Column) -> Column:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the small-lettered text."""
    plain = F.trim(_small(text), F.lit(_SEPARATORS))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, _SPLIT))


def _notice_grams(docs: DataFrame) -> DataFrame:
    rows = []
    for i, (label, notice) in enumerate(NOTICES):
        words = re.findall(r"[0-9a-z]+", notice.lower())
        rows += [(i, label, len(words), t, *words[t : t + GRAM]) for t in range(len(words) - GRAM + 1)]
    schema = "notice int, label string, notice_words int, t int, " + ", ".join(f"n{j} string" for j in range(GRAM))
    return docs.sparkSession.createDataFrame(rows, schema).withColumn("gram", F.xxhash64(*[f"n{j}" for j in range(GRAM)]))


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """The text's key and words, and ``more`` columns; other columns of docs are left out."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(F.lit(1), text).alias("__k1"), F.xxhash64(F.lit(2), text).alias("__k2"), _words(F.col("text")).alias("__words"), *more)


def notice_spans(docs: DataFrame) -> DataFrame:
    """(__k1, __k2, label, first_word, past_word, cover) of the verified spans of each distinct text."""
    grams = F.transform("__words", lambda w, i: F.xxhash64(w, *[F.get("__words", i + j) for j in range(1, GRAM)]))
    # The outer form: for the other, Spark infers a filter that computes the grams anew below, words and all.
    placed = _keyed(docs).select(*_KEY, "__words", grams.alias("__grams")).select(*_KEY, "__words", F.posexplode_outer("__grams").alias("p", "gram"))
    notices = F.broadcast(_notice_grams(docs))
    same = placed["gram"] == notices["gram"]
    for j in range(GRAM):  # equal hashes, and equal words
        same = same & (F.get("__words", F.col("p") + j) == notices[f"n{j}"])
    hits = placed.join(notices, same).select(*_KEY, "notice", "label", "notice_words", "t", "p").distinct()
    votes = hits.groupBy(*_KEY, "notice", "label", "notice_words", (F.col("p") - F.col("t")).alias("diagonal"))
    votes = votes.agg(F.collect_set("t").alias("ts"), F.min("p").alias("first"), F.max("p").alias("last"))
    near = W.partitionBy(*_KEY, "notice").orderBy("diagonal")
    jump = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near) > DRIFT).cast("int"), F.lit(1))
    runs = votes.withColumn("run", F.sum(jump).over(near.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy(*_KEY, "notice", "label", "notice_words", "run").agg(F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"), F.min("first").alias("first_word"), (F.max("last") + GRAM).alias("past_word"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + (GRAM - 1))))))
    spans = spans.withColumn("cover", covered / F.col("notice_words"))
    right = (F.col("cover") >= LEAST_COVER) & (F.col("past_word") - F.col("first_word") <= MOST_LENGTH * F.col("notice_words"))
    return spans.where(right).select(*_KEY, "label", "first_word", "past_word", "cover")


def _base_places(words: Column) -> Column:
    """array<struct<at, label>> of the base phrases."""
    def at(w: Column, i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in BASE_PHRASES.items():
            first, *rest = phrase.split()
            here = w == first
            for j, part in enumerate(rest, 1):
                here = here & (F.get(words, i + j) == part)
            label = F.when(here, F.lit(name)).otherwise(label)
        return F.struct(i.alias("at"), label.alias("label"))

    return F.filter(F.transform(words, at), lambda x: x["label"].isNotNull())


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, spans (array of struct<label, first_word, past_word, cover>).

    A null text is empty and has none of them, with score 0. Equal texts are matched once and every row keeps its
    result; a null doc_id keeps its row. Matches of a text of any length are spread by text and notice, and a text that
    a third of all rows share is one.
    """
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("label", T.StringType())])))
    small = _small(F.col("text"))
    maybe = small.contains("license") | (small.contains("cc") & small.contains("by"))
    base = _keyed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), *_KEY, F.size("__words").cast("long").alias("n_words"), F.when(maybe, _base_places(F.col("__words"))).otherwise(none).alias("places"))
    spans = notice_spans(docs).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("label", "first_word", "past_word", "cover"))).alias("spans"))
    out = base.join(spans, _KEY, "left")
    at = F.transform("places", lambda x: x["at"].cast("long"))
    names = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    more = F.coalesce(F.transform("spans", lambda x: x["label"]), F.array().cast("array<string>"))
    score = F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda x: x["cover"])), F.lit(0.0)), F.when(F.size("places") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(names, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(names, more))), ",").alias("labels"),
        score.alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<label:string,first_word:int,past_word:int,cover:double>>")).alias("spans"),
    )
