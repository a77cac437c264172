"""Line deduplication by distinct-site spread, with DataFrame functions only.

Every line's hash gets a HyperLogLog sketch of the sites that have it; sketches merge in a pre-aggregating shuffle. Only
hashes with fewer rows than the limit need none.
Estimates clearly under or over the limit decide at once; hashes near it get exact distinct counts. Lines on too many
sites are boilerplate and leave every document. Only hashes, sketches and flags are shuffled by line; a text moves at
most once, and only if too many documents change for the changes to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, free_names, materialize, small_or_shuffled

#: A line on at least this many distinct sites is boilerplate.
SITES = 5
#: Lines of fewer characters, without blanks at their ends, are left alone: blank ones only.
LEAST_CHARS = 1
#: log2 of the sketch's registers; its relative standard error is about 1.04 / sqrt(2 ** LG_K), 1.6 %.
LG_K = 12
#: Estimates within this share of the limit (six standard errors), and at least one site, are counted exactly.
NEAR = 0.1

_KEY = ["k1", "k2"]


def _lines(docs: DataFrame, site: str, text: str) -> DataFrame:
    """A row for each line of enough characters: the text's key, the line's place, site and hash."""
    # Lines are equal if they differ in case and in blanks at their ends only.
    plain = F.lower(F.trim("line"))
    each = docs.select(*_keys(text), F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("site"), F.posexplode_outer(F.split(text, "\n")).alias("at", "line"))
    return each.where(F.length(plain) >= LEAST_CHARS).select(*_KEY, "site", "at", F.xxhash64(plain).alias("line_hash"))


def _keys(text: str) -> list[Column]:
    return [F.xxhash64(F.lit(i), text).alias(k) for i, k in enumerate(_KEY, 1)]


def boilerplate_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(line_hash) of those on ``sites`` or more distinct sites, from (site, line_hash) rows. A null site is one site."""
    # A line that has fewer rows than the limit cannot be on so many sites; no other count decides for a line.
    often = materialize(lines.groupBy("line_hash").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("line_hash"), "frequent-lines")
    held = materialize(lines.select("site", "line_hash").join(small_or_shuffled(often), "line_hash", "left_semi"), "site-lines")
    margin = max(1.0, NEAR * sites)
    sketched = held.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"))
    sketched = materialize(sketched.where(F.col("estimate") >= sites - margin), "line-sketches")
    sure = sketched.where(F.col("estimate") > sites + margin).select("line_hash")
    near = small_or_shuffled(sketched.where(F.col("estimate") <= sites + margin).select("line_hash"))
    exact = held.join(near, "line_hash", "left_semi").groupBy("line_hash").agg(F.count_distinct("site").alias("n"))
    out = materialize(sure.union(exact.where(F.col("n") >= sites).select("line_hash")), "boilerplate")
    discard(often, held, sketched)
    return out


def without_boilerplate(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """``docs``, with all its columns, plus n_lines and n_removed_lines; ``text`` is without its boilerplate lines.

    A line is what stands between \\n. No row is dropped. A null text stays null with no lines, an empty one has one
    line. A text of which nothing but blanks would be left stays whole: it is a copy of something, for near-duplicate
    removal to decide. Null sites are one site; doc_id is of no account; repeated rows all stay and change alike. Rows
    are keyed by their texts' hashes, so a group of copies is one case and a null text is none. Columns of docs named
    n_lines or n_removed_lines are replaced.
    """
    lines = materialize(_lines(docs, site, "text"), "lines")
    boilerplate = small_or_shuffled(boilerplate_lines(lines, sites))
    gone = lines.join(boilerplate, "line_hash", "left_semi").select(*_KEY, "at").distinct().groupBy(*_KEY).agg(F.sort_array(F.collect_list("at")).alias("gone"))
    k1, k2, at, new = free_names(docs, *_KEY, "gone", "new")
    gone = materialize(gone.toDF(k1, k2, at), "removed-lines")
    discard(lines)
    out = docs.withColumns(dict(zip((k1, k2), _keys("text"), strict=True))).join(small_or_shuffled(gone), [k1, k2], "left")

    def kept(parts: Column) -> Column:
        before, after = F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(F.size(parts)))
        return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(parts, a + 2, b - a - 1)))

    # Only texts that lose lines are split, once; the others are handed on as they are.
    left = F.transform(F.transform(F.array(F.split("text", "\n")), kept), lambda k: F.when(F.exists(k, lambda line: F.trim(line) != ""), F.array_join(k, "\n")))[0]
    out = out.withColumn(new, F.when(F.col(at).isNotNull(), left))
    n_lines = F.coalesce((F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long"), F.lit(0))
    removed = F.when(F.col(new).isNotNull(), F.size(at).cast("long")).otherwise(F.lit(0))
    counts = [n_lines.alias("n_lines"), removed.alias("n_removed_lines")]
    return out.select(*[F.coalesce(F.col(new), F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed_lines")], *counts)


def sql(sites: int = SITES) -> str:
    """The same rows (doc_id, text, n_lines, n_removed_lines) in DuckDB SQL, with exact counts."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source, string_split(text, chr(10)) AS x FROM documents),
    p AS (SELECT r, source, x, unnest(range(1, len(x) + 1)) AS i FROM d),
    l AS (SELECT r, i, coalesce(source, chr(1)) AS site, x[i] AS line, lower(trim(x[i], ' ')) AS plain FROM p),
    b AS (SELECT plain FROM l WHERE length(plain) >= {LEAST_CHARS} GROUP BY plain HAVING count(DISTINCT site) >= {sites}),
    m AS (SELECT l.*, b.plain IS NOT NULL AS gone FROM l LEFT JOIN b USING (plain)),
    g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone,
      count(*) FILTER (NOT gone AND trim(line, ' ') <> '') > 0 AS apply,
      coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY r)
    SELECT doc_id, CASE WHEN n_gone > 0 AND apply THEN kept ELSE text END AS text,
      coalesce(n_lines, 0)::BIGINT AS n_lines, (CASE WHEN n_gone > 0 AND apply THEN n_gone ELSE 0 END)::BIGINT AS n_removed_lines
    FROM d LEFT JOIN g USING (r)"""
