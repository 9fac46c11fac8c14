"""Line deduplication by distinct-site spread.

For every line hash a HyperLogLog sketch of the sites that carry the line is
merged by aggregation, map-side first, so a line that a third of all rows share
costs one row for each task. Where the estimate is so near the threshold that
the sketch's error could decide, the distinct sites are counted exactly. A line
on enough sites is boilerplate and stays only where it stands first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base

MIN_SITES = 10
SKETCH_LG_K = 12
SIGMAS = 4.0


def near_threshold(min_sites: int, lg_k: int = SKETCH_LG_K, sigmas: float = SIGMAS) -> tuple[float, float]:
    """Estimates strictly outside these bounds decide by themselves."""
    error = max(1.0, sigmas * 1.04 / math.sqrt(2**lg_k) * min_sites)
    return min_sites - error, min_sites + error


def _split(text: Column) -> Column:
    return F.coalesce(F.split(text, "\n"), F.array().cast("array<string>"))


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """A row for each line that isn't blank; two hashes of it with seeds of their own are its key of 128 bits."""
    keyed = docs.select(F.col("doc_id"), F.col(site).alias("site"), F.xxhash64(text).alias("text_key"), F.posexplode(_split(F.col(text))).alias("place", "line"))
    return keyed.where(F.length(F.trim("line")) > 0).select("doc_id", "site", "text_key", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("text_key"), F.col("place"))


def spread_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """Hashes of the lines on at least min_sites distinct non-null sites, with the place where each stands first and the number of its rows."""
    lines = _lines(docs, text, site)
    low, high = near_threshold(min_sites, lg_k)
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg(F.col("site").cast("string"), lg_k).alias("sketch"), F.count("site").alias("n"), F.count("*").alias("n_rows"), F.min(_place()).alias("first"))
    guessed = _base.checkpoint(sketches.where(F.col("n") >= min_sites).select("h1", "h2", "first", "n_rows", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low))
    sure = guessed.where(F.col("sites") > high).drop("sites")
    near = guessed.where(F.col("sites") <= high).drop("sites")
    counted = _base.spread_join(lines.where("site is not null"), near.select("h1", "h2", "n_rows"), ["h1", "h2"], "n_rows").groupBy("h1", "h2", "site").count().groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    return sure.unionByName(near.join(counted.where(F.col("exact") >= min_sites), ["h1", "h2"]).drop("exact"))


def line_dedup(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """All rows and columns, with cross-site boilerplate lines taken out of the text; n_lines and n_removed besides.

    Lines are what lies between line feeds, unchanged; blank lines are never
    removed. A boilerplate line stays at its first place: smallest doc_id (null
    last), then xxhash64 of the text, then place; so no content is lost from
    the table. Repeated rows share that place, each keeps it. Null sites are no
    sites. Null text stays null with n_lines 0; an empty text is one blank line.
    Columns of ``docs`` named n_lines or n_removed are replaced; an empty table
    gives an empty result.
    """
    _base.require(docs, "doc_id", text, site)
    spread = _base.checkpoint(spread_lines(docs, text, site, min_sites, lg_k))
    removed = _base.spread_join(_lines(docs, text, site), spread, ["h1", "h2"], "n_rows").where(_place() != F.col("first"))
    own = docs.drop("n_lines", "n_removed")
    its_id, its_key, gone = (_base.fresh(own, x) for x in ("its_id", "its_key", "gone"))
    of = removed.groupBy(F.col("doc_id").alias(its_id), F.col("text_key").alias(its_key)).agg(F.collect_set("place").alias(gone))
    joined = own.join(of, own["doc_id"].eqNullSafe(of[its_id]) & (F.xxhash64(own[text]) == of[its_key]), "left").drop(its_id, its_key)
    lines = _split(F.col(text))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    out = joined.withColumns({"n_lines": F.size(lines).cast("long"), "n_removed": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")})
    return out.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)).drop(gone)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256, the hash of the text that is left."""
    out = line_dedup(_base.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents
), spread AS (
  SELECT line FROM lines WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), judged AS (
  SELECT l.doc_id, l.line, l.place,
         s.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY l.doc_id, l.place) > 1 AS gone
  FROM lines l LEFT JOIN spread s ON l.line = s.line
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
