"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words; a document of the source expects
``target / words of the source`` copies.  The expected copies are prefix-summed within the
source (ordered by size, then by a hash of the id, so that every stretch of sizes is met in
its share), one random offset per source is added, and a document is emitted once for each
integer boundary that its stretch of the prefix sum crosses.

The prefix sums have three levels (sizes of a source, hash buckets of a size, rows of a
bucket), so no task ever orders a whole source, however hot it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words, what the mix takes
MOST = 2.0  # times its source's size, what a target takes at most
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_rank, n_docs, source_size, target): water filling by weight under caps.

    The sources that reach their cap are those with the least cap per weight, so one running
    sum in that order finds the level at which all others stop.  One row per source: small.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    w = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_rank", F.row_number().over(w) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("before")) / F.col("rest"))
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("final", F.min(F.when(open_, F.struct("before", "source_rank", "level"))).over(every)["level"])
    per = per.withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")))
    return per.select("source", "source_rank", "n_docs", "source_size", "target")


def _offset(source: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, bucket_rows: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    Null text: size 0.  Null source: a source of its own, last in order.  Null or repeated
    ids: their rows stay, each with its own stretch (which of equal rows gets a copy more
    can't be told).  Empty table: no rows.  Deterministic for a given ``seed``.
    """
    sizes = stash(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    per = targets(sizes, weights, share, most)
    total = sizes.count()
    digits = max(1, math.ceil(math.log(max(1, total / bucket_rows), 16)))
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    per = per.withColumnRenamed("source", "of")  # one row per source: broadcast while that is small
    rows = sizes.join(per, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "source_rank", "source_size", "target", "size", h.alias("h"))
    rows = rows.withColumn("bucket", F.substring("h", 1, digits))
    counts = rows.groupBy("source_rank", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_size = counts.groupBy("source_rank", "size").agg(F.sum("n").alias("n"))
    above = Window.partitionBy("source_rank").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("source_rank", "size", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("at_size"))
    inside = Window.partitionBy("source_rank", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = counts.select("source_rank", "size", "bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("at_bucket"))
    at = at.join(by_size, ["source_rank", "size"]).select("source_rank", "size", "bucket", (F.col("at_size") + F.col("at_bucket")).alias("at"))
    within = Window.partitionBy("source_rank", "size", "bucket").orderBy("h", "doc_id")
    rows = rows.withColumn("k", F.row_number().over(within) - 1).join(at, ["source_rank", "size", "bucket"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    rank = (F.col("at") + F.col("k")).cast("double")
    u = _offset(F.col("source"), seed)
    copies = (F.floor(u + rate * (rank + 1)) - F.floor(u + rate * rank)).cast("long")
    rows = rows.withColumn("copies", copies)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns stay as they are.

    Rows that share an id are told apart by their size and source; equal ones take turns.
    """
    plan = mix_plan(docs, key=key, **options)
    text, source = options.get("text", "text"), options.get("source", "source")
    plan = plan.select(F.col("doc_id").alias("_k"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("copies").alias("_c"))
    plan = stash(plan.groupBy("_k", "_s", "_z").agg(F.sort_array(F.collect_list("_c"), asc=False).alias("_cs")).where("_cs[0] > 0"), "plan")
    # all columns travel as one struct, so no name of theirs can clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("_k2"), F.col(f"`{source}`").alias("_s2"), word_count(F.col(f"`{text}`")).alias("_z2"))

    def met(part: DataFrame) -> DataFrame:
        part = part.hint("merge")  # it spills, and is the plan of every size
        return keyed.join(part, F.col("_k2").eqNullSafe(F.col("_k")) & F.col("_s2").eqNullSafe(F.col("_s")) & (F.col("_z2") == F.col("_z")))

    out = met(plan.where("size(_cs) = 1")).select("row", F.col("_cs")[0].alias("_t"))
    twins = plan.where("size(_cs) > 1")
    if twins.limit(1).count():
        turn = Window.partitionBy("_k2", "_s2", "_z2").orderBy("_z2")
        several = met(twins).withColumn("_i", F.row_number().over(turn)).select("row", F.coalesce(F.get("_cs", F.col("_i") - 1), F.lit(0)).alias("_t"))
        out = out.unionByName(several.where("_t > 0"))
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("_t").cast("int")))).select("row.*")


def op6_mixing(spark, sf_dir):
    """The mix of all ``documents``: one row a row; null and empty texts have size 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), per0 AS (
  SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), per1 AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS source_rank FROM per0
), per2 AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][source_rank % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM per1
), per3 AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
    sum(weight) OVER (ORDER BY cap / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    sum(source_size) OVER ()::DOUBLE AS total FROM per2
), per4 AS (
  SELECT *, (total * 1.5::DOUBLE - bef) / rest AS lvl FROM per3
), per5 AS (
  SELECT *, first_value(CASE WHEN lvl * weight <= cap THEN lvl END) OVER (ORDER BY CASE WHEN lvl * weight <= cap THEN 0 ELSE 1 END, bef, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM per4
), per AS (
  SELECT source, source_size, coalesce(least(cap, fin * weight), cap) AS target FROM per5
), ranked AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id) - 1 AS r,
    ('0x' || substr(md5('mix-1|' || coalesce('s' || s.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
    CASE WHEN p.source_size > 0 THEN least(p.target / p.source_size, 2.0::DOUBLE) ELSE 0 END AS rate
  FROM sizes s JOIN per p ON s.source IS NOT DISTINCT FROM p.source
), done AS (
  SELECT *, (floor(u + rate * (r::DOUBLE + 1)) - floor(u + rate * r::DOUBLE))::BIGINT AS copies FROM ranked
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM done
"""
