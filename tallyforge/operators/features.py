"""Time-series features, groups, ranks and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .ranks import average_ranks


def fixed_grid(df: DataFrame, series: str, at: str, value: str, first: int, last: int) -> DataFrame:
    """(series, at, value, filled): each series on every integer of [first, last].

    A series needs both end points and no position twice, else it has no rows here; gaps inside
    are filled linearly between their neighbours.  Non-finite values count as missing.
    """
    good = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    inside = df.where(good & F.col(at).between(first, last)).select(F.col(series).alias("s"), F.col(at).cast("int").alias("t"), F.col(value).cast("double").alias("v"))
    whole = inside.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("d"), F.min("t").alias("lo"), F.max("t").alias("hi")).where((F.col("n") == F.col("d")) & (F.col("lo") == first) & (F.col("hi") == last)).select("s")
    after = Window.partitionBy("s").orderBy("t")
    steps = inside.join(whole, "s", "left_semi").withColumns({"t2": F.lead("t").over(after), "v2": F.lead("v").over(after)})
    # each point brings the gap behind it: no grid has to be joined
    full = steps.withColumn("g", F.explode(F.sequence("t", F.coalesce(F.col("t2") - 1, F.col("t")))))
    part = (F.col("g") - F.col("t")) / (F.col("t2") - F.col("t"))
    filled = F.col("g") > F.col("t")
    return full.select(F.col("s").alias(series), F.col("g").alias(at), F.when(filled, F.col("v") + part * (F.col("v2") - F.col("v"))).otherwise(F.col("v")).alias(value), filled.alias("filled"))


def seven_numbers(df: DataFrame, series: str, at: str, value: str) -> DataFrame:
    """Per series: first, last, mean, greatest, least, slope, log10 of the variance of steps."""
    w = Window.partitionBy(series).orderBy(at)
    steps = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    return steps.groupBy(series).agg(
        F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.avg(value).alias("mean"), F.max(value).alias("greatest"), F.min(value).alias("least"),
        F.coalesce(F.regr_slope(F.col(value).cast("double"), F.col(at).cast("double")), F.lit(0.0)).alias("slope"), F.log10(F.coalesce(F.var_pop("_d"), F.lit(0.0)) + 1e-12).alias("roughness"),
    )


def half_slopes(df: DataFrame, series: str, at: str, value: str) -> DataFrame:
    """(series, n, last, head_slope, tail_slope): slopes of the first and the second half of the points."""
    w = Window.partitionBy(series)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(at)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    head = F.col("_r") < F.floor(F.col("_n") / 2)
    slope = lambda on: F.coalesce(F.regr_slope(F.when(on, F.col(value).cast("double")), F.when(on, F.col(at).cast("double"))), F.lit(0.0))
    return ranked.groupBy(series).agg(F.count(F.lit(1)).alias("n"), F.max_by(value, at).alias("last"), slope(head).alias("head_slope"), slope(~head).alias("tail_slope"))


def local_peaks(df: DataFrame, series: str, at: str, value: str, threshold: float) -> DataFrame:
    """(series, interior, peaks): strictly above the left neighbour, not below the right one."""
    w = Window.partitionBy(series).orderBy(at)
    near = df.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)}).where("_a is not null and _b is not null")
    return near.groupBy(series).agg(F.count(F.lit(1)).alias("interior"), F.count_if((F.col(value) > F.col("_a")) & (F.col(value) >= F.col("_b")) & (F.col(value) > threshold)).alias("peaks"))


def element_summary(df: DataFrame, key: str, vector: str, thresholds: tuple = (0.05, 0.1, 0.2), quantiles: tuple = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Per key over all elements of its vectors: mean, deviation, greatest, exceedances, exact quantiles.

    Vectors may be many for one key: sums are taken before the shuffle and quantiles from sorted ranges.
    """
    x = df.select(key, F.explode(F.col(vector).cast("array<double>")).alias("x"))
    names = [F.count_if(F.col("x") > t).alias(f"above_{i}") for i, t in enumerate(thresholds)]
    out = x.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"), F.max("x").alias("greatest"), *names)
    cuts = ranks.quantiles(x, [key], "x", quantiles).select(F.col(key).alias("_k"), "q")
    met = out.join(cuts, F.col(key).eqNullSafe(F.col("_k")), "left")
    return met.select(*out.columns, *[F.col("q")[i].alias(f"q{int(q * 100):02d}") for i, q in enumerate(quantiles)])


def spearman(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, n, rho): rank correlation with mean ranks; null without spread."""
    ranked = average_ranks(average_ranks(df, [group], a, "_ra"), [group], b, "_rb")
    return ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("rho"))


def worst_rows(df: DataFrame, group: list[str], error: str, position: str, k: int = 5) -> DataFrame:
    """The ``k`` rows of greatest error of each group, ties to the smaller position, with ``rank``."""
    w = Window.partitionBy(*group).orderBy(F.desc(error), position)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def groups_of_at_least(df: DataFrame, key: list[str], n: int) -> DataFrame:
    big = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(*key)
    return df.join(big, key, "left_semi")


def groups_with_several(df: DataFrame, key: list[str], value: str, n: int = 2) -> DataFrame:
    """Rows of groups in which ``value`` takes ``n`` values at least."""
    many = df.groupBy(*key).agg(F.countDistinct(value).alias("_n")).where(F.col("_n") >= n).select(*key)
    return df.join(many, key, "left_semi")


def ranking_pairs(df: DataFrame, group: str, position: str, life: str, lower: str) -> DataFrame:
    """Pairs of a group in order of position, with the winner where it is certain.

    A row has an exact ``life`` or a ``lower`` bound of a censored one.  Exact against exact: the
    longer life wins (equal lives: no winner).  Exact against censored: the censored one wins if
    its bound is strictly above; otherwise, and for two censored ones, nothing is resolved.
    """
    side = lambda p: df.select(F.col(group).alias("g"), F.col(position).alias(f"{p}pos"), F.col(life).alias(f"{p}life"), F.col(lower).alias(f"{p}low"))
    met = side("l").join(side("r"), "g").where("lpos < rpos")
    l, r, ll, rl = (F.col(c) for c in ("llife", "rlife", "llow", "rlow"))
    kind = F.when(l.isNotNull() & r.isNotNull(), F.when(l == r, "tied").otherwise("exact")).when(l.isNotNull() & (rl > l), "censor_resolved").when(r.isNotNull() & (ll > r), "censor_resolved").otherwise("unresolvable")
    winner = F.when(kind == "exact", F.when(l > r, F.col("lpos")).otherwise(F.col("rpos"))).when((kind == "censor_resolved") & l.isNotNull(), F.col("rpos")).when(kind == "censor_resolved", F.col("lpos"))
    return met.select(F.col("g").alias(group), "lpos", "rpos", kind.alias("kind"), winner.alias("winner"))


def pair_correct(pairs: DataFrame, scores: DataFrame, position: str, score: str) -> DataFrame:
    """Resolved pairs with ``correct``: 1 if the winner scores higher, 0.5 on a tie, else 0."""
    l = scores.select(F.col(position).alias("lpos"), F.col(score).alias("ls"))
    r = scores.select(F.col(position).alias("rpos"), F.col(score).alias("rs"))
    met = pairs.where("winner is not null").join(l, "lpos").join(r, "rpos")
    ahead = F.when(F.col("ls") == F.col("rs"), 0.5).when((F.col("ls") > F.col("rs")) == (F.col("winner") == F.col("lpos")), 1.0).otherwise(0.0)
    return met.withColumn("correct", ahead)


def macro_weights(df: DataFrame, group: str, eligible: Column) -> DataFrame:
    """``df`` with weight 1 / eligible rows of the group, 0 for rows that aren't eligible.

    Groups are counted before they are joined back, so a hot one stays spread over its tasks.
    """
    counts = df.groupBy(F.col(group).alias("_mg")).agg(F.count_if(eligible).alias("_mn"))
    met = df.join(counts, F.col(group).eqNullSafe(F.col("_mg")))
    return met.withColumn("macro_weight", F.when(eligible, 1 / F.col("_mn")).otherwise(F.lit(0.0))).drop("_mg", "_mn")


def macro_mae(df: DataFrame, group: str, error: str) -> DataFrame:
    """One row: the mean of the groups' mean absolute errors."""
    return df.groupBy(group).agg(F.avg(F.abs(F.col(error))).alias("m")).agg(F.count(F.lit(1)).alias("groups"), F.avg("m").alias("macro_mae"))


def continued_positions(df: DataFrame, key: str, part: str, position: str) -> DataFrame:
    """``df`` with ``merged``: positions running on where a later part starts again.  A part is
    shifted by the greatest merged position before it if it doesn't start above that."""
    spans = df.groupBy(key, part).agg(F.min(position).alias("lo"), F.max(position).alias("hi"))
    start = F.struct(F.lit(0).cast("long").alias("top"), F.array().cast("array<struct<part:bigint,shift:bigint>>").alias("out"))

    def step(acc, s):
        shift = F.when(s["lo"] > acc["top"], F.lit(0).cast("long")).otherwise(acc["top"])
        return F.struct(F.greatest(acc["top"], (s["hi"] + shift).cast("long")).alias("top"), F.concat(acc["out"], F.array(F.struct(s["part"].cast("long").alias("part"), shift.alias("shift")))).alias("out"))

    listed = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(part).alias("part"), "lo", "hi"))).alias("s"))
    shifts = listed.select(key, F.inline(F.aggregate("s", start, step)["out"])).withColumnRenamed("part", part)
    return df.join(shifts, [key, part]).withColumn("merged", F.col(position) + F.col("shift")).drop("shift")


def counterbalanced_design(spark, conditions: int = 16, replicates: int = 3, sessions: int = 3, operators: int = 2, lots: int = 4) -> DataFrame:
    """Conditions x replicates with session, operator and lot dealt by a Latin rectangle, and the
    order within each session by a seeded hash."""
    rows = spark.range(conditions * replicates).select(F.floor(F.col("id") / replicates).alias("condition"), (F.col("id") % replicates).alias("replicate"))
    rows = rows.withColumns({
        "session": (F.col("condition") + F.col("replicate")) % sessions,
        "operator": (F.col("condition") + F.floor(F.col("condition") / operators) + F.col("replicate")) % operators,
        "lot": (F.col("condition") + F.col("replicate") * (lots - 1)) % lots,
    })
    w = Window.partitionBy("session").orderBy(F.md5(F.concat_ws("|", F.col("condition").cast("string"), F.col("replicate").cast("string"))))
    return rows.withColumn("run_order", F.row_number().over(w))
