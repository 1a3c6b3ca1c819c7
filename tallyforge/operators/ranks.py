"""Running sums, ranks and pair counts in groups of any size, without one task per group.

``running_sums`` sorts by ranges of (group, order), sums each range by itself and adds what lies before the range.
A range boundary cuts one group at most, so the offsets are at most two rows a range: the
one thing that is broadcast, with a bound set by the number of ranges.  Everything else builds on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

#: Points of a group that one task counts in memory.
BLOCK = 8192


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str], descending: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a column for each of ``sums`` (name: summed column): the sum over the rows of the group that
    come before in ``order``.

    Rows of a group with equal order are told apart arbitrarily: aggregate them first where that matters.
    Nulls come first in rising columns and last in ``descending`` ones; a null is a group of its own.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.desc(c) if c in descending else F.asc(c) for c in order]
    parts = written(df.repartitionByRange(ranges, *map(F.asc, group), *keys).withColumn("_range", F.spark_partition_id()))
    totals = parts.groupBy("_range", *group).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    cut = totals.withColumn("_cut", F.count(F.lit(1)).over(whole)).where("_cut > 1")
    cut = cut.select("_range", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)], *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_range", *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    met = local.join(F.broadcast(cut.withColumnRenamed("_range", "_at")), (F.col("_range") == F.col("_at")) & _all_same(group), "left")
    return met.select(*df.columns, *[(F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in sums])


def _all_same(group: list[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(group):
        out = out & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return out


def average_ranks(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ranks from 1, ties sharing their mean rank; null values rank first.

    Equal values are counted before they are ranked, so neither a hot group nor a hot value lands in one task.
    """
    sizes = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_m"))
    ranked = running_sums(sizes, group, [value], {"_before": "_m"}).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate([*group, value])], (F.col("_before") + (F.col("_m") + 1) / 2).alias(name)
    )
    keys = [*group, value]
    return df.join(ranked, _all_same(keys)).select(*df.columns, name)


def quantiles(df: DataFrame, group: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """(group, n, q): the exact quantiles of each group, interpolated between neighbours; nulls don't count.

    No task holds a group: equal values are counted, and of the counts in order only the one or two that a quantile
    falls on are kept.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_m"))
    run = running_sums(sizes, group, [value], {"_before": "_m"})
    totals = sizes.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)]).agg(F.sum("_m").alias("_n"))
    met = run.join(totals, _all_same(group))
    end, place = F.col("_before") + F.col("_m"), [F.lit(float(q)) * (F.col("_n") - 1) for q in at]
    holds = lambda p: F.max(F.when((F.col("_before") <= p) & (p < end), F.col(value)))
    ends = [c for i, p in enumerate(place) for c in (holds(F.floor(p)).alias(f"_lo{i}"), holds(F.ceil(p)).alias(f"_hi{i}"))]
    found = met.groupBy(*group).agg(F.max("_n").alias("_n"), *ends)
    between = lambda i, p: F.when(F.floor(p) == F.ceil(p), F.col(f"_lo{i}")).otherwise((F.ceil(p) - p) * F.col(f"_lo{i}") + (p - F.floor(p)) * F.col(f"_hi{i}"))
    return found.select(*group, F.col("_n").alias("n"), F.array(*[between(i, p) for i, p in enumerate(place)]).alias("q"))


# --- pairs, counted without being formed


def _levels(n: int) -> int:
    return max(n - 1, 0).bit_length()


def dominated(score: np.ndarray, weight: np.ndarray, run: np.ndarray | None = None) -> np.ndarray:
    """For every place the weight of those before it with a strictly lower score, in its own run if places have rising
    numbers of ``run``: halves are merged level by level, all of a level and of all runs at once."""
    n = len(score)
    out = np.zeros(n, np.int64)
    rank = np.unique(score, return_inverse=True)[1].astype(np.int64)
    run = np.zeros(n, np.int64) if run is None else run
    place = np.arange(n) - np.searchsorted(run, run)
    levels = _levels(int(place.max(initial=0)) + 1)
    at = (run << levels) + place  # no node holds places of two runs
    for level in range(levels):
        node, right = at >> (level + 1), (at >> level) & 1
        order = np.lexsort((1 - right, rank, node))  # of equal scores the right half first: they don't count
        left = np.where(right[order] == 0, weight[order], 0)
        sums = np.cumsum(left) - left
        first = np.r_[True, node[order][1:] != node[order][:-1]]
        base = np.maximum.accumulate(np.where(first, sums, 0))
        mine = right[order] == 1
        out[order[mine]] += (sums - base)[mine]
    return out


def _lower_before(points: DataFrame) -> DataFrame:
    """(g, exact, censored) of points (g, place, score, exact, censored), place from 0 in each group: sums over all
    points of exact points before them with a lower score, by exact and censored ones.

    Blocks of a group are counted in memory, those of many small groups at once.  Of two blocks the later one lies right of the other in exactly one node of
    the binary tree over blocks, so each node's right half meets its left half once, in order of score.
    """
    blocks = points.withColumn("block", F.floor(F.col("place") / BLOCK))
    schema = "g string, exact decimal(38,0), censored decimal(38,0)"

    def sums(table, starts):
        column = lambda c: table.column(c).to_numpy()
        run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(table)]))
        lower = dominated(column("score"), column("exact"), run)
        out = {"g": table.column("g").take(pa.array(starts))}
        for c in ("exact", "censored"):
            weight = column(c)
            if float(lower.max()) * float(weight.max()) * BLOCK >= 2.0**62:
                lower, weight = lower.astype(object), weight.astype(object)
            out[c] = pa.array(np.add.reduceat(lower * weight, starts).tolist(), pa.int64() if lower.dtype != object else pa.decimal128(38, 0)).cast(pa.decimal128(38, 0), safe=False)
        return pa.table(out)

    def count(batches):
        # runs of one (g, block), many in a batch; the last one may go on in the next batch
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
            if not len(table):
                continue
            g, block = table.column("g"), table.column("block").to_numpy()
            new = pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)).to_numpy() | (block[1:] != block[:-1])
            starts = np.r_[0, np.flatnonzero(new) + 1]
            rest = table.slice(starts[-1])
            if len(starts) > 1:
                yield from sums(table.slice(0, starts[-1]), starts[:-1]).to_batches()
        if rest is not None:
            yield from sums(rest.combine_chunks(), np.array([0])).to_batches()

    sorted_runs = blocks.select("g", "block", "place", F.col("score").cast("double").alias("score"), "exact", "censored").repartition("g", "block").sortWithinPartitions("g", "block", "place")
    inside = sorted_runs.mapInArrow(count, schema)
    sizes = blocks.groupBy("g").agg(F.max("block").alias("last")).where("last > 0")
    level = F.explode(F.sequence(F.lit(0), F.ceil(F.log2(F.col("last") + 1)).cast("int") - 1))
    split = blocks.join(sizes, "g").withColumn("level", level)
    split = split.withColumn("node", F.expr("shiftright(block, level + 1)")).withColumn("right", F.expr("shiftright(block, level) % 2 = 1"))
    side = lambda right, c: F.sum(F.when(F.col("right") == right, F.col(c)).otherwise(0))
    halves = split.groupBy("g", "level", "node", "score").agg(side(False, "exact").alias("low"), side(True, "exact").alias("exact"), side(True, "censored").alias("censored"))
    run = running_sums(halves, ["g", "level", "node"], ["score"], {"before": "low"})
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)") * F.col("before").cast("decimal(18,0)")).cast("decimal(38,0)").alias(c)
    across = run.groupBy("g").agg(wide("exact"), wide("censored"))
    return inside.unionByName(across).groupBy("g").agg(F.sum("exact").alias("exact"), F.sum("censored").alias("censored"))


def pair_counts(df: DataFrame, group: list[str], life: str, lower: str, score: str | None = None) -> DataFrame:
    """(group, kind, n [, correct]): the pairs of each group by kind, without forming one of them.

    A row has an exact ``life`` or, where that is null, a ``lower`` bound.  Two exact lives are ``exact``, or ``tied`` if equal; an exact one and a
    bound strictly above it are ``censor_resolved``; all others are ``unresolvable``.  With ``score``, ``correct`` sums 1 for a resolved
    pair whose winner (the longer life, or the bound) scores higher and 0.5 for equal scores; a null score is never right.
    Kinds without pairs have no row; groups may be of any size.
    """
    names = [F.col(c).alias(f"_k{i}") for i, c in enumerate(group)]
    exact = F.col(life).isNotNull()
    rows = df.select(F.to_json(F.struct(*names)).alias("g"), *names, F.coalesce(life, lower).alias("x"), exact.alias("_e"), (~exact & F.col(lower).isNotNull()).alias("_c"), *([F.col(score).alias("score")] if score else []))
    labels = rows.groupBy("g").agg(*[F.first(f"_k{i}").alias(f"_k{i}") for i in range(len(group))], F.count(F.lit(1)).alias("n"), F.count_if("_e").alias("e"))
    held = rows.where("x is not null")
    by_life = held.groupBy("g", "x").agg(F.count_if("_e").alias("exact"), F.count_if("_c").alias("censored"))
    run = running_sums(by_life, ["g"], ["x"], {"before": "exact"})
    big = lambda c: c.cast("decimal(38,0)")
    two = lambda n: big(F.col(n)) * (big(F.col(n)) - 1) / 2
    sums = run.groupBy("g").agg(F.sum(two("exact")).alias("tied"), F.sum(big(F.col("censored")) * F.col("before")).alias("resolved"))
    met = labels.join(sums, "g", "left").fillna(0, ["tied", "resolved"])
    n = {"exact": two("e") - F.col("tied"), "tied": F.col("tied"), "censor_resolved": F.col("resolved"), "unresolvable": two("n") - two("e") - F.col("resolved")}
    named = [F.col(f"_k{i}").alias(c) for i, c in enumerate(group)]
    if score is None:
        kinds = [F.struct(F.lit(k).alias("kind"), c.cast("long").alias("n")) for k, c in n.items()]
        return met.select(*named, F.inline(F.array(*kinds))).where("n > 0")
    scored = held.where("score is not null").groupBy("g", "x", "score").agg(F.count_if("_e").alias("exact"), F.count_if("_c").alias("censored"))
    # of equal lives the higher score comes first, so that none of them is before a higher one
    placed = running_sums(scored.withColumn("one", F.lit(1)), ["g"], ["x", "score"], {"place": "one"}, descending=("score",))
    above = _lower_before(placed).select("g", F.col("exact").alias("above_exact"), F.col("censored").alias("above_censored"))
    level = running_sums(scored, ["g", "score"], ["x"], {"before": "exact"}).groupBy("g")
    level = level.agg(F.sum(big(F.col("exact")) * F.col("before")).alias("even_exact"), F.sum(big(F.col("censored")) * F.col("before")).alias("even_censored"))
    met = met.join(above, "g", "left").join(level, "g", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    right = {"exact": zero("above_exact") + zero("even_exact") / 2, "censor_resolved": zero("above_censored") + zero("even_censored") / 2}
    kinds = [F.struct(F.lit(k).alias("kind"), c.cast("long").alias("n"), right.get(k, F.lit(None).cast("double")).alias("correct")) for k, c in n.items()]
    return met.select(*named, F.inline(F.array(*kinds))).where("n > 0")
