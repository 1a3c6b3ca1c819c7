"""Closure and cycles of edge tables, by joins that end when nothing new is found.

Each step is a written table in the shared folder, so lineage stays short and a lost executor
repeats one step at most.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shared(df: DataFrame):
    """Sets the context's folder, if it isn't set, and returns it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="tallyforge-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back."""
    _shared(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table by columns in the shared folder: for wide tables that many queries read, each of them a few columns.

    Its size is known to the planner, so small tables are broadcast.  What was shuffled to make it is removed as soon as it is written.
    """
    path = f"{_shared(df).rstrip('/')}/stored-{uuid.uuid4().hex}"
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def expand_edges(rows: DataFrame, sources: str, targets: str) -> DataFrame:
    """(src, dst) of every source with every target of a row's lists."""
    return rows.select(F.explode(sources).alias("src"), F.col(targets).alias("_t")).select("src", F.explode("_t").alias("dst")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) of all pairs with a path; a node reaches itself only on a cycle.

    Paths double in each round (known pairs joined with known pairs), so a chain of length n
    takes log2(n) rounds.
    """
    known = fresh = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    while True:
        a, b = known.select("src", F.col("dst").alias("mid")), fresh.select(F.col("src").alias("mid"), "dst")
        c, d = fresh.select("src", F.col("dst").alias("mid")), known.select(F.col("src").alias("mid"), "dst")
        made = a.join(b, "mid").select("src", "dst")
        if fresh is not known:
            made = made.union(c.join(d, "mid").select("src", "dst"))
        fresh = written(made.distinct().join(known, ["src", "dst"], "left_anti"))
        if not fresh.limit(1).count():
            return known
        known = written(known.union(fresh))


def least_below(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(node, least): the least value that stands at a node or at what it leads to.

    ``values`` (node, value) may name a node several times; null nodes and values count for nothing, and a node without any
    value below it has no row.  The state is one row a node.  In each round a node takes the least value of the nodes
    it leads to, and an edge to a node with one edge of its own jumps over it, so a chain of n nodes takes about log2(n) rounds
    (a chain of branching nodes one round a node).  It ends with the first round that changes no value; cycles are no matter.
    """
    edges = written(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    state = written(values.where("node is not null and value is not null").groupBy("node").agg(F.min("value").alias("least")))
    while True:
        out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.max("dst").alias("next"))
        nodes = out.join(state, "node", "full").withColumnRenamed("node", "dst")
        met = written(edges.join(nodes, "dst", "left"))
        gained = met.where("least is not null").groupBy(F.col("src").alias("node")).agg(F.min("least").alias("gain"))
        state = state.join(gained, "node", "full").select("node", F.least("least", "gain").alias("least"), F.coalesce(F.col("gain") < F.col("least"), F.col("gain").isNotNull()).alias("fresh"))
        state = written(state)
        if not state.where("fresh").limit(1).count():
            return state.select("node", "least")
        state = state.drop("fresh")
        edges = written(met.where("n is not null").select("src", F.when(F.col("n") == 1, F.col("next")).otherwise(F.col("dst")).alias("dst")).where("src <> dst").distinct())


def cyclic_residue(edges: DataFrame) -> DataFrame:
    """(node) left when nodes without incoming edges are peeled off: cycles and what follows them."""
    left = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    n = left.count()
    while n:
        # an edge stays as long as something still leads to its source
        kept = written(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        m = kept.count()
        left = kept
        if m == n:
            break
        n = m
    return left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()


def several_producers(edges: DataFrame) -> DataFrame:
    """(dst, n) of products with more than one producer."""
    return edges.distinct().groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
