"""Nearest neighbours by counting collisions in sorted one-dimensional projections.

All rows are dealt to index blocks.  A block keeps, for each of ``PROJECTIONS`` random
directions, its vectors sorted by their projection.  A query's windows are centred on its own
projections; virtual rehashing widens all of them by a common factor until enough vectors
(a share of the block) lie inside at least ``threshold`` of the windows.  Exactly those are
verified by inner product in double precision, and the best of all blocks are merged.

The largest inner product becomes the least distance by one more coordinate, which lifts all
vectors to the length of the longest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROJECTIONS = 128
BLOCK = 8192
QUERY_BLOCK = 4096
SHARE = 0.3  # of a block, what is verified at least
LEAST = 200  # vectors of a block verified at least
THRESHOLD = 0.5  # of all windows, in how many a vector must lie
WIDEN = 1.2
SEED = 97


def usable(v: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


class Block:
    """Sorted projections of the vectors of one block, and the windows of a batch of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, longest: float, o: dict):
        self.ids, self.vectors, self.o = ids, vectors, o
        n, m = len(ids), o["projections"]
        self.need = max(o["least"], math.ceil(o["share"] * n))
        self.threshold = math.ceil(o["threshold"] * m)
        lift = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", vectors, vectors), 0))
        directions = np.random.default_rng(o["seed"]).standard_normal((vectors.shape[1] + 1, m))
        spread = np.hstack([vectors, lift[:, None]]) @ directions
        order = np.argsort(spread, axis=0, kind="stable")
        self.sorted = np.take_along_axis(spread, order, axis=0).T.copy()
        places = np.empty_like(order)
        np.put_along_axis(places, order, np.arange(n)[:, None], axis=0)
        self.places = places.T.astype(np.uint16).copy()  # where each vector stands in each projection
        length = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        self.centres = (queries * (longest / length)[:, None]) @ directions[:-1]
        self.unit = float(np.median(spread.std(axis=0))) or 1.0
        self._windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.start = 0
        if self.need < n:  # rehashing starts near the radius that the first queries end at
            ends = [self._radius(q) for q in range(min(8, len(queries)))]
            self.start = int(np.median(ends)) - 1

    def windows(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """First place and size of the window of each query in each projection."""
        if radius not in self._windows:
            half = self.unit * 0.5 * self.o["widen"] ** radius
            low = np.stack([np.searchsorted(s, c - half, "left") for s, c in zip(self.sorted, self.centres.T, strict=True)], axis=1)
            high = np.stack([np.searchsorted(s, c + half, "right") for s, c in zip(self.sorted, self.centres.T, strict=True)], axis=1)
            self._windows[radius] = low.astype(np.uint16), (high - low).astype(np.uint16)
        return self._windows[radius]

    def _inside(self, query: int, radius: int) -> np.ndarray:
        """Vectors that collide with the query in enough windows."""
        low, size = (x[query][:, None] for x in self.windows(radius))
        hits = np.zeros(len(self.ids), np.uint16)
        for a in range(0, len(self.places), 16):
            hits += ((self.places[a : a + 16] - low[a : a + 16]) < size[a : a + 16]).view(np.uint8).sum(axis=0, dtype=np.uint8)
        return np.flatnonzero(hits >= self.threshold)

    def _radius(self, query: int) -> int:
        radius = 0
        while len(self._inside(query, radius)) < self.need:
            radius += 1
        return radius

    def candidates(self, query: int) -> np.ndarray:
        """The vectors inside at the first radius where there are enough of them."""
        if self.need >= len(self.ids):
            return np.arange(len(self.ids))
        radius = self.start
        while True:
            found = self._inside(query, radius)
            if len(found) >= self.need:
                return found
            radius += 1


def _search(k: int, o: dict):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def dense(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("vec_id").to_numpy()
        v = t.column("v").combine_chunks()
        return ids, np.asarray(v.flatten(), np.float64).reshape(len(ids), -1)

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        peak, longest = rows.column("peak")[0].as_py(), rows.column("longest")[0].as_py()
        ids, x = dense(rows)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        asked, vectors = dense(queries)
        # windows and screening see vectors with components up to 1, so that none is too large for them
        small, small_vectors = x / peak, vectors / peak
        block = Block(ids, small, small_vectors, longest, o)
        single = small.astype(np.float32)
        out = [[], [], []]
        for i, (q, v) in enumerate(zip(asked, vectors, strict=True)):
            at = block.candidates(i)
            at = at[ids[at] != q]
            if len(at) > k:
                # single precision tells which can't be among the best; its error is bounded
                w = small_vectors[i]
                rough = single[at] @ w.astype(np.float32)
                bound = np.partition(rough, len(at) - k)[len(at) - k]
                at = at[rough >= bound - 1e-4 * longest * math.sqrt(w @ w)]
            score = x[at] @ v
            best = np.lexsort((ids[at], -score))[:k]
            out[0].append(np.full(len(best), q))
            out[1].append(ids[at][best])
            out[2].append(score[best])
        return pa.table([np.concatenate(c) for c in out], schema=schema)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK, projections: int = PROJECTIONS, share: float = SHARE, least: int = LEAST, threshold: float = THRESHOLD, widen: float = WIDEN, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, ties to smaller ids.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids.
    A query meets the vectors of its own length; every length is searched by itself, and vectors may be of any finite
    size.  Rows with the query's id are not its candidates; a query id that repeats counts once for each length
    (its least vector).  Fewer candidates than ``k``: all; empty tables: no rows.
    """
    if block > 1 << 15:
        raise ValueError("a block's places must fit 16 bits")
    v = F.col(vector).cast("array<double>")
    take = lambda df: df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("d", F.size("v"))
    rows, queries = take(rows), take(queries).groupBy("vec_id", "d").agg(F.min("v").alias("v"))
    # one row a length: the largest component, then the largest norm of vectors divided by it
    peaks = rows.groupBy("d").agg(F.max(F.array_max(F.transform("v", F.abs))).alias("peak"), F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("peak")) * (x / F.col("peak"))))
    longest = rows.join(peaks, "d").groupBy("d").agg(F.max(norm).alias("longest"))
    counts = queries.groupBy("d").agg(F.count(F.lit(1)).alias("m"))
    sizes = peaks.join(longest, "d").join(counts, "d")
    sizes = sizes.select("d", "peak", "longest", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("m") / query_block).cast("int").alias("asked"))
    deal = lambda count, *of: F.pmod(F.xxhash64(*of), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    # equal ids would meet in one block; the vector takes part in the hash of rows
    rows = rows.join(sizes, "d").withColumn("b", deal("blocks", "vec_id", "v")).withColumn("q", every("asked")).select("d", "b", "q", "vec_id", "v", "peak", "longest")
    queries = queries.join(sizes, "d").withColumn("q", deal("asked", "vec_id", F.lit(5))).withColumn("b", every("blocks")).select("d", "b", "q", "vec_id", "v")
    options = {"projections": projections, "share": share, "least": least, "threshold": threshold, "widen": widen, "seed": seed}
    found = rows.groupBy("d", "b", "q").cogroup(queries.groupBy("d", "b", "q")).applyInArrow(_search(k, options), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
