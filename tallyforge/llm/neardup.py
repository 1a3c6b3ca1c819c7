"""Near-duplicates by one-permutation MinHash, banded buckets and star-shaped candidates.

A document's set of word shingles is hashed once; the hashes are dealt to ``BINS`` bins by
their leading bits and each bin keeps its least.  An empty bin takes the value of the first
filled bin in its own random order of bins (optimal densification).  ``BANDS`` groups of
``ROWS`` bins give a document's buckets.

Documents with equal sets are one node from the start, so groups of copies cost nothing
later.  In each bucket the node that shares most buckets with others is the centre of a star
(a group's original rather than one of its variants); only centre-member pairs are candidates,
confirmed on full sets.  Where the confirmed links leave a bucket with more than one
component, its other nodes take their turn as centres (a few first, then in growing steps; the
order is a hash, so no bucket is ever sorted), for pairs of different components only, until
every bucket is one component or all its nodes had their turn: no link that shares a bucket is
lost.  Bitmaps of the sets bound how far two sets differ at least, which rules out nearly all
of these pairs inside the join, exactly.  Later links join components, not nodes, so earlier
links are not read again.

A pair at exactly 0.80 shares no bucket, and is missed, with a probability of about 6.5e-5
(0.81: 3e-5); nothing finds it later unless others link both.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordBatch, arrow_batches, brief, mix, stash

BINS = 256
ROWS = 8
BANDS = 64
THRESHOLD = 80  # of 100
CELLS = 2048
STEP = 32  # how much faster centres are added from round to round
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_ORDER = np.stack([np.random.default_rng(1000 + j).permutation(BINS) for j in range(BINS)])
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - (BINS - 1).bit_length())
#: Each bin stands in as many bands as it takes to fill all of them.
_PICK = np.concatenate([np.random.default_rng(500 + i).permutation(BINS) for i in range(-(-BANDS * ROWS // BINS))])[: BANDS * ROWS].reshape(BANDS, ROWS)


def shingle_sets(batch: WordBatch, words: int) -> list[np.ndarray]:
    """For each row its sorted distinct shingle hashes; with fewer words than a shingle, the
    whole sequence as one; none without words."""
    h = batch.hashes(lower=True)
    n = len(h) - words + 1
    roll = np.zeros(max(n, 0), np.uint64)
    for j in range(words):
        roll = roll * _PAIR + h[j : j + len(roll)]
    roll = mix(roll)
    out = []
    for i in range(batch.rows):
        a, b = batch.first[i], batch.first[i + 1]
        if b - a >= words:
            out.append(np.unique(roll[a : b - words + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for v in h[a:b]:
                x = x * _PAIR + v
            out.append(mix(x ^ _PAIR))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """One value per bin of a sorted, not empty set."""
    at = np.searchsorted(s, _EDGES)
    upper = np.append(at[1:], len(s))
    full = upper > at
    value = s[np.minimum(at, len(s) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        tried = full[_ORDER[empty, :16]]
        donor = _ORDER[empty, np.argmax(tried, axis=1)]
        late = np.flatnonzero(~tried.any(axis=1))
        if len(late):
            rest = _ORDER[empty[late]]
            donor[late] = rest[np.arange(len(late)), np.argmax(full[rest], axis=1)]
        value[empty] = value[donor]
    return value


def bands(sig: np.ndarray) -> np.ndarray:
    parts = sig[_PICK]
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = mix(out * _PAIR + parts[:, j])
    return out


def cells(s: np.ndarray) -> np.ndarray:
    """A bitmap of the cells that a set's members fall into.  Two sets differ in as many
    members at least as their bitmaps differ in bits."""
    seen = np.zeros(CELLS, bool)
    seen[(s & np.uint64(CELLS - 1)).astype(np.int64)] = True
    return np.packbits(seen).view(np.int64)


def _node(s: np.ndarray) -> int:
    """A hash of a whole sorted set."""
    with np.errstate(over="ignore"):
        x = (mix(s + np.uint64(len(s))) * mix(np.arange(1, len(s) + 1, dtype=np.uint64) | np.uint64(1))).sum(dtype=np.uint64)
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, node, bands) of docs (doc_id, text); node is null without words."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, node, band = [], [], []
            for s in shingle_sets(WordBatch(batch.column(1)), words):
                n.append(len(s))
                node.append(_node(s) if len(s) else None)
                band.append(bands(signature(s)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "bands"])

    return docs.mapInArrow(run, f"doc_id {kind}, n long, node long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, set, cells) of docs (doc_id, text): the whole set as bytes, and its bitmap."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [s for s in shingle_sets(WordBatch(batch.column(1)), words) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([cells(s) for s in sets], pa.list_(pa.int64()))], names=["node", "set", "cells"])

    return docs.mapInArrow(run, "node long, set binary, cells array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= threshold * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "a long, b long")


def components(links: DataFrame, name: str = "components") -> tuple[DataFrame, int]:
    """(node, comp) of all nodes in links (a, b), and their number; comp is one of the
    component's nodes, and stands in the table with itself.

    Each pass names every node after the least of its neighbourhood, in an order drawn anew
    by hash, and then goes on with the links between names only: they shrink by a factor from
    pass to pass, so all passes together read the links a few times, however long the chains.
    Every pass is a written table, and only counts come back.
    """
    edges = stash(links.select("a", "b").where("a <> b"), name + "-links")
    count, passes = edges.count(), []
    while count:
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(passes))).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        names = stash(both.groupBy("a").agg(F.min(rank("b")).alias("least")).select(F.col("a").alias("node"), F.least("least", rank("a"))["x"].alias("comp")), name)
        passes.append(names)
        few = brief(names, 2 * count)
        left = edges.join(few, F.col("a") == F.col("node")).select(F.col("comp").alias("a"), "b")
        left = left.join(few, F.col("b") == F.col("node")).select("a", F.col("comp").alias("b")).where("a <> b")
        edges = stash(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name + "-links")
        count = edges.count()
    if not passes:
        return edges.selectExpr("a AS node", "b AS comp"), 0
    done = passes.pop()
    for names in reversed(passes):
        later = done.select(F.col("node").alias("comp"), F.col("comp").alias("last"))
        done = names.join(later, "comp", "left").select("node", F.coalesce("last", "comp").alias("comp"))
    done = stash(done.unionByName(done.select(F.col("comp").alias("node"), "comp")).distinct(), name)
    return done, done.count()


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, node, component_id, kept.

    node: a hash of the row's set of shingles, null without any.

    component_id: the smallest doc_id that links reach, itself included; kept: whether that is
    the row's own.  Null and empty texts have no shingles and are linked with nothing; equal
    sets are linked whatever their ids.  Rows that repeat an id have one result each, of
    their own text; a null id is never the smallest of others, and such rows are not kept
    unless they are linked with nothing.  An empty table gives no rows.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    seen = stash(signatures(docs, words), "signatures")
    nodes = seen.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = stash(nodes, "nodes")
    dealt = nodes.select(F.explode("bands").alias("bucket"), "node", "n")
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("c0"), F.max("node").alias("c1"), F.count(F.lit(1)).alias("m")).where("c0 < c1").select("bucket", "m")
    met = stash(dealt.join(shared, "bucket"), "met")
    popular = met.groupBy("node").agg(F.sum("m").alias("pop"))
    members = stash(met.join(popular, "node").select("bucket", "node", "n", "pop"), "members")

    inner = nodes.join(members.select("node").distinct(), "node", "left_semi").select("first", "node")
    wanted = inner.select(F.col("first").alias("doc_id")).distinct().hint("merge")
    sets = _sets(docs.join(wanted, "doc_id", "left_semi"), words).groupBy("node").agg(F.first("set").alias("set"), F.first("cells").alias("cells"))
    sets = stash(sets.join(members.select("node").distinct(), "node", "left_semi"), "sets")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold

    best = members.groupBy("bucket").agg(F.max(F.struct("pop", -F.col("node"), "n")).alias("x"))
    best = best.select("bucket", (-F.col("x")["col2"]).alias("a"), F.col("x")["n"].alias("na"))
    star = members.join(best, "bucket").where(F.col("node") != F.col("a")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), "na", F.col("n").alias("nb"))
    pairs = star.where(fits).select("a", "b").distinct()
    links = stash(_confirmed(pairs, sets, threshold), "links")
    comps, named = components(links)

    low, high = 0, STEP
    turn = F.shiftrightunsigned(F.xxhash64("bucket", "node"), 1) / F.lit(2.0**63) * F.col("m")  # a place in the bucket, without sorting it
    while True:
        now = members.join(brief(comps, named), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        several = now.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("m")).where((F.col("c0") < F.col("c1")) & (F.col("m") > low))
        several = stash(several.select("bucket", "m"), "several")
        buckets = several.count()
        if not buckets:
            break
        open_ = now.join(brief(several, buckets), "bucket").withColumn("turn", turn).drop("m")
        if "cells" not in open_.columns:
            open_ = open_.join(sets.select("node", "cells"), "node")
        open_ = stash(open_, "open")
        x = open_.where((F.col("turn") >= low) & (F.col("turn") < high)).select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.struct("turn", "node").alias("ta"), F.col("cells").alias("xa"))
        y = open_.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.struct("turn", "node").alias("tb"), F.col("cells").alias("xb"))
        apart = reduce(add, [F.bit_count(F.col("xa")[i].bitwiseXOR(F.col("xb")[i])) for i in range(CELLS // 64)])
        near = (100 + threshold) * apart <= (100 - threshold) * (F.col("na") + F.col("nb"))
        pairs = x.join(y, "bucket").where((F.col("tb") > F.col("ta")) & (F.col("ca") != F.col("cb")) & fits & near)
        pairs = stash(pairs.select("a", "b", "ca", "cb").distinct(), "pairs")
        count = pairs.count()
        if count:
            fresh = _confirmed(brief(pairs.select("a", "b"), count), sets, threshold).join(brief(pairs, count), ["a", "b"])
            merged, found = components(fresh.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
            if found:
                into = brief(merged.select(F.col("node").alias("comp"), F.col("comp").alias("into")), found)
                old = comps.join(into, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp"))
                comps = stash(old.unionByName(merged.join(comps, "node", "left_anti")), "components")
                named += found
        members = open_.select("bucket", "node", "n", "cells")  # a bucket of one component stays so
        low, high = high, high * STEP

    labelled = nodes.select("node", "first").join(brief(comps, named), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = labelled.groupBy("comp").agg(F.min("first").alias("component_id"))
    labelled = labelled.join(smallest, "comp").select("node", "component_id")
    out = seen.select("doc_id", "n", "node").join(labelled, "node", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "node", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, own.isNull()).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the smallest id.

    Of rows with equal id and equal set one stays; rows without shingles all stay.
    """
    found = stash(near_duplicates(docs, words, threshold, key, text), "kept")
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("any"))
    once = ids.where("n = 1 and doc_id is not null and any").select(F.col("doc_id").alias("_id")).hint("merge")  # it spills, and is the plan of every size
    out = docs.join(once, docs[key] == once["_id"], "left_semi")
    again = ids.where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    if not again.limit(1).count():
        return out
    # ids that repeat: rows are told apart by their sets, beside which they travel as one struct
    rest = docs.join(again, docs[key].eqNullSafe(again["_id"]), "left_semi")
    rest = rest.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("body"))

    def run(batches):
        for batch in batches:
            nodes = [_node(s) if len(s) else None for s in shingle_sets(WordBatch(batch.column(2)), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64())], names=["row", "id", "node"])

    rest = rest.mapInArrow(run, T.StructType([rest.schema["row"], rest.schema["id"], T.StructField("node", T.LongType())]))
    good = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("node").alias("_n")).distinct()
    rest = rest.join(good, F.col("id").eqNullSafe(F.col("_id")) & F.col("node").eqNullSafe(F.col("_n")), "left_semi")
    rest = rest.where("node is not null").dropDuplicates(["id", "node"]).unionByName(rest.where("node is null"))
    return out.unionByName(rest.select("row.*"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2).drop("node")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) ELSE w END AS g FROM d
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), p AS (
  SELECT a.doc_id AS l, b.doc_id AS r, a.n AS ln, b.n AS rn, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL
), links AS (
  SELECT l, r FROM p WHERE 100 * c >= 80 * (ln + rn - c)
), two AS (
  SELECT l AS a, r AS b FROM links UNION ALL SELECT r, l FROM links
), walk AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT walk.a, two.b FROM walk JOIN two ON walk.b = two.a
), comp AS (
  SELECT a AS doc_id, min(b) AS component_id FROM walk GROUP BY a
)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN comp USING (doc_id)
"""
