"""A toxicity classifier whose scores are held still under swaps of identity terms.

Features are the terms of a text (lower-case runs of letters and digits) and the beginnings of
its longer terms, present or not.  They are chosen by how much more often toxic (or clean) labelled texts have them than chance
allows; a logistic model is fitted by Newton steps.  For every labelled sentence that names a
group, a counterfactual is made by swapping the term for another of its list, and the squared
change of the log-odds is added to the loss, so that the mere mention of a group carries no
weight.  The fit sees a bounded sample of labelled rows (``max_rows``); scoring sees all texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_TERM, WordBatch, arrow_batches, stash

MAX_ROWS = 12_000
MAX_TERMS = 512
BEGINNINGS = (3, 4, 5, 6)
PENALTY = 10.0
#: Terms of a list can stand for one another in a sentence.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("mexicans", "americans", "germans", "africans", "europeans", "chinese", "indians"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
)
_TERM = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def term_hash(terms: list[str]) -> np.ndarray:
    batch = WordBatch(pa.array(terms, pa.string()), NOT_TERM)
    return batch.hashes(lower=True)[batch.first[:-1]]


def _features(text: pa.Array) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, and the (row, hash) of each term and of its beginnings of ``BEGINNINGS`` letters."""
    b = WordBatch(text, NOT_TERM)
    rows, hashes = [b.row], [b.hashes(lower=True)]
    if len(b.starts):
        lead = (b.data & 0xC0) != 0x80
        at = np.append(np.flatnonzero(lead), len(b.data))
        before = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum(lead, out=before[1:])
        first, letters = before[b.starts], before[b.ends] - before[b.starts]
        starts, ends, row = b.starts, b.ends, b.row
        for k in BEGINNINGS:
            longer = np.flatnonzero(letters > k)
            b.starts, b.ends = starts[longer], at[first[longer] + k]
            rows.append(row[longer])
            hashes.append(~b.hashes(lower=True))
        b.starts, b.ends = starts, ends
    return b.rows, np.concatenate(rows), np.concatenate(hashes)


def _pairs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a row once."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


class Swaps:
    def __init__(self, lists: tuple = IDENTITY_TERMS):
        self.next = {t: [x for x in group if x != t] for group in lists for t in group}
        self.hashes = np.unique(term_hash(sorted(self.next))) if self.next else np.zeros(0, np.uint64)

    def of(self, text: str) -> list[tuple[str, str]]:
        """(term, its stand-in) for the identity terms of each sentence; which stand-in is
        fixed by the sentence."""
        out = []
        for sentence in _SENTENCE.split(text.lower()):
            for t in dict.fromkeys(_TERM.findall(sentence)):
                if others := self.next.get(t):
                    out.append((t, others[zlib.crc32(sentence.encode()) % len(others)]))
        return out


def _counts(batches):
    """(feature, n, positive) of a part of the sample."""
    for batch in batches:
        toxic = np.asarray(batch.column(0)).astype(np.int64)
        _, row, h = _features(batch.column(1))
        row, h = _pairs(row, h)
        terms, at = np.unique(h, return_inverse=True)
        n, positive = np.bincount(at, minlength=len(terms)), np.bincount(at, weights=toxic[row], minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(positive.astype(np.int64))], names=["feature", "n", "positive"])


def _examples(swaps: Swaps, chosen: np.ndarray):
    """(toxic, features, swapped out, swapped in) of each labelled text."""

    def run(batches):
        for batch in batches:
            n, row, h = _features(batch.column(1))
            inside = np.isin(h, chosen)
            named = np.bincount(row[np.isin(h, swaps.hashes)], minlength=n) > 0
            row, h = _pairs(row[inside], h[inside])
            edge = np.searchsorted(row, np.arange(n + 1))
            features, outs, ins = [], [], []
            for i, t in enumerate(batch.column(1)):
                features.append(h[edge[i] : edge[i + 1]].tobytes())
                pairs = swaps.of(t.as_py() or "") if named[i] else []
                for side, out in ((0, outs), (1, ins)):
                    out.append([_features(pa.array([p[side]]))[2].tobytes() for p in pairs])
            kind = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features, pa.binary()), pa.array(outs, kind), pa.array(ins, kind)], names=["toxic", "features", "outs", "ins"])

    return run


class Model:
    """``terms``: sorted hashes of features; ``weights`` of each; ``bias``."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, bias: float):
        self.terms, self.weights, self.bias = terms, weights, bias

    def scores(self, text: pa.Array) -> np.ndarray:
        n, row, h = _features(text)
        z = np.full(n, self.bias)
        if len(self.terms) and len(h):
            at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            hit = np.flatnonzero(self.terms[at] == h)
            pair = np.unique(row[hit] * len(self.terms) + at[hit])
            z += np.bincount(pair // len(self.terms), weights=self.weights[pair % len(self.terms)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(examples: list[tuple], terms: np.ndarray, penalty: float = PENALTY, ridge: float = 1.0, rounds: int = 12) -> Model:
    """The model of (toxic, features, outs, ins) rows over ``terms``.  Without both classes: their share."""
    y = np.array([float(e[0]) for e in examples])
    n, positive = len(y), y.sum()
    if n == 0 or positive in (0, n):
        share = (positive + 0.5) / (n + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    x = np.zeros((n, len(terms) + 1), np.float32)
    x[:, -1] = 1
    for i, e in enumerate(examples):
        x[i, np.searchsorted(terms, np.frombuffer(e[1], np.uint64))] = 1
    held = np.diag(np.append(np.full(len(terms), ridge), 1e-6))
    # counterfactual pairs: what the swap takes away and brings
    for _, _, outs, ins in examples:
        for gone, come in zip(outs, ins, strict=True):
            d = np.zeros(len(terms) + 1)
            for sign, side in ((1.0, gone), (-1.0, come)):
                of = np.frombuffer(side, np.uint64)
                at = np.minimum(np.searchsorted(terms, of), len(terms) - 1) if len(terms) else np.zeros(0, np.int64)
                d[at[terms[at] == of[: len(at)]]] += sign
            if d.any():
                held += penalty * np.outer(d, d)
    w = np.zeros(len(terms) + 1)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (q - y) + held @ w
        bend = (x * (q * (1 - q) + 1e-6)[:, None].astype(np.float32)).T @ x + held
        step = np.linalg.solve(bend, slope)
        w = w - step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-6:
            break
    return Model(terms, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS, identity_terms: tuple = IDENTITY_TERMS, penalty: float = PENALTY) -> Model:
    """Fit on at most ``max_rows`` labelled documents, taken by a hash of the id.

    Null labels and ids are left out; an id with several labels counts as toxic if most of
    them say so.  The sample's features are counted where it
    lies; the chosen ones of each row (``max_terms`` at most) reach the driver.
    """
    arrow_batches(docs.sparkSession)
    labels = labels.select(F.col(key).alias("_id"), F.col(label).cast("double").alias("_y")).where("_id is not null and _y is not null")
    if usable is not None:
        labels = labels.where(usable)
    sample = labels.groupBy("_id").agg((F.avg("_y") > 0.5).cast("int").alias("toxic"))
    sample = sample.join(docs.select(F.col(key).alias("_id")).distinct(), "_id", "left_semi")
    sample = sample.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    met = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(sample), "_id").select("toxic", "text")
    met = stash(met, "labelled")
    n, positive = met.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if positive in (0, n):
        return fit([(1,)] * positive + [(0,)] * (n - positive), np.zeros(0, np.uint64))
    counts = met.mapInArrow(_counts, "feature long, n long, positive long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
    share, p1, p0 = F.col("n") / n, F.col("positive") / positive, (F.col("n") - F.col("positive")) / (n - positive)
    z = F.abs(p1 - p0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / positive + 1 / (n - positive)))
    best = counts.withColumn("z", z).where("z > 4 and n >= 3").orderBy(F.desc("z"), "feature").limit(max_terms).select("feature").collect()
    terms = np.sort(np.array([r[0] for r in best], np.int64).view(np.uint64))
    rows = met.mapInArrow(_examples(Swaps(identity_terms), terms), "toxic int, features binary, outs array<binary>, ins array<binary>").collect()
    return fit(sorted((r[0], bytes(r[1]), tuple(map(bytes, r[2])), tuple(map(bytes, r[3]))) for r in rows), terms, penalty)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the column ``score``, from the whole text.  Null and empty texts get the
    model's base rate; repeated rows score alike; an empty table stays empty."""
    if "score" in docs.columns:
        raise ValueError("docs has a column score")
    arrow_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(batch.column(at)))], names=[*batch.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double")


def held_out(key: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, ~held_out(F.col("_id")))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
