"""Harmonic packing of tokenized documents into sequences of bounded length.

A piece of ``n`` tokens is of class ``j = capacity // n``: ``j`` of its class fit one sequence,
whichever they are.  So each worker fills the sequences of a class by counting alone, without
knowing any other piece's length.  Documents are cut into full sequences and a rest; a rest
that would waste more than ``slack`` tokens in its class is cut at the next reciprocal,
``capacity // (j + 1)``, so that it fills the class exactly.

Each worker's last, incomplete sequence of a class is opened again: those pieces (fewer than
``j`` a class and worker) are numbered across workers by prefix sums of the workers' counts and
fill sequences of the same class.  What then is left (fewer than ``j`` a class, a bound that
doesn't depend on the input) is packed first-fit by decreasing length.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, stash

CAPACITY = 1024
SLACK = 16
VOCABULARY = "byte_bpe_50k"
END_ID = 0

#: The fast tokenizer is used only for these characters, for which both give the same ids (see
#: the tests, which try every one of them); other texts go to the slower library.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x7e\xa1-ſ]|<\\|endoftext\\|>")


@lru_cache(maxsize=1)
def _tokenizers(vocabulary: str):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def encode(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """Ids as ``tokenizers`` gives them, without special tokens added."""
    fast, exact = _tokenizers(vocabulary)
    return exact.encode(text, add_special_tokens=False).ids if _PLAIN.search(text) else fast.encode_ordinary(text)


def cuts(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces of ``n`` tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        part = capacity // (j + 1)
        if capacity // j - rest <= slack or rest - part < 1 or part <= slack:
            out.append(rest)
            break
        out.append(part)
        rest -= part
    return out


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, slack: int = SLACK, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, cls, worker, k [, ids]) of all documents:
    ``k`` counts the pieces of a class on a worker.  Null text: empty, one end token."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, cls int, worker long, k long" + ", ids array<int>" * keep_ids

    def run(batches):
        worker = TaskContext.get().partitionId()
        count = np.zeros(capacity + 1, np.int64)
        plan = lru_cache(maxsize=65536)(lambda n: cuts(n, capacity, slack))
        for batch in batches:
            at, cols = [], [[] for _ in range(6)]
            start, length, crc, total, cls, k = cols
            every = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = np.array(encode(t or "", vocabulary) + [END_ID], dtype="<u4")
                raw, s = ids.tobytes(), 0
                for n in plan(len(ids)):
                    j = capacity // n
                    at.append(i)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
                    total.append(len(ids))
                    cls.append(j)
                    k.append(count[j])
                    count[j] += 1
                    if keep_ids:
                        every.append(ids[s : s + n].astype(np.int32))
                    s += n
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in (start, length, crc, total)], pa.array(cls, pa.int32()), pa.array(np.full(len(at), worker)), pa.array(k, pa.int64())]
            if keep_ids:
                arrays.append(pa.array(every, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "worker", "k"] + ["ids"] * keep_ids)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _last_fit(capacity: int):
    def fit(pdf):
        """First fit by decreasing length, over a set whose size is bounded by the classes."""
        pdf = pdf.drop(columns="_g").sort_values(["length", "worker", "k"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        room: list[int] = []
        seq, off = [], []
        for n in pdf["length"]:
            b = next((b for b, r in enumerate(room) if r >= n), len(room))
            if b == len(room):
                room.append(capacity)
            seq.append(b)
            off.append(capacity - room[b])
            room[b] -= n
        # numbers below zero: no other sequence has them
        pdf["sequence_id"] = [-1 - b for b in seq]
        pdf["offset"] = off
        return pdf

    return fit


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, slack: int = SLACK, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """All documents as pieces with sequence_id and offset (gapless from 0 in each sequence).

    A sequence has at most ``capacity`` tokens; numbers of sequences are unique, not dense.
    Null and empty texts are one end token.  Repeated rows are packed each for itself; null
    keys are kept.  An empty table gives no pieces.
    """
    if capacity >= 1 << 16:
        raise ValueError("a class number must fit 16 bits")
    made = stash(pieces(docs, key, text, capacity, slack, vocabulary, keep_ids), "pieces")
    # of each worker and class: one row, at most twice the root of the capacity a worker
    counts = made.groupBy("worker", "cls").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("full", F.floor(F.col("n") / F.col("cls")) * F.col("cls"))
    before = Window.partitionBy("cls").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("cls").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.col("n") - F.col("full")
    counts = counts.select("worker", "cls", "full", F.coalesce(F.sum(left).over(before), F.lit(0)).alias("base"), F.sum(left).over(whole).alias("all"))
    rows = made.join(counts, ["worker", "cls"])
    g = F.when(F.col("k") < F.col("full"), F.col("k")).otherwise(F.col("base") + F.col("k") - F.col("full"))
    shared = F.col("k") >= F.col("full")
    rows = rows.withColumn("g", g).withColumn("shared", shared)
    open_ = F.col("shared") & (F.col("g") >= F.floor(F.col("all") / F.col("cls")) * F.col("cls"))
    rows = rows.withColumn("open", open_)
    number = F.when(F.col("shared"), F.lit(0).cast("long")).otherwise(F.col("worker") + 1)
    number = F.shiftleft(number, 42) + F.shiftleft((F.floor(F.col("g") / F.col("cls"))).cast("long"), 16) + F.col("cls")
    inside = Window.partitionBy("sequence_id").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    closed = rows.where("not open").withColumn("sequence_id", number)
    closed = closed.withColumn("offset", F.when(F.col("cls") == 1, F.lit(0).cast("long")).otherwise(F.coalesce(F.sum("length").over(inside), F.lit(0))))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    rest = rows.where("open").select(*made.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema) + ", sequence_id long, offset long"
    fitted = rest.withColumn("_g", F.pmod("cls", F.lit(1))).groupBy("_g").applyInPandas(_last_fit(capacity), schema)
    return closed.select(*out).unionByName(fitted.select(*out))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
