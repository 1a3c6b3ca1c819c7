"""Documents in chunks, for operators that ask shards about a chunk's content and get answers back.

A chunk is one row: a few megabytes of documents as a compressed Arrow stream.  The chunk
table is written once to the shared folder, bucketed by chunk, so each later join of answers
to their chunk moves the answers only, never the texts.  A chunk's content is fixed once
written, whatever is recomputed after a lost executor.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, keep_track, shared_dir

CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 4000
#: Bytes of the source that make up one bucket of a chunk table, and Spark's limit of buckets.
BUCKET_BYTES = 64 << 20
MOST_BUCKETS = 100_000


def pack_stream(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def unpack_stream(blob) -> pa.RecordBatch:
    """All rows of a chunk as one batch."""
    found = pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()
    return found.to_batches()[0] if found.num_rows else pa.RecordBatch.from_pylist([], schema=found.schema)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; the first bytes of all items lie together, then the second
    ones, and so on, which packs counts and differences best."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        parts.append(f"{a.dtype.str:<8}".encode() + np.array([a.nbytes], np.int64).tobytes())
    parts += [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack_arrays(blob) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(blob))
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, heads = 8, []
    for _ in range(n):
        heads.append((np.dtype(raw[at : at + 8].decode().strip()), int(np.frombuffer(raw, np.int64, 1, at + 8)[0])))
        at += 16
    out = []
    for kind, size in heads:
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def buckets_for(df: DataFrame) -> int:
    """Buckets of a table like ``df``: they follow the bytes that its files hold.  Where the plan
    doesn't know them (it then says far too many), the partitions bound them."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = min(size, df.rdd.getNumPartitions() * (128 << 20))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, size // BUCKET_BYTES))


def chunk_table(docs: DataFrame, name: str, size_of_chunk: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, body) of ``docs``, written and bucketed by chunk."""
    spark = docs.sparkSession
    arrow_batches(spark)

    def run(batches):
        worker, n, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([(worker << 32) + n], pa.int64()), pa.array([pack_stream(held)], pa.binary())], names=["chunk", "body"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 100)
                at += 100
                held.append(part)
                size += part.get_total_buffer_size() if batch.num_rows <= 100 else part.nbytes
                rows += part.num_rows
                if size >= size_of_chunk or rows >= CHUNK_ROWS:
                    yield row()
                    n, held, size, rows = n + 1, [], 0, 0
        if held:
            yield row()

    return bucketed(docs.mapInArrow(run, "chunk long, body binary"), name, "chunk", buckets_for(docs))


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed: joins and groups by ``by`` don't move it."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.format("parquet").option("compression", "none").option("path", path).bucketBy(buckets, by).saveAsTable(table)
    keep_track(path, table)
    out = spark.table(table)
    out.stash_path = path, table
    return out


def one_row_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow over rows that are megabytes each: batches are cut by bytes."""
    arrow_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def answered(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """(chunk, body, answers): each chunk with the blobs that answer it, as an array."""
    per = answers.groupBy("chunk").agg(F.collect_list("answer").alias("answers"))
    return chunks.join(per, "chunk", "left").select("chunk", "body", F.coalesce("answers", F.array().cast("array<binary>")).alias("answers"))
