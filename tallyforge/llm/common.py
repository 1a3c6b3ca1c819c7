"""Helpers that the corpus operators share: tables, shared storage, vectorised words.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D``.  ``WordBatch`` finds and
hashes every word of an Arrow string column with numpy, without a Python object per word.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; with Spark's byte limit it bounds a Python worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once.  All operators set the same, since results are
    lazy and run with what the session holds then."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only if unset,
    and only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
    spark.sparkContext.setCheckpointDir(own)
    return own


_made: list[tuple[str, str | None]] = []


def keep_track(path: str, table: str | None = None) -> None:
    """Remember a folder (and table) that ``cleanup`` may remove."""
    _made.append((path, table))


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> int:
    """Remove every table and folder that operators of this session wrote to the shared folder;
    to be called when the results that read them were written.  Gives their number."""
    n = len(_made)
    while _made:
        path, table = _made.pop()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(spark, path)
    return n


def discard(df: DataFrame) -> None:
    """Remove a table of ``stash`` or ``chunks.bucketed`` that nothing reads any more."""
    path, table = df.stash_path
    if table:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    remove(df.sparkSession, path)
    _made.remove((path, table))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here,
    and a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    keep_track(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path, None
    return out


def brief(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """``df``, of counted ``rows`` of a few numbers each, broadcast in joins if they are ``most`` at most."""
    return F.broadcast(df) if rows <= most else df


_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For terms: all ASCII but letters and digits parts them.
NOT_TERM = np.ones(256, bool)
NOT_TERM[48:58] = NOT_TERM[65:91] = NOT_TERM[97:123] = NOT_TERM[128:] = False
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_keys = np.zeros(0, np.uint64)


def _position_keys(n: int) -> np.ndarray:
    """Unrelated odd factors for the positions of bytes in a word."""
    global _keys
    if len(_keys) < n:
        _keys = mix(np.arange(1, max(n, 2 * len(_keys), 256) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _keys


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes.  Every position in a stretch has a factor of its
    own, so stretches made of few bytes in a pattern don't meet."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)])
    if not at[-1]:
        return np.zeros(len(size), np.uint64)
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    value = (_BYTE_LOWER if lower else _BYTE)[data[place + np.repeat(starts, size)]] * _position_keys(int(size.max()))[place]
    total = np.zeros(at[-1] + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_PRIME = np.uint64(2**31 - 1)
_BASES = (1_203_816_527, 866_412_953)


class Stretches:
    """Hashes of stretches of a sequence of 64-bit values: two polynomials modulo the prime
    2^31 - 1, each over its own half of the values, so no pattern of equal values cancels out."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self._parts = []
        for k, base in enumerate(_BASES):
            power, inverse = _prime_powers(base, n + 1), _prime_powers(pow(base, -1, int(_PRIME)), n + 1)
            half = (values >> np.uint64(33 if k else 2)) % _PRIME + np.uint64(1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(half * power[:n] % _PRIME, out=total[1:])
            self._parts.append((total, inverse))

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = length.astype(np.uint64)
        for total, inverse in self._parts:
            out = mix(out ^ ((total[start + length] - total[start]) % _PRIME * inverse[start] % _PRIME))
        return out


_prime: dict[int, np.ndarray] = {}


def _prime_powers(base: int, n: int) -> np.ndarray:
    """Powers 0..n-1 of ``base`` modulo the prime."""
    found = _prime.get(base)
    if found is None:
        found = np.ones(1, np.uint64)
    while len(found) < n:  # the next half is the one before times a power
        found = np.concatenate([found, found * np.uint64(pow(base, len(found), int(_PRIME))) % _PRIME])
    _prime[base] = found
    return found


class WordBatch:
    """The words of every row of an Arrow string column.

    ``starts`` and ``ends``: byte positions in ``data``; ``row``: the row of each word;
    ``first``: for each row, its first word (length rows + 1).  Null rows have no words.
    """

    def __init__(self, text: pa.Array, space: np.ndarray = _SPACE):
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        if not pa.types.is_string(text.type):
            text = text.cast(pa.string())
        self.rows = len(text)
        if text.null_count:
            text = text.fill_null("")
        if self.rows == 0:
            offsets, data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
        else:
            _, off, buf = text.buffers()
            offsets = np.frombuffer(off, np.int32)[text.offset : text.offset + self.rows + 1].astype(np.int64)
            data = np.frombuffer(buf, np.uint8)[offsets[0] : offsets[-1]] if buf is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
            offsets = offsets - offsets[0]
        self.data, self.offsets = data, offsets
        space = space[data]
        edge = np.zeros(len(data) + 1, bool)  # a word can't go on over these
        edge[offsets] = True
        begin = ~space
        begin[1:] &= space[:-1] | edge[1:-1]
        end = ~space
        if len(data):
            end[:-1] &= space[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower``: A-Z count as a-z."""
        return byte_hashes(self.data, self.starts, self.ends, lower)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()
