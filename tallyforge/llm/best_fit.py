"""Best-fit packing with large-item matching: as few sequences of bounded length as possible.

A document becomes its token ids and an end id; one longer than ``capacity`` is cut into pieces of
``capacity`` tokens and a rest.  Pieces above a third of the capacity lie at most two to a
sequence, so they are matched first: from the longest down, each with the longest one that
still fits beside it.  The other pieces go, from the longest down, into the smallest gap that holds them.

Sequences with equal gaps are interchangeable and so are pieces of equal length.  So the whole plan
is drawn up from the number of pieces of each length, at most ``capacity`` numbers whatever the
input, and says for ranges of pieces which range of sequences takes them.  Spark counts, numbers
the pieces of each length across workers by prefix sums and places every piece by the plan.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, stash

CAPACITY = 4096
VOCABULARY = "word_bpe_49k"
END_ID = 1

#: Characters for which words are looked up one by one (the tests try every one of them); texts
#: with any other character, or with a special token's string, go to the library as a whole.
PLAIN = [c for c in map(chr, [*range(9, 14), *range(32, 127), *range(0xA1, 0x180)]) if c != "İ"]
_OTHER = re.compile(f"[^{re.escape(''.join(PLAIN))}]|<\\|(?:start|end)oftext\\|>")
#: The vocabulary's own pattern for words, as its file states it (a fixed value), with its
#: classes written out for the characters above.
_LETTER = re.escape("".join(c for c in PLAIN if unicodedata.category(c)[0] == "L"))
_NUMBER = re.escape("".join(c for c in PLAIN if unicodedata.category(c)[0] == "N"))
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
#: Words remembered by a worker; longer words aren't.
REMEMBER, LONGEST = 1 << 19, 64


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self._by_word = vocabulary == VOCABULARY
        self._known: dict[str, bytes] = {}

    def exact(self, text: str) -> bytes:
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _look_up(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words, each one unit of the vocabulary's pattern, asked for in one text."""
        found = self._exact.encode(" ".join(words), add_special_tokens=False)
        number = np.array(found.word_ids, dtype=np.int64)
        raw, edge = np.array(found.ids, dtype="<u4").tobytes(), 4 * np.searchsorted(number, np.arange(len(words) + 1))
        return {w: raw[a:b] for w, a, b in zip(words, edge[:-1].tolist(), edge[1:].tolist())}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self._known) > REMEMBER:
            self._known.clear()
        plain = [self._by_word and not _OTHER.search(t) for t in texts]
        words = [_WORD.findall(t.lower()) if p else [] for t, p in zip(texts, plain)]
        new = set().union(*words).difference(self._known)
        if new:
            self._known |= self._look_up(sorted(new))
        out = [b"".join(map(self._known.__getitem__, w)) if p else self.exact(t) for t, w, p in zip(texts, words, plain)]
        for w in new:
            if len(w) > LONGEST:
                del self._known[w]
        return out


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, worker, k [, ids]): ``k`` counts the pieces of one
    length on a worker.  Null text: empty, one end id."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, worker long, k long" + ", ids array<int>" * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        worker, encode = TaskContext.get().partitionId(), _encoder(vocabulary)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, at = [], []
            number, start, length, crc, k = at = [[] for _ in range(5)]
            every = []
            for i, ids in enumerate(encode([t or "" for t in batch.column(1).to_pylist()])):
                raw = ids + end
                for s in range(0, len(raw), 4 * capacity):
                    part = raw[s : s + 4 * capacity]
                    n = len(part) // 4
                    row.append(i)
                    for column, value in zip(at, (s // (4 * capacity), s // 4, n, zlib.crc32(part), seen[n])):
                        column.append(value)
                    seen[n] += 1
                    if keep_ids:
                        every.append(np.frombuffer(part, "<i4"))
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *[pa.array(c, pa.int64()) for c in (start, length, crc)]]
            arrays += [pa.array(np.full(len(row), worker, np.int64)), pa.array(k, pa.int64())]
            if keep_ids:
                arrays.append(pa.array(every, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "worker", "k"] + ["ids"] * keep_ids)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class Plan:
    """Which sequences take the pieces of each length.

    A row says: of the pieces of ``length``, those numbered ``first`` to ``first + count - 1`` lie ``per``
    to a sequence from sequence ``bin`` on, from ``offset`` on.  A range of sequences is split at most
    once for each length, and a gap more than halves whenever a length fills it, so the rows
    are bounded by the capacity alone.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity, self.bins, self.rows = capacity, 0, []
        self._left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self._left[length] = n
        self._first = np.zeros(capacity + 1, np.int64)
        self._gaps: dict[int, list[tuple[int, int]]] = {}
        self._is_gap = np.zeros(capacity + 1, bool)
        self._match_large()
        for length in np.flatnonzero(self._left)[::-1]:
            self._best_fit(int(length))

    def _put(self, length: int, n: int, per: int, bin_: int, gap: int) -> None:
        self.rows.append((length, int(self._first[length]), n, per, bin_, self.capacity - gap))
        self._first[length] += n
        self._left[length] -= n

    def _open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def _keep_gap(self, gap: int, bin_: int, n: int) -> None:
        if gap and n:
            self._gaps.setdefault(gap, []).append((bin_, n))
            self._is_gap[gap] = True

    def _match_large(self) -> None:
        least = self.capacity // 3 + 1
        for length in range(self.capacity, least - 1, -1):
            while n := int(self._left[length]):
                top = min(length - (n < 2), self.capacity - length)
                fits = np.flatnonzero(self._left[least : top + 1])
                if not len(fits):
                    bin_ = self._open(n)
                    self._put(length, n, 1, bin_, self.capacity)
                    self._keep_gap(self.capacity - length, bin_, n)
                    break
                other = least + int(fits[-1])
                pairs = n // 2 if other == length else min(n, int(self._left[other]))
                bin_ = self._open(pairs)
                self._put(length, pairs, 1, bin_, self.capacity)
                self._put(other, pairs, 1, bin_, self.capacity - length)
                self._keep_gap(self.capacity - length - other, bin_, pairs)

    def _best_fit(self, length: int) -> None:
        while n := int(self._left[length]):
            fits = np.flatnonzero(self._is_gap[length:])
            if len(fits):
                gap = length + int(fits[0])
                bin_, room = self._gaps[gap].pop()
                if not self._gaps[gap]:
                    del self._gaps[gap]
                    self._is_gap[gap] = False
            else:
                gap = self.capacity
                room = -(-n // (gap // length))
                bin_ = self._open(room)
            per = gap // length
            full = min(room, n // per)
            if full:
                self._put(length, full * per, per, bin_, gap)
                self._keep_gap(gap - per * length, bin_, full)
                bin_, room, n = bin_ + full, room - full, n - full * per
            if room and n:  # the last pieces, fewer than a gap takes
                self._put(length, n, n, bin_, gap)
                self._keep_gap(gap - n * length, bin_, 1)
                bin_, room = bin_ + 1, room - 1
            self._keep_gap(gap, bin_, room)

    def columns(self) -> tuple[np.ndarray, ...]:
        """Rows in order of length and first, as arrays."""
        return tuple(np.array(sorted(self.rows), np.int64).reshape(-1, 6).T.copy())


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """All documents as pieces with sequence_id and offset (gapless from 0 in each sequence).

    Null and empty texts are one end token.  Repeated rows are packed each for itself, null keys
    are kept, other columns of the table don't matter.  An empty table gives no pieces.  The
    driver sees only how many pieces each length has.
    """
    made = stash(pieces(docs, key, text, capacity, end_id, vocabulary, keep_ids), "fit-pieces")
    counts = made.groupBy("worker", "length").agg(F.count(F.lit(1)).alias("n"))
    plan = Plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("worker", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # pieces of one length may be a third of all: the join's key names the worker too
    numbered = made.hint("merge").join(base, ["worker", "length"]).withColumn("rank", F.col("base") + F.col("k")).drop("base", "k", "worker")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    types = {f.name: f.dataType.simpleString() for f in made.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in out) + ", sequence_id long, offset long"
    length, first, _, per, bin_, offset = plan.columns()
    shift = np.int64(48)
    begins = (length << shift) | first

    def place(batches):
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(begins, (n << shift) | rank, side="right") - 1
            step = rank - first[at]
            sequence, place_ = bin_[at] + step // per[at], offset[at] + step % per[at] * n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.array(sequence), pa.array(place_)], names=[*out, "sequence_id", "offset"])

    return numbered.select(*out, "rank").mapInArrow(place, schema)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.  Null text: the end token alone."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
