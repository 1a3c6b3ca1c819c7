"""Passages that an earlier document has, found with FM-indexes over content shards.

Every window of ``WINDOW`` words has an anchor: its greatest word pair, longer pairs first.
Neighbouring windows with one anchor form a segment, and equal windows always have equal
anchors, so all occurrences of a window meet in the shard of its anchor.

1. Each chunk of documents sends the fingerprints of its anchors (each once) to shards, and
   gets back one bit each: met in another document or not.
2. Segments of met anchors go to index shards, each distinct one of a chunk once, with the
   smallest document that holds it in the chunk.  A shard indexes its distinct segments (a
   compressed FM-index), streams them through it by backward search, and reports for every
   window, from the interval of its matches, the smallest document with it.
3. Answers return to their chunks, and words under windows with a smaller document go.

Whatever repeats is sent once per chunk, so a passage that a third of all documents hold
costs a shard one entry per chunk.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import answered, chunk_table, one_row_batches, pack_arrays, unpack_arrays, unpack_stream
from .common import Stretches, WordBatch, mix
from .fm_index import FMIndex

WINDOW = 13
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD_BITS = np.uint64((1 << 48) - 1)  # of a word's hash, what travels: six bytes
#: Chunks of about 50,000 anchors whose fingerprints, or indexed segments, make up one shard.
CHUNKS_PER_FILTER_SHARD = 40
CHUNKS_PER_INDEX_SHARD = 5


class Segments:
    """The segments of a chunk: anchor, content hash, first word, windows, row."""

    def __init__(self, text: pa.Array, usable: np.ndarray, window: int):
        self.batch = b = WordBatch(text)
        self.hashes = h = b.hashes()
        n = len(h) - window + 1
        if n <= 0 or window < 2:
            at = np.zeros(0, np.int64)
            value = np.zeros(0, np.uint64)
        else:
            pair = mix(h[:-1] * _STEP + h[1:])
            size = np.minimum(b.ends - b.starts, 120).astype(np.uint64)
            best = ((size[:-1] + size[1:]) << np.uint64(56)) | (pair >> np.uint64(8))
            have, need = 1, window - 1
            while have < need:
                step = min(have, need - have)
                best = np.maximum(best[:-step], best[step:])
                have += step
            best = best[:n]
            row = b.row
            inside = (row[:n] == row[window - 1 :]) & usable[row[:n]]
            at = np.flatnonzero(inside)
            value = best[at]
        new = np.ones(len(at), bool)
        if len(at):
            new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        self.anchor = mix(value[begin])
        self.start = at[begin]
        self.windows = np.diff(np.append(begin, len(at)))
        self.row = b.row[self.start] if len(begin) else np.zeros(0, np.int64)
        words = self.windows + window - 1
        self.content = Stretches(h).hashes(self.start, words)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of many stretches, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return first + np.arange(total)


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].reshape(-1)


def _from_six(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = x.reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _prints(anchor: np.ndarray) -> np.ndarray:
    return anchor >> np.uint64(16)


def _shard(prints: np.ndarray, shards: int) -> np.ndarray:
    return ((prints >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _chunk_rows(body, key_at: int = 0):
    batch = unpack_stream(body.as_buffer())
    ids = batch.column(key_at)
    return batch, np.asarray(ids.fill_null(0).cast(pa.int64())), np.asarray(ids.is_valid())


def _send_anchors(window: int, shards: int):
    def run(batches):
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, ids, usable = _chunk_rows(body)
                seg = Segments(docs.column(1), usable, window)
                prints, inverse = np.unique(_prints(seg.anchor), return_inverse=True)
                doc = ids[seg.row]
                low, high = np.full(len(prints), np.iinfo(np.int64).max), np.full(len(prints), np.iinfo(np.int64).min)
                np.minimum.at(low, inverse, doc)
                np.maximum.at(high, inverse, doc)
                of = _shard(prints, shards)
                out = [(s, chunk, pack_arrays(_six(prints[a:b]), np.packbits(low[a:b] < high[a:b]))) for s, a, b in _runs(of)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["shard", "chunk", "blob"])

    return run


def _runs(of: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of a sorted array."""
    cut = np.flatnonzero(np.diff(of)) + 1
    edge = np.concatenate([[0], cut, [len(of)]]) if len(of) else np.zeros(0, np.int64)
    return [(int(of[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _met_anchors(table: pa.Table) -> pa.Table:
    """Which fingerprints of each chunk are met in another document."""
    shard, chunks = table.column("shard")[0].as_py(), table.column("chunk").to_numpy()
    prints, several, size = [], [], []
    for blob in table.column("blob"):
        p, bits = unpack_arrays(blob.as_buffer())
        prints.append(_from_six(p))
        size.append(len(prints[-1]))
        several.append(np.unpackbits(bits, count=size[-1]).astype(bool))
    every, met = np.concatenate(prints), np.concatenate(several)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    met[order[1:][same]] = True
    met[order[:-1][same]] = True
    parts = np.split(met, np.cumsum(size)[:-1])
    return pa.table({"chunk": pa.array(chunks), "answer": pa.array([pack_arrays(np.array([shard]), np.packbits(m)) for m in parts], pa.binary())})


def _send_segments(window: int, shards: int, index_shards: int):
    def run(batches):
        for batch in batches:
            for chunk, body, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                docs, ids, usable = _chunk_rows(body)
                seg = Segments(docs.column(1), usable, window)
                prints, inverse = np.unique(_prints(seg.anchor), return_inverse=True)
                bits = {int(s[0]): m for s, m in (unpack_arrays(a.as_buffer()) for a in answers.values)} if answers.values is not None else {}
                met = np.zeros(len(prints), bool)
                for s, a, b in _runs(_shard(prints, shards)):
                    met[a:b] = np.unpackbits(bits[s], count=b - a).astype(bool)
                take = np.flatnonzero(met[inverse]) if len(inverse) else np.zeros(0, np.int64)
                # of equal segments in the chunk the one of the smallest document
                order = take[np.lexsort((ids[seg.row[take]], seg.content[take], _prints(seg.anchor[take])))]
                keep = np.ones(len(order), bool)
                keep[1:] = (seg.content[order][1:] != seg.content[order][:-1]) | (seg.anchor[order][1:] != seg.anchor[order][:-1])
                order = order[keep]
                out = []
                for s, a, b in _runs(_shard(_prints(seg.anchor[order]), index_shards)):
                    x = order[a:b]
                    length = seg.windows[x] + window - 1
                    words = seg.hashes[_ranges(seg.start[x], length)] & _WORD_BITS
                    out.append((s, chunk, pack_arrays(seg.content[x], ids[seg.row[x]], length.astype(np.int32), _six(words))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["shard", "chunk", "blob"])

    return run


def smallest_documents(words: np.ndarray, lengths: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """For every window of distinct segments (one after the other) the smallest document with it."""
    _, symbol = np.unique(words, return_inverse=True)
    n = len(lengths)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    text = np.zeros(len(words) + n, np.int64)  # a 0 after each segment
    at = _ranges(start + np.arange(n), lengths)
    text[at] = symbol + 1
    of = np.repeat(np.arange(n), lengths + 1)
    index = FMIndex(text, int(symbol.max()) + 2, window)
    windows = lengths - window + 1
    begin = _ranges(start + np.arange(n), windows)
    # equal windows have one answer: the first of each is searched
    _, first, inverse = np.unique(index.ranks[begin], return_index=True, return_inverse=True)
    lo, hi, matched = index.search(text, begin[first] + window, window)
    own = docs[of]
    answer = own[begin[first]].copy()  # of those that nothing else matches so far back
    full = np.flatnonzero(matched == window)
    full = full[np.argsort(lo[full], kind="stable")]
    if len(full):
        # intervals of different patterns of one length don't overlap
        edges = np.stack([lo[full], hi[full]], axis=1).reshape(-1)
        by_rank = np.append(own[index.suffixes], np.iinfo(np.int64).max)
        answer[full] = np.minimum.reduceat(by_rank, edges)[::2]
    return answer[inverse]


def _index_shard(window: int):
    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_numpy()
        content, docs, lengths, words = ([np.asarray(x) for x in part] for part in zip(*(unpack_arrays(b.as_buffer()) for b in table.column("blob")), strict=True))
        sizes = [len(c) for c in content]
        content, docs, lengths, words = np.concatenate(content), np.concatenate(docs), np.concatenate(lengths).astype(np.int64), _from_six(np.concatenate(words))
        order = np.lexsort((docs, content))
        new = np.ones(len(order), bool)
        new[1:] = content[order][1:] != content[order][:-1]
        distinct = order[new]  # each content with its smallest document
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        least = smallest_documents(words[_ranges(start[distinct], lengths[distinct])], lengths[distinct], docs[distinct], window)
        windows = lengths[distinct] - window + 1
        at = np.concatenate([[0], np.cumsum(windows)[:-1]])
        out = []
        for part in np.split(np.arange(len(of)), np.cumsum(sizes)[:-1]):
            d = of[part]
            out.append(pack_arrays(content[part], windows[d].astype(np.int32), least[_ranges(at[d], windows[d])]))
        return pa.table({"chunk": pa.array(chunks), "answer": pa.array(out, pa.binary())})

    return run


def _cut(window: int, digest: bool):
    def run(batches):
        for batch in batches:
            for body, answers in zip(batch.column(1), batch.column(2), strict=True):
                docs, ids, usable = _chunk_rows(body)
                seg = Segments(docs.column(1), usable, window)
                b = seg.batch
                gone = np.zeros(len(seg.hashes) + 1, np.int64)
                got = [unpack_arrays(a.as_buffer()) for a in answers.values] if answers.values is not None else []
                if got and len(seg.content):
                    content, windows, least = (np.concatenate(x) for x in zip(*got, strict=True))
                    windows = windows.astype(np.int64)
                    at = np.concatenate([[0], np.cumsum(windows)[:-1]])
                    order = np.argsort(content, kind="stable")
                    where = np.minimum(np.searchsorted(content, seg.content, sorter=order), len(order) - 1)
                    where = order[where]
                    hit = np.flatnonzero((content[where] == seg.content) & (windows[where] == seg.windows))
                    smaller = least[_ranges(at[where[hit]], seg.windows[hit])] < np.repeat(ids[seg.row[hit]], seg.windows[hit])
                    begin = _ranges(seg.start[hit], seg.windows[hit])[smaller]
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, begin + window, -1)
                removed = np.cumsum(gone[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(removed)])
                n_removed = np.diff(total[b.first])
                kept = []
                for i, t in enumerate(docs.column(1)):
                    words = (t.as_py() or "").encode().split()
                    if n_removed[i]:
                        words = compress(words, ~removed[b.first[i] : b.first[i + 1]])
                    line = b" ".join(words)
                    kept.append(hashlib.sha256(line).hexdigest() if digest else line.decode())
                yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(b.counts), pa.array(n_removed), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without the words that lie in a
    window of ``window`` words which also starts in a document with a smaller id.

    kept: the remaining words joined by one space, or with ``digest`` its SHA-256.  Ids are
    integers.  Null and empty texts have no words; rows with a null id neither lose words nor
    take them from others; rows of one id don't take words from each other; a text shorter
    than a window stays.  An empty table gives no rows.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = chunk_table(docs, "substrings")
    n = chunks.count()
    shards, index_shards = max(1, math.ceil(n / CHUNKS_PER_FILTER_SHARD)), max(1, math.ceil(n / CHUNKS_PER_INDEX_SHARD))
    sent = "shard long, chunk long, blob binary"
    prints = one_row_batches(chunks, _send_anchors(window, shards), sent)
    met = prints.groupBy("shard").applyInArrow(_met_anchors, "chunk long, answer binary")
    segments = one_row_batches(answered(chunks, met), _send_segments(window, shards, index_shards), sent)
    found = segments.groupBy("shard").applyInArrow(_index_shard(window), "chunk long, answer binary")
    return one_row_batches(answered(chunks, found), _cut(window, digest), f"doc_id {kind}, n_words long, n_removed long, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return done.withColumnRenamed("kept", "kept_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM hit) GROUP BY doc_id
), lost AS (
  SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
), words AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t FROM words
    LEFT JOIN (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit) g ON g.doc_id = words.doc_id AND g.p = words.p
    WHERE g.p IS NULL GROUP BY words.doc_id
)
SELECT l.doc_id, len(w)::BIGINT AS n_words, len(ps)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM lost l LEFT JOIN kept ON l.doc_id = kept.doc_id
"""
