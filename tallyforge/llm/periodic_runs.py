"""Runs of words that repeat with a period, found from the number of matches at each lag.

A run is a stretch of consecutive words with smallest period ``q`` and at least
``max(SHORTEST, REPEATS * q)`` words that no neighbouring word extends.  Such a run gives at least
``max(SHORTEST, REPEATS * q) - q`` positions that match the position ``q`` further on.  The matches at every
lag are counted exactly: for rare words from the differences of their positions, for frequent
ones from the autocorrelation of their indicator by fast Fourier transform, whichever is cheaper.  Only lags with enough
matches are scanned for islands.

A scan looks at every fourth of the length an island needs, keeps what matches three times in
succession and only there follows the islands to their ends.  Lags rise, and what is found at one
takes its matches off that lag's multiples: a stretch with a multiple as its smallest period can't
match within a run of the divisor, so nothing is lost, and a text of one word alone costs one scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches

SHORTEST, REPEATS = 6, 4


def frequent_from(size: int) -> int:
    """How often a word must occur for one transform of ``size`` places to cost less than the differences
    of its positions, half the square of their number."""
    return max(32, int(0.5 * (size * size.bit_length()) ** 0.5))


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, others different ones."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def lag_matches(ids: np.ndarray, most: int, frequent: int | None = None) -> np.ndarray:
    """For each lag up to ``most``, the exact number of positions with equal words that far apart."""
    out = np.zeros(most + 1, np.int64)
    size = 1 << int(len(ids) + most).bit_length()
    frequent = frequent or frequent_from(size)
    order = np.argsort(ids, kind="stable")
    count = np.bincount(ids)
    times = count[ids[order]]
    at = order[(times > 1) & (times < frequent)]
    word = ids[at]
    kept, held = [], 0
    first, step = np.arange(len(at)), 1
    while len(first):  # light: differences of positions, nearest first
        first = first[: np.searchsorted(first, len(at) - step)]
        lag = at[first + step] - at[first]
        on = (word[first + step] == word[first]) & (lag <= most)
        first, step = first[on], step + 1
        kept.append(lag[on])
        held += len(kept[-1])
        if held > len(ids):
            out += np.bincount(np.concatenate(kept), minlength=most + 1)
            kept, held = [], 0
    if held:
        out += np.bincount(np.concatenate(kept), minlength=most + 1)
    heavy = np.flatnonzero(count >= frequent)
    if len(heavy) and most:
        power = np.zeros(size // 2 + 1)
        for w in heavy:
            spectrum = np.fft.rfft(ids == w, size)
            power += spectrum.real**2 + spectrum.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    out[0] = 0
    return out


def _islands(ids: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """Maximal stretches [a, b) of at least ``need`` positions that match the one ``lag`` further on."""
    n = len(ids) - lag
    step = max(need // 4, 1)
    probe = np.arange(0, n, step)
    hit = np.flatnonzero(ids[probe] == ids[probe + lag])
    if step > 1:  # an island meets at least three probes in succession
        if len(hit) < 3:
            return []
        good = hit[:-2][hit[2:] - hit[:-2] == 2]
    else:
        if len(hit) < need:
            return []
        good = hit[: len(hit) - need + 1][hit[need - 1 :] - hit[: len(hit) - need + 1] == need - 1]
    found, done = [], -1
    for at in probe[good].tolist():
        if at < done:
            continue
        b = _follow(ids, lag, at, n)
        a = _follow_back(ids, lag, at)
        done = max(b, at + 1)
        if b - a >= need and (not found or found[-1][0] != a):
            found.append((a, b))
    return found


def _follow(ids: np.ndarray, lag: int, at: int, n: int) -> int:
    """The first position from ``at`` on that doesn't match, looking twice as far each time."""
    width = 64
    while at < n:
        end = min(at + width, n)
        differ = ids[at:end] != ids[at + lag : end + lag]
        if differ.any():
            return at + int(differ.argmax())
        at, width = end, 2 * width
    return n


def _follow_back(ids: np.ndarray, lag: int, at: int) -> int:
    width = 64
    while at > 0:
        start = max(at - width, 0)
        differ = (ids[start:at] != ids[start + lag : at + lag])[::-1]
        if differ.any():
            return at - int(differ.argmax())
        at, width = start, 2 * width
    return 0


def find(ids: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS, frequent: int | None = None) -> list[tuple[int, int, int]]:
    """All runs (start, length, period), by start, then period."""
    n = len(ids)
    most = n // repeats
    if n < shortest or not most:
        return []
    lags = np.arange(most + 1)
    need = np.maximum(repeats * lags, shortest) - lags
    left = lag_matches(ids, most, frequent)
    found = []
    for q in np.flatnonzero(left >= need).tolist():
        if q == 0 or left[q] < need[q]:
            continue
        for a, b in _islands(ids, q, int(need[q])):
            end = b + q
            if any(q % p == 0 and s <= a and end <= s + size for s, size, p in found):
                continue  # a divisor is this stretch's period
            found.append((a, end - a, q))
            multiples = np.arange(q, min(end - a, most + 1), q)
            left[multiples] -= end - a - multiples
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS, frequent: int | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document.

    ``runs``: array of (start, length, period) by start, then period.  ``collapsed``: the words joined by one
    space, without those that lie in a run after its first ``period`` words.  Null, empty and blank
    texts have no words, no runs and an empty string.  Repeated rows and null keys each give their row; other
    columns don't matter.  A worker holds one batch of texts and a few arrays as long as the words of one.
    """
    if repeats < 2:
        raise ValueError("a run needs at least two periods")
    arrow_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches):
        for batch in batches:
            size, every, collapsed = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                words = (t or b"").split()
                got = find(numbers(words), shortest, repeats, frequent)
                if got:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s, n, q in got:
                        edge[s + q] += 1
                        edge[s + n] -= 1
                    words_left = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                else:
                    words_left = words
                size.append(len(words))
                every.append([{"start": s, "length": n, "period": q} for s, n, q in got])
                collapsed.append(b" ".join(words_left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(every, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, after the words of a tenth of them were made to repeat.

    Without a run, start, length, period and exponent_milli are null and runs_sha256 is that of the empty string.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    docs = docs.withColumn("w", words).withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])), ' ')")
    docs = docs.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))
    found = runs(docs)
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS length, r.start AS start, r.period AS period)))")
    found = found.withColumn("best", best)
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\\n'), '')")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.length")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
