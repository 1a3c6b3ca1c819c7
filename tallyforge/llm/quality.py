"""Quality rules as a short-circuit cascade.

Each rule rejects documents by features of the whole text.  The cost of a rule (CPU seconds a
document) and its rejection rate are measured on the first rows of every partition; rules
then run in order of rejections per cost, each only on what the earlier ones left.  A verdict
is the conjunction of all rules, so the order changes the time and never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WordBatch, arrow_batches, byte_hashes, mix

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 64  # of each partition, to measure the rules on

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_WINDOW = 8
_STEP = np.uint64(0x2545F4914F6CDD1D)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


class Features:
    """Features of a batch of texts; each is computed when first asked for, on ``keep`` rows."""

    def __init__(self, text: pa.Array):
        self.batch = WordBatch(text)
        self._made: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = getattr(self, "_" + name)()
        return self._made[name]

    def _n_words(self):
        return self.batch.counts

    def _hashes(self):
        return self.batch.hashes()

    def _word_chars(self):
        """Code points in words: bytes that begin one, less those of white space."""
        d = self.batch.data
        inside = ((d & 0xC0) != 0x80) & ~((d == 32) | ((d >= 9) & (d <= 13)))
        return _per_row(inside, self.batch.offsets)

    def _n_symbols(self):
        return _per_row(_IS_SYMBOL[self.batch.data], self.batch.offsets)

    def _lines(self):
        """(row, hash) of each line with a word."""
        b = self.batch
        d = b.data
        cut = np.flatnonzero(d == 10)
        starts = np.unique(np.concatenate([b.offsets[:-1], cut + 1]))
        starts = starts[starts < len(d)]
        ends = np.minimum(np.concatenate([starts[1:], [len(d)]]) if len(starts) else starts, len(d)).astype(np.int64)
        row = np.searchsorted(b.offsets, starts, "right") - 1
        if len(starts):
            ends = np.where((ends > starts) & (d[ends - 1] == 10), ends - 1, ends)
        words = np.zeros(len(d) + 1, np.int64)
        np.cumsum(~((d == 32) | ((d >= 9) & (d <= 13))), out=words[1:])
        full = words[ends] > words[starts] if len(starts) else np.zeros(0, bool)
        starts, ends, row = starts[full], ends[full], row[full]
        return row, byte_hashes(d, starts, ends)

    def _n_lines(self):
        return np.bincount(self.lines[0], minlength=self.batch.rows)

    def _n_dup_lines(self):
        row, h = self.lines
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        same = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
        return np.bincount(row[1:][same], minlength=self.batch.rows)

    def _n_repeat_words(self):
        """Words in windows of eight that are found twice or more in the text."""
        b, h = self.batch, self.hashes
        n = len(h)
        if n < _WINDOW:
            return np.zeros(b.rows, np.int64)
        m = n - _WINDOW + 1
        key = np.zeros(m, np.uint64)
        for j in range(_WINDOW):
            key = key * _STEP + h[j : j + m]
        inside = b.row[:m] == b.row[_WINDOW - 1 :]
        at = np.flatnonzero(inside)
        key = mix(key[at] ^ mix(b.row[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + _WINDOW, -1)
        return _per_row(np.cumsum(edge[:-1]) > 0, b.first)

    def _n_shouted(self):
        """Words with two or more of A-Z and none of a-z."""
        b = self.batch
        d = b.data
        up, low = (np.zeros(len(d) + 1, np.int64) for _ in range(2))
        np.cumsum((d >= 65) & (d <= 90), out=up[1:])
        np.cumsum((d >= 97) & (d <= 122), out=low[1:])
        return _per_row((up[b.ends] - up[b.starts] >= 2) & (low[b.ends] == low[b.starts]), b.first)

    def _n_stutter(self):
        """Words equal to the word before them."""
        b, h = self.batch, self.hashes
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (b.row[1:] == b.row[:-1])
        return _per_row(same, b.first)


@dataclass(frozen=True)
class Rule:
    """``rejects``: for each row whether the rule rejects it."""

    name: str
    rejects: Callable[[Features], np.ndarray]


RULES = (
    Rule("few_words", lambda f: f.n_words < 20),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 30 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("repeated_lines", lambda f: 10 * f.n_dup_lines > 4 * f.n_lines),
    Rule("shouting", lambda f: 10 * f.n_shouted > 3 * f.n_words),
    Rule("stutter", lambda f: 10 * f.n_stutter > 2 * f.n_words),
    Rule("word_length", lambda f: (10 * f.word_chars < 25 * f.n_words) | (f.word_chars > 12 * f.n_words)),
)
BASE = 2  # of RULES, those that the contract fixes


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[dict]:
    """Per rule: name, CPU seconds a document, rejection rate, on the first ``rows`` rows of
    every partition.  Comes back as one line per rule; no text leaves the executors."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            part = batch.column(0).slice(0, rows)
            if len(part):
                out = []
                for rule in rules:
                    t = time.thread_time()
                    n = int(rule.rejects(Features(part)).sum())
                    out.append((rule.name, time.thread_time() - t, n, len(part)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["name", "s", "n", "rows"])
            return

    from pyspark.sql import functions as F

    got = docs.select(text).mapInArrow(run, "name string, s double, n long, rows long").groupBy("name").agg((F.sum("s") / F.sum("rows")).alias("cost"), (F.sum("n") / F.sum("rows")).alias("rate")).collect()
    return [r.asDict() for r in got]


def ordered(measured: list[dict], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejections per cost, most first; ties and unmeasured rules in their own order."""
    worth = {m["name"]: m["rate"] / max(m["cost"], 1e-12) for m in measured}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, 0.0)))


def cascade(text: pa.Array, rules: tuple[Rule, ...]) -> np.ndarray:
    """For each row whether all rules keep it; a rule sees only what the earlier ones left."""
    left = np.arange(len(text))
    for rule in rules:
        if not len(left):
            break
        part = text if len(left) == len(text) else text.take(pa.array(left))
        left = left[~rule.rejects(Features(part))]
    keep = np.zeros(len(text), bool)
    keep[left] = True
    return keep


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that all rules keep, with all their columns.

    Null and empty texts have no words and fail the first rule.  Repeated rows, ties and null
    ids are each judged on their own; an empty table stays empty.
    """
    rules = ordered(measure(docs, rules, text), rules)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(cascade(batch.column(at), rules)))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rest = RULES[BASE:]
    rest = ordered(measure(docs, rest), rest)
    arrow_batches(spark)

    def run(batches):
        for batch in batches:
            f = Features(batch.column(1))
            failed = np.logical_or.reduce([r.rejects(f) for r in RULES[:BASE]])
            kept = ~failed
            passed = np.flatnonzero(kept)
            if len(passed):
                kept[passed] = cascade(batch.column(1).take(pa.array(passed)), rest)
            cols = [f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c.astype(np.int64)) for c in cols], pa.array(failed), pa.array(kept)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {key}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS j FROM rep) GROUP BY doc_id
), f AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(cov.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Z][^a-z]*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS shouted,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) AS stutter
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id
), g AS (
  SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines OR 10 * shouted > 3 * n_words
    OR 10 * stutter > 2 * n_words OR 10 * word_chars < 25 * n_words OR word_chars > 12 * n_words) AS kept
FROM g
"""
