"""Spelling variants of a vocabulary: near words, without a pair of them ever being a row.

Two words are near if one inserted, deleted or replaced code point makes one of the other.

*Replacements.*  Every word belongs to one group for each position: its letters but that one.  Words of
a group are all near each other, and two near words of one length share exactly one group.  So a word's share of a
group is the group's size less one, and its best near word there is the first of the group's top two
that it isn't itself.

*Insertions and deletions.*  Every word gives its distinct deletions; one that is a word of the vocabulary
tells both sides of each other: the word found counts the deletions that reach it and keeps the best.

Both come from one shuffle by group, one sort and one window.  Words are ranked once by falling count, then code
points; from then on a word is its rank, so that the best near word is the least rank and no row carries a
spelling.  A group is two numbers of 62 bits, four polynomials over the code points modulo the prime 2^31 - 1;
all groups of a word are made in time linear in its length.  A group has no more words than the
alphabet has letters at one place, so no group is hot.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _PRIME, _prime_powers, arrow_batches, stash

#: Runs of the query's letters in UTF-8, A-Z lower-cased: [a-z] and U+00C0 to U+00FF.
LETTERS = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+")
LEAST_LENGTH, LEAST_COUNT, LEAD = 5, 3, 2
#: Distinct words a worker counts before it hands them on.
HELD = 200_000
_BASES = (1_203_816_527, 866_412_953, 1_611_527_119, 402_653_189)
#: Stands for the letter of a wildcard; above all code points.
_WILD = np.uint64(0x110000)
_WORD, _DELETION, _WILDCARD = 0, 1, 2


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: re.Pattern = LETTERS, alter: Callable[[str, bytes], bytes] | None = None) -> DataFrame:
    """(word, n) over all texts: runs of ``letters`` in the text with A-Z lower-cased.

    ``alter(key, run)`` may replace a run of the document with that key by another.  Counted on the
    workers before anything is shuffled.  Null and empty texts have no words.
    """
    arrow_batches(docs.sparkSession)

    def hand_on(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def work(batches):
        counts = Counter()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                found = Counter(letters.findall((t or b"").lower()))
                if alter:
                    for w, n in found.items():
                        counts[alter(k, w)] += n
                else:
                    counts.update(found)
                if len(counts) >= HELD:
                    yield hand_on(counts)
                    counts = Counter()
        yield hand_on(counts)

    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInArrow(work, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def ranked(words: DataFrame) -> DataFrame:
    """(rank, word, n): ranks rise with falling count, then in code-point order.  Sorted by ranges
    over all workers; a rank is unique, not dense."""
    order = words.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("rank"), "word", "n")
    return stash(order, "ranked-words")


def group_keys(words: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which word, kind, a, b) of the word itself, its wildcards and its distinct deletions of ``least``
    code points or more."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letter = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    total = len(letter)
    edge = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(words)), size)
    at = np.arange(total)
    start, end = edge[of], edge[of + 1]
    # of equal letters in a row only the last one's deletion counts
    last = np.ones(total, bool)
    if total:
        last[:-1] = (letter[1:] != letter[:-1]) | (of[1:] != of[:-1])
    cut = np.flatnonzero(last & (size[of] > least))
    halves = []
    for base in _BASES:
        power, inverse = _prime_powers(base, total + 1), _prime_powers(pow(base, -1, int(_PRIME)), total + 2)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum(letter * power[:total] % _PRIME, out=sums[1:])
        part = lambda a, b, sums=sums: (sums[b] - sums[a]) % _PRIME
        own = part(edge[:-1], edge[1:]) * inverse[edge[:-1]] % _PRIME
        before, after = part(start, at), part(at + 1, end)
        wild = (before + after + _WILD * power[:total]) % _PRIME * inverse[start] % _PRIME
        gone = (before[cut] + after[cut] * inverse[1]) % _PRIME * inverse[start[cut]] % _PRIME
        halves.append(np.concatenate([own, gone, wild]))
    kind = np.repeat(np.array([_WORD, _DELETION, _WILDCARD], np.int8), [len(words), len(cut), total])
    pair = [(x | y << np.uint64(31)).astype(np.int64) for x, y in zip(halves[::2], halves[1::2])]
    return np.concatenate([np.arange(len(words)), of[cut], of]), kind, *pair


def near_words(vocabulary: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(rank, n_near, best): of every ranked word that has a near word, their number and the least rank."""

    def keys(batches):
        for batch in batches:
            which, kind, a, b = group_keys(batch.column(1).to_pylist(), least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(kind), pa.array(a), pa.array(b)], names=["rank", "kind", "a", "b"])

    arrow_batches(vocabulary.sparkSession)
    rows = vocabulary.select("rank", "word").mapInArrow(keys, "rank long, kind byte, a long, b long")
    rows = rows.withColumn("wild", F.col("kind") == _WILDCARD)
    group = Window.partitionBy("a", "b", "wild").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    deletion = F.col("kind") == _DELETION
    rows = rows.select(
        "rank", "wild", "kind",
        F.count(F.lit(1)).over(group).alias("size"),
        F.first("rank").over(group).alias("top"),
        F.nth_value("rank", 2).over(group).alias("second"),
        F.max(F.when(~deletion, F.col("rank"))).over(group).alias("word"),
        F.min(F.when(deletion, F.col("rank"))).over(group).alias("longer"),
    )
    near = F.when(F.col("wild"), F.col("size") - 1).when(F.col("word").isNull(), F.lit(0)).when(deletion, F.lit(1)).otherwise(F.col("size") - 1)
    best = F.when(F.col("wild"), F.when(F.col("top") == F.col("rank"), F.col("second")).otherwise(F.col("top"))).when(deletion, F.col("word")).otherwise(F.col("longer"))
    return rows.where("size > 1").select("rank", near.alias("near"), best.alias("best")).where("near > 0").groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(rank, root) of (rank, form) rows: forms followed to the last.  Chains have ``longest`` steps at most;
    each pass doubles the steps a row has taken, and rows that are at their end drop out of the joins."""
    root = forms.select("rank", F.col("form").alias("root"))
    step = 1
    while step < longest:
        onward = root.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        joined = root.hint("merge").join(onward, "root", "left")
        root = stash(joined.select("rank", F.coalesce("next", "root").alias("root")), "spelling-roots")
        step *= 2
    return root


def variants(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, lead: float = LEAD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    Words of at least ``least_length`` code points and ``least_count`` occurrences take part.  ``form``: the near
    word with the largest n (ties: least in code-point order), null unless that n is ``lead`` times the word's own.
    ``root``: forms followed to the last, the word itself if it has none.  Repeated rows of a word add
    up, null words and counts are left out, other columns don't matter; an empty table gives no rows.
    """
    if lead <= 1:
        raise ValueError("forms must grow, or chains might not end")
    whole = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = ranked(whole.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count)))
    near = near_words(vocabulary, least_length)
    counts = vocabulary.select(F.col("rank").alias("best"), F.col("n").alias("best_n"))
    counted = vocabulary.select("rank", "n").hint("merge").join(near, "rank", "left").hint("merge").join(counts, "best", "left")
    form = F.when(F.col("best_n") >= F.col("n") * lead, F.col("best"))
    found = stash(counted.select("rank", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")), "spelling-forms")
    most = vocabulary.agg(F.max("n").alias("n")).first().n or least_count
    longest = 1
    while least_count * lead**longest < most:
        longest += 1
    root = roots(found.where("form is not null").select("rank", "form"), longest)
    spelled = lambda name: vocabulary.select(F.col("rank").alias(name), F.col("word").alias(f"{name}_word"))
    out = found.hint("merge").join(root, "rank", "left").hint("merge").join(vocabulary.select("rank", "word"), "rank")
    out = out.hint("merge").join(spelled("form"), "form", "left").hint("merge").join(spelled("root"), "root", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def drop_letter(key: str | None, run: bytes) -> bytes:
    """The query's misspellings: where 97 divides h = crc32(``key:run``), the run without its code point h % length."""
    h = zlib.crc32(run, zlib.crc32(f"{key}:".encode()))
    if h % 97:
        return run
    w = run.decode()
    i = h % len(w)
    return (w[:i] + w[i + 1 :]).encode()


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of ``documents``.  Null texts have no words."""
    return variants(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), alter=drop_letter))


SQL = r"""
WITH RECURSIVE crc(v, c) AS (  -- the table of CRC-32: eight steps for each byte
  SELECT range::BIGINT, list_reduce(list_prepend(range::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FROM range(256)),
tab AS (SELECT list(c ORDER BY v) AS t FROM crc),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) GROUP BY ALL),
bytes AS (
  SELECT doc_id, w, n, flatten(list_transform(string_split(concat(doc_id, ':', w), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM runs),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]))) AS h FROM bytes, tab),
altered AS (
  SELECT CASE WHEN h % 97 = 0 THEN concat(left(w, (h % length(w))::INT), substr(w, (h % length(w))::INT + 2)) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM altered GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
parts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
cut AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM parts),
less AS (SELECT DISTINCT word, n, concat(a, b) AS d FROM cut),
pairs AS (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT l.word, l.n, v.word, v.n FROM less l JOIN v ON v.word = l.d
  UNION ALL SELECT v.word, v.n, l.word, l.n FROM less l JOIN v ON v.word = l.d),
ordered AS (SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS k FROM pairs),
forms AS (
  SELECT v.word, v.n, coalesce(o.n_near, 0)::BIGINT AS n_near, CASE WHEN o.other_n >= 2 * v.n THEN o.other END AS form, CASE WHEN o.other_n >= 2 * v.n THEN o.other_n END AS form_n
  FROM v LEFT JOIN (SELECT * FROM ordered WHERE k = 1) o ON o.word = v.word),
walk AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, w.root FROM walk w JOIN forms f ON f.form = w.word)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word
"""
