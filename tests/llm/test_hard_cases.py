"""Inputs built to break hashes, component passes and column names."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import mixing, neardup, quality, secret_ledger, substring_dedup
from tallyforge.llm.common import Stretches, WordBatch


def thue_morse(n: int) -> list[int]:
    return [bin(i).count("1") % 2 for i in range(n)]


def twins(n: int) -> tuple[str, str]:
    """Two words of n letters that polynomial hashes modulo 2^64 can't tell apart."""
    bits = thue_morse(n)
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_in_patterns_stay_apart(n):
    a, b = twins(n)
    h = WordBatch(pa.array([a, b])).hashes()
    assert h[0] != h[1]
    u, v = (np.random.default_rng(1).integers(0, 2**63, 2).astype(np.uint64))
    s = [u if x == "a" else v for x in a] + [u if x == "a" else v for x in b]
    left, right = Stretches(np.array(s)).hashes(np.array([0, n]), np.array([n, n]))
    assert left != right
    same = Stretches(np.array(s[:n] + s[:n])).hashes(np.array([0, n]), np.array([n, n]))
    assert same[0] == same[1]


@pytest.mark.parametrize("n", [1024, 2048])
def test_patterns_in_operators(spark, n):
    a, b = twins(n)
    tail = " ".join(f"t{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()] == [0, 0]
    alone = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(alone, 2).collect()} == {(1, 1), (2, 2)}
    assert quality.Features(pa.array([f"{a}\n{b}"])).n_dup_lines.tolist() == [0]
    # the same with words for letters: segments of many words
    long = [" ".join("xy"[c == "b"] for c in w) for w in (a, b)]
    docs = spark.createDataFrame([(1, long[0]), (2, long[1])], "doc_id long, text string")
    want = brute_removed(long, 13)
    assert [r.n_removed for r in sorted(substring_dedup.dedup_substrings(docs).collect())] == want


def brute_removed(texts, window):
    seen, out = set(), []
    for t in texts:
        w = t.split()
        wins = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
        gone = {i + j for i, x in enumerate(wins) if x in seen for j in range(window)}
        out.append(len(gone))
        seen |= set(wins)
    return out


def test_components_of_chains_and_stars(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(400)]
    star = [(1000, 1001 + i) for i in range(300)]
    cloud = [(2000 + r.randrange(200), 2000 + r.randrange(200)) for _ in range(150)]
    links = chain + star + cloud
    got, n = neardup.components(spark.createDataFrame(links, "a long, b long"))
    label = {x.node: x.comp for x in got.collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[find(a)] = find(b)
    nodes = {x for e in links if e[0] != e[1] for x in e}
    assert set(label) == nodes and n == len(nodes)
    assert len({(label[x], find(x)) for x in nodes}) == len({label[x] for x in nodes}) == len({find(x) for x in nodes})
    assert all(label[label[x]] == label[x] for x in nodes)


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 7, "n"), (1, "a b c d e f g", 8, "m"), (2, "x y z u v w", 9, None), (None, "p q r s t u", 1, "k"), (None, None, 2, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _node int, _id string").withColumnRenamed("_id", "id")
    docs = docs.selectExpr("*", "1 AS row", "2 AS node", "'b' AS body", "3 AS bucket", "4 AS comp")
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    got = sorted((x.doc_id or 0, x.text or "") for x in out.collect())
    assert got == [(0, ""), (0, "p q r s t u"), (1, "a b c d e f g"), (2, "x y z u v w")]
    assert {x._node for x in out.collect()} <= {7, 8, 9, 1, 2}


def test_secrets_of_repeated_rows_and_clashing_columns(spark):
    text = "see password = 'abcdefghijkl' ok"
    rows = [(1, text, "a", "b", 3), (1, text, "a", "b", 3), (None, text, "c", None, 4), (None, text, None, "d", None), (2, None, "e", "f", 5), (2, "", "e", "f", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, blob string, found string, _salt int").selectExpr("*", "1 AS row", "2 AS spread", "3 AS salt")
    out = secret_ledger.secrets(docs).collect()
    assert len(out) == 6 and out[0].__fields__[-2:] == ["blob_", "found_"]
    for r in out:
        assert [(s.kind, s.start, s.end) for s in r.found_] == ([("assign", 4, 28)] if r.text else [])
    clean = secret_ledger.redact(docs)
    assert clean.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text or "", r.blob or "", r.found or "", r._salt or 0) for r in clean.collect()))
    assert got == sorted((d or 0, "see [SECRET]' ok" if t else "", b or "", f or "", s or 0) for d, t, b, f, s in rows)


def test_ledger_scans_nothing_twice(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"token: {'x' * 14}{i}") for i in range(9)], "doc_id long, text string")
    ledger = f"file://{tmp_path}/ledger"
    first = secret_ledger.secrets(docs, ledger=ledger).collect()
    n = spark.read.parquet(f"{ledger}/scanned").count()
    again = secret_ledger.secrets(docs, ledger=ledger).collect()
    assert spark.read.parquet(f"{ledger}/scanned").count() == n == 9 * len(secret_ledger.RULES)
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_mix_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5), "s", 7) for i in range(40)] + [(None, None, None, 8)] * 3, "doc_id long, text string, source string, _e int")
    docs = docs.selectExpr("*", "1 AS _t", "2 AS _k2", "3 AS _k", "4 AS _c", "5 AS _z2", "6 AS row", "7 AS _s2")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert {(r._t, r._k2, r._k, r._c, r._z2, r.row, r._s2) for r in out.collect()} == {(1, 2, 3, 4, 5, 6, 7)}
    assert {r._e for r in out.collect()} <= {7, 8}
