"""The registered corpus queries on the smallest tables: against their SQL, or their contract."""

import os
import zlib

import pytest

from tallyforge.llm import registry
from tests.test_queries import DIR, duck, rows  # noqa: F401  the fixture

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_its_sql(spark, duck, name):  # noqa: F811
    df = registry.QUERIES[name](spark, DIR)
    cur = duck.execute(registry.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())


def test_toxicity_query(spark):
    out = registry.QUERIES["op2_toxicity"](spark, DIR).collect()
    assert len(out) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    hit = [r for r in out if r.predicted and r.doc_id in labels]
    assert hit and sum(labels[r.doc_id] for r in hit) >= 0.8 * len(hit)


def test_html_query(spark):
    out = registry.QUERIES["op3_html_text"](spark, DIR).collect()
    assert out and all(r.n_chars == len(r.text) > 0 and "<p>" not in r.text for r in out)


def test_lm_query(spark):
    out = registry.QUERIES["op8_lm_scores"](spark, DIR).collect()
    held = [r for r in out if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_neighbours_query(spark):
    from tests.llm.test_llm_operators import brute_nearest

    data = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    want = brute_nearest(data, [d for d in data if d[0] % 20 == 0], 20)
    out = registry.QUERIES["op9_neighbours"](spark, DIR).collect()
    assert sum(r.vec_id in want[r.query_id] for r in out) >= 0.9 * sum(map(len, want.values()))
