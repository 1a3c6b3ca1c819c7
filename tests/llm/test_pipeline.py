"""Each stage of the pipeline against a plain version, on what the stage before kept."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallyforge.llm import mixing, packing, toxicity
from tests.llm.test_llm_operators import brute_near, check_packing, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rows = [(d, (t + (" vilex word" if d % 5 == 0 else "")) if t and d != 48 else t, lang, s, n) for d, t, lang, s, n in corpus(7, 90)]
    rows[4] = (*rows[4][:1], "plain text with password = 'hunter2hunter2' inside it", *rows[4][2:])
    rows.append(rows[8])  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(r[0], int("vilex" in (r[1] or ""))) for r in rows if r[0] % 2 == 0 or "vilex" in (r[1] or "")], "doc_id long, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append((name, docs.collect(), out.collect(), docs.columns, out.columns))
        docs = out
    for name, before, after, cols, got in seen[:-1]:
        assert got == cols, name

    name, before, after, *_ = seen[0]  # toxic documents go, all others stay
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    import pyarrow as pa

    scores = model.scores(pa.array([r.text for r in before], pa.string()))
    assert Counter(map(tuple, after)) == Counter(tuple(r) for r, s in zip(before, scores, strict=True) if s < 0.5)
    assert not any("vilex" in (r.text or "") for r in after) and len(after) > 50

    name, before, after, *_ = seen[1]  # the smallest document of each group
    groups = {d: c for (d, _, c) in brute_near([(r.doc_id, r.text) for r in before], 5)}
    assert sorted(r.doc_id for r in after) == sorted(d for d, c in groups.items() if d == c)

    name, before, after, *_ = seen[2]  # every document, secrets replaced
    texts = {r.doc_id: r.text for r in after}
    assert sorted(texts) == sorted(r.doc_id for r in before)
    assert any("[SECRET]" in (t or "") for t in texts.values()) and not any("hunter2" in (t or "") for t in texts.values())
    for r in before:
        if not re.search(r"(?i)(password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}", r.text or ""):
            assert texts[r.doc_id] == r.text
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)

    name, before, after, *_ = seen[3]  # as often as the plan says
    plan = {p.doc_id: p.copies for p in mixing.mix_plan(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert Counter(r.doc_id for r in after) == Counter({d: n for d, n in plan.items() if n})

    name, before, after, *_ = seen[4]
    check_packing([(r.doc_id, r.text) for r in before], after)
    assert sum(p.length for p in after) == sum(len(packing.encode(r.text or "")) + 1 for r in before)


def test_run_is_the_stages(spark, folder):
    a, b = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
    key = lambda df: sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in df.collect())
    assert key(a) == key(b)
    assert np.all([p.length <= 1024 for p in a.collect()])
