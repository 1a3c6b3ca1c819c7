import json

import numpy as np
import pytest

from tallyforge.operators import probe
from tallyforge.streaming import events


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_stream_of_events(spark, tmp_path):
    lines = [json.dumps({"event_id": f"e{i % 3}", "created_at": f"2024-01-01T0{i}:00:00Z", "outcome": {"status": "success"} if i % 2 else {}}) for i in range(5)]
    (tmp_path / "a.txt").write_text("\n".join([*lines, '{"a": 1, "a": 2}', "not json"]))
    s = events.read(spark, f"file://{tmp_path}")
    assert sum(r.ok for r in drain(spark, s.select("ok"), "ok_rows")) == 5
    assert sorted(r.key for r in drain(spark, events.first_of_each(s, delay="1 day").select("key"), "firsts")) == ["e0", "e1", "e2"]
    got = drain(spark, events.counts(s), "counted", "complete")
    assert sorted((r.n, r.recorded) for r in got) == [(1, 0)] * 3 + [(1, 1)] * 2


def test_stream_of_rows(spark, tmp_path):
    rows = [{"decision_id": "d1", "allowed_actions": ["a"], "actual_action": "b"}, {"decision_id": "d2", "allowed_actions": ["a"], "actual_action": "a"}]
    (tmp_path / "d.txt").write_text("\n".join(map(json.dumps, rows)))
    got = drain(spark, events.row_issues(events.read(spark, f"file://{tmp_path}"), "decision"), "row_issues")
    assert [(r.code, r.row_id) for r in got] == [("decision_action_not_allowed", "d1")]


def test_probe_and_controls(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "a" if i % 2 else "b", i // 10, (rng.normal(3.0 * (i % 2), 0.3, 4)).tolist(), rng.normal(size=4).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, label string, g int, leak array<double>, noise array<double>").cache()
    report = probe.audit(df, {"noise": "noise", "leak": "leak"}, "label", "id", components=2).collect()
    assert [r.feature_set for r in report] == ["leak", "noise"] and report[0].severity == "severe" and report[1].score < 0.4
    frame = spark.createDataFrame(report)
    one = probe.control_efficacy(frame, spark.createDataFrame([("leak", "noise")], "raw string, control string")).first()
    assert one.reduction == pytest.approx(report[0].score - report[1].score)
    with pytest.raises(ValueError, match="two labels"):
        probe.probe(df.where("label = 'a'"), "label", "leak", "id")


def test_registry(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, x.tolist(), float(2 * x[0] - x[1])) for i, x in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "id int, fold int, x array<double>, y double")
    got = probe.held_out_predictions(df, "fold", "x", "y", "ridge").toPandas()
    assert len(got) == 60 and np.corrcoef(got.y, got.prediction)[0, 1] > 0.95
    with pytest.raises(ValueError, match="unknown model"):
        probe.make_model("none")
