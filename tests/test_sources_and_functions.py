"""Strict JSON, spectra and scalar functions."""

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalars as sc
from tallyforge.sources import spectra, strict_json


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "ok"), [('{"a": 1}', True), ('{"a": 1, "a": 2}', False), ('{"b": {"a": 1, "a": 2}}', False), ('{"a": NaN}', False), ('{"a": Infinity}', False), ('{"a": 1e999}', False), ('{"a": "1e999"}', True), ("", False), ("[1, 2]", True), ('{"a": 1e308}', True), (None, False)])
def test_strict_json(spark, text, ok):
    df = spark.createDataFrame([(text,)], "value string")
    assert strict_json.with_document(df).first().ok is ok


def test_typed_fields(spark):
    df = strict_json.with_document(spark.createDataFrame([('{"i": 1, "f": 1.5, "b": true, "s": "2", "e": "", "n": null}',)], "value string"))
    f = strict_json.field
    row = df.select(f("doc", "$.i", "double"), f("doc", "$.f", "double"), f("doc", "$.b", "double"), f("doc", "$.s", "double"), f("doc", "$.e", "string"), f("doc", "$.b", "boolean"), f("doc", "$.i", "boolean"), f("doc", "$.n", "string"), f("doc", "$.s", "string"), f("doc", "$.none", "string")).first()
    assert tuple(row) == (1.0, 1.5, None, None, None, True, None, None, "2", None)


def test_ledger_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2, "a": 3}\n')
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [r.ok for r in strict_json.read_rows(spark, f"{tmp_path}/a.jsonl").orderBy("pos").collect()] == [True, False, False]
    assert [r.pos for r in strict_json.read_rows(spark, f"{tmp_path}/b.json").orderBy("pos").collect()] == [0, 1]


def test_file_ledger(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    found = strict_json.file_ledger(spark, f"{tmp_path}/x.bin")
    row = found.first()
    assert row.bytes == 3 and row.md5 == "900150983cd24fb0d6963f7d28e17f72"
    declared = spark.createDataFrame([(row.path, 3, row.sha256), (row.path, 4, row.sha256), ("gone", 1, "x"), (row.path, 3, "y")], "path string, bytes long, sha256 string")
    assert sorted(r.code for r in strict_json.reconcile_files(found, declared).collect()) == ["table_bytes_mismatch", "table_file_missing", "table_hash_mismatch"]


def test_strict_sink(spark):
    df = spark.createDataFrame([(1.5, 1), (float("nan"), 2), (float("inf"), 3)], "b double, a int")
    assert [r.value for r in strict_json.to_strict_json(df).collect()] == ['{"a":1,"b":1.5}', '{"a":2,"b":null}', '{"a":3,"b":null}']


@pytest.mark.parametrize(("path", "safe"), [("a/b.json", True), ("../a", False), ("a/../b", False), ("/a", False), ("", False), ("a\\..\\b", False), ("c:/a", False), ("a..b", True), (None, False)])
def test_safe_path(spark, path, safe):
    assert one(spark, sc.F.coalesce(strict_json.safe_path(F.lit(path).cast("string")), F.lit(None))) is safe


def test_spectrum_text(spark):
    text = "##NAMES=Garnet\n##X=1\n##X=2\n1.0, 2.5\nbad, row\n2.0, 3.5\n##END=\n"
    s = one(spark, spectra.parse_spectrum(F.lit(text)))
    assert s.header == {"NAMES": "Garnet", "X": "2", "END": ""} and [(p.x, p.y) for p in s.points] == [(1.0, 2.5), (2.0, 3.5)]


def test_archive(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for i in range(7):
            z.writestr(f"p{i}.json", json.dumps({"two_theta_values": [0, 1, 2], "intensities": [i, 1, 2]}))
        z.writestr("bad.json", b"\xff\xfe")
        z.writestr("note.txt", "x")
    (tmp_path / "a.zip").write_bytes(b.getvalue())
    names = spectra.archive_members(spark, f"{tmp_path}/a.zip")
    assert names.count() == 8
    picked = spectra.spread_sample(names.where("member <> 'bad.json'"), 3)
    assert sorted(r.member for r in picked.collect()) == ["p0.json", "p3.json", "p6.json"]
    texts = spectra.archive_texts(spark, f"{tmp_path}/a.zip", picked)
    assert sorted(r.summary.y_max for r in spectra.pattern_summary(texts).collect()) == [2.0, 3.0, 6.0]
    with pytest.raises(ValueError, match="positive"):
        spectra.spread_sample(names, 0)


def test_standardize(spark):
    df = spark.createDataFrame([([0.0, 1.0, 1.0, 3.0], [0.0, 2.0, 9.0, 4.0]), ([1.0], [1.0]), (None, [1.0])], "x array<double>, y array<double>")
    got = [r.standard for r in spectra.standardize(df, "x", "y", 5, 0.0, 4.0).collect()]
    assert got[0] == pytest.approx([0.0, 0.5, 0.75, 1.0, 0.0]) and got[1] is None and got[2] is None


def test_losses_and_scores(spark):
    assert one(spark, sc.log_loss_bits(F.lit(1), F.lit(0.25))) == pytest.approx(2.0)
    assert one(spark, sc.brier(F.lit(0), F.lit(0.5))) == 0.25
    with pytest.raises(Exception, match="brier"):
        one(spark, sc.brier(F.lit(2), F.lit(0.5)))
    assert one(spark, sc.leakage_score(F.lit(0.75), F.lit(0.5))) == 0.5 and one(spark, sc.leakage_score(F.lit(0.2), F.lit(0.5))) == 0.0 and one(spark, sc.leakage_score(F.lit(0.9), F.lit(1.0))) == 0.0
    assert [one(spark, sc.severity(F.lit(v))) for v in (0.149, 0.15, 0.5)] == ["low", "moderate", "severe"]


@pytest.mark.parametrize(("low", "high", "verdict"), [(0.2, 0.3, "premature_compression"), (0.1, 0.3, "inconclusive"), (-1.0, 0.1, "bounded_risk_adequacy"), (None, 0.1, "inconclusive")])
def test_risk_verdicts(spark, low, high, verdict):
    assert one(spark, sc.risk_verdict(F.lit(low).cast("double"), F.lit(high), 0.1)) == verdict


def test_elapsed(spark):
    c = lambda *a: one(spark, sc.compare_elapsed(*[F.lit(x) for x in a]))
    assert c(2.0, "minutes", "o", 100.0, "seconds", "o") == 1
    assert c(2.0, "cycles", "o", 2.0, "cycles", "o") == 0
    assert c(2.0, "cycles", "o", 2.0, "seconds", "o") is None and c(1.0, "seconds", "o", 2.0, "seconds", "p") is None


@pytest.mark.parametrize(("text", "ok"), [("2024-01-01T00:00:00Z", True), ("2024-01-01T00:00:00+02:00", True), ("2024-01-01T00:00:00", False), ("2024-01-01", False), (None, False)])
def test_offset_timestamps(spark, text, ok):
    assert (one(spark, sc.offset_timestamp(F.lit(text).cast("string"))) is not None) is ok


def test_vector_functions(spark):
    x = F.lit([1.0, 2.0, 3.0])
    assert one(spark, sc.zscores(x, 0.0)) == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    assert one(spark, sc.l1_normalized(x, 0.0)) == pytest.approx([1 / 6, 1 / 3, 0.5])
    assert one(spark, sc.differences(x)) == [1.0, 1.0]
    assert one(spark, sc.peak_density(F.lit([0.0, 1.0, 1.0, 0.0]), 0.5)) == 0.5 and one(spark, sc.peak_density(F.lit([0.0]), 0.5)) == 0.0


@pytest.mark.parametrize(
    ("shown", "values", "ok"),
    [
        ("0.62", [0.6249], True), ("0.62", [0.631], False), ("none", [1.0], False), ("about 12 of 13", [12.4], False), ("about 12 of 13", [12.4, 13.0], True), ("in 2024 it was 0.12 of 7", [0.12], False),
        ("0.12 or 0.13", [0.125], False), ("0.12", [0.125], True), ("0.13", [0.125], False), ("2.67", [2.675], True), ("2.68", [2.675], False), ("2", [2.5], True), ("[0.1, -0.25]", [0.1, -0.25], True),
        ("12.", [12.2], True), ("", [], True), ("5", [None], False), ("1e3", [1000.0], False),
    ],
)
def test_display(spark, shown, values, ok):
    assert one(spark, sc.display_matches(F.lit(shown), F.lit(values).cast("array<double>") if values else F.array().cast("array<double>"))) is ok
