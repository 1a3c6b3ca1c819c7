"""Files by ranges: large files, many members, what is cut short or damaged, numbered lines over many blocks."""

import hashlib
import json
import os
import zipfile

import pytest

from tallyforge.sources import ranges, spectra, strict_json


def test_hash_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "big.bin", "wb") as f:
        f.seek(3 << 30)
        f.write(b"end")
    want = hashlib.sha256()
    for _ in range(3 << 4):
        want.update(bytes(1 << 26))
    want.update(b"end")
    row = strict_json.file_ledger(spark, f"{tmp_path}/big.bin").first()
    assert (row.bytes, row.sha256) == ((3 << 30) + 3, want.hexdigest())
    os.remove(tmp_path / "big.bin")


def test_hash_of_an_empty_file(spark, tmp_path):
    (tmp_path / "none").write_bytes(b"")
    row = strict_json.file_ledger(spark, f"{tmp_path}/none").first()
    assert row.bytes == 0 and row.sha256 == hashlib.sha256().hexdigest()


def archive(path, names, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for n, text in names:
            z.writestr(n, text)


def test_many_members_are_read_by_many_tasks(spark, tmp_path):
    names = [(f"d/{i:04}.json", json.dumps({"i": i, "pad": "é" * i})) for i in range(500)]
    archive(tmp_path / "a.zip", names)
    archive(tmp_path / "b.zip", names[:3], zipfile.ZIP_STORED)
    archive(tmp_path / "c.zip", names[3:5], zipfile.ZIP_BZIP2)
    texts = spectra.archive_texts(spark, f"{tmp_path}/*.zip")
    assert texts.rdd.getNumPartitions() >= 4
    got = sorted((r.archive.rsplit("/", 1)[1], r.member, r.value) for r in texts.collect())
    assert got == sorted([("a.zip", *n) for n in names] + [("b.zip", *n) for n in names[:3]] + [("c.zip", *n) for n in names[3:5]])


def test_archive_cut_short_raises(spark, tmp_path):
    archive(tmp_path / "a.zip", [(f"{i}.json", "{}") for i in range(50)])
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="not a whole zip archive"):
        spectra.archive_members(spark, f"{tmp_path}/a.zip").collect()


def test_damaged_members_are_left_out(spark, tmp_path):
    archive(tmp_path / "a.zip", [("x.JSON", '{"a": 1}'), ("y.json", '{"b": 2}'), ("f/", ""), ("n.txt", "")], zipfile.ZIP_STORED)
    data = (tmp_path / "a.zip").read_bytes().replace(b'{"b": 2}', b'{"b": 3}')
    (tmp_path / "a.zip").write_bytes(data)
    assert sorted(r.member for r in spectra.archive_members(spark, f"{tmp_path}/a.zip").collect()) == ["x.JSON", "y.json"]
    assert [r.value for r in spectra.archive_texts(spark, f"{tmp_path}/a.zip").collect()] == ['{"a": 1}']


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_last_of_equal_names_counts(spark, tmp_path):
    archive(tmp_path / "a.zip", [("x.json", "1"), ("x.json", "2")])
    archive(tmp_path / "none.zip", [])
    assert [r.value for r in spectra.archive_texts(spark, f"{tmp_path}/*.zip").collect()] == ["2"]
    assert spectra.archive_texts(spark, f"{tmp_path}/none.zip").count() == 0


def test_archives_without_an_opener_are_read_whole(spark, tmp_path, monkeypatch):
    archive(tmp_path / "a.zip", [("x.json", "1"), ("y.json", "2")])
    monkeypatch.setattr(ranges, "can_open", lambda path: False)
    assert sorted((r.member, r.value) for r in ranges.zip_texts(spark, f"{tmp_path}/a.zip").collect()) == [("x.json", "1"), ("y.json", "2")]
    assert strict_json.file_ledger(spark, f"{tmp_path}/a.zip").first().sha256 == hashlib.sha256((tmp_path / "a.zip").read_bytes()).hexdigest()


def test_written_archives_come_back(spark, tmp_path):
    rows = [("a", "x"), ("b", ""), (None, "y"), ("c", None), ("é", "ü\n")]
    made = ranges.write_archives(spark.createDataFrame(rows, "member string, value string").repartition(2), f"{tmp_path}/out")
    texts = ranges.zip_texts(spark, [r.archive for r in made.collect()], suffix="")
    assert sorted((r.member, r.value) for r in texts.collect()) == [("a", "x"), ("b", ""), ("é", "ü\n")]


def test_lines_are_numbered_over_many_blocks(spark, tmp_path):
    lines = [json.dumps({"i": i, "pad": "x" * (i % 300)}) for i in range(4000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("{}\n\n{}\n")
    (tmp_path / "c.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = strict_json.read_rows(spark, f"{tmp_path}/*.jsonl")
        assert df.rdd.getNumPartitions() > 1
        got = df.select("path", "pos", strict_json.field("doc", "$.i", "double").alias("i"), "ok").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = sorted((r.pos, r.i) for r in got if r.path.endswith("a.jsonl"))
    assert a == [(i, float(i)) for i in range(4000)]
    assert sorted((r.pos, r.ok) for r in got if r.path.endswith("b.jsonl")) == [(0, True), (1, False), (2, True)]
    assert not [r for r in got if r.path.endswith("c.jsonl")]


def test_a_line_that_is_not_utf8_is_not_ok(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"a": 1}\n{"a": "\xff"}\n')
    assert [(r.pos, r.ok) for r in strict_json.read_rows(spark, f"{tmp_path}/a.jsonl").orderBy("pos").collect()] == [(0, True), (1, False)]
