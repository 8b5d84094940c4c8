"""Readers and run publishing."""

import hashlib
import json

from clipspark.sources import files
from tests.conftest import rows


def test_transcripts_with_rejects(spark, tmp_path):
    good = {"source_id": "v1", "language": "en", "duration": 9.5, "model": "m",
            "segments": [{"id": 0, "start": 0.0, "end": 1.5, "text": "Hi", "words": []}, {"id": 1, "start": 2.0, "end": 3.0, "text": "there"}]}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text('{"source_id": "v2", "segments": []}')
    (tmp_path / "c.json").write_text('{"source_id": ')
    t = files.read_transcripts(spark, str(tmp_path))
    assert rows(t["segments"], "segment_id", "end_ms", "words_requested") == [("0", "1500", "True"), ("1", "3000", "False")]
    assert sorted(r["reason"] for r in t["rejects"].collect()) == ["no segments", "not a JSON object"]


def test_bare_and_wrapped_candidates(spark, tmp_path):
    item = {"id": "c1", "start": 1.0, "end": 31.0, "duration": 30.0, "text": "x", "segment_ids": [1, 2]}
    (tmp_path / "a.json").write_text(json.dumps([item]))
    (tmp_path / "b.json").write_text(json.dumps({"candidate_set_id": "cset_1", "candidates": [item]}))
    assert rows(files.read_candidates(spark, str(tmp_path)), "candidate_set_id", "candidate_id", "end_ms") == [
        ("cset_1", "c1", "31000"), ("legacy", "c1", "31000")]


def test_a_finished_source_is_left_alone(spark, tmp_path):
    path = str(tmp_path / "runs")
    a = spark.createDataFrame([("s1", 1), ("s2", 2)], "source_id string, v int")
    files.write_run({"scores": a}, path)
    b = spark.createDataFrame([("s1", 10), ("s3", 3)], "source_id string, v int")
    assert rows(files.unfinished(b.select("source_id"), path)) == [("s3",)]
    files.write_run({"scores": b}, path)
    assert rows(files.read_run(spark, path, "scores"), "source_id", "v") == [("s1", "1"), ("s2", "2"), ("s3", "3")]
    files.write_run({"scores": b}, path, overwrite=True)
    assert rows(files.read_run(spark, path, "scores"), "source_id", "v") == [("s1", "10"), ("s2", "2"), ("s3", "3")]


def test_fingerprints_change_with_content(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 300_000)
    (tmp_path / "b.bin").write_bytes(b"x" * 299_999 + b"y")
    got = files.fingerprint_files(spark, str(tmp_path)).select("fingerprint_id").distinct().count()
    assert got == 2


def test_a_source_of_the_second_table_only_is_published(spark, tmp_path):
    path = str(tmp_path / "runs")
    a = spark.createDataFrame([("s1", 1)], "source_id string, v int")
    b = spark.createDataFrame([("s1", 5), ("s2", 6)], "source_id string, w int")
    files.write_run({"scores": a, "clips": b}, path)
    assert rows(files.read_run(spark, path, "clips"), "source_id", "w") == [("s1", "5"), ("s2", "6")]
    assert rows(files.unfinished(b.select("source_id"), path)) == []


def test_fingerprints_of_all_sizes_by_both_readers(spark, tmp_path, monkeypatch):
    """Around the limits, with names that need care, against hashes made here."""
    chunk, want = files.CHUNK, {}
    for n in (0, 1, chunk, 3 * chunk - 1, 3 * chunk, 3 * chunk + 1, 5 * chunk + 7):
        data = bytes((i * i + n) % 251 for i in range(n))
        (tmp_path / f"a b%20#{n}.bin").write_bytes(data)
        middle = n // 2 - chunk // 2
        told = data if n <= 3 * chunk else data[:chunk] + data[middle : middle + chunk] + data[-chunk:]
        if n:  # Spark's listing leaves empty files out
            want[n] = hashlib.sha256(told).hexdigest()
    ranged = files.fingerprint_files(spark, str(tmp_path))
    assert {r.bytes: r.content_hash for r in ranged.collect()} == want
    monkeypatch.setattr(files, "RANGED", ())
    whole = files.fingerprint_files(spark, str(tmp_path))
    assert rows(whole) == rows(ranged)


def test_a_file_larger_than_an_array_is_read_in_ranges(spark, tmp_path):
    size = 5 << 30
    with open(tmp_path / "large.bin", "wb") as f:  # sparse: takes hardly any disk
        f.truncate(size)
        f.seek(size - 1)
        f.write(b"!")
    got = files.fingerprint_files(spark, str(tmp_path)).first()
    assert got.bytes == size and got.content_hash == hashlib.sha256(bytes(3 * files.CHUNK - 1) + b"!").hexdigest()
