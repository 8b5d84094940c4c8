"""Work done once, and spread: parses, and rows that can meet nothing in a join."""

import pytest

from clipspark.operators import audits, segmentation
from clipspark.sources import files


def test_documents_are_parsed_once(spark):
    raw = spark.createDataFrame([("a", '{"source_id": "s", "segments": [{"id": 1, "start": 0, "end": 1, "text": "x"}]}'), ("b", "{")], "path string, value string")
    for name, df in files.parse_transcripts(raw).items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1, name
    assert [r.path for r in files.parse_transcripts(raw)["rejects"].collect()] == ["b"]


def test_files_without_a_key_stay_out_of_the_join(spark):
    f = spark.range(1_000).selectExpr("id as source_id", "'p' as path", "'clip' as kind", "1L as bytes", "if(id < 10, 'k', null) as key", "'s' as sha")
    r = spark.createDataFrame([("k", 1, "s"), (None, 1, "s")], "key string, bytes long, sha string")
    got = audits.file_actions(f, r)
    assert [x["count"] for x in got.groupBy("action").count().orderBy("action").collect()] == [10, 990]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join"):]
    assert "Union" in plan[: plan.index("Join")] and "isnotnull" in joined


def test_the_look_ahead_of_chapters_is_searched_once(spark, monkeypatch):
    class Seen(Exception):
        pass

    def caught(nodes, *_):
        raise Seen(nodes)

    monkeypatch.setattr(segmentation, "materialise", caught)
    s = spark.createDataFrame([(1, k, k * 5_000, k * 5_000 + 4_000, "x.") for k in range(9)], "source_id long, segment_id long, start_ms long, end_ms long, text string")
    with pytest.raises(Seen) as e:
        segmentation.chapter_plan(s)
    plan = e.value.args[0]._jdf.queryExecution().optimizedPlan().toString()
    # run, hit and last each come out of a generator, which no later use copies
    assert plan.count("sort_array(") == 1 and plan.count("Generate inline") == 3
