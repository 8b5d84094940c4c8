"""A cross-section of the registered queries against their SQL on the smallest tables
(``check.py`` does the same for all of them)."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from check import plain

SAMPLE = (
    "g3_candidate_windows", "g4_chapter_plan", "c1_score_heuristic", "c3_score_v2_1", "c12_recover_rejections", "discover",
    "e2_ndcg_at_k", "e9_score_distribution", "e12_disagreements", "j1_surrounding_context", "j3_assign_chapter", "r4_shortlist_union",
    "r15_final_order", "a10_burst_peaks", "a18_refine_subclip", "v5_active_subject", "v7_smooth_crop", "e20_retention_plan", "s1_transcript_segments",
    "s1_transcript_words", "s3_read_predictions", "v12_layout_windows", "v15_viewport_targets", "e16_blind_mapping", "a19_frame_plan_scenes",
    "j6_refine_boundaries", "j11_pending_transcripts", "v1_box_overlap", "e15_blind_export",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    want = Counter(tuple(plain(r[have.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want and got


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
