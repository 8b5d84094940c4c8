"""Hand-computed cases."""

from clipspark.operators import evaluation, framing, scoring, segmentation

SEG = "source_id long, segment_id long, start_ms long, end_ms long, text string"
FEATURES = (
    "candidate_id long, hook double, standalone double, story_payoff double, emotion double, humor double, surprise double, retention double, "
    "shareability double, boringness double, context_dependency double, llm_quality_score double, setup_only boolean, transitional boolean, "
    "outside_payoff boolean, reason string"
)


def test_short_source_is_one_window(spark):
    seg = spark.createDataFrame([(1, 0, 1000, 8000, "Hello there."), (1, 1, 10000, 18000, "Bye.")], SEG)
    r = segmentation.candidate_windows(seg).collect()
    assert [(x["start_ms"], x["end_ms"], x["text"]) for x in r] == [(1000, 18000, "Hello there. Bye.")]


def test_sparse_source_falls_back_to_everything(spark):
    seg = spark.createDataFrame([(1, i, i * 200_000, i * 200_000 + 4_000, f"w{i}.") for i in range(4)], SEG)
    r = segmentation.candidate_windows(seg).collect()
    assert [(x["start_ms"], x["end_ms"], len(x["segment_ids"])) for x in r] == [(0, 604_000, 4)]


def test_second_formula_on_even_features(spark):
    row = (1, 50.0, 50.0, 50.0, 50.0, 50.0, 50.0, 50.0, 50.0, 20.0, 25.0, None, False, False, False, "r")
    scored, rejected = scoring.score_v2_1(spark.createDataFrame([row], FEATURES))
    assert scored.collect()[0]["score"] == 42.0 and rejected.count() == 0


def test_dcg_and_rates(spark):
    labels = [("s", f"c{i}", float(v), v >= 3) for i, v in enumerate((4, 2, 3, 1, 0), start=1)]
    pool = spark.createDataFrame(labels, "candidate_set_id string, candidate_id string, human_score double, publishable boolean")
    preds = spark.createDataFrame([("s", "x", f"c{i}", i) for i in range(1, 6)], "candidate_set_id string, scorer string, candidate_id string, rank long")
    assert abs(evaluation.dcg(preds, pool, 3).collect()[0]["dcg"] - 20.392789) < 1e-6
    m = {r["k"]: r for r in evaluation.metrics_at_k(preds, pool, (3, 10)).collect()}
    assert m[3]["precision"] == 0.6667 and m[10]["precision"] == 0.2 and m[10]["bad_rate"] == 0.3


def test_partial_labels_leave_recall_undefined(spark):
    pool = spark.createDataFrame(
        [("s", "a", 4.0, True), ("s", "b", None, None)], "candidate_set_id string, candidate_id string, human_score double, publishable boolean"
    )
    preds = spark.createDataFrame([("s", "x", "a", 1)], "candidate_set_id string, scorer string, candidate_id string, rank long")
    r = evaluation.recall_at_k(preds, pool, (1,)).collect()[0]
    assert r["recall"] is None and "1/2" in r["message"]


def test_a_flaky_face_keeps_its_identity(spark):
    seen = [i for i in range(70) if i % 7 not in (5, 6)]
    d = spark.createDataFrame(
        [(1, i, i * 200, 1, 200 + int(1.6 * i), 260, 90, 90, "face", False) for i in seen],
        "clip_id long, frame long, t_ms long, subject long, x long, y long, w long, h long, type string, scene_cut boolean",
    )
    ids = {r["track_id"] for r in framing.track_subjects(d).collect()}
    assert ids == {1}


def test_one_frame_ghosts_are_never_confirmed(spark):
    face = [(1, i, i * 200, 1, 300, 260, 90, 90, "face", False) for i in range(40)]
    ghosts = [(1, i, i * 200, 2, 900 + (i % 3) * 90, 40, 60, 60, "face", False) for i in range(0, 40, 10)]
    d = spark.createDataFrame(
        face + ghosts, "clip_id long, frame long, t_ms long, subject long, x long, y long, w long, h long, type string, scene_cut boolean"
    )
    assert {r["track_id"] for r in framing.track_subjects(d).where("confirmed").collect()} == {1}
