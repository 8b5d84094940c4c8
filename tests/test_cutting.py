"""Cuts in one sorted pass: what is shuffled, and sources of several blocks."""

import random

import __spark_entry__ as entry
from clipspark.operators import segmentation
from clipspark.sources import derived
from tests.conftest import rows


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_are_not_shuffled_for_cards(spark, sf_dir):
    for name in ("g6_caption_events", "g7_caption_word_spans"):
        df = entry.queries()[name](spark, sf_dir)
        assert _exchanges(df) == 1, name  # the segments' clock


def test_segments_are_shuffled_once_for_windows(spark, sf_dir):
    assert _exchanges(entry.queries()["g3_candidate_windows"](spark, sf_dir)) == 1


def _greedy_cards(words):
    """The rule as a loop over ``(pos, s, e, word)``."""
    out, i, n = [], 0, len(words)
    while i < n:
        j, size = i, 0
        while True:
            _, _, e, w = words[j]
            size += len(w)
            done = j + 1 == n or w.endswith((".", "!", "?")) or words[j + 1][1] - e >= 350
            if done or (j > i and w.endswith((",", ":", ";", "—", "-"))) or j - i == 3 or size + j - i >= 32:
                break
            j += 1
        out.append(" ".join(w[3] for w in words[i : j + 1]))
        i = j + 1
    return out


def test_cards_match_the_rule_over_many_blocks(spark):
    r, data = random.Random(5), {}
    for source in range(6):
        at, data[source] = 0, []
        for p in range(r.randint(1, 300)):
            at += r.choice([400, 400, 400, 800, 90_000 if source % 2 else 400])
            data[source].append((p * 3, at, at + 340, r.choice(["a", "bb,", "ccc", "dddddddddddddddd", "stop."])))
    df = spark.createDataFrame([(s, *w) for s, ws in data.items() for w in ws], "source_id long, pos long, start_ms long, end_ms long, word string")
    for block in (1_000, 5_000, 60_000, 86_400_000):
        got = {}
        for x in segmentation.caption_cards(df, block_ms=block).orderBy("source_id", "card").collect():
            got.setdefault(x["source_id"], []).append((x["card"], x["text"]))
        assert got == {s: list(enumerate(_greedy_cards(ws), 1)) for s, ws in data.items()}, block


def test_lines_give_the_same_cards_as_words(spark, sf_dir):
    lines, spread = derived.lines(spark, sf_dir)
    want = rows(segmentation.caption_cards(derived.words(spark, sf_dir)))
    assert want and rows(segmentation.caption_cards(lines, spread=spread)) == want


def test_a_source_of_many_blocks_without_a_window_is_one(spark):
    sparse = [(1, k, k * 600_000, k * 600_000 + 1_000, f"w{k}") for k in range(8)]
    dense = [(2, k, 90_000_000 + k * 5_000, 90_000_000 + k * 5_000 + 4_000, f"w{k}") for k in range(30)]
    short = [(3, k, k * 2_000, k * 2_000 + 1_000, f"w{k}") for k in range(3)]
    seg = spark.createDataFrame(sparse + dense + short, "source_id long, segment_id long, start_ms long, end_ms long, text string")
    want = rows(segmentation.candidate_windows(seg))
    assert [x[0] for x in want].count("1") == 1 and [x[0] for x in want].count("3") == 1
    for block in (100_000, 1_200_000):
        assert rows(segmentation.candidate_windows(seg, block_ms=block)) == want
