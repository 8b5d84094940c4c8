"""Recording-shaped views over the given tables.

The given tables hold no recordings, so transcripts, timelines, boxes, labels and
model answers are derived from them with integer arithmetic: every table here is a
plain transformation whose size follows its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _timed(rows: DataFrame) -> DataFrame:
    dur = 400 * (1 + F.length("text") % 17)
    gap = F.when(F.col("segment_id") % 7 == 0, 1500).when(F.col("segment_id") % 3 == 0, 700).otherwise(150)
    clock = Window.partitionBy("source_id").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("dur", dur.cast("long"))
        .withColumn("gap", gap.cast("long"))
        .withColumn("end_ms", F.sum(F.col("dur") + F.col("gap")).over(clock) - F.col("gap"))
        .withColumn("start_ms", F.col("end_ms") - F.col("dur"))
        .select("source_id", "segment_id", "start_ms", "end_ms", "text")
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timed segment per sentence of a document; a document is one source."""
    parts = F.split(F.regexp_replace("text", r"([.!?]) ", "$1\n"), "\n")
    rows = (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("source_id"), F.posexplode(parts).alias("pos", "part"))
        .select("source_id", F.col("pos").cast("long").alias("segment_id"), F.trim("part").alias("text"))
        .where(F.col("text") != "")
    )
    return _timed(rows)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorers' ranked predictions; a document source is one candidate set."""
    from clipspark.operators.ranking import number_by_score

    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    scorers = F.array(
        F.struct(F.lit("A").alias("scorer"), (F.col("n_chars") % 101).cast("double").alias("score")),
        F.struct(F.lit("B").alias("scorer"), (F.col("doc_id") * 37 % 101).cast("double").alias("score")),
    )
    scored = docs.select(
        F.col("source").alias("candidate_set_id"), F.col("doc_id").alias("candidate_id"), F.inline(scorers)
    )
    i = F.col("candidate_id")
    return number_by_score(scored, ["candidate_set_id", "scorer"], "score", "candidate_id").select(
        "candidate_set_id",
        "scorer",
        "candidate_id",
        "rank",
        "score",
        F.when(i % 5 == 0, "rejected_editorial").when(i % 4 == 0, F.lit(None)).otherwise("ranked").alias("status"),
        F.when(i % 6 != 0, i * 13 % 50 + 1).alias("previous_rank"),
        F.get(
            F.array(*[F.lit(c) for c in ("STRONG", "GOOD", "WEAK", "REJECT", "FATAL_REJECT")]), (i % 6).cast("int")
        ).alias("editorial_class"),
        F.when(i % 8 == 0, "REJECT").otherwise("KEEP").alias("critic_result"),
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every set, with human labels where there are any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("candidate_set_id"))
    labels = table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    i = F.col("doc_id")
    have = F.col("labelled")
    dims = have & (i % 3 != 0)
    score = F.greatest(F.lit(0), F.least(F.lit(4), 3 * F.col("quality") + i % 2 - F.col("toxic"))).cast("double")
    return docs.join(labels, "doc_id", "left").select(
        "candidate_set_id",
        i.alias("candidate_id"),
        F.when(have, score).alias("human_score"),
        F.when(have, (F.col("quality") == 1) & (F.col("toxic") == 0)).alias("publishable"),
        F.when(dims, (i % 9) / 2.0).alias("hook_score"),
        F.when(dims, (i % 5).cast("double")).alias("standalone_score"),
        F.when(dims, (i % 7) / 2.0).alias("payoff_score"),
        F.when(dims, (i % 13) / 4.0).alias("value_score"),
        F.when(dims, (i % 4) / 1.0).alias("context_dependency"),
        F.when(dims, i % 4 == 0).alias("bad_start"),
        F.when(dims, i % 5 == 0).alias("bad_end"),
    )


FEATURE_FACTORS = {
    "hook": 7, "standalone": 9, "story_payoff": 11, "emotion": 13, "humor": 15, "surprise": 17,
    "retention": 19, "shareability": 21, "boringness": 23, "context_dependency": 25, "llm_quality_score": 3,
}


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten 0-100 dimensions and three flags per document, some with a field missing."""
    docs = table(spark, sf_dir, "documents").where(F.col("text") != "").select("source", "doc_id", "n_chars")
    i = F.col("doc_id")

    def dim(name: str) -> Column:
        value = ((i * FEATURE_FACTORS[name] + F.col("n_chars")) % 101).cast("double")
        if name == "retention":
            value = F.when(i % 13 != 0, value)
        if name == "llm_quality_score":
            value = F.when(i % 4 != 0, value)
        return value.alias(name)

    return docs.select(
        "source",
        i.alias("candidate_id"),
        *[dim(n) for n in FEATURE_FACTORS],
        (i % 5 == 0).alias("setup_only"),
        (i % 7 == 0).alias("transitional"),
        (i % 11 == 0).alias("outside_payoff"),
        F.concat(F.lit("text "), i.cast("string")).alias("reason"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document-as-recording: language and length."""
    seg = segments(spark, sf_dir).groupBy("source_id").agg(F.max("end_ms").alias("duration_ms"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("lang").alias("language"))
    return docs.join(seg, "source_id")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        segments(spark, sf_dir)
        .where(F.col("segment_id") % 40 == 0)
        .select("source_id", (F.col("start_ms") + 300).alias("t_ms"))
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every segment, 400 ms apart and 340 ms long."""
    return segments(spark, sf_dir).select(
        "source_id", "segment_id", "start_ms", F.posexplode(F.split("text", r"\s+")).alias("i", "word")
    ).select(
        "source_id",
        (F.col("segment_id") * 100_000 + F.col("i")).alias("pos"),
        (F.col("start_ms") + F.col("i") * 400).alias("start_ms"),
        (F.col("start_ms") + F.col("i") * 400 + 340).alias("end_ms"),
        "word",
    )


def lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    """The same words by segment: the segments, and each one's words as arrays."""
    n = F.size(F.split("text", r"\s+")) - 1
    start, place = F.col("start_ms"), F.col("pos")
    spread = {
        "places": F.sequence(place, place + n),
        "begins": F.sequence(start, start + n * 400, F.lit(400).cast("long")),
        "ends": F.sequence(start + 340, start + 340 + n * 400, F.lit(400).cast("long")),
        "said": F.split("text", r"\s+"),
    }
    rows = segments(spark, sf_dir)
    return rows.select("source_id", (F.col("segment_id") * 100_000).alias("pos"), "start_ms", "text"), spread


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping one-minute candidates, one per 45 s in which somebody speaks."""
    return (
        segments(spark, sf_dir)
        .groupBy("source_id", F.floor(F.col("start_ms") / 45_000).alias("candidate_seq"))
        .agg(
            F.min("start_ms").alias("start_ms"),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("segment_id", "text"))), lambda r: r["text"]), " "
            ).alias("text"),
        )
        .withColumn("end_ms", F.col("start_ms") + 60_000)
        .select("source_id", "candidate_seq", "start_ms", "end_ms", "text")
    )


def coarse_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-minute stretches in which somebody speaks, with holes between them."""
    return (
        segments(spark, sf_dir)
        .groupBy("source_id", F.floor(F.col("start_ms") / 240_000).alias("chapter"))
        .agg(F.min("start_ms").alias("start_ms"), (F.min("start_ms") + 100_000).alias("end_ms"))
    )


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps somebody asks about; some fall outside every candidate."""
    return (
        clips(spark, sf_dir)
        .where(F.col("candidate_seq") % 3 == 0)
        .select(
            "source_id",
            F.col("candidate_seq").alias("moment_id"),
            (F.col("start_ms") + (F.col("source_id") % 70) * 1000).alias("t_ms"),
        )
    )


def clip_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked predictions of three scorers over the one-minute candidates."""
    from clipspark.operators.ranking import number_by_score

    seq, src = F.col("candidate_seq"), F.col("source_id")
    rows = F.array(
        F.struct(F.lit("heuristic").alias("scorer"), ((seq * 37 + src) % 101).cast("double").alias("score")),
        F.struct(
            F.when(seq % 2 == 0, F.lit("multimodal")).alias("scorer"), ((seq * 53 + src * 3) % 101).cast("double").alias("score")
        ),
        F.struct(
            F.when(seq % 4 == 0, F.lit("contextual")).alias("scorer"), ((seq * 71 + src * 7) % 101).cast("double").alias("score")
        ),
    )
    flat = clips(spark, sf_dir).select("source_id", "candidate_seq", F.inline(rows)).where(F.col("scorer").isNotNull())
    return number_by_score(flat, ["source_id", "scorer"], "score", "candidate_seq").withColumn(
        "status", F.when(F.col("scorer") == "contextual", F.when(F.col("source_id") % 5 == 0, "rejected_weak").otherwise("ranked"))
    )


def _answer(body: Column, n: Column) -> Column:
    """Some answers are broken, fenced or chatty, as stored model answers are."""
    text = F.when(n % 11 == 0, F.expr("substring(_b, 1, length(_b) - 1)")).otherwise(body)
    return (
        F.when(n % 3 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(n % 5 == 0, F.concat(F.lit("Sure! "), text, F.lit(" Done.")))
        .otherwise(text)
    )


def responses(spark: SparkSession, sf_dir: str, stage: str) -> DataFrame:
    """Stored answers of one model stage, one per document; some are absent."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("candidate_set_id"), F.col("doc_id").alias("candidate_id")
    )
    i = F.col("candidate_id")
    s = F.substring("candidate_set_id", 4, 10).cast("long")

    def pick(*options: str) -> Column:
        return F.get(F.array(*[F.lit(o) for o in options]), (i % len(options)).cast("int"))

    def pct(k: int) -> Column:
        return (i * k % 101).cast("string")

    yes = lambda k: F.when(i % k == 0, "true").otherwise("false")
    if stage == "editorial":
        cls = F.when((s % 4 == 0) & (i % 8 != 0), "fatal_reject").otherwise(
            pick("STRONG", "good", "MAYBE", "WEAK", "REJECT", "odd", "")
        )
        fields = [
            ("editorial_class", F.concat(F.lit('"'), cls, F.lit('"'))),
            ("scroll_stop", pct(31)),
            ("context_dependency", pct(17)),
            ("dead_air", F.concat(F.lit('"'), pct(7), F.lit('"'))),
            ("salvageable", F.when(i % 5 == 0, '"yes"').otherwise("false")),
            ("best_internal_moment_present", yes(6)),
            ("needs_more_setup", yes(2)),
            ("needs_boundary_refinement", yes(3)),
            ("payoff_inside_candidate", yes(10)),
            ("standalone_after_refinement_probability", pct(13)),
            ("quality_penalty", (i % 20).cast("string")),
            ("fatal_reject_evidence", pick('["dead air", " "]', "[]", '["dead air"]', '"payoff lies outside, nothing useful"')),
            (
                "reason_to_watch",
                pick("null", '"They continue talking about it all day"', '"Short one"', '"A host falls off the chair mid sentence"', '"n/a"'),
            ),
            ("reject_reasons", F.when(i % 9 == 0, '["too slow", ""]').otherwise("[]")),
            ("confidence", pct(7)),
        ]
    elif stage == "critic":
        fields = [
            ("decision", F.concat(F.lit('"'), pick("keep", "REJECT", "", "maybe", "no"), F.lit('"'))),
            ("reason", F.concat(F.lit('" because '), i.cast("string"), F.lit('"'))),
            ("confidence", pct(37)),
            ("hard_reject", yes(2)),
            ("failure_modes", pick('["severe asr errors", "no visual value"]', '"duplicate"', "[]")),
        ]
        extra = F.concat(F.lit(', "keep_for_comparison": '), yes(7), F.lit(', "penalty": '), (i % 30).cast("string"))
    else:
        quality = [(n, pct(k)) for k, n in enumerate(
            ("visual_event", "reaction", "emotion", "humor", "surprise", "energy", "standalone", "shareability",
             "context_dependency", "quality_score"), start=11)]
        fields = [
            ("observable_event", yes(2)),
            ("visual_payoff", F.when(i % 19 == 0, '"unsure"').otherwise("true")),
            *quality,
            ("boringness", F.when(i % 13 == 0, "150").otherwise((100 - i * 3 % 40).cast("string"))),
            ("retention", F.when(i % 17 == 0, "null").otherwise((i % 60).cast("string"))),
            ("outside_payoff", yes(3)),
            ("missing_setup", yes(4)),
            ("insufficient_visual_evidence", yes(5)),
            ("confidence", ((i % 100) / 100.0).cast("string")),
            ("reason", F.lit('"seen"')),
        ]
    parts: list[Column] = []
    for n, (name, value) in enumerate(fields):
        parts += [F.lit(("" if n == 0 else ", ") + f'"{name}": '), value]
    inner = F.concat(*parts)
    if stage == "critic":
        inner = F.concat(inner, F.when(i % 4 != 0, extra).otherwise(""))
    body = F.concat(F.lit("{"), inner, F.lit("}"))
    return (
        docs.where(i % 23 != 0)
        .withColumn("_b", body)
        .select("candidate_set_id", "candidate_id", F.lit(stage).alias("stage"), _answer(F.col("_b"), i).alias("raw"))
    )


def chapter_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("source_id") * 7 + F.col("chapter")
    names = F.array_join(
        F.transform(F.sequence(F.lit(1), F.lit(15)), lambda k: F.concat(F.lit('"e'), k.cast("string"), F.lit('"'))), ", "
    )
    body = F.concat(
        F.lit('{"summary": " s'), n.cast("string"), F.lit(' ", "topic": "t'), (n % 5).cast("string"),
        F.lit('", "participants": ["a", " ", "b"], "events": ['), names, F.lit('], "setups": "one", "payoffs": []}'),
    )
    return (
        coarse_chapters(spark, sf_dir)
        .where(n % 13 != 0)
        .withColumn("_b", body)
        .select("source_id", "chapter", _answer(F.col("_b"), n).alias("raw"))
    )


def source_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    kinds = F.get(F.array(*[F.lit(k) for k in ("Stream", "interview", "show", "", "GAME")]), (n % 5).cast("int"))
    body = F.concat(
        F.lit('{"video_summary": "v'), n.cast("string"), F.lit('", "content_type": "'), kinds,
        F.lit('", "main_topics": ["x", "y'), (n % 4).cast("string"), F.lit('"], "conflicts": "c"}'),
    )
    return (
        table(spark, sf_dir, "documents").select("doc_id").where(n % 13 != 0).withColumn("_b", body)
        .select(F.col("doc_id").alias("source_id"), _answer(F.col("_b"), n).alias("raw"))
    )


def top_logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer-token alternatives per document; a few offer no answer token at all."""
    i = F.col("doc_id")
    alts = F.array(
        F.struct(F.when(i % 7 == 0, "hm").otherwise(" Yes.").alias("token"), (-(i % 50) / 10.0).alias("logprob")),
        F.struct(F.when(i % 7 == 0, "er").otherwise("no").alias("token"), (-(i % 13) / 10.0).alias("logprob")),
        F.struct(F.when(i % 7 == 0, "um").otherwise("YES").alias("token"), (-(i % 29) / 10.0).alias("logprob")),
        F.struct(F.lit("maybe").alias("token"), (-(i % 3) / 10.0).alias("logprob")),
    )
    return table(spark, sf_dir, "documents").select(i.alias("candidate_id"), F.inline(alts))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second-by-second activity series per user, from the events in time order."""
    from clipspark.operators.blocks import number_rows, with_key_totals
    from clipspark.operators.signals import _with_previous, combined_activity

    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), "event_id", "ts", "value", "event_type", F.to_date("ts").alias("day")
    )
    numbered = number_rows(ev, ["source_id"], "day", [F.col("ts"), F.col("event_id")], "n").withColumn("bin", F.col("n") - 1)
    topped = with_key_totals(numbered, ["source_id"], "day", {"top": ("max", F.col("value"))})
    rows = topped.select(
        "source_id", "bin", F.round(F.col("value") / F.col("top"), 4).alias("energy"), ((F.col("event_id") % 100) / 100.0).alias("speech"),
        F.round((F.col("event_id") % 37) / 37.0, 4).alias("motion"), (F.col("event_type") == "error").alias("scene_change"),
    )
    moved = _with_previous(rows, "source_id", "bin", {"energy": "before"})
    with_delta = moved.withColumn("delta", F.round(F.coalesce(F.abs(F.col("energy") - F.col("before")), F.lit(0.0)), 4)).drop("before")
    return with_delta.withColumn(
        "combined", combined_activity(F.col("delta"), F.col("energy"), F.col("motion"), F.col("scene_change"))
    )


def spans(series: DataFrame, step: int = 20, length: int = 40) -> DataFrame:
    """Candidates over a series: every ``step`` bins, ``length`` bins long; the last one
    of each source starts after the series has ended."""
    last = series.groupBy("source_id").agg(F.max("bin").alias("last"))
    return last.select(
        "source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / step) + 1)).alias("seq")
    ).select("source_id", "seq", (F.col("seq") * step).alias("start_bin"), (F.col("seq") * step + length).alias("end_bin"))


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One second of sound per embedding vector; a label is one source."""
    from clipspark.operators.blocks import number_rows

    v = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("source_id"), "vec_id", F.col("embedding").alias("samples"),
        F.floor(F.col("vec_id") / 1_000_000).alias("part"),
    )
    return number_rows(v, ["source_id"], "part", [F.col("vec_id")], "n").select(
        "source_id", (F.col("n") - 1).alias("frame_idx"), "samples"
    )


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pcm(spark, sf_dir).withColumnRenamed("samples", "pixels")


CLIP_FRAMES = 225


def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled frames: a user's events cut into clips of at most 225 frames, 200 ms apart."""
    from clipspark.operators.blocks import number_rows

    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.to_date("ts").alias("day"))
    n = number_rows(ev, ["user_id"], "day", [F.col("ts"), F.col("event_id")], "n").withColumn("n", F.col("n") - 1)
    return n.select(
        (F.col("user_id") * 1_000_000 + F.floor(F.col("n") / CLIP_FRAMES)).alias("clip_id"),
        (F.col("n") % CLIP_FRAMES).alias("frame"),
        (F.col("n") % CLIP_FRAMES * 200).alias("t_ms"),
        (F.col("event_type") == "error").alias("scene_change"),
        F.col("event_type"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scripted subjects: a face that drifts and flickers, and a person now and then.
    Frames in which nobody is seen keep one row without a box."""
    fr = clip_frames(spark, sf_dir)
    n = F.col("frame")
    cut = (F.col("event_type") == "error") & (n % 10 == 9)

    def box(subject: int, there: Column, x: Column, y: int, size: int, kind: str) -> Column:
        return F.when(
            there,
            F.struct(
                F.lit(subject).cast("long").alias("subject"), x.cast("long").alias("x"), F.lit(y).cast("long").alias("y"),
                F.lit(size).cast("long").alias("w"), F.lit(size).cast("long").alias("h"), F.lit(kind).alias("type"),
            ),
        )

    boxes = F.array_compact(
        F.array(
            box(1, ~(n % 7).isin(5, 6), 200 + n * 8 % 400, 260, 90, "face"),
            box(2, F.col("event_type").isin("view", "click"), F.lit(900), 300, 80, "face"),
            box(3, F.col("event_type") == "purchase", F.lit(520), 200, 150, "person"),
        )
    )
    return fr.select("clip_id", "frame", "t_ms", cut.alias("scene_cut"), F.explode_outer(boxes).alias("b")).select(
        "clip_id", "frame", "t_ms", "scene_cut", "b.*", F.lit(0.9).alias("conf")
    )


LOOK_SIZE = 64


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``detections`` with ``appearance``: a subject of a clip looks like one embedding, a
    little different in every frame; every eleventh frame shows nothing of it."""
    named = F.pmod(F.col("clip_id") * 31 + F.col("subject") * 7, F.lit(500)).alias("vec_id")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    boxes = detections(spark, sf_dir).select("*", named).join(vectors, "vec_id", "left")
    n = F.col("frame")
    seen = F.transform("e", lambda v, i: F.round(100 * v.cast("double"), 3) + (i * 5 + n * 3) % 7)
    return boxes.withColumn("appearance", F.when(n % 11 != 4, F.slice(seen, 1, LOOK_SIZE))).drop("vec_id", "e")
