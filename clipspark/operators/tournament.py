"""Shortlists, comparative ranking and the final order of a candidate set.

Everything here works on shortlists, which the fusion step bounds (32 per set by
default): windows and grouped folds over one set are therefore over at most that many
rows, whatever the size of the set itself."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipspark.functions.exprs import first_match

SET = "candidate_set_id"
ID = "candidate_id"

# Class order, points and display bands.
CLASS_ORDER = {"STRONG": 4, "GOOD": 3, "MAYBE": 2, "WEAK": 1, "REJECT": 0, "FATAL_REJECT": 0}
WIN, TIE = 1.0, 0.5
SURVIVOR_BAND = (100.0, 45.0)
REJECTED_BAND = (35.0, 5.0)
PREFERENCE = ("multimodal_v1_1", "multimodal_v1", "highlight_v2_1", "highlight_v2", "heuristic_v1")


def class_rank(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return first_match([(c == name, order) for name, order in CLASS_ORDER.items()], 0)


def shortlist_union(preds: DataFrame, a: str, b: str, k_a: int = 20, k_b: int = 20, limit: int = 32) -> DataFrame:
    """Union of two scorers' heads; a scorer that missed a candidate counts as one past
    its head. Ordered by best place, then sum of places, then id."""
    heads = preds.where(
        ((F.col("scorer") == a) & (F.col("rank") <= k_a)) | ((F.col("scorer") == b) & (F.col("rank") <= k_b))
    )
    wide = heads.groupBy(SET, ID).agg(
        F.max(F.when(F.col("scorer") == a, F.col("rank"))).alias("a_rank"),
        F.max(F.when(F.col("scorer") == b, F.col("rank"))).alias("b_rank"),
    )
    x, y = F.coalesce("a_rank", F.lit(k_a + 1)), F.coalesce("b_rank", F.lit(k_b + 1))
    order = Window.partitionBy(SET).orderBy("best_rank", "sum_rank", ID)
    return (
        wide.withColumn("best_rank", F.least(x, y))
        .withColumn("sum_rank", x + y)
        .withColumn("place", F.row_number().over(order).cast("long"))
        .where(F.col("place") <= limit)
        .withColumn(
            "retrieval_sources",
            F.concat_ws(",", F.when(F.col("a_rank").isNotNull(), a), F.when(F.col("b_rank").isNotNull(), b)),
        )
    )


def shortlist_interleave(preds: DataFrame, a: str, b: str, k_a: int = 12, k_b: int = 12, limit: int = 20) -> DataFrame:
    """Take b's and a's heads in turn, keeping each candidate's first appearance."""
    turn = F.when(F.col("scorer") == b, F.col("rank") * 2).otherwise(F.col("rank") * 2 + 1)
    heads = preds.where(
        ((F.col("scorer") == a) & (F.col("rank") <= k_a)) | ((F.col("scorer") == b) & (F.col("rank") <= k_b))
    )
    first = heads.groupBy(SET, ID).agg(F.min(turn).alias("_turn"))
    order = Window.partitionBy(SET).orderBy("_turn")
    return (
        first.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).drop("_turn")
    )


def resolve_ranking(preds: DataFrame, preference: Sequence[str] = PREFERENCE, base: str = "highlights", explicit: str | None = None) -> DataFrame:
    """Keep, per set, only the ranking that drives it: the most preferred scorer there,
    else the first other by name, else the base ranking; or the one named."""
    if explicit:
        return preds.where(F.col("scorer") == explicit)
    place = first_match(
        [(F.col("scorer") == s, F.lit(i)) for i, s in enumerate(preference)],
        F.when(F.col("scorer") == base, len(preference) + 1).otherwise(len(preference)),
    )
    # one small row per set: the winning scorer, found map-side
    best = preds.groupBy(SET).agg(F.min(F.struct(place.alias("p"), "scorer"))["scorer"].alias("scorer"))
    return preds.join(best, [SET, "scorer"], "left_semi")


def select_top_n(ranked: DataFrame, windows: DataFrame, highlights: DataFrame, n: int) -> DataFrame:
    """First ``n`` per set by (rank, id) with a stable clip id and the candidate's span,
    taken from the frozen windows or, failing that, from the highlights."""
    order = Window.partitionBy(SET).orderBy("rank", ID)
    top = ranked.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    w = windows.select(SET, ID, F.col("start_ms").alias("_ws"), F.col("end_ms").alias("_we"))
    h = highlights.select(SET, ID, F.col("start_ms").alias("_hs"), F.col("end_ms").alias("_he"))
    return (
        top.join(w, [SET, ID], "left")
        .join(h, [SET, ID], "left")
        .select(
            SET, ID, "scorer", "rank",
            F.format_string("%s_r%02d_%s", F.substring(SET, 1, 12), F.col("rank"), F.col(ID).cast("string")).alias("clip_id"),
            F.coalesce("_ws", "_hs").alias("start_ms"),
            F.coalesce("_we", "_he").alias("end_ms"),
        )
    )


def seed_order(survivors: DataFrame) -> DataFrame:
    """Starting order: editorial class, then stopping power, then id."""
    order = Window.partitionBy(SET).orderBy(class_rank("editorial_class").desc(), F.col("scroll_stop").desc(), ID)
    return survivors.withColumn("seed", (F.row_number().over(order) - 1).cast("long"))


def deal_batches(seeded: DataFrame, size: int = 7) -> DataFrame:
    """Deal the seeded order round-robin so that each batch mixes strengths."""
    size = max(2, size)
    n = F.count(F.lit(1)).over(Window.partitionBy(SET))
    batches = F.ceil(n / F.lit(size))
    dealt = seeded.withColumn("_n", n).withColumn("batch", F.when(F.col("_n") <= size, 0).otherwise(F.col("seed") % batches))
    members = F.count(F.lit(1)).over(Window.partitionBy(SET, "batch"))
    sized = dealt.withColumn("_m", members)
    paired = F.max((F.col("_m") >= 2).cast("int")).over(Window.partitionBy(SET)) == 1
    return (
        sized.withColumn("_paired", paired)
        .where((F.col("_m") >= 2) | ~F.col("_paired"))
        .withColumn("batch", F.when(F.col("_paired"), F.col("batch")).otherwise(0).cast("long"))
        .drop("_n", "_m", "_paired")
    )


def borda_points(batches: DataFrame, orderings: DataFrame) -> DataFrame:
    """Points of each batch member from the model's ordering of the batch: unknown and
    repeated ids are ignored, forgotten ones follow in seed order."""
    named = orderings.groupBy(SET, "batch", ID).agg(F.min("pos").alias("pos"))
    rows = batches.join(named, [SET, "batch", ID], "left")
    order = Window.partitionBy(SET, "batch").orderBy(F.col("pos").isNull(), "pos", "seed")
    n = F.count(F.lit(1)).over(Window.partitionBy(SET, "batch"))
    return (
        rows.withColumn("position", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("_n", n)
        .select(
            SET, ID, "batch", "position",
            F.when(F.col("_n") <= 1, 1.0)
            .otherwise(F.round(F.try_divide(F.col("_n") - 1 - F.col("position"), F.col("_n") - 1), 4))
            .alias("listwise_points"),
        )
    )


def _neighbours(standing: np.ndarray, opponents: list[set[int]]) -> Iterator[tuple[int, int]]:
    """Players in the order of the standings, each with the nearest free one below it that
    it hasn't met; with the nearest free one if it has met them all."""
    below = np.append(np.arange(1, len(standing)), -1)  # linked list of free places
    place = 0
    while place >= 0:
        nearest, before, at = below[place], place, below[place]
        while at >= 0 and standing[at] in opponents[standing[place]]:
            before, at = at, below[at]
        if at < 0:
            before, at = place, nearest
        below[before] = below[at]
        yield standing[place], standing[at]
        place = below[place]


def _swiss(key, seeded: pd.DataFrame, judged: pd.DataFrame) -> pd.DataFrame:
    """Rounds of one shortlist, over arrays indexed by seed order."""
    players = seeded.sort_values("seed")
    ids, n = players["candidate_id"].to_numpy(), len(players)
    start, listwise = players["penalty"].to_numpy(float), players["listwise_points"].to_numpy(float)
    verdict = judged.set_index(["a", "b"])["winner"].to_dict()
    gained, resting = np.zeros(n), np.zeros(n, bool)
    opponents: list[set[int]] = [set() for _ in range(n)]
    games = []
    for number in range(1, (n - 1).bit_length() + 1):
        standing = np.lexsort((np.arange(n), -listwise, -(gained + start)))
        if n % 2:  # the lowest that hasn't rested yet sits out
            fresh = np.flatnonzero(~resting[standing])
            out = fresh[-1] if len(fresh) else n - 1
            resting[standing[out]] = True
            standing = np.delete(standing, out)
        for one, two in list(_neighbours(standing, opponents)):
            if two in opponents[one]:  # nobody new is left for them: no game
                continue
            opponents[one].add(two)
            opponents[two].add(one)
            a, b = sorted((one, two), key=lambda x: ids[x])
            winner = verdict.get((ids[a], ids[b]), "TIE")
            gained[a] += {"A": WIN, "TIE": TIE}.get(winner, 0.0)
            gained[b] += {"B": WIN, "TIE": TIE}.get(winner, 0.0)
            games.append((key[0], number, ids[a], ids[b], winner))
    return pd.DataFrame(games, columns=["candidate_set_id", "round", "a", "b", "winner"])


def swiss_rounds(seeded: DataFrame, judgments: DataFrame) -> DataFrame:
    """Comparisons a Swiss tournament makes; an unjudged pair is a tie.

    Each round's pairing depends on the results before it, so one shortlist is one
    small group; different sets run in parallel."""
    cols = seeded.select(SET, ID, "seed", "penalty", "listwise_points")
    pairs = judgments.select(F.col(SET).alias("_set"), "a", "b", "winner")
    return cols.groupBy(SET).cogroup(pairs.groupBy("_set")).applyInPandas(
        _swiss, f"{SET} string, round long, a long, b long, winner string"
    )


def final_pairs(standings: DataFrame, played: DataFrame, top: int = 4) -> DataFrame:
    """Unplayed pairs among the leaders, each in one orientation. The leaders are at
    most ``top`` per set."""
    order = Window.partitionBy(SET).orderBy(F.col("standing").desc(), F.col("listwise_points").desc(), "seed")
    lead = standings.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top).select(SET, ID)
    a, b = lead.withColumnRenamed(ID, "a"), lead.withColumnRenamed(ID, "b")
    return a.join(b, SET).where(F.col("a") < F.col("b")).join(played.select(SET, "a", "b"), [SET, "a", "b"], "left_anti")


def standings(judgments: DataFrame) -> DataFrame:
    """Wins, losses, ties and points of everyone who was compared."""
    w = F.col("winner")
    sides = F.array(
        F.struct(F.col("a").alias(ID), (w == "A").cast("long").alias("win"), (w == "B").cast("long").alias("loss")),
        F.struct(F.col("b").alias(ID), (w == "B").cast("long").alias("win"), (w == "A").cast("long").alias("loss")),
    )
    flat = judgments.select(SET, F.inline(sides))
    return flat.groupBy(SET, ID).agg(
        F.sum("win").alias("wins"),
        F.sum("loss").alias("losses"),
        F.sum(1 - F.col("win") - F.col("loss")).alias("ties"),
        F.sum(F.col("win") * WIN + (1 - F.col("win") - F.col("loss")) * TIE).alias("points"),
    )


def head_to_head(judgments: DataFrame, table: DataFrame) -> DataFrame:
    """Points won against those with equally many points."""
    p = table.select(SET, ID, "points")
    w = F.col("winner")
    sides = F.array(
        F.struct(F.col("a").alias("me"), F.col("b").alias("foe"), F.when(w == "A", WIN).when(w == "TIE", TIE).otherwise(0.0).alias("got")),
        F.struct(F.col("b").alias("me"), F.col("a").alias("foe"), F.when(w == "B", WIN).when(w == "TIE", TIE).otherwise(0.0).alias("got")),
    )
    flat = judgments.select(SET, F.inline(sides))
    mine = p.select(SET, F.col(ID).alias("me"), F.col("points").alias("mp"))
    theirs = p.select(SET, F.col(ID).alias("foe"), F.col("points").alias("fp"))
    tied = flat.join(mine, [SET, "me"]).join(theirs, [SET, "foe"]).where(F.col("mp") == F.col("fp"))
    scored = tied.groupBy(SET, F.col("me").alias(ID)).agg(F.sum("got").alias("head_to_head"))
    return p.select(SET, ID).join(scored, [SET, ID], "left").withColumn("head_to_head", F.coalesce("head_to_head", F.lit(0.0)))


def final_order(seeded: DataFrame, judgments: DataFrame) -> DataFrame:
    """Total order of the survivors: adjusted points, points, head to head, listwise
    points, class, stopping power, seed.

    ``seeded`` carries penalty (already divided by 100), listwise_points, seed."""
    table = seeded.select(SET, ID).join(standings(judgments), [SET, ID], "left")
    filled = table.select(
        SET, ID, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("wins", "losses", "ties")],
        F.coalesce("points", F.lit(0.0)).alias("points"),
    )
    rows = seeded.join(filled, [SET, ID]).join(head_to_head(judgments, filled), [SET, ID])
    rows = rows.withColumn("adjusted_points", F.round(F.col("points") + F.col("penalty"), 6))
    order = Window.partitionBy(SET).orderBy(
        F.col("adjusted_points").desc(), F.col("points").desc(), F.col("head_to_head").desc(),
        F.col("listwise_points").desc(), class_rank("editorial_class").desc(), F.col("scroll_stop").desc(), "seed",
    )
    return rows.withColumn("final_rank", F.row_number().over(order).cast("long"))


def _band(index: Column, count: Column, band: tuple[float, float]) -> Column:
    high, low = band
    return F.when(count <= 1, F.lit(high)).otherwise(F.round(high - (high - low) * F.try_divide(index, count - 1), 2))


def emit_ranking(ordered: DataFrame, rejected: DataFrame, previous: DataFrame) -> DataFrame:
    """Survivors in order, then the rejected, with display scores in separate bands and
    the move against the previous ranking.

    ``rejected`` carries scroll_stop, confidence, decision; ``previous`` rank, score."""
    alive = ordered.select(SET, ID, F.col("final_rank").alias("rank"), F.lit("ranked").alias("status"))
    sizes = alive.groupBy(SET).agg(F.count(F.lit(1)).alias("_alive"))
    order = Window.partitionBy(SET).orderBy(F.col("scroll_stop").desc(), F.col("confidence").desc(), ID)
    gone = (
        rejected.withColumn("_i", F.row_number().over(order).cast("long"))
        .join(sizes, SET, "left")
        .select(
            SET, ID, (F.coalesce("_alive", F.lit(0)) + F.col("_i")).alias("rank"),
            F.when(F.col("decision") == "REJECT", "rejected_critic").otherwise("rejected_editorial").alias("status"),
        )
    )
    group = Window.partitionBy(SET, (F.col("status") == "ranked"))
    every = (
        alive.unionByName(gone)
        .withColumn("_n", F.count(F.lit(1)).over(group))
        .withColumn("_i", F.col("rank") - F.min("rank").over(group))
    )
    score = F.when(F.col("status") == "ranked", _band(F.col("_i"), F.col("_n"), SURVIVOR_BAND)).otherwise(
        _band(F.col("_i"), F.col("_n"), REJECTED_BAND)
    )
    prev = previous.select(SET, ID, F.col("rank").alias("previous_rank"))
    return every.join(prev, [SET, ID], "left").select(
        SET, ID, "rank", "status", score.alias("display_score"), "previous_rank",
        (F.col("previous_rank") - F.col("rank")).alias("rank_delta"),
    )
