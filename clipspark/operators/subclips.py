"""Choosing the best stretch inside a candidate.

A candidate is at most a minute or two long, so its phrases, its seconds and the
start-end pairs tried are bounded per candidate; candidates are what spreads the work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipspark.operators import context, signals
from clipspark.operators.beside import Met, beside
from clipspark.operators.blocks import DAY_MS
from clipspark.operators.signals import CAND, payoff_ends, rounded

# Component weights, penalties and limits (milliseconds).
WEIGHTS = {
    "hook": 0.22, "payoff": 0.20, "payoff_coverage": 0.10, "mean_activity": 0.10,
    "completeness": 0.12, "setup_preserved": 0.08, "duration_prior": 0.06, "advisory_overlap": 0.12,
}
LEAD_PENALTY, TAIL_PENALTY = 12.0, 8.0
MIN_MS, TARGET_MIN_MS, TARGET_MAX_MS, MAX_MS = 8_000, 15_000, 30_000, 45_000
HOOK_MS, TAIL_MS, PRE_MS, POST_MS, GRID_MS = 3_000, 3_000, 150, 300, 500
BORING = 0.25
PHRASE_GAP_MS = 350
SNAP_MS = 60


class _Curves:
    """The curves of a batch in ten-thousandths, one after another: means, low shares and
    maxima of a span of one, each from a fixed number of look-ups."""

    def __init__(self, values: np.ndarray, edges: np.ndarray):
        self.first, self.last = edges[:-1], edges[1:] - 1
        self.sums, self.lows = (np.concatenate([[0], np.cumsum(x)]) for x in (values, values < int(BORING * 10_000)))
        longest = int((edges[1:] - edges[:-1]).max(initial=1))
        self.tops = [values]
        while 1 << len(self.tops) <= longest:
            top, half = self.tops[-1], 1 << len(self.tops) - 1
            self.tops.append(np.maximum(top, np.concatenate([top[half:], top[-1:].repeat(half)])[: len(top)]))

    def bins(self, of: np.ndarray, lo_ms: np.ndarray, hi_ms: np.ndarray):
        """The seconds that a span touches, ends clipped to the curve."""
        size = self.last[of] - self.first[of]
        lo, hi = (np.clip(ms // 1000, 0, size) + self.first[of] for ms in (lo_ms, np.maximum(lo_ms, hi_ms - 1)))
        return lo, hi

    def mean(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi + 1] - self.sums[lo]) / (10_000.0 * (hi - lo + 1))

    def low(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.lows[hi + 1] - self.lows[lo]) / (hi - lo + 1)

    def top(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp(hi - lo + 1)[1] - 1
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.maximum(self.tops[k][lo[at]], self.tops[k][hi[at] - (1 << int(k)) + 1])
        return out


def _score(curves: _Curves, of: np.ndarray, s: np.ndarray, e: np.ndarray, start_quality, end_quality, setup, peak, b0, b1, a0, a1) -> np.ndarray:
    """Score every (start, end) pair; ``of`` is the curve of each."""
    d = e - s
    head, body, late = (curves.bins(of, lo, hi) for lo, hi in ((s, np.minimum(e, s + HOOK_MS)), (s, e), ((s * 10 + d * 4) // 10, e)))
    inside = ((peak >= s) & (peak <= e)).astype(float)
    covered = np.maximum(0.0, np.minimum(e, b1) - np.maximum(s, b0))
    share = np.where(d < TARGET_MIN_MS, (d - MIN_MS) / float(TARGET_MIN_MS - MIN_MS), (MAX_MS - d) / float(MAX_MS - TARGET_MAX_MS))
    # fmin and fmax pass over a missing end of the advice
    meet = np.fmax(0.0, np.fmin(e, a1) - np.fmax(s, a0))
    parts = {
        "hook": curves.mean(*head),
        "payoff": 0.7 * (curves.top(*late) / 10_000.0) + 0.3 * inside,
        "payoff_coverage": np.where(b1 - b0 <= 0, 0.5, np.minimum(1.0, np.divide(covered, b1 - b0, out=np.zeros(len(s)), where=b1 - b0 != 0))),
        "mean_activity": curves.mean(*body),
        "completeness": 0.4 * start_quality + 0.6 * end_quality,
        "setup_preserved": np.select([np.isnan(setup), s <= setup + 250, s < peak], [0.5, 1.0, 0.5], 0.0),
        "duration_prior": np.where((d >= TARGET_MIN_MS) & (d <= TARGET_MAX_MS), 1.0, 0.35 + 0.65 * np.clip(share, 0.0, 1.0)),
    }
    advised = rounded(meet / (np.fmax(e, a1) - np.fmin(s, a0)))
    plain = None
    for name, part in parts.items():
        plain = rounded(part) * WEIGHTS[name] if plain is None else plain + rounded(part) * WEIGHTS[name]
    total, w = sum(WEIGHTS[n] for n in parts), WEIGHTS["advisory_overlap"]
    positive = np.where(np.isnan(a0), plain / total, (plain + advised * w) / (total + w))
    lead = rounded(LEAD_PENALTY * curves.low(*head))
    tail = rounded(TAIL_PENALTY * curves.low(*curves.bins(of, np.maximum(s, e - TAIL_MS), e)))
    return rounded(np.clip(100.0 * positive - lead - tail, 0.0, 100.0))


def _fitting(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = ends - starts[:, None]
    return np.nonzero((d >= MIN_MS) & (d <= MAX_MS))


def _phrases(start, end, terminal, gap, run, duration: int, peak: int):
    """Pairs on phrase edges: starts, ends, the quality of each, and when the peak's run begins."""
    snaps, stops = np.maximum(0, start - PRE_MS), np.minimum(duration, end + POST_MS)
    starts, ends = np.unique(np.append(snaps, 0)), np.unique(np.append(stops, duration))
    i, j = _fitting(starts, ends)
    if not len(i):
        return None
    snapped = (np.abs(starts[:, None] - snaps) < SNAP_MS).any(axis=1)
    near = np.abs(ends[:, None] - stops) < SNAP_MS
    quality = np.where(terminal, 1.0, np.where(gap >= PHRASE_GAP_MS, 0.65, 0.4))
    end_quality = np.where(near.any(axis=1), quality[near.argmax(axis=1)], 0.0)
    holding = np.flatnonzero((start <= peak) & (peak <= end))
    mine = run[holding[0]] if len(holding) else run[np.lexsort((run, start, np.abs(start - peak)))[0]]
    setup = max(0, int(start[np.flatnonzero(run == mine)[0]]) - PRE_MS)
    return starts[i], ends[j], np.where(snapped, 1.0, 0.3)[i], end_quality[j], setup


def _grid(duration: int):
    at = np.unique(np.minimum(np.arange(duration // GRID_MS + 2) * GRID_MS, duration))
    i, j = _fitting(at, at)
    half = np.full(len(i), 0.5)
    return (at[i], at[j], half, half, np.nan) if len(i) else None


def _search(names: list[str]):
    """The best pair of each candidate of a batch; pairs are scored a bounded number at a time."""

    def best(at: np.ndarray, tried: list, curves: _Curves, peak, spans: list[np.ndarray]):
        size = np.array([len(t[0]) for t in tried])
        of = np.repeat(at, size)
        s, e, sq, eq = (np.concatenate([t[k] for t in tried]) for k in range(4))
        setup = np.repeat(np.array([t[4] for t in tried], float), size)
        score = _score(curves, of, s, e, sq, eq, setup, peak[of], *(x[of] for x in spans))
        order = np.lexsort((s, e - s, -score, of))
        first = order[np.concatenate([[0], np.cumsum(size)[:-1]])]
        return s[first], e[first], score[first], size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = {n: (batch[n].flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(batch[n]).fill_null(0).to_numpy())])) for n in ("c", "us", "ue", "ut", "ug", "ur")}
            values, edges = flat["c"][0].to_numpy(zero_copy_only=False), flat["c"][1]
            curves = _Curves(values, edges)
            said = [flat[n][0].fill_null(False).to_numpy(zero_copy_only=False) if n == "ut" else flat[n][0].to_numpy(zero_copy_only=False) for n in ("us", "ue", "ut", "ug", "ur")]
            u = flat["us"][1]
            peak = np.array([int(values[a:b].argmax()) * 1000 for a, b in zip(edges, edges[1:])], np.int64)
            spans = [batch[n].cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for n in ("b0", "b1", "a0", "a1")]
            timed, length = batch["duration_ms"].is_valid().to_numpy(zero_copy_only=False), batch["duration_ms"].fill_null(MAX_MS).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            s, e, evaluated, how = np.zeros(n, np.int64), np.minimum(length, MAX_MS).astype(np.int64), np.zeros(n, np.int64), np.full(n, "full_candidate", object)
            score = rounded(100.0 * curves.mean(*curves.bins(np.arange(n), s, e)))
            at, tried, pairs, grids = [], [], 0, {}
            for i in range(n):
                d, found = int(length[i]), None
                if timed[i] and d > MIN_MS:
                    if u[i + 1] > u[i]:
                        found, how[i] = _phrases(*(x[u[i] : u[i + 1]] for x in said), d, int(peak[i])), "speech_units"
                    if found is None:
                        found, how[i] = grids.setdefault(d, None) or _grid(d), "grid"
                        grids[d] = found
                    if found is None:
                        how[i] = "full_candidate"
                    else:
                        at.append(i)
                        tried.append(found)
                        pairs += len(found[0])
                if at and (pairs > 500_000 or i == n - 1):
                    k = np.array(at)
                    s[k], e[k], score[k], evaluated[k] = best(k, tried, curves, peak, spans)
                    at, tried, pairs = [], [], 0
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in CAND), *map(pa.array, (how, s, e, score, evaluated))], names=names)

    return run


def _refined(rows: DataFrame) -> DataFrame:
    """The search over rows that hold all of a candidate: duration_ms, the curve ``c``, the units
    ``u`` (a list, or null), the advice a0, a1 and its duration."""

    def ms(c: str) -> Column:
        return (F.col(c) * 1000).cast("long")

    base = payoff_ends(rows, BORING).select(
        *CAND, "duration_ms", F.transform("c", lambda x: F.round(x["norm"] * 10_000).cast("long")).alias("c"),
        ms("start_offset").alias("b0"), ms("end_offset").alias("b1"), ms("a0").alias("a0"), ms("a1").alias("a1"),
        F.col("u.start_ms").alias("us"), F.col("u.end_ms").alias("ue"),
        F.col("u.terminal").alias("ut"), F.col("u.gap_after_ms").alias("ug"), F.col("u.run_index").alias("ur"),
    )
    types = [f"{c} {base.schema[c].dataType.simpleString()}" for c in CAND]
    schema = [*types, "boundary_source string", "start_ms long", "end_ms long", "score double", "evaluated long"]
    return base.mapInArrow(_search([c.split()[0] for c in schema]), ", ".join(schema))


def refine_subclip(cands: DataFrame, units: DataFrame, curve: DataFrame, advisory: DataFrame) -> DataFrame:
    """Best start and end inside each candidate: on phrase edges, else on a half-second
    grid, else the whole candidate up to the longest allowed.

    ``cands``: source_id, seq, duration_ms; ``units``: speech units with candidate
    offsets; ``curve``: source_id, seq, bin, norm; ``advisory``: source_id, seq, a0, a1
    in seconds (null when none), duration."""
    said = units.groupBy(*CAND).agg(
        F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "terminal", "gap_after_ms", "run_index"))).alias("u")
    )
    shape = curve.groupBy(*CAND).agg(F.sort_array(F.collect_list(F.struct("bin", "norm"))).alias("c"))
    advice = advisory.select(*CAND, "a0", "a1", "duration")
    return _refined(cands.select(*CAND, "duration_ms").join(shape, CAND).join(said, CAND, "left").join(advice, CAND, "left"))


def refine_spoken(cands: DataFrame, segments: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """``refine_subclip`` from the transcript alone: units and curve of a candidate are made
    where its segments meet it, and stay in its row.

    ``cands``: source_id, seq, start_ms, end_ms, duration_ms, a0, a1 in seconds (null when
    no advice)."""
    units, curve = context._units(150, False), signals._spoken

    def work(met: Met) -> dict[str, pa.Array]:
        return units(met) | curve(met)

    said = context.unit_segments(segments.withColumn("chars", F.length("text")), texts=False, keep=["chars"])
    fields = f"{context.UNIT_FIELDS}, {signals.SPOKEN_FIELDS}"
    rows = beside(cands, said, ("start_ms", "end_ms"), fields, work, block_ms)
    u = F.transform(
        F.arrays_zip("unit_start", "unit_end", "terminal", "gap_after", "run"),
        lambda x: F.struct(
            x["unit_start"].alias("start_ms"), x["unit_end"].alias("end_ms"), x["terminal"].alias("terminal"),
            x["gap_after"].alias("gap_after_ms"), x["run"].alias("run_index"),
        ),
    )
    rows = rows.select(*CAND, "duration_ms", "a0", "a1", F.sort_array(u).alias("u"), signals.by_second("combined").alias("spoken"))
    seconds = F.ceil(F.col("duration_ms") / 1000.0)
    return _refined(signals.settled(rows, [("transcript", "spoken")], seconds).withColumn("duration", F.col("duration_ms") / 1000.0))
