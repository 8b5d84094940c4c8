"""A quality classifier by co-training.

Two views of a document: its content (shares of symbols, capitals, digits, breaks, distinct
words and the like, each as one of a few bins) and its metadata (language, source, length).
Each view has a classifier whose weights are log ratios of feature counts, so that they come
from sums over rows, however many there are. The first classifiers are made from a bounded
sample of labelled rows. In round r each classifier names the share r * ``CONFIDENT`` of *all*
unlabelled rows that it is most sure of, both ways, by quantiles of its odds over all of them;
the feature counts of these rows join the labelled ones of the other view, together weighing
``TRUST`` times that share of the labelled rows. At the end each view is calibrated on the
labelled rows, and the calibrated log odds are combined by weights fitted to the same rows.
The model scores every document.

Labels come only from rows whose crc32 of the id modulo 3 is not 1. The driver holds the
sample (``LABELLED`` rows of each label, as small features) and the feature counts. Figures
are made from the texts once and written; all later passes read those slim rows.

Defined results: null and empty texts have zero shares; null metadata is a value of its
own; null ids are never learned from; rows of equal odds at the edge of the confident share
are all named, and those of a label weigh together the same; without both labels every score
is the share of label 1; repeated rows count as often as they stand and get equal scores; very
long texts are read whole in parts; an empty table gives no rows; further columns are left out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import fit, held_out, labelled_sample, platt
from .tables import map_text, pick, written
from .words import offsets, words

LABELLED = 4_000
ROUNDS = 4
CONFIDENT = 0.05  # share of all unlabelled rows that a view names in the first round
TRUST = 0.5  # weight of a named row beside a labelled one
STRENGTH = 8.0  # a feature's counts are drawn towards both labels' by so many rows
_BINS = 8
_BUCKETS = 1 << 16
CONTENT = ("symbols", "capitals", "digits", "lines", "spaces", "marks", "other", "word_length", "distinct", "words")


def content(texts: pa.Array) -> np.ndarray:
    """One row of content figures per text."""
    out = [np.zeros((0, len(CONTENT)))]
    kinds = np.zeros(256, np.int64)
    for i, chars in enumerate((b"#*$%&|<>@^~_=+\\", bytes(range(65, 91)), b"0123456789", b"\n", b" \t\r\x0b\x0c", b".,;:!?'\"-()", bytes(range(128, 256)))):
        kinds[list(chars)] = i + 1
    for part in words(texts, "spaced"):
        n = len(part.counts)
        _, at = offsets(texts.slice(part.rows.start, n))
        size = np.diff(at)
        row = np.repeat(np.arange(n), size)
        share = np.bincount(row * 8 + kinds[part.buffer], minlength=8 * n).reshape(n, 8)[:, 1:] / np.maximum(1, size)[:, None]
        of = part.row_of()
        length = np.bincount(of, part.end - part.begin, minlength=n) / np.maximum(1, part.counts)
        order = np.lexsort((part.number, of))
        new = np.append(True, (part.number[order][1:] != part.number[order][:-1]) | (of[order][1:] != of[order][:-1])) if len(of) else np.zeros(0, bool)
        distinct = np.bincount(of[order][new], minlength=n) / np.maximum(1, part.counts)
        out.append(np.column_stack([share, length, distinct, np.log1p(part.counts)]))
    return np.concatenate(out)


def _metadata(docs: DataFrame) -> Column:
    """Three small numbers: buckets of language and source, and the length's magnitude."""
    def bucket(c: str) -> Column:
        return (F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(_BUCKETS))).cast("int")

    length = F.when(F.col("n_chars") > 0, F.floor(2 * F.log2(F.col("n_chars").cast("double"))).cast("int")).otherwise(-1) + 1
    return F.array(bucket("lang"), bucket("source"), F.least(F.greatest(length, F.lit(0)), F.lit(_BUCKETS - 1)))


@dataclass
class View:
    """A linear classifier over rows that each have a few of its features."""

    weight: np.ndarray
    bias: float

    def odds(self, on: np.ndarray) -> np.ndarray:
        return self.bias + self.weight[on].sum(axis=1)


def learned(counts: np.ndarray, total: np.ndarray) -> View:
    """The view whose features were counted ``counts[label]`` times in ``total[label]`` rows."""
    pooled = counts.sum(axis=0) / total.sum()
    drawn = (counts + STRENGTH * pooled) / (total[:, None] + STRENGTH)
    weight = np.zeros(counts.shape[1])
    known = pooled > 0
    weight[known] = np.log(drawn[1, known]) - np.log(drawn[0, known])
    return View(weight, float(np.log(total[1]) - np.log(total[0])))


def _on(edges: np.ndarray):
    """The features of a row in each view, as columns."""
    bins = [sum(((F.get("figures", F.lit(i)) >= F.lit(float(e))).cast("int") for e in row), F.lit(0)) + i * _BINS for i, row in enumerate(edges)]
    return F.array(*bins).alias("content"), F.transform("meta", lambda m, i: m + i * _BUCKETS).alias("metadata")


VIEWS = ("content", "metadata")


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def with_odds(rows: DataFrame, views: list[View], keep: list[str]) -> DataFrame:
    """``keep`` of each row and its odds in both views."""
    held = rows.sparkSession.sparkContext.broadcast(views)
    rows = rows.select(*keep, *[v for v in VIEWS if v not in keep])
    schema = T.StructType([rows.schema[k] for k in keep])
    for v in VIEWS:
        schema = schema.add(f"{v}_odds", "double")

    def task(batches):
        for b in batches:
            odds = [pa.array(view.odds(_matrix(b.column(v))), pa.float64()) for v, view in zip(VIEWS, held.value)]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *odds], names=schema.fieldNames())

    return rows.mapInArrow(task, schema)


def confident(unlabelled: DataFrame, views: list[View], share: float, take: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view (counts, rows) by label of those rows that the *other* is most sure of."""
    ask = [take * (1 - share), 1 - take * share]
    odds = with_odds(unlabelled, views, [])
    cuts = odds.agg(*[F.percentile_approx(f"{v}_odds", ask).alias(v) for v in VIEWS]).first()
    out = []
    rows = with_odds(unlabelled, views, list(VIEWS))
    sums = None
    for v, other in zip(VIEWS, reversed(VIEWS)):
        at, (low, high) = F.col(f"{v}_odds"), cuts[v] or (0.0, 0.0)
        label = F.when((at <= low) & (at < 0), 0).when((at >= high) & (at > 0), 1)
        # one more feature, -1, counts the rows themselves
        part = rows.withColumn("label", label).filter("label is not null").select(F.lit(other).alias("view"), "label", F.explode(F.concat(F.array(F.lit(-1)), other)).alias("feature"))
        sums = part if sums is None else sums.union(part)
    found = sums.groupBy("view", "label", "feature").agg(F.count("*").alias("n")).toPandas()
    for v, view in zip(VIEWS, views):
        counts, total = np.zeros((2, len(view.weight))), np.zeros(2)
        mine = found[found["view"] == v]
        one = mine["feature"].to_numpy() < 0
        np.add.at(total, mine["label"].to_numpy()[one], mine["n"].to_numpy()[one])
        counts[mine["label"].to_numpy()[~one], mine["feature"].to_numpy()[~one]] = mine["n"].to_numpy()[~one]
        out.append((counts, total))
    return out


def co_train(seen: list[np.ndarray], label: np.ndarray, weigh: np.ndarray, sizes: list[int], unlabelled: DataFrame, share: float, rounds: int = ROUNDS) -> tuple[list[View], np.ndarray]:
    """(both views, weights (a, b, c) of their calibrated sum). ``seen`` holds the features
    of the labelled rows in each view, ``sizes`` the number of features."""
    total = np.array([weigh[label == l].sum() for l in (0, 1)])
    counts = [np.array([np.bincount(on[label == l].ravel(), np.repeat(weigh[label == l], on.shape[1]), minlength=n) for l in (0, 1)]) for on, n in zip(seen, sizes)]
    views = [learned(c, total) for c in counts]
    for r in range(1, rounds + 1):
        named = confident(unlabelled, views, share, CONFIDENT * r)
        views = []
        for base, (more, n) in zip(counts, named):
            scale = np.where(n > 0, TRUST * CONFIDENT * r * total / np.maximum(1, n), 0.0)
            views.append(learned(base + scale[:, None] * more, total + scale * n))
    for v, view in enumerate(views):
        a, c = platt(view.odds(seen[v]), label, weigh)
        view.weight, view.bias = a * view.weight, a * view.bias + c
    odds = np.column_stack([view.odds(s) for view, s in zip(views, seen)])
    scale = max(1.0, float(np.abs(odds).max()))
    w, b = fit(np.repeat(np.arange(len(odds)), 2), np.tile([0, 1], len(odds)), len(odds), np.ones(2), label, weigh, values=(odds / scale).ravel())
    return views, np.array([w[0] / scale, w[1] / scale, b])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, content_score, metadata_score, score of every document."""
    docs = pick(docs, "doc_id", "text", "lang", "source", "n_chars").withColumn("meta", _metadata(docs))
    sample, share = labelled_sample(docs, labels, "quality", (LABELLED, LABELLED))

    def work():
        return lambda texts: {"figures": pa.array(content(texts).tolist(), pa.list_(pa.float64()))}

    rows = written(map_text(docs, "figures array<double>", work, keep=["doc_id", "meta"]))
    out = ["doc_id", held_out(F.col("doc_id")).alias("held_out")]
    sample = sample.select("doc_id", "label")
    if {r.label for r in sample.select("label").distinct().collect()} != {0, 1}:
        return rows.select(*out, *[F.lit(share).alias(c) for c in ("content_score", "metadata_score", "score")])
    cuts = rows.agg(*[F.percentile_approx(F.get("figures", F.lit(i)), [k / _BINS for k in range(1, _BINS)]).alias(c) for i, c in enumerate(CONTENT)]).first()
    labelled = pick(labels, "doc_id").distinct().withColumn("named", F.lit(True))
    rows = written(rows.select("doc_id", *_on(np.array(list(cuts)))).join(labelled, "doc_id", "left").withColumn("free", F.col("named").isNull() & F.col("doc_id").isNotNull()).drop("named"))
    # one row per id of the sample: the least, if an id has several
    known = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct(*VIEWS)).alias("on")).orderBy("label", "doc_id").collect()
    label = np.array([r.label for r in known], float)
    weigh = np.where(label == 1, share / label.sum(), (1 - share) / (1 - label).sum()) * len(label)
    seen = [np.array([r.on[v] for r in known]) for v in VIEWS]
    views, joint = co_train(seen, label, weigh, [_BINS * len(CONTENT), 3 * _BUCKETS], rows.filter("free"), share)

    def sigmoid(z: Column) -> Column:
        return 1 / (1 + F.exp(-z))

    joined = F.lit(float(joint[0])) * F.col("content_odds") + F.lit(float(joint[1])) * F.col("metadata_odds") + F.lit(float(joint[2]))
    scored = with_odds(rows, views, ["doc_id"])
    return scored.select(*out, *[sigmoid(F.col(f"{v}_odds")).alias(f"{v}_score") for v in VIEWS], sigmoid(joined).alias("score"))
