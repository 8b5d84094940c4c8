"""Toxicity by weak supervision.

1. Lexicon and pattern voters. Features of a text are its lower-cased words and their
   beginnings of 4, 5 and 6 bytes, which stand for words with changing ends. From a bounded
   sample of labelled rows come the features that mark toxic rows; each voter holds a part
   of them (kind by kind, split in two by number), beside a fixed English list and patterns
   of shouting. A voter votes when one of its features occurs.
2. The generative label model. Means and covariances of the votes are counted over all
   documents. If voters i, j, k are independent given the hidden label, then
   cov(i, j) = p (1 - p) d_i d_j with d the difference a label makes to a vote, so
   d_i^2 = cov(i, j) cov(i, k) / (cov(j, k) p (1 - p)): the lower quartile over all such
   triples gives each voter's accuracy, as voters that repeat each other only raise it. What is left of the covariances is the correlation of the
   voters; it enters the posterior through the inverse of that matrix.
3. A linear classifier over the marked features is fitted to the posterior labels of the
   sample and scaled to its labels. It scores every document.

Labels come only from rows whose crc32 of the id modulo 3 is not 1. Only the labelled
sample (at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` rows), V x V sums and at most
``FEATURES`` features reach the driver; none grows with the input.

Defined results: null and empty texts have no features and get the score of a text
without any; null ids count as not held out and are never used for learning; several
labels of one id count as toxic if one does; without usable labels the fixed list alone
decides; repeated rows get equal scores; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .learning import fit, held_out, labelled_sample, platt
from .tables import map_text, pick
from .words import KINDS, Words, spans, words

TOXIC_ROWS = 4_000
CLEAN_ROWS = 8_000
FEATURES = 4_096
THRESHOLD = 0.7
_KINDS = 4  # whole words and beginnings of 4, 5, 6 bytes
# Common English insults.
INSULTS = ("clown", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless")


def features(part: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of all features of all words; the last two bits tell the kind."""
    numbers = [part.number]
    letters = KINDS["alnum_lower"][1][part.buffer]
    for k in (4, 5, 6):
        numbers.append(spans(letters, part.begin, np.minimum(part.begin + k, part.end)))
    row = part.row_of()
    return np.tile(row, _KINDS), np.concatenate([(x & ~np.uint64(3)) | np.uint64(i) for i, x in enumerate(numbers)])


def _insult_numbers() -> np.ndarray:
    part = next(words(pa.array([" ".join(INSULTS)]), "alnum_lower"))
    return part.number & ~np.uint64(3)


@dataclass
class Marks:
    """Sorted feature numbers, each with its voter (or -1)."""

    number: np.ndarray
    voter: np.ndarray
    voters: int

    def present(self, part: Words) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, index of the feature) that occur."""
        if not len(self.number) or not len(part.number):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, number = features(part)
        at = np.minimum(np.searchsorted(self.number, number), len(self.number) - 1)
        hit = self.number[at] == number
        both = np.unique(row[hit] * len(self.number) + at[hit])
        return both // len(self.number), both % len(self.number)

    def votes(self, part: Words) -> np.ndarray:
        """A 0/1 matrix, one row per text; the last two voters are patterns."""
        rows = len(part.counts)
        out = np.zeros((rows, self.voters + 2), bool)
        row, index = self.present(part)
        voter = self.voter[index]
        out[row[voter >= 0], voter[voter >= 0]] = True
        if len(part.number):
            first = np.minimum(part.first[:-1], len(part.number) - 1)
            upper = (part.buffer[part.begin] >= 0x41) & (part.buffer[part.begin] <= 0x5A) & (part.buffer[part.end - 1] <= 0x5A) & (part.end - part.begin > 1)
            marked = np.append(part.buffer, 0)[part.end] == 0x21
            some = part.counts > 0
            out[:, -2] = some & (3 * np.add.reduceat(upper.astype(np.int64), first) > part.counts)
            out[:, -1] = some & (4 * np.add.reduceat(marked.astype(np.int64), first) > part.counts)
        return out


@dataclass
class Model:
    """Sorted feature numbers with weights, and the score's scale."""

    number: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, part: Words) -> np.ndarray:
        row, index = Marks(self.number, self.number, 0).present(part)
        z = self.bias + np.bincount(row, self.weight[index], minlength=len(part.counts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _feature_counts(sample: DataFrame) -> list[tuple[int, int, int]]:
    """(number, rows with it, toxic rows with it) of the features that mark toxic rows best."""
    toxic = sample.filter("label = 1").count()
    least = max(3, toxic // 100)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy().astype(np.int64)
            for part in words(batch.column(1), "alnum_lower"):
                row, number = features(part)
                order = np.lexsort((row, number))
                row, number = row[order], number[order]
                new = np.append(True, (row[1:] != row[:-1]) | (number[1:] != number[:-1])) if len(row) else np.zeros(0, bool)
                row, number = row[new], number[new]
                number, first, n = np.unique(number, return_index=True, return_counts=True)
                t = np.add.reduceat(label[part.rows][row], first) if len(row) else n
                yield pa.RecordBatch.from_arrays([pa.array(number.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(t.astype(np.int64))], names=["number", "n", "t"])

    schema = T.StructType().add("number", "long").add("n", "long").add("t", "long")
    counts = sample.select("label", "text").mapInArrow(task, schema).groupBy("number").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    best = counts.filter((F.col("t") >= least) & (10 * F.col("t") >= 8 * F.col("n"))).orderBy(F.desc("t"), "number").limit(FEATURES)
    return [(r.number, r.n, r.t) for r in best.collect()]


def moments(docs: DataFrame, marks: Marks) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, sums of the votes, sums of their products) over all documents."""
    v = marks.voters + 2
    held = docs.sparkSession.sparkContext.broadcast(marks)
    schema = T.StructType().add("i", "integer").add("j", "integer").add("n", "long")
    i, j = (x.ravel().astype(np.int32) for x in np.indices((v + 1, v)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((v + 1, v), np.int64)
        for batch in batches:
            for part in words(batch.column(0), "alnum_lower"):
                x = held.value.votes(part).astype(np.int64)
                total[:v] += x.T @ x
                total[v] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "n"])

    rows = pick(docs, "text").mapInArrow(task, schema).groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((v + 1, v))
    for r in rows:
        total[r.i, r.j] = r.n
    return total[v, 0], np.diag(total[:v]).copy(), total[:v]


def label_model(n: float, ones: np.ndarray, both: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """(weights, offset) of the posterior's log odds as a function of the votes."""
    mean = ones / max(1, n)
    cov = both / max(1, n) - np.outer(mean, mean)
    spread = share * (1 - share)
    v = len(mean)
    d = np.zeros(v)
    for i in range(v):
        found = []
        for j in range(v):
            for k in range(j):
                if i not in (j, k) and cov[j, k] > 1e-7 and cov[i, j] > 0 and cov[i, k] > 0:
                    found.append(cov[i, j] * cov[i, k] / (cov[j, k] * spread))
        if found:
            d[i] = min(1.0, float(np.sqrt(np.quantile(found, 0.25))))
    # a vote's rates given the label stay rates
    one = np.clip(mean + (1 - share) * d, 1e-4, 1 - 1e-4)
    zero = np.clip(mean - share * d, 1e-4, 1 - 1e-4)
    d = one - zero
    rest = cov - spread * np.outer(d, d)
    alone = share * one * (1 - one) + (1 - share) * zero * (1 - zero)
    rest = 0.5 * (rest + rest.T)
    rest[np.diag_indices(v)] = np.maximum(alone, 1e-4)
    low = np.linalg.eigvalsh(rest)[0]
    if low < 1e-4:
        rest[np.diag_indices(v)] += 1e-4 - low
    weight = np.linalg.solve(rest, d)
    return weight, float(np.log(share / (1 - share)) - weight @ (one + zero) / 2)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier, from all documents and a bounded sample of labels."""
    docs = pick(docs, "doc_id", "text")
    fixed = _insult_numbers()
    fallback = Model(np.sort(fixed), np.full(len(fixed), 4.0), -3.0)
    sample, share = labelled_sample(docs, labels, "toxic", (CLEAN_ROWS, TOXIC_ROWS))
    found = _feature_counts(sample)
    if not found or not 0 < share < 1:
        return fallback
    number = np.array([f[0] for f in found], np.int64).view(np.uint64)
    support = np.array([f[2] for f in found], float)
    extra = np.setdiff1d(fixed, number)
    number, support = np.append(number, extra), np.append(support, np.ones(len(extra)))
    order = np.argsort(number)
    number, support = number[order], support[order]
    kind, half = (number & np.uint64(3)).astype(int), ((number >> np.uint64(7)) & np.uint64(1)).astype(int)
    voter = np.where(np.isin(number, fixed), 2 * _KINDS, 2 * kind + half)
    marks = Marks(number, voter, 2 * _KINDS + 1)
    weight, offset = label_model(*moments(docs, marks), share)

    # the sample's votes and features: bounded by its rows
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def work():
        def make(texts: pa.Array) -> dict[str, pa.Array]:
            votes, found = [], []
            for part in words(texts, "alnum_lower"):
                votes += held.value.votes(part).astype(float).tolist()
                row, index = held.value.present(part)
                cut = np.searchsorted(row, np.arange(len(part.counts) + 1))
                found += [index[cut[i] : cut[i + 1]] for i in range(len(part.counts))]
            return {"votes": pa.array(votes, pa.list_(pa.float64())), "found": pa.array(found, pa.list_(pa.int64()))}

        return make

    rows = map_text(sample, "votes array<double>, found array<bigint>", work, keep=["doc_id", "label"]).orderBy("doc_id").collect()
    label = np.array([r.label for r in rows], float)
    posterior = 1 / (1 + np.exp(-np.clip(offset + np.array([r.votes for r in rows]) @ weight, -500, 500)))
    row = np.repeat(np.arange(len(rows)), [len(r.found) for r in rows])
    index = np.array([i for r in rows for i in r.found], np.int64)
    # the sample holds more toxic rows than the corpus: weigh its rows back
    weigh = np.where(label == 1, share / max(1, label.sum()), (1 - share) / max(1, (1 - label).sum())) * len(rows)
    if label.min() == label.max():
        return fallback
    scale = np.sqrt(support / support.max())
    w, b = fit(row, index, len(rows), scale, posterior, np.ones(len(rows)))
    margin = b + np.bincount(row, w[index], minlength=len(rows))
    a, c = platt(margin, label, weigh)
    return Model(number, a * w, a * b + c)


def toxicity_scores(docs: DataFrame, model: Model, into: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``into`` that holds the score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        def make(texts: pa.Array) -> dict[str, pa.Array]:
            parts = [held.value.score(part) for part in words(texts, "alnum_lower")]
            return {"score": pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())}

        return make

    return map_text(docs, "score double", work, text=text, keep=keep, into=into)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = toxicity_scores(docs, learn(docs, labels), "toxicity", keep=["doc_id"])
    score = F.col("toxicity.score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"))
