"""Near-duplicate documents by a grouped prefix join on word shingles.

A document's set holds its distinct shingles of lower-cased words. Two sets link when
intersection / union reaches a share (in whole numbers). A ``Rule`` gives both; the default
is three words and 0.9, the contract of op2. Under any fixed order of all shingles, two
linked sets share one of the first ``(1 - share) * n + 1`` shingles, the prefix. Here shingles of
rare words come first, so few prefixes meet by chance: words with a share of at least
``FREQUENT`` of all words, counted over the whole corpus, lower the rank. There can be no
more than 1 / FREQUENT such words, so the list sent to the tasks is bounded.

Equal sets become one member. Members with one prefix and size form a group, and prefixes
are joined between groups. Since documents are wanted by connected component, links come
in two steps. In each bucket of groups that share a prefix shingle, first every member is
set beside two members of the bucket only, and linked to the closest; this is done twice,
the second time across the components found. Then, exactly,
all pairs of groups that share a bucket, fit in size and position, and still lie in
different components are expanded to their members and compared. A pair that the second
step leaves out is connected already, so no link is lost; and a large group of copies
doesn't give all its pairs. Parity masks of the sets bound their difference from below: 256
bits inside the joins, then masks that grow with the set; few pairs that don't link are left
for verification, which counts the whole sets.

Memory of a task: rows of one Arrow batch. The buckets are joined by plain joins that Spark
may split; comparisons in one bucket are quadratic only in the groups of it that the first
step couldn't connect.

Defined results: null and empty texts, and texts without words, have no set and link with
nothing; repeated rows are copies; null ids stand for no id (a component of null ids only
has a null id); rows that share an id but not a text are separate documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Sieve, components, free_name, pick, written
from .words import Words, mix, runs, words

FREQUENT = 1 / 8192
_MASKS = ("m0", "m1", "m2", "m3")


@dataclass(frozen=True)
class Rule:
    """Words in a shingle, and the share of the union, in hundredths, from which sets link."""

    shingle: int = 3
    percent: int = 90

    def __post_init__(self) -> None:
        if self.shingle < 1 or not 0 < self.percent <= 100:
            raise ValueError(f"no rule for near duplicates: {self}")

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Length of the prefix of a set of ``n`` shingles."""
        return (100 - self.percent) * n // 100 + 1

    def behind(self, n: Column) -> Column:
        """Shingles behind the prefix."""
        return n - F.floor((100 - self.percent) * n / 100) - 1

    def fits(self, n_a: Column, n_b: Column) -> Column:
        """Whether sets of these sizes may link."""
        return 100 * F.least(n_a, n_b) >= self.percent * F.greatest(n_a, n_b)

    def common(self, both: Column) -> Column:
        """Shingles that linked sets share at least, where ``both`` is the sum of the sizes."""
        return F.ceil(self.percent * both / (100 + self.percent))


RULE = Rule()


def frequent_words(docs: DataFrame, share: float = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, class): the words with at least about ``share`` of all words, sorted by
    number; the class rises by one each time the share doubles. Words under an eighth of
    the share in a stretch of text are left out of its counts, so a count is short by at
    most an eighth of ``share``."""
    schema = T.StructType().add("number", "long").add("n", "long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words(batch.column(0), "spaced_lower"):
                number, n = np.unique(part.number, return_counts=True)
                often = n >= share / 8 * len(part.number)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(number[often].view(np.int64), 0)), pa.array(np.append(n[often], len(part.number)).astype(np.int64)),
                ], names=["number", "n"])

    counts = pick(docs, "text").mapInArrow(task, schema).groupBy("number").agg(F.sum("n").alias("n"))
    counts = written(counts)  # the row of number 0 holds the sum of all words
    total = counts.filter("number = 0").agg(F.sum("n")).first()[0] or 0
    rows = counts.filter((F.col("number") != 0) & (F.col("n") >= total * share * 7 / 8)).collect()
    number = np.array([r.number for r in rows], np.int64).view(np.uint64)
    n = np.array([r.n for r in rows], float)
    order = np.argsort(number)
    return number[order], (1 + np.log2(np.maximum(1, n[order] / max(1, total) / share))).astype(np.uint64)


def _sets(part: Words, number: np.ndarray, level: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, rank) of the distinct shingles of each row, in ascending order."""
    cls = np.zeros(len(part.number), np.uint64)
    if len(number):
        at = np.minimum(np.searchsorted(number, part.number), len(number) - 1)
        cls = np.where(number[at] == part.number, level[at], cls)
    starts, value = part.windows(shingle)
    low = cls[starts]
    for k in range(1, shingle):
        low = np.minimum(low, cls[starts + k])
    row = np.searchsorted(part.first, starts, "right") - 1
    short = np.flatnonzero((part.counts > 0) & (part.counts < shingle))
    row = np.concatenate([row, short])
    rank = np.concatenate([(low << np.uint64(60)) | (value >> np.uint64(4)), runs(part.number, part.first[short], part.first[short + 1]) >> np.uint64(4)])
    order = np.lexsort((rank, row))
    row, rank = row[order], rank[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (rank[1:] != rank[:-1])
    return row[new], rank[new]


def members(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(doc_id, rid, n, sk, m0..m3, mask, prefix) of every row of (doc_id, rid, text): the
    size of its set, the number of the set (null if empty), a parity mask of 256 bits, one
    of four to eight bits for each shingle, and the prefix."""
    held = docs.sparkSession.sparkContext.broadcast(frequent_words(docs))
    schema = T.StructType([docs.schema["doc_id"], docs.schema["rid"]]).add("n", "long").add("sk", "long")
    for m in _MASKS:
        schema = schema.add(m, "long")
    schema = schema.add("mask", "binary").add("prefix", T.ArrayType(T.LongType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, level = held.value
        for batch in batches:
            for part in words(batch.column(2), "spaced_lower"):
                row, rank = _sets(part, number, level, rule.shingle)
                rows = len(part.counts)
                n = np.bincount(row, minlength=rows)
                first = np.cumsum(n) - n
                some = np.flatnonzero(n)
                spread = mix(rank)
                sk, masks = np.zeros(rows, np.uint64), np.zeros((4, rows), np.uint64)
                if len(some):
                    sk[some] = mix(np.add.reduceat(spread, first[some]) + n[some].astype(np.uint64))
                    bit = np.uint64(1) << (spread & np.uint64(63))
                    lane = (spread >> np.uint64(6)) & np.uint64(3)
                    for k in range(4):
                        masks[k, some] = np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), first[some])
                bits = 1 << np.ceil(np.log2(np.maximum(64, 4 * n))).astype(np.int64)
                place = np.cumsum(bits) - bits
                flips = np.bincount(place[row] + (spread & (bits[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(bits.sum())) & 1
                packed = np.packbits(flips.astype(bool), bitorder="little").tobytes()
                mask = [packed[a // 8 : (a + b) // 8] for a, b in zip(place.tolist(), bits.tolist())]
                p = np.where(n > 0, rule.prefix(n), 0)
                taken = np.repeat(first, p) + np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
                offsets = np.concatenate([[0], np.cumsum(p)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rank[taken].view(np.int64)))
                here = slice(part.rows.start, part.rows.stop)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[here], batch.column(1)[here], pa.array(n.astype(np.int64)), pa.array(sk.view(np.int64), mask=n == 0),
                    *[pa.array(m.view(np.int64)) for m in masks], pa.array(mask, pa.binary()), prefix,
                ], names=schema.fieldNames())

    return docs.select("doc_id", "rid", "text").mapInArrow(task, schema)


def _may_link(n_a: Column, n_b: Column, differ: Column, rule: Rule) -> Column:
    """Sizes fit, and a lower bound of the sets' difference leaves room for a link."""
    both = n_a + n_b
    return rule.fits(n_a, n_b) & (differ <= both - 2 * rule.common(both))


def _bits(pairs) -> Column:
    total = F.lit(0)
    for x in pairs:
        total = total + F.bit_count(x)
    return total


def sifted(pairs: DataFrame, slim: DataFrame, rule: Rule = RULE) -> DataFrame:
    """(a, b, gap) of the pairs whose long masks leave room for a link. Two masks differ in
    no more bits than the sets in shingles; the longer one is folded to the shorter's
    length. ``gap`` is that difference as a share of both sizes."""
    one = slim.select(F.col("sk").alias("a"), F.col("n").alias("na"), F.col("mask").alias("ma"))
    two = slim.select(F.col("sk").alias("b"), F.col("n").alias("nb"), F.col("mask").alias("mb"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ma", "mb")

    def fold(x: np.ndarray, size: int) -> np.ndarray:
        return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            differ = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                differ[i] = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
            may = differ <= both - 2 * (-(-rule.percent * both // (100 + rule.percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(differ / both)], names=["a", "b", "gap"]).filter(pa.array(may))

    return rows.mapInArrow(task, "a bigint, b bigint, gap double")


def verified(pairs: DataFrame, slim: DataFrame, docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The pairs (a, b) of set numbers whose sets link. Only texts of sets in a pair are
    shuffled: a filter of fixed size holds back the rest."""
    pairs = written(pairs)
    wanted = written(pairs.select(F.col("a").alias("sk")).union(pairs.select("b")).distinct().join(slim.select("sk", "rid"), "sk"))
    texts = Sieve(wanted.select("rid")).rows(docs.select("rid", "text"), "rid").join(wanted, "rid")
    texts = written(texts.select("sk", "text").dropDuplicates(["sk"]))
    t = texts.select(F.col("sk").alias("a"), F.col("text").alias("text_a"))
    u = texts.select(F.col("sk").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(t, "a").join(u, "b").select("a", "b", "text_a", "text_b")
    none = np.zeros(0, np.uint64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_pylist() for i in (0, 1)]
            sets: dict[int, np.ndarray] = {}
            for side in (0, 1):
                fresh = list({k: i for i, k in enumerate(keys[side]) if k not in sets}.items())
                column = batch.column(2 + side).take(pa.array([i for _, i in fresh], pa.int64()))
                for part in words(column, "spaced_lower"):
                    row, rank = _sets(part, none, none, rule.shingle)
                    cut = np.searchsorted(row, np.arange(len(part.counts) + 1))
                    for i in range(len(part.counts)):
                        sets[fresh[part.rows.start + i][0]] = rank[cut[i] : cut[i + 1]]
            good = []
            for i, (a, b) in enumerate(zip(*keys)):
                x, y = sets[a], sets[b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= rule.percent * (len(x) + len(y) - common):
                    good.append(i)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    return written(rows.mapInArrow(task, T.StructType().add("a", "long").add("b", "long")))


def _posts(table: DataFrame) -> DataFrame:
    """(token, g, n, pos): prefix shingles of the groups, without most of those that only
    one set has."""
    shared = table.select(F.explode("prefix").alias("token"), "sk").groupBy("token").agg(F.min("sk").alias("x"), F.max("sk").alias("y")).filter("x != y").select("token")
    sieve = Sieve(shared)
    schema = T.StructType().add("token", "long").add("g", "long").add("n", "long").add("pos", "integer")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            token = batch.column(2).flatten().to_numpy()
            pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            keep = sieve.passes(token)
            g, n = (np.repeat(batch.column(i).to_numpy(), size)[keep] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(g), pa.array(n), pa.array(pos[keep].astype(np.int32))], names=schema.fieldNames())

    return table.select("g", "n", "prefix").mapInArrow(task, schema).groupBy("token", "g").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))


def linked_sets(docs: DataFrame, rule: Rule = RULE) -> tuple[DataFrame, DataFrame]:
    """(members table, labels (sk, component)) for docs of (doc_id, rid, text); sets that
    link with no other set have no label."""
    table = written(members(docs, rule).withColumn("g", F.when(F.col("n") > 0, F.xxhash64("n", "prefix"))))
    some = table.filter("n > 0")
    posts = written(_posts(some))
    slim = some.groupBy("sk").agg(F.min("rid").alias("rid"), F.first("g").alias("g"), F.first("n").alias("n"), *[F.first(m).alias(m) for m in (*_MASKS, "mask")])
    slim = written(slim.join(posts.select("g").distinct(), "g", "left_semi"))
    edges, labels = None, None
    for seeds in ((1, 2), (3, 4)):
        known = _with_component(slim, labels)
        stars = written(sifted(_stars(posts, known, seeds[0], rule).union(_stars(posts, known, seeds[1], rule)).distinct(), slim, rule))
        # each member's closest one; the rest stage finds what these don't connect
        ends = stars.select(F.col("a").alias("m"), "gap", "a", "b").union(stars.select("b", "gap", "a", "b"))
        closest = ends.groupBy("m").agg(F.min(F.struct("gap", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        found = verified(closest, slim, docs, rule)
        edges = found if edges is None else edges.union(found)
        labels = components(edges)
    rest = verified(sifted(_rest(posts, _with_component(slim, labels), rule), slim, rule).select("a", "b"), slim, docs, rule)
    labels = components(edges.union(rest))
    return table, labels.select(F.col("node").alias("sk"), "component")


def _with_component(slim: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members with their component so far: themselves, if nothing links to them."""
    slim = slim.drop("mask", "rid")
    if labels is None:
        return slim.withColumn("component", F.col("sk"))
    known = slim.join(labels.select(F.col("node").alias("sk"), "component"), "sk", "left").withColumn("component", F.coalesce("component", "sk"))
    return written(known)


def _stars(posts: DataFrame, slim: DataFrame, seed: int, rule: Rule) -> DataFrame:
    """Pairs of each member with one member of each of its buckets, if they lie in
    different components."""
    one = slim.groupBy("g").agg(F.min(F.struct(F.xxhash64("sk", F.lit(seed)).alias("h"), "sk", "component", "n", *_MASKS)).alias("one"))
    centre = posts.groupBy("token").agg(F.min(F.struct(F.xxhash64("g", "token", F.lit(seed)).alias("h"), F.col("g").alias("c"), F.col("n").alias("cn"))).alias("centre"))
    pairs = posts.join(centre.select("token", "centre.c", "centre.cn"), "token").filter(rule.fits(F.col("n"), F.col("cn"))).filter("g != c").select("g", "c")
    pairs = pairs.distinct().union(slim.groupBy("g").agg(F.count("*").alias("size")).filter("size > 1").select("g", F.col("g").alias("c")))
    ends = slim.join(pairs, "g").join(one.select(F.col("g").alias("c"), "one"), "c")
    differ = _bits([F.col(m).bitwiseXOR(F.col(f"one.{m}")) for m in _MASKS])
    may = (F.col("component") != F.col("one.component")) & _may_link(F.col("n"), F.col("one.n"), differ, rule)
    return ends.filter(may).select(F.least("sk", "one.sk").alias("a"), F.greatest("sk", "one.sk").alias("b"))


def _rest(posts: DataFrame, slim: DataFrame, rule: Rule) -> DataFrame:
    """All pairs of members that share enough prefix shingles, may link, and lie in
    different components."""
    slim = written(slim.withColumn("part", F.xxhash64("g", "component")))
    parts = slim.groupBy("g", "part", "component", "n").agg(*[F.bit_and(m).alias(f"all_{m}") for m in _MASKS], *[F.bit_or(m).alias(f"any_{m}") for m in _MASKS])
    rows = posts.drop("n").join(parts, "g")
    split = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("token")
    rows = written(rows.join(split, "token", "left_semi").drop("g"))
    a, b = rows.alias("a"), rows.alias("b")
    col = lambda side, name: F.col(f"{side}.{name}")
    # bits that all of one side have and none of the other
    differ = _bits([(col("a", f"all_{m}").bitwiseAND(F.bitwise_not(col("b", f"any_{m}")))).bitwiseOR(col("b", f"all_{m}").bitwiseAND(F.bitwise_not(col("a", f"any_{m}")))) for m in _MASKS])
    common = F.least(col("a", "n") - col("a", "pos"), col("b", "n") - col("b", "pos"))
    fits = (
        (col("a", "token") == col("b", "token")) & (col("a", "part") < col("b", "part")) & (col("a", "component") != col("b", "component"))
        & _may_link(col("a", "n"), col("b", "n"), differ, rule)
    )
    # no more can be shared than before both places and from both places on
    fits &= common + F.least(col("a", "pos"), col("b", "pos")) >= rule.common(col("a", "n") + col("b", "n"))
    met = a.join(b, fits).select(col("a", "part").alias("pa"), col("b", "part").alias("pb"), col("a", "n").alias("x"), col("b", "n").alias("y"))
    # Up to the end of the prefix that ends first, what two sets share stands in both
    # prefixes; behind it at most the rest of that set is shared.
    behind = F.greatest(rule.behind(F.col("x")), rule.behind(F.col("y")))
    met = met.groupBy("pa", "pb", "x", "y").agg(F.count("*").alias("c"))
    pairs = met.filter(F.col("c") + behind >= rule.common(F.col("x") + F.col("y"))).select("pa", "pb")
    left = slim.select(F.col("part").alias("pa"), F.col("sk").alias("a"), F.col("n").alias("na"), *[F.col(m).alias(f"a{m}") for m in _MASKS])
    right = slim.select(F.col("part").alias("pb"), F.col("sk").alias("b"), F.col("n").alias("nb"), *[F.col(m).alias(f"b{m}") for m in _MASKS])
    both = pairs.join(left, "pa").join(right, "pb")
    may = _may_link(F.col("na"), F.col("nb"), _bits([F.col(f"a{m}").bitwiseXOR(F.col(f"b{m}")) for m in _MASKS]), rule)
    return both.filter(may).select("a", "b")


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("rid"), F.col(f"`{text}`").alias("text"))


def duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = RULE) -> DataFrame:
    """(doc_id, rid, n_shingles, component_id) of every row; component_id is the smallest
    id that links reach."""
    table, labels = linked_sets(_numbered(docs, key, text), rule)
    rows = table.select("doc_id", "rid", "n", "sk").join(labels, "sk", "left").withColumn("component", F.coalesce("component", "sk"))
    least = rows.filter("sk is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "component", "left").select("doc_id", "rid", F.col("n").alias("n_shingles"), F.when(F.col("sk").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = RULE) -> DataFrame:
    """The rows of ``docs`` with one row left of each component: the smallest id (null
    ids last), and one copy if its row is repeated. Rows without words stay."""
    table, labels = linked_sets(_numbered(docs, key, text), rule)
    rows = table.select("doc_id", "rid", "sk").join(labels, "sk", "left").withColumn("component", F.coalesce("component", "sk"))
    first = rows.filter("sk is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid")).alias("one")).select(F.col("one.rid").alias("rid"), F.lit(True).alias("once"))
    stay = written(first.union(rows.filter("sk is null").select("rid", F.lit(False)).distinct()))
    rid, once, nth = free_name(docs, "rid"), free_name(docs, "once"), free_name(docs, "nth")
    marked = docs.withColumn(rid, F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))).join(stay.select(F.col("rid").alias(rid), F.col("once").alias(once)), rid)
    marked = marked.withColumn(nth, F.row_number().over(Window.partitionBy(rid).orderBy(rid)))
    return marked.filter((F.col(nth) == 1) | ~F.col(once)).select(*[F.col(f"`{c}`") for c in docs.columns])


def class_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return duplicate_classes(docs).select("doc_id", "n_shingles", "component_id")
