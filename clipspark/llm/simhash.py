"""SimHash fingerprints of whole texts, and the search for near ones by permuted block tables.

A text's terms are its pairs of neighbouring words (runs of other characters than
``\\x20\\x09-\\x0D``; the last word is paired with nothing), each as often as it occurs. A term
has a hash of 128 bits and a weight, the code points of its words, at most ``HEAVIEST``. It
votes with its weight for the bits that are set in its hash and against the others; the
fingerprint's bits are the signs of the sums. Two fingerprints that differ in a share x of
their bits belong to term vectors at an angle of about pi * x, so their likeness is
cos(pi * x), not below 0.

Only DataFrame functions are used. Terms are exploded and summed in one generated loop:
bits i and i + 32 of a hash share one sum, in its lower and upper half, so 64 bits need 32
sums. What is shuffled are these sums, once a row, never terms.

To find all fingerprints within a Hamming radius r, the 128 bits are cut into r + 2 blocks: two
fingerprints within r agree on two blocks at least. There is one table for each two blocks,
in which these stand in front as the key; each pair is compared in the first table in which
its keys meet. Equal fingerprints are one row of the tables, with their number.

Defined results: a null text is empty; a text without words has no votes and a fingerprint of
zeros; repeated rows are fingerprinted each; texts may have any length that a row can hold
(votes stay below 2 ** 31, which takes a text of 1 GB); an empty table gives no rows; other columns are ignored, whatever
their names. The next document is the one of the next larger doc_id (null is the smallest),
of several rows with that id the one whose text has the least MD5; after the largest id
comes the smallest, which may be the row's own."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import free_name, pick, written

HEAVIEST = 64
BITS = 128
RADIUS = 6
#: The ids divisible by it are the queries of the registered search.
QUERY_STEP = 100
_LANES = (1 << 32) + 1


def _large(df: DataFrame) -> DataFrame:
    """A side of a join that must not be broadcast: Spark sizes files as they are packed, and
    rows after an explode as if each had stayed one."""
    return df.hint("merge")


def fingerprints(df: DataFrame, keep: list[str], texts: list[str]) -> DataFrame:
    """The columns ``keep`` and for each text column t its fingerprint in two halves,
    ``t_0`` and ``t_1`` of type long. ``keep`` holds small columns."""
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    keys = ["row", *[f"k{i}" for i in range(len(keep))], "which"]
    one_each = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.coalesce(F.col(f"`{t}`"), F.lit("")).alias("text")) for i, t in enumerate(texts)]))
    rows = df.withColumn(unique := free_name(df, "row"), F.monotonically_increasing_id())  # before the rows are multiplied
    rows = rows.select(F.col(unique).alias("row"), *kept, one_each.alias("t")).select(*keys[:-1], "t.which", F.btrim("t.text", F.lit(" \t\n\x0b\x0c\r")).alias("text"))
    rows = rows.withColumn("words", F.split("text", r"[\x20\x09-\x0D]+"))
    pairs = F.explode(F.arrays_zip(F.col("words").alias("a"), F.expr("concat(slice(words, 2, size(words)), array(''))").alias("b")))
    terms = rows.select(*keys, pairs.alias("p")).select(
        *keys,
        F.least(F.length("p.a") + F.length("p.b"), F.lit(HEAVIEST)).cast("long").alias("weight"),
        F.xxhash64("p.a", "p.b").alias("h0"),
        F.xxhash64("p.b", "p.a", F.lit(1)).alias("h1"),
    )
    sums = [F.sum(F.col("weight") * F.shiftrightunsigned(f"h{half}", i).bitwiseAND(F.lit(_LANES))).alias(f"s{half}_{i}") for half in (0, 1) for i in range(32)]
    votes = terms.groupBy(*keys).agg(F.sum("weight").alias("all"), *sums)

    def bits(half: int) -> Column:
        low = [F.when(2 * F.col(f"s{half}_{i}").bitwiseAND(F.lit((1 << 32) - 1)) > F.col("all"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(32)]
        high = [F.when(2 * F.shiftrightunsigned(f"s{half}_{i}", 32) > F.col("all"), F.lit((1 << (i + 32)) - (1 << 64 if i == 31 else 0))).otherwise(F.lit(0)) for i in range(32)]
        out = F.lit(0).cast("long")
        for b in low + high:
            out = out.bitwiseOR(b.cast("long"))
        return out

    prints = votes.select(*keys, bits(0).alias("f0"), bits(1).alias("f1"))
    halves = [F.max(F.when(F.col("which") == i, F.col(f"f{half}"))).alias(f"{t}_{half}") for i, t in enumerate(texts) for half in (0, 1)]
    wide = prints.groupBy(*keys[:-1]).agg(*halves)
    return wide.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[f"`{t}_{half}`" for t in texts for half in (0, 1)])


def as_text(f0: str, f1: str) -> Column:
    """A fingerprint's 32 hex digits."""
    return F.concat(*[F.lpad(F.lower(F.hex(f)), 16, "0") for f in (f0, f1)])


def likeness(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Estimated cosine of the term vectors behind two fingerprints, from 0 to 1."""
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b)), F.lit(0))
    return F.greatest(F.lit(0.0), F.cos(apart * F.lit(3.141592653589793 / BITS)))


def with_next(docs: DataFrame, step: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` (doc_id, text) with ``own``, the MD5 of the text, and ``gift``, the first
    ``step`` code points of the next document; (zero, id, next_zero, next_id, own) for each id).

    Ids are put in order as slim rows by range partitioning; only each range's first and last
    id meet in one task. Then every document sends its beginning to the rows of the id before."""
    rows = docs.select(F.col("doc_id").isNull().alias("zero"), F.coalesce("doc_id", F.lit(0)).alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slim = rows.select("zero", "id", F.md5("text").alias("own"), step.cast("long").alias("wanted"))
    ids = slim.groupBy("zero", "id").agg(F.min("own").alias("own"), F.max("wanted").alias("wanted"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct((~F.col("zero")).alias("last"), "id", "wanted")  # null ids first
    ranged = written(ids.select(place.alias("p"), "own").repartitionByRange(n, "p").withColumn("part", F.spark_partition_id()))
    edges = ranged.groupBy("part").agg(F.min("p").alias("low"), F.max("p").alias("high"))  # a row per range
    every = Window.partitionBy()
    edges = edges.select(
        "part",
        F.coalesce(F.lead("low").over(every.orderBy("part")), F.min("low").over(every)).alias("after"),
        F.coalesce(F.lag("high").over(every.orderBy("part")), F.max("high").over(every)).alias("before"),
    )
    inside = Window.partitionBy("part").orderBy("p")
    linked = ranged.select("part", "own", "p", F.lead("p").over(inside).alias("following"), F.lag("p").over(inside).alias("leading")).join(F.broadcast(edges), "part")
    linked = linked.select("own", "p", F.coalesce("following", "after").alias("following"), F.coalesce("leading", "before").alias("leading"))
    links = written(
        linked.selectExpr("not p.last as zero", "p.id as id", "own", "not following.last as next_zero", "following.id as next_id", "not leading.last as to_zero", "leading.id as to_id", "leading.wanted as wanted")
    )
    # `own` is the least MD5 of an id, so only its row is not above it
    gifts = rows.join(_large(links.withColumnRenamed("own", "least")), ["zero", "id"]).filter(F.md5("text") <= F.col("least"))
    gifts = written(gifts.selectExpr("to_zero as zero", "to_id as id", "substring(text, 1, cast(wanted as int)) as gift").dropDuplicates(["zero", "id"]))
    return rows.join(_large(gifts), ["zero", "id"]), links.select("zero", "id", "next_zero", "next_id", "own")


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (q0, q1, f0, f1, apart) of a fingerprint of ``queries`` and one of ``prints``
    (columns f0, f1 of type long; both distinct) whose bits differ in ``radius`` places at most."""
    n = radius + 2
    cuts = [BITS * i // n for i in range(n + 1)]

    def block(a: str, b: str, i: int) -> Column:
        """Bits cuts[i] to cuts[i + 1] of the 128; a block may lie in both halves."""
        parts = []
        for half, name in enumerate((a, b)):
            low, high = max(cuts[i], 64 * half), min(cuts[i + 1], 64 * half + 64)
            if low < high:
                parts.append(F.shiftrightunsigned(name, low - 64 * half).bitwiseAND(F.lit((1 << (high - low)) - 1 if high - low < 64 else -1)))
        return parts[0] if len(parts) == 1 else F.shiftleft(parts[1], min(cuts[i + 1], 64) - cuts[i]).bitwiseOR(parts[0])

    def tables(df: DataFrame, a: str, b: str) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.xxhash64(F.lit(i * n + j), block(a, b, i), block(a, b, j)).alias("key")) for i, j in combinations(range(n), 2)]
        return df.select(a, b, F.explode(F.array(*keys)).alias("t")).select(a, b, "t.i", "t.j", "t.key")

    left = tables(queries.select(F.col("f0").alias("q0"), F.col("f1").alias("q1")), "q0", "q1")
    pairs = left.join(_large(tables(prints.select("f0", "f1"), "f0", "f1")), ["key", "i", "j"])
    same = [(block("q0", "q1", i) == block("f0", "f1", i)).cast("int") for i in range(n)]
    # the first table in which two fingerprints meet is that of the first two blocks they share
    before = sum((F.when(F.col("j") > i, same[i]).otherwise(0) for i in range(n)), F.lit(0))
    own = F.lit(False)
    for i, j in combinations(range(n), 2):
        own = own | ((F.col("i") == i) & (F.col("j") == j) & (same[i] + same[j] == 2))
    apart = F.bit_count(F.col("q0").bitwiseXOR(F.col("f0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("f1")))
    return pairs.filter((apart <= radius) & own & (before == 1)).select("q0", "q1", "f0", "f1", apart.alias("apart"))


def fingerprint_table(documents: DataFrame) -> DataFrame:
    """Per document: n_chars, its fingerprint and that of its edited text, whose last quarter
    is replaced by the beginning of the next document, their likeness (``near_edited``), the
    likeness to the next document (``near_next``), and for each doc_id divisible by
    ``QUERY_STEP`` the number of other documents within ``RADIUS`` bits (``n_near``)."""
    docs = pick(documents, "doc_id", "text")
    quarter = F.floor(F.length("text") / 4)
    rows, links = with_next(docs, quarter)
    kept = F.expr("substring(text, 1, length(text) - length(text) div 4)")
    edited = F.concat(kept, F.expr("substring(gift, 1, cast(length(text) div 4 as int))"))
    rows = rows.select("doc_id", "zero", "id", "text", edited.alias("edited")).select("*", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("own"), F.sha2("edited", 256).alias("edited_sha256"))
    prints = written(fingerprints(rows, ["doc_id", "zero", "id", "own", "n_chars", "edited_sha256"], ["text", "edited"]))
    first = prints.join(_large(links.select("zero", "id", "own")), ["zero", "id", "own"]).groupBy("zero", "id").agg(F.min("text_0").alias("n0"), F.min("text_1").alias("n1"))
    nexts = links.select("zero", "id", F.col("next_zero"), F.col("next_id")).join(_large(first.select(F.col("zero").alias("next_zero"), F.col("id").alias("next_id"), "n0", "n1")), ["next_zero", "next_id"])
    distinct = written(prints.groupBy(F.col("text_0").alias("f0"), F.col("text_1").alias("f1")).agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("doc_id") % QUERY_STEP == 0, F.lit(False))).alias("asked")))
    pairs = within(distinct.filter("asked"), distinct).join(_large(distinct.select("f0", "f1", "n")), ["f0", "f1"])
    near = pairs.groupBy("q0", "q1").agg(F.sum("n").alias("found"))
    out = prints.join(_large(nexts.select("zero", "id", "n0", "n1")), ["zero", "id"]).join(_large(near.withColumnsRenamed({"q0": "text_0", "q1": "text_1"})), ["text_0", "text_1"], "left")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("text_0", "text_1").alias("fingerprint"),
        as_text("edited_0", "edited_1").alias("edited_fingerprint"),
        likeness(("text_0", "text_1"), ("edited_0", "edited_1")).alias("near_edited"),
        likeness(("text_0", "text_1"), ("n0", "n1")).alias("near_next"),
        F.when(F.col("doc_id") % QUERY_STEP == 0, F.col("found") - 1).alias("n_near"),
    )
