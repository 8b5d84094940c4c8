"""Secrets in texts: fixed patterns, and strings that pass for random.

Patterns (kinds assign, access, hex) give the base spans. Beside them every run of 16 or
more token characters with a digit is a candidate. Its encoding is inferred from its
characters (hex, base32, lower or upper letters with digits, base62, base64), and three
tests ask whether its symbols were drawn evenly and independently from that alphabet: a
chi-squared test of uniformity, a runs test about the middle of the alphabet, and a test of
serial correlation. A candidate's p-value is three times the least of the three. Among the
distinct candidates of one encoding and length band, the Benjamini-Hochberg rule at level
``FALSE_DISCOVERY`` says which are not random; so longer strings, whose tests are sharper,
aren't judged by a limit set by short ones. Candidates that are not rejected and don't
touch a base span are added as kind random.

All of it is DataFrame work: matches are exploded (a text's pieces between matches give the
positions), tests run on exploded symbols of distinct candidates, and what is broadcast is
one row for each encoding and band. A text's own matches and symbols are folded by windows
and sums, so neither long texts nor frequent strings need memory in one place.

Defined results: null and empty texts have no spans; repeated rows get equal results; rows
are told apart by id and text together, null ids included; empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import free_name, written

FALSE_DISCOVERY = 0.05
#: Kinds in the order of spans that start together: (name, pattern, least length).
PATTERNS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"(AKIA)([A-Z0-9]{16,})"),
    ("hex", r"()([0-9a-f]{24,})"),
    ("random", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])()([A-Za-z0-9+/_-]{16,}={0,2})"),
)
KINDS = tuple(name for name, _ in PATTERNS)
_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order they are tried: (name, what fits, alphabet).
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", _DIGIT + "abcdef"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("lower36", "^[0-9a-z]+$", _DIGIT + _LOWER),
    ("upper36", "^[0-9A-Z]+$", _DIGIT + _UPPER),
    ("base62", "^(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", _DIGIT + _UPPER + _LOWER),
    ("base64", "^(?=.*[a-z])(?=.*[A-Z])([0-9A-Za-z+/]+|[0-9A-Za-z_-]+)$", _UPPER + _LOWER + _DIGIT + "+/"),
)
BANDS = (24, 32, 48)


def _matches(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(rid, kind, start, end, value) of every match; ``docs`` has rid and text."""
    parts = []
    for name, pattern in PATTERNS:
        if name not in kinds:
            continue
        text, rx = F.col("text"), F.lit(pattern)
        # the last piece has no match behind it
        found = F.arrays_zip(
            F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
            F.transform(F.regexp_extract_all(text, rx, 0), lambda x: F.length(x)).alias("size"),
            F.regexp_extract_all(text, rx, 2).alias("value"),
        )
        parts.append(F.when(text.rlike(pattern), F.struct(F.lit(name).alias("kind"), found.alias("found"))))
    each = docs.select("rid", F.explode(F.array_compact(F.array(*parts))).alias("k"))
    each = each.select("rid", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("i", "m")).filter("m.size is not null")
    each = each.select("rid", "kind", "i", "m.gap", "m.size", "m.value").dropDuplicates(["rid", "kind", "i"])
    before = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    return each.select("rid", "kind", (end - F.col("size")).alias("start"), end.alias("end"), "value")


def _normal(z: Column) -> Column:
    """The normal distribution function, by a logistic curve that is 0.0002 off at most."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _choose(values: list, default=None) -> Column:
    out = F
    for (name, _, _), value in zip(ENCODINGS, values):
        out = out.when(F.col("encoding") == name, value)
    return out.otherwise(default) if default is not None else out


def tested(tokens: DataFrame) -> DataFrame:
    """(value, stratum, p) of distinct candidates with an encoding; p in millionths."""
    core = F.regexp_replace("value", "=+$", "")
    encoding = F
    for name, pattern, _ in ENCODINGS:
        encoding = encoding.when(F.col("core").rlike("[A-Za-z]") & F.col("core").rlike(pattern), name)
    named = tokens.select("value").distinct().select("value", core.alias("core")).withColumn("encoding", encoding).filter("encoding is not null")
    symbols = named.select("value", "encoding", F.posexplode(F.split(F.when(F.col("encoding") == "hex", F.lower("core")).otherwise(F.translate("core", "_-", "/+")), "(?!^)")).alias("i", "c"))
    symbols = symbols.withColumn("v", F.instr(_choose([F.lit(a) for _, _, a in ENCODINGS]), F.col("c")) - 1).withColumn("k", _choose([F.lit(len(a)) for _, _, a in ENCODINGS]))
    order = Window.partitionBy("value").orderBy("i")
    symbols = symbols.withColumn("last", F.lag("v").over(order))
    middle = (F.col("k") - 1) / 2
    high, last_high = (2 * F.col("v") >= F.col("k")).cast("long"), (2 * F.col("last") >= F.col("k")).cast("long")
    counted = symbols.groupBy("value", "encoding", "k", "v").agg(
        F.count("*").alias("c"), F.sum(high).alias("high"), F.sum(F.coalesce((high != last_high).cast("long"), F.lit(0))).alias("turns"),
        F.sum(F.coalesce((F.col("v") - middle) * (F.col("last") - middle), F.lit(0.0))).alias("product"),
    )
    s = counted.groupBy("value", "encoding", "k").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.sum("high").alias("n1"), F.sum("turns").alias("turns"), F.sum("product").alias("product"))
    n, k, n1 = F.col("n").cast("double"), F.col("k").cast("double"), F.col("n1").cast("double")
    free = k - 1
    chi = F.col("squares") * k / n - n
    z_even = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    p_even = 1 - _normal(z_even)
    mean = 1 + 2 * n1 * (n - n1) / n
    p_runs = F.when((n1 == 0) | (n1 == n), 0.0).otherwise(2 * (1 - _normal(F.abs(F.col("turns") + 1 - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))))))
    p_serial = 2 * (1 - _normal(F.abs(F.col("product") / ((k * k - 1) / 12) / F.sqrt(n - 1))))
    p = F.least(F.lit(1.0), 3 * F.least(p_even, p_runs, p_serial))
    band = F
    for i, top in enumerate(BANDS):
        band = band.when(F.col("n") < top, i)
    return s.select("value", F.concat_ws("/", "encoding", band.otherwise(len(BANDS)).cast("string")).alias("stratum"), F.floor(p * 1_000_000).alias("p"))


def random_values(tokens: DataFrame) -> DataFrame:
    """(value): the candidates that the tests, taken together, don't reject."""
    scored = tested(tokens)
    steps = scored.groupBy("stratum", "p").agg(F.count("*").alias("c"))
    up = Window.partitionBy("stratum").orderBy("p")  # a million rows at most in each stratum
    steps = steps.select("stratum", "p", F.sum("c").over(up).alias("rank"), F.sum("c").over(Window.partitionBy("stratum")).alias("m"))
    limit = steps.groupBy("stratum").agg(F.max(F.when(F.col("p") * F.col("m") <= F.col("rank") * F.lit(FALSE_DISCOVERY * 1_000_000), F.col("p"))).alias("limit"))
    return scored.join(F.broadcast(limit), "stratum").filter("limit is null or p > limit").select("value")


def spans(docs: DataFrame) -> DataFrame:
    """(rid, kind, start, end): base spans and added ones, for docs with rid and text."""
    found = written(_matches(docs))  # small, and read by base spans, candidates and tests
    base = found.filter("kind != 'random'").filter(F.when(F.col("kind") == "assign", F.length("value") >= 6).otherwise(True))
    tokens = found.filter("kind = 'random'")
    added = tokens.join(random_values(tokens), "value").select("rid", "kind", "start", "end")
    base = base.select("rid", "kind", "start", "end")
    # an added span may not touch a base span of its text: sweep over both by start
    order = Window.partitionBy("rid").orderBy("start", F.col("kind") == "random")
    both = base.union(added)
    reach = F.max(F.when(F.col("kind") != "random", F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("kind") != "random", F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    both = both.select("rid", "kind", "start", "end", reach.alias("reach"), ahead.alias("ahead"))
    touched = (F.coalesce("reach", F.lit(0)) > F.col("start")) | (F.coalesce(F.col("ahead") < F.col("end"), F.lit(False)))
    return both.filter((F.col("kind") != "random") | ~touched).select("rid", "kind", "start", "end")


def _numbered(docs: DataFrame, key: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))


def per_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, spans): the sorted spans of every text that has some."""
    found = spans(docs.select(_numbered(docs, key, text).alias("rid"), F.col(f"`{text}`").alias("text")))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return found.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind"))).alias("spans"))


def secret_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), _numbered(docs, key, text).alias("rid")).join(per_text(docs, key, text), "rid", "left")
    all_spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,place:bigint,end:bigint,kind:string>>"))
    base = F.filter(all_spans, lambda x: x["kind"] != "random")

    def told(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(all_spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(all_spans).alias("spans"), count("random"))


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; touching spans by one."""
    rid, mine = free_name(docs, "rid"), free_name(docs, "spans")
    found = per_text(docs, key, text).select(F.col("rid").alias(rid), F.col("spans").alias(mine))
    rows = docs.withColumn(rid, _numbered(docs, key, text)).join(found, rid, "left")
    t, s = f"`{text}`", f"`{mine}`"
    # each span cuts what stands before it; a span inside an earlier one cuts nothing
    pieces = F.expr(f"""
        aggregate({s}, struct(cast(0 as bigint) as at, cast('' as string) as done),
          (a, x) -> case when x.end <= a.at then a
                         else struct(x.end as at, concat(a.done, case when x.start > a.at or a.at = 0
                                     then concat(substring({t}, cast(a.at + 1 as int), cast(x.start - a.at as int)), '{mark}') else '' end) as done) end,
          a -> concat(a.done, substring({t}, cast(a.at + 1 as int))))""")
    changed = F.when(F.col(s).isNull(), F.col(t)).otherwise(pieces)
    return rows.select(*[changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
