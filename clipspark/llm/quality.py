"""Quality rules: repetition inside a text, and lines that many documents of a host share.

Base figures are computed row by row. Then every line with a word is normalised (letters
A-Z lowered, white space collapsed) and hashed, and for each host the distinct documents
that hold it are counted; copies of one text count once. A line is boilerplate where it
stands in at least ``LEAST_DOCS`` documents, or on small hosts in ``SMALL_DOCS`` and in
``LINE_SHARE`` of the host's documents: either limit is enough, as on a large host a share
alone would pass lines that stand in thousands of documents. A document that fails the base
rules is rejected, and so is one that the removal of these lines depletes: more than
``DEPLETED`` of its words go, or fewer than ``LEAST_WORDS`` are left. ``quality_table`` has the
figures of the whole texts and this verdict; ``cleaned_table`` also returns what is left and
applies all base rules to it.

Only (line number, host, text number) rows are shuffled, never texts, and distinct pairs
are combined before the shuffle, so one line or host in a third of all documents is spread
over all tasks.

Defined results: null and empty texts have no words and fail the base rules; a null host
is a host of its own; repeated rows get equal results; empty tables give no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DOCS = 10
LINE_SHARE = 0.10
SMALL_DOCS = 3
DEPLETED = 0.50
LEAST_WORDS = 50
_SPACE = " \t\n\x0b\x0c\r"
_SPACES = "[\\x20\\x09-\\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def _worded(line: Column) -> Column:
    return F.length(F.translate(line, _SPACE, "")) > 0


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), _worded)


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more, for an array of words.

    Equal windows stand together once (window, place) pairs are sorted."""
    n = F.size(w)

    def numbered(windows: Column) -> Column:
        return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    def places(s: Column) -> Column:
        m = F.size(s)
        none = F.array().cast("array<int>")
        both = F.zip_with(F.slice(s, 1, m - 1), F.slice(s, 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(none))
        return F.sort_array(F.array_distinct(F.flatten(both)))

    def covered(p: Column) -> Column:
        k = F.size(p)
        steps = F.zip_with(F.slice(p, 1, k - 1), F.slice(p, 2, k - 1), lambda a, b: F.least(F.lit(3), b - a))
        return F.when(k == 0, F.lit(0)).otherwise(3 + F.aggregate(steps, F.lit(0), lambda a, x: a + x))

    pairs = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    windows = F.zip_with(pairs, F.slice(w, 3, n - 2), lambda p, c: F.xxhash64(p["a"], p["b"], c))
    return F.when(n < 4, F.lit(0)).otherwise(let(numbered(windows), lambda s: let(places(s), covered)))


def _base(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    per_words = let(_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    dups = let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(per_words, lambda p: F.struct(
        p["n_words"].alias("n_words"), F.length(F.translate(t, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), dups.cast("long").alias("n_dup_lines"), p["n_repeat_words"].alias("n_repeat_words"),
    ))


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def boilerplate_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(rid, i, n): place among the lines with a word, and words, of each line over either
    limit; ``docs`` has rid, text, host."""
    normal = F.regexp_replace(_lowered(F.col("line")), _SPACES, " ")
    lines = docs.select("rid", "host", F.xxhash64("text").alias("tid"), F.posexplode(_lines(F.col("text"))).alias("i", "line")).select("rid", "host", "tid", "i", F.trim(normal).alias("line"))
    lines = lines.select("rid", "host", "tid", "i", F.xxhash64("line").alias("h"), (F.length("line") - F.length(F.translate("line", " ", "")) + 1).alias("n"))
    held = lines.select("host", "h", "tid").distinct().groupBy("host", "h").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min(SMALL_DOCS, least_docs))
    hosts = docs.select(F.col("host").alias("host_"), F.xxhash64("text").alias("tid")).distinct().groupBy("host_").agg(F.count("*").alias("all_docs"))
    over = (F.col("docs") >= least_docs) | (F.col("docs") >= line_share * F.col("all_docs"))
    often = held.join(hosts, F.col("host").eqNullSafe(F.col("host_"))).filter(over).select("host_", F.col("h").alias("h_"))
    hits = lines.join(often, (F.col("h") == F.col("h_")) & F.col("host").eqNullSafe(F.col("host_")), "left_semi")
    return hits.select("rid", "i", "n").distinct()


def boilerplate_words(docs: DataFrame, least_docs: int = LEAST_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(rid, n_boilerplate): words in boilerplate lines, for texts with some; ``docs`` has
    rid, text, host."""
    return boilerplate_lines(docs, least_docs, line_share).groupBy("rid").agg(F.sum("n").alias("n_boilerplate"))


def _keyed(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    t = F.col(f"`{text}`")
    return docs.select(F.col(f"`{key}`").alias("doc_id"), t.alias("text"), F.col(f"`{host}`").alias("host"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{host}`"), t).alias("rid"))


def _failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines at the places of ``gone`` among its lines with a word."""
    def left(lines: Column) -> Column:
        worded = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: _worded(F.get(lines, i)))
        drop = let(worded, lambda at: F.transform(gone, lambda g: F.get(at, g)))
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    return F.when(gone.isNull(), text).otherwise(let(F.split(text, "\n"), left))


def cleaned_table(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", depleted: float = DEPLETED) -> DataFrame:
    """doc_id, text, n_words, n_removed, base_failed and kept of every row: the text
    without its boilerplate lines (blank lines stay), its words, the words removed, and
    whether what is left passes the base rules and is not depleted."""
    docs = _keyed(docs, key, text, host)
    gone = boilerplate_lines(docs).groupBy("rid").agg(F.collect_list("i").alias("gone"), F.sum("n").alias("n_removed"))
    rows = docs.join(gone, "rid", "left").select("doc_id", _without(F.col("text"), F.col("gone")).alias("text"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))
    rows = rows.select("doc_id", "text", "n_removed", _base(F.col("text")).alias("b")).select("doc_id", "text", "n_removed", "b.*")
    stays = ~_failed() & (F.col("n_removed") <= depleted * (F.col("n_words") + F.col("n_removed")))
    return rows.select("doc_id", "text", "n_words", "n_removed", _failed().alias("base_failed"), stays.alias("kept"))


def quality_table(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", depleted: float = DEPLETED) -> DataFrame:
    """doc_id, the base figures, base_failed, kept and n_boilerplate (words removed) of every row."""
    docs = _keyed(docs, key, text, host)
    figures = docs.select("doc_id", "rid", _base(F.col("text")).alias("b")).select("doc_id", "rid", "b.*")
    rows = figures.join(boilerplate_words(docs), "rid", "left").withColumn("n_boilerplate", F.coalesce("n_boilerplate", F.lit(0)).cast("long"))
    failed, left = _failed(), F.col("n_words") - F.col("n_boilerplate")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("n_boilerplate") <= depleted * F.col("n_words")) & (left >= LEAST_WORDS)).alias("kept"), "n_boilerplate",
    )
