"""Word-based scoring of candidate text.

Words are counted on Arrow batches: a text is a list of chunks between white space, and what a
chunk holds is looked up once per distinct chunk. Scores are column expressions over the counts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipspark.functions.exprs import clamp, first_match, flag_list

# Vocabularies the scores are defined over (Russian and English).
QUESTION_WORDS = (
    "почему", "как", "зачем", "что", "кто", "где", "куда", "откуда", "сколько",
    "why", "how", "what", "who", "where", "when",
)
INTRIGUE_WORDS = (
    "секрет", "секреты", "тайна", "ошибка", "ошибки", "никогда", "всегда", "шок",
    "главное", "правда", "факт", "факты", "внимание", "осторожно", "важно",
    "secret", "secrets", "mystery", "mistake", "never", "always", "truth", "revealed",
)
ADDRESS_WORDS = (
    "ты", "вы", "тебе", "вам", "представь", "представьте", "смотри", "смотрите",
    "послушай", "слушай", "знаешь", "знаете",
    "you", "imagine", "look", "listen", "watch",
)
EMOTION_WORDS = (
    "вау", "ого", "жесть", "кошмар", "ужас", "супер", "круто", "обалдеть", "невероятно",
    "боже", "безумие", "бомба", "топ", "кайф", "офигеть", "шок", "провал", "восторг",
    "wow", "insane", "crazy", "awesome", "unbelievable", "shocking", "terrible", "huge", "omg",
)
INFO_WORDS = (
    "потому", "поэтому", "из-за", "например", "во-первых", "во-вторых", "исследование",
    "статистика", "результат", "причина", "тысяч", "миллион", "миллиард", "процент",
    "рублей", "долларов", "лет", "because", "therefore", "example", "result", "statistic",
)
DANGLING_WORDS = ("и", "а", "но", "да", "короче", "так вот", "ну", "and", "but", "so", "well")
CLOSING_MARKS = (".", "!", "?")
CLOSING_QUOTED = ('."', '!"', '?"')
OPENING_WORDS = 25
OPENING_CHARS = 120

WORD_KINDS = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Pc"}
CIRCLED_LETTERS = ((0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189))


class _Kinds(dict):
    """What a character is to the patterns: ``l`` part of a word, ``d`` a digit, ``_``, a
    sign they name, or ``o``. As ``\\w`` and ``\\d`` with Unicode classes."""

    def __missing__(self, c: int) -> str:
        kind = unicodedata.category(chr(c))
        if chr(c) in "_%$€₽.,":
            found = chr(c)
        elif kind == "Nd":
            found = "d"
        elif kind in WORD_KINDS or c in (0x200C, 0x200D) or any(a <= c <= b for a, b in CIRCLED_LETTERS):
            found = "l"
        else:
            found = "o"
        self[c] = found
        return found


KINDS = _Kinds()
WORD_SHAPE = re.compile(r"(?<![ld_])l{2,}(?![ld_])")
NUMBER_SHAPE = re.compile(r"(?<![ld_])d+(?:[.,]d+)?(?![ld_])|[%$€₽]")


# chunks of letters whose case is one character for one, between common marks: most of all
PLAIN_MARKS = ".,;:!?\"'()-"
PLAIN_WORD = "^[A-Za-zÀ-ÖØ-Þà-öø-ÿА-яЁё]+$"


def _chunk(chunk: str) -> tuple[list[str], int, bool]:
    """Lower-case words of two letters or more, numbers and signs, and whether it is in capitals."""
    low = chunk.lower()
    words = [low[m.start() : m.end()] for m in WORD_SHAPE.finditer(low.translate(KINDS))]
    numbers = sum(1 for _ in NUMBER_SHAPE.finditer(chunk.translate(KINDS)))
    return words, numbers, len(chunk) > 2 and low != chunk and chunk.upper() == chunk


def _chunks(chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The words of distinct chunks in a row, and for each chunk: how many are its own, its
    numbers, and whether it is in capitals. Plain chunks are taken all at once."""
    core = pc.utf8_trim(chunks, PLAIN_MARKS)
    plain = pc.match_substring_regex(core, PLAIN_WORD).to_numpy(zero_copy_only=False)
    held = (plain & (pc.utf8_length(core).to_numpy() > 1)).astype(np.int64)
    numbers = np.zeros(len(chunks), np.int64)
    shout = pc.and_(pc.equal(pc.utf8_upper(chunks), chunks), pc.not_equal(pc.utf8_lower(chunks), chunks))
    loud = plain & (pc.utf8_length(chunks).to_numpy() > 2) & shout.to_numpy(zero_copy_only=False)
    owner, words = [np.flatnonzero(held)], []
    other = np.flatnonzero(~plain)
    for i, chunk in zip(other.tolist(), chunks.take(pa.array(other)).to_pylist()):
        found, numbers[i], loud[i] = _chunk(chunk)
        held[i] = len(found)
        words += found
    owner.append(np.repeat(other, held[other]))
    said = pa.concat_arrays([pc.utf8_lower(core.take(pa.array(owner[0]))), pa.array(words, pa.string())])
    return said.take(pa.array(np.argsort(np.concatenate(owner), kind="stable"))), held, numbers, loud


COUNTS = {
    "_n": "int", "_bangs": "int", "_emo": "int", "_info": "int", "_caps": "int", "_nums": "int", "_kinds": "int", "_top": "int",
    "_ask": "boolean", "_tease": "boolean", "_talk": "boolean", "_dangling": "boolean",
}


def _count(text: pa.Array) -> dict[str, np.ndarray]:
    """The columns of ``COUNTS`` for each text (null: empty)."""
    t = pc.utf8_trim(pc.fill_null(text, ""), " ")
    chunks = pc.ascii_split_whitespace(t)
    size = pc.list_value_length(chunks).to_numpy()
    coded = pc.list_flatten(chunks).dictionary_encode()
    code, rows = coded.indices.to_numpy(), len(t)
    edges = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])

    def per_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return upto[edges[1:]] - upto[edges[:-1]]

    # the words of distinct chunks, numbered
    said, held, numbers, loud = _chunks(coded.dictionary)
    numbered = said.dictionary_encode()
    flat, kind_of = numbered.indices.to_numpy(), numbered.dictionary
    begin = np.cumsum(held) - held

    # the words of every text, in order
    many = held[code]
    upto = np.concatenate([[0], np.cumsum(many)])
    word = flat[np.repeat(begin[code] - upto[:-1], many) + np.arange(upto[-1])]
    word_edges = upto[edges]
    n = np.diff(word_edges)
    row = np.repeat(np.arange(rows), n)

    def is_in(words: tuple[str, ...]) -> np.ndarray:
        return pc.is_in(kind_of, pa.array(words)).to_numpy(zero_copy_only=False)[word]

    opening = np.arange(len(word)) - word_edges[row] < OPENING_WORDS
    some = n > 0
    first = np.zeros(rows, bool)
    first[some] = is_in(DANGLING_WORDS)[word_edges[:-1][some]]

    # runs of equal words, text by text
    key = np.sort(row * max(len(kind_of), 1) + word)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    run = np.diff(np.concatenate([at, [len(key)]]))
    kinds = np.bincount(row[at], minlength=rows)
    top = np.zeros(rows, np.int64)
    if len(at):
        top[some] = np.maximum.reduceat(run, (np.cumsum(kinds) - kinds)[some])
    start = pc.utf8_slice_codeunits(t, 0, OPENING_CHARS)
    return {
        "_n": n,
        "_bangs": pc.count_substring(t, "!").to_numpy(),
        "_emo": per_text(is_in(EMOTION_WORDS), word_edges),
        "_info": per_text(is_in(INFO_WORDS), word_edges),
        "_caps": per_text(loud[code], edges),
        "_nums": per_text(numbers[code], edges),
        "_kinds": kinds,
        "_top": top,
        "_ask": (per_text(opening & is_in(QUESTION_WORDS), word_edges) > 0) | pc.match_substring(start, "?").to_numpy(zero_copy_only=False),
        "_tease": per_text(opening & is_in(INTRIGUE_WORDS), word_edges) > 0,
        "_talk": per_text(opening & is_in(ADDRESS_WORDS), word_edges) > 0,
        "_dangling": first,
    }


def with_counts(cands: DataFrame) -> DataFrame:
    """``cands`` and the columns of ``COUNTS``, of its ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = _count(batch.column("text"))
                added = [pa.array(counts[c], pa.bool_() if kind == "boolean" else pa.int32()) for c, kind in COUNTS.items()]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *COUNTS])

    schema = T.StructType(list(cands.schema.fields))
    for c, kind in COUNTS.items():
        schema = schema.add(c, T.BooleanType() if kind == "boolean" else T.IntegerType())
    return cands.mapInArrow(run, schema)


def score_heuristic(cands: DataFrame) -> DataFrame:
    """Add hook/emotion/information/standalone/shareability scores and the overall score.

    ``cands`` needs ``text`` and ``duration_ms``; scores are 0-100 at one decimal.
    """
    t = F.trim("text")
    wpm = F.col("_n") / F.greatest(F.lit(1.0), F.col("duration_ms") / 1000.0) * 60.0
    feat = with_counts(cands).withColumn("_wpm", wpm)
    n = F.col("_n")

    def bonus(cond: Column, value: float) -> Column:
        return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))

    hook = F.least(F.lit(100.0), 45.0 + bonus(F.col("_ask"), 25.0) + bonus(F.col("_tease"), 20.0) + bonus(F.col("_talk"), 15.0))
    emotion = F.least(
        F.lit(100.0),
        40.0
        + F.least(F.lit(25.0), F.col("_bangs") * 10.0)
        + F.least(F.lit(30.0), F.col("_emo") * 12.0)
        + F.least(F.lit(15.0), F.col("_caps") * 5.0),
    )
    information = F.least(
        F.lit(100.0),
        40.0
        + F.least(F.lit(25.0), F.col("_nums") * 8.0)
        + F.least(F.lit(25.0), F.col("_info") * 8.0)
        + bonus(F.try_divide("_kinds", n) > 0.65, 15.0),
    )
    closed = F.lit(False)
    for mark in (*CLOSING_MARKS, *CLOSING_QUOTED):
        closed = closed | t.endswith(mark)
    standalone = clamp(
        60.0
        + F.when(F.col("_dangling"), F.lit(-20.0)).otherwise(F.lit(15.0))
        + F.when(closed, F.lit(15.0)).otherwise(F.lit(-10.0))
        + bonus(n >= 50, 10.0),
        10.0,
        100.0,
    )
    repeats = (F.try_divide("_top", n) > 0.22) & (n > 20)
    penalty = first_match([(F.col("_wpm") < 70.0, 15.0), (F.col("_wpm") > 240.0, 10.0)], 0.0) + bonus(repeats, 15.0)
    scored = (
        feat.withColumn("_h", hook)
        .withColumn("_e", emotion)
        .withColumn("_i", information)
        .withColumn("_s", standalone)
        .withColumn(
            "_v",
            clamp(F.round(0.40 * F.col("_h") + 0.35 * F.col("_e") + 0.25 * F.col("_i"), 1), 0.0, 100.0),
        )
        .withColumn(
            "_all",
            F.round(
                clamp(
                    0.25 * F.col("_h") + 0.20 * F.col("_s") + 0.20 * F.col("_e") + 0.15 * F.col("_i") + 0.20 * F.col("_v") - penalty,
                    0.0,
                    100.0,
                ),
                1,
            ),
        )
    )
    thin = n < 5
    notes = flag_list(
        [
            (F.col("_ask"), "opening question hook"),
            (F.col("_tease"), "high curiosity hook words"),
            (F.col("_talk"), "direct viewer address"),
            (F.col("_bangs") > 0, F.concat(F.col("_bangs").cast("string"), F.lit(" exclamation markers"))),
            (F.col("_emo") > 0, "emotional keywords"),
            (F.col("_nums") > 0, "concrete numbers / data points"),
            (F.col("_info") > 0, "structured explanatory reasoning"),
            (F.col("_wpm") < 70.0, "slow speech density"),
            (repeats, "excessive word repetition"),
        ]
    )
    named = {"score": "_all", "hook_score": "_h", "standalone_score": "_s", "emotion_score": "_e",
             "information_score": "_i", "shareability_score": "_v"}
    out = scored.select(
        *cands.columns,
        *[F.when(thin, F.lit(10.0)).otherwise(F.col(c)).alias(name) for name, c in named.items()],
        F.when(thin, F.lit("Fragment contains almost no speech words."))
        .otherwise(F.when(notes == "", F.lit("Balanced dialogue fragment")).otherwise(notes))
        .alias("reason"),
    )
    return out
