"""Packing by order-preserving dynamic programming.

The documents of a task keep their order and are written one after another, each closed by
an end id. A cut may stand at a document's end (free), a sentence's end (small penalty; of ends
within the same ``SPACING`` ids only the first) or, where no such end comes for
``FORCED_SPACING`` ids, between two ids (large penalty). Let
position(j) be the ids before cut j; then

    cost(j) = min over cuts i with position(j) - position(i) <= size of
              cost(i) + size - (position(j) - position(i)) + penalty(j)

is the least padding and penalty up to cut j. As ``cost(i) + position(i)`` is all that
depends on i, the best i of the sliding range stands at the head of a queue with rising
values, and each cut enters and leaves the queue once.

Nothing is shuffled: a task packs its own documents as they stream by, holding about
``STRETCH`` ids, and pads only its last sequence for want of documents.

Defined results: a null or empty text is the end id alone; documents of any length are
split; repeated rows are packed each; an empty table gives no pieces."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import encoder
from .tables import pick

SIZE = 2048
END_ID = 1
SENTENCE_PENALTY = 2
FORCED_PENALTY = 16
SPACING = 8
FORCED_SPACING = 16
STRETCH = 400_000


def best_cuts(position: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Indices of the chosen cuts, from the first to the last position. Neighbouring
    positions are at most ``size`` apart."""
    at, fine = position.tolist(), penalty.tolist()
    came = [0] * len(at)
    queue: deque[tuple[int, int, int]] = deque([(at[0], at[0], 0)])  # (cost + position, position, index)
    for j in range(1, len(at)):
        here = at[j]
        oldest = here - size
        while queue[0][1] < oldest:
            queue.popleft()
        came[j] = queue[0][2]
        value = queue[0][0] + size + fine[j]  # cost(j) + position(j)
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, here, j))
    cuts = [len(at) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, penalty) of the places where a cut may stand, 0 and the end included."""
    sentence = np.flatnonzero(closes[ids]) + 1
    if len(sentence):  # at most one in each SPACING ids
        sentence = sentence[np.append(True, sentence[1:] // SPACING != sentence[:-1] // SPACING)]
    places = np.unique(np.concatenate([[0], sentence, doc_ends]))
    gap = np.diff(places)
    many = (gap - 1) // FORCED_SPACING
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
    forced = np.repeat(places[:-1], many) + nth * FORCED_SPACING
    position = np.concatenate([places, forced])
    penalty = np.concatenate([np.where(np.isin(places, doc_ends), 0, SENTENCE_PENALTY), np.full(len(forced), FORCED_PENALTY)])
    order = np.argsort(position, kind="stable")
    return position[order], penalty[order]


class Packer:
    """Packs a stream of documents into sequences."""

    def __init__(self, closes: np.ndarray, size: int, first_sequence: int):
        self.closes, self.size, self.sequence = closes, size, first_sequence
        self.docs: list[tuple[int | None, int, int]] = []  # (doc_id, ids already packed, ids in all)
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)

    def pieces(self, final: bool) -> list[tuple]:
        """Pieces of the sequences that are settled; all of them at the end."""
        if not self.held:
            return []
        ids = np.concatenate(self.ids)
        ends = np.cumsum([total - done for _, done, total in self.docs])
        position, penalty = candidates(ids, ends, self.closes)
        cuts = position[best_cuts(position, penalty, self.size)]
        if not final:  # what follows may still move the last cuts
            cuts = cuts[: max(1, len(cuts) - 8)]
        out = []
        edges = np.unique(np.concatenate([cuts, ends[ends <= cuts[-1]]]))
        doc = np.searchsorted(ends, edges[:-1], "right")
        seq = np.searchsorted(cuts, edges[:-1], "right") - 1
        begins = ends - np.array([total - done for _, done, total in self.docs])
        raw = ids.astype("<u4").tobytes()
        for a, b, d, s in zip(edges[:-1].tolist(), edges[1:].tolist(), doc.tolist(), seq.tolist()):
            doc_id, done, total = self.docs[d]
            out.append((doc_id, done + a - int(begins[d]), b - a, raw[4 * a : 4 * b], total, self.sequence + s, a - int(cuts[s])))
        self.sequence += len(cuts) - 1
        stop = int(cuts[-1])
        d = int(np.searchsorted(ends, stop, "right"))
        rest = self.docs[d:]
        if rest:
            doc_id, done, total = rest[0]
            rest[0] = (doc_id, done + stop - int(begins[d]), total)
        self.docs, self.ids, self.held = rest, [ids[stop:]], len(ids) - stop
        return out


PIECES = T.StructType().add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long").add("sequence_id", "long").add("offset", "long")


def pack(docs: DataFrame, vocabulary_path: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (key, start, length, ids as little-endian 32-bit numbers, doc_tokens,
    sequence_id, offset) of all documents. The vocabulary file is read on the driver and
    sent to the tasks; its size is that of the file."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = pick(docs, key, text)
    schema = T.StructType([docs.schema[key], *PIECES.fields])
    arrow_key = None

    def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.fieldNames())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary.value)
        packer = Packer(code.ends_sentence(), size, TaskContext.get().partitionId() << 32)
        kind = arrow_key
        for rows in batches:
            kind, row = rows.column(0).type, 0
            for ids, first in code.encode(rows.column(1)):
                n = len(first) - 1
                for doc_id, a, b in zip(rows.column(0).slice(row, n).to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    packer.add(doc_id, np.append(ids[a:b], np.uint32(END_ID)))
                    if packer.held >= STRETCH and (out := packer.pieces(False)):
                        yield batch(out, kind)
                row += n
        if out := packer.pieces(True):
            yield batch(out, kind)

    return docs.mapInArrow(task, schema)


def packed_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    pieces = pack(docs, vocabulary_path)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
