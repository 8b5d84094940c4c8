"""Vectors compressed to codes of four parts, with dictionaries of values.

Components become integers, so many vectors share few values per dimension. Vectors are kept
in blocks of up to ``BLOCK`` rows: for each dimension the sorted distinct integers of the
block (its dictionary) and for each vector the place of its value in it. To compare a block
with a codebook, the squared difference of every dictionary value to all entries is
tabulated once per dimension; the distance of a part is then a gather from these tables by
dictionary code and an addition, without a multiplication per vector.

Each round reads the blocks, assigns every part to its nearest entry and sums the members
of each entry within the task; Spark adds these sums up, and only the codebook (256 entries)
reaches the driver. The blocks are a written table, so a round starts from files.

Defined results: rows whose vector is null or holds a null, NaN or infinite component are
dropped; an integer beyond ``LARGEST`` in size is held at it, so that distances fit a long;
vectors are filled up with zeros to the longest length, and that to a multiple of four
(an empty vector is all zeros); rows of equal vec_id, or without one (these sort last), are
ordered by their integers; with fewer than 256 vectors the codebooks are as short; equal
distances go to the lower entry; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 4096
LARGEST = 2**26
BROADCAST_LABELS = 10_000
_STEP = 512  # vectors whose distances are held at once

_BLOCKS = "values array<int>, offsets array<int>, codes binary"
_SUMS = "slot int, total long, n long"


def integer_vectors(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, xs): floor(SCALE * x) of every component of the vectors that are finite."""
    rows = embeddings.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.filter("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return rows.select("vec_id", "label", F.expr(f"transform(v, x -> cast(greatest(least(floor(x * {SCALE}), {LARGEST}), -{LARGEST}) as int)) as xs"))


def _blocked(dims: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        lists = rows["xs"].combine_chunks()
        n, sizes = len(lists), np.diff(lists.offsets.to_numpy())
        x = np.zeros((n, dims), np.int32)
        x[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        values, offsets, codes = [], [0], np.zeros((dims, n), "<u2")
        for d in range(dims):
            found, codes[d] = np.unique(x[:, d], return_inverse=True)
            values.append(found)
            offsets.append(offsets[-1] + len(found))
        one = lambda a, kind: pa.array([a], pa.list_(kind))
        columns = [pa.array([rows[c].to_pylist()], pa.list_(rows[c].type)) for c in ("vec_id", "label")]
        flat = np.concatenate(values) if dims else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([*columns, one(flat, pa.int32()), one(offsets, pa.int32()), pa.array([codes.tobytes()])], names=["vec_id", "label", "values", "offsets", "codes"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, most - n))
                batch = batch.slice(held[-1].num_rows)
                n += held[-1].num_rows
                if n == most:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return task


class Block:
    """One row of the written blocks."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, codes: bytes):
        self.values, self.offsets = values, offsets
        self.dims = len(offsets) - 1
        raw = np.frombuffer(codes, "<u2")
        self.n = len(raw) // self.dims if self.dims else 0
        self.codes = raw.reshape(self.dims, self.n)

    def dictionary(self, d: int) -> np.ndarray:
        return self.values[self.offsets[d] : self.offsets[d + 1]]

    def assign(self, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part of each vector, as (PARTS, n) arrays."""
        size = self.dims // PARTS
        entry, distance = np.zeros((PARTS, self.n), np.int64), np.zeros((PARTS, self.n), np.int64)
        for p in range(PARTS):
            tables = []
            for d in range(p * size, (p + 1) * size):
                gap = self.dictionary(d).astype(np.int64)[:, None] - codebook[None, :, d]
                tables.append(gap * gap)
            if sum(int(t.max()) for t in tables) < 2**31:
                tables = [t.astype(np.int32) for t in tables]
            for a in range(0, self.n, _STEP):
                b = min(a + _STEP, self.n)
                sums = np.zeros((b - a, len(codebook)), tables[0].dtype if tables else np.int64)
                for d, table in zip(range(p * size, (p + 1) * size), tables):
                    sums += table[self.codes[d, a:b]]
                entry[p, a:b] = sums.argmin(1)  # the first of equal ones
                distance[p, a:b] = sums[np.arange(b - a), entry[p, a:b]]
        return entry, distance


def _each(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            values, offsets = (batch.column(first + k)[i].values.to_numpy(zero_copy_only=False) for k in (0, 1))
            yield batch, i, Block(values, offsets, batch.column(first + 2)[i].as_py())


def _summing(codebook: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums and counts of the members of each entry, one row per entry and dimension."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = codebook.shape
        size, total, count = dims // PARTS, np.zeros((k, dims), np.int64), np.zeros((k, PARTS), np.int64)
        for _, _, block in _each(batches, 0):
            entry, _ = block.assign(codebook)
            for p in range(PARTS):
                count[:, p] += np.bincount(entry[p], minlength=k)
                for d in range(p * size, (p + 1) * size):  # exact: below 2 ** 53
                    total[:, d] += np.bincount(entry[p], weights=block.dictionary(d)[block.codes[d]], minlength=k).astype(np.int64)
        n = np.repeat(count, size, axis=1).ravel()
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total.ravel()[used]), pa.array(n[used])], names=["slot", "total", "n"])

    return task


def _coding(codebook: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block in _each(batches, 2):
            ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
            if not block.dims:
                entry, distance = np.zeros((PARTS, len(ids)), np.int64), np.zeros((PARTS, len(ids)), np.int64)
            else:
                entry, distance = block.assign(codebook)
            raw = np.ascontiguousarray(entry.T.astype(np.uint8)).tobytes().hex()
            codes = [raw[a : a + 2 * PARTS] for a in range(0, len(raw), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(distance.sum(0))], names=["vec_id", "label", "code", "error"])

    return task


def codebook_digest(codebook: np.ndarray) -> str:
    size = codebook.shape[1] // PARTS
    numbers = [codebook[:, p * size : (p + 1) * size].ravel() for p in range(PARTS)]
    return hashlib.sha256(",".join(map(str, np.concatenate(numbers).tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of every kept vector, codebook of shape (entries, dims))."""
    if not 1 <= entries <= 256 or not 1 <= block <= 65536:
        raise ValueError("a code has two hex digits, and a dictionary code 16 bits")
    rows = integer_vectors(embeddings)
    longest = rows.agg(F.max(F.size("xs"))).first()[0] or 0
    dims = -(-longest // PARTS) * PARTS
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "xs").select("xs").limit(entries).collect()
    codebook = np.array([r.xs + [0] * (dims - len(r.xs)) for r in start], np.int64).reshape(len(start), dims)
    kept = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema.fields[:2]] + T.StructType.fromDDL(_BLOCKS).fields)
    blocks = written(rows.mapInArrow(_blocked(dims, block), kept))
    for _ in range(rounds if dims else 0):
        sums = blocks.select("values", "offsets", "codes").mapInArrow(_summing(codebook), _SUMS)
        sums = sums.groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # entries * dims rows at most
        slot, total, n = (sums[c].to_numpy() for c in ("slot", "total", "n"))
        codebook = codebook.copy()
        codebook.ravel()[slot] = total // n
    schema = T.StructType(rows.schema.fields[:2]).add("code", "string").add("error", "long")
    return blocks.mapInArrow(_coding(codebook), schema), codebook


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over the label) and the codebooks' digest."""
    coded, codebook = compress(embeddings)
    coded = written(coded)
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    if labels.count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    found = coded.join(labels.withColumnRenamed("label", "own_label"), F.expr("label <=> own_label"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebook)).alias("codebooks_sha256"))
