"""The prefix trie of conversations, built from adaptive radix trees.

A turn (role, text) is named by the SHA-256 of both, read as a big-endian number of
``WIDTH`` bytes: equal turns have one name in every task and no dictionary is shuffled. A
conversation's key is its turns' names in order. Keys are range-partitioned by (key,
conv_id) and sorted, so each task holds a run of neighbouring branches and equal keys, however
many, are dealt over several tasks. A task adds its keys to a radix tree (``radix.py``) and
emits a node at each byte depth that is a whole number of turns. Every ``BLOCK`` turns it
emits and forgets the branches that lie off the first and the last key, so it holds a
bounded number of turns and those two paths.

Nodes on these two paths may go on in the neighbouring partitions. Their parts are merged
``FAN_IN`` neighbours at a time: what is no longer on the first or last path of a group is
whole, and after a few rounds everything is. A merging task holds at most 2 * FAN_IN paths.

Members that end at a node are hashed in ascending order as they pass by. Where such a run
may go on in the next partition its ids travel as chunks and are hashed one after another
(a SHA-256 can't be split; the task holds one chunk).

A conversation is one row of ``WIDTH`` bytes and one number per turn, so a conversation has
at most some tens of millions of turns. Range partitioning samples keys on the driver, as
Spark's sorting always does.

Defined results: a null role or text is empty; turns of equal number (or null, which come
first) are ordered by their names; repeated turns count each; rows without a conv_id belong to
no conversation; an empty table has no nodes, not even a root; texts may have any length;
other columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .radix import Node, RadixTree
from .tables import pick, written

WIDTH = 32
BLOCK = 100_000
FAN_IN = 64
CHUNK_IDS = 8192
ROWS = 10_000
BROADCAST_ROWS = 100_000
NOTHING = hashlib.sha256(b"").hexdigest()

_WHOLE, _OPEN, _MEMBERS = 0, 1, 2
#: Rows of the trees: whole nodes, parts of open nodes, and chunks of members.
_ROWS = (
    "kind int, part long, id binary, parent binary, depth long, weight long, conv_id long, parent_conv_id long, n_convs long, "
    "heads long, n_leaves long, saved long, ends string, on_first boolean, on_last boolean, seq long, members binary"
)
_NAMES = [f.split()[0] for f in _ROWS.split(", ")]
_ARROW = pa.schema(
    [
        (n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}[k])
        for n, k in (f.split() for f in _ROWS.split(", "))
    ]
)
_EMPTY_ROW = dict.fromkeys(_NAMES)


def conversation_keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, sizes): the names of a conversation's turns in order, as one binary,
    and the code points of each turn's text."""
    turns = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null")
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    turns = turns.select("conv_id", F.struct("turn", name.alias("name"), F.length("text").cast("long").alias("size")).alias("t"))
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    key = F.unhex(F.array_join(F.transform("ts", lambda t: F.hex(t["name"])), ""))
    return lists.select(F.col("conv_id").cast("long"), key.alias("key"), F.transform("ts", lambda t: t["size"]).alias("sizes"))


def with_shared_openings(keys: DataFrame) -> DataFrame:
    """Conversation c opens with the first h turns of conversation c - c % 100 in place of its
    own first h; h is crc32(c) % 6."""
    base = keys.filter("conv_id % 100 = 0").selectExpr("conv_id as base", f"substring(key, 1, {5 * WIDTH}) as opening", "slice(sizes, 1, 5) as opening_sizes")
    own = keys.selectExpr("*", "conv_id - conv_id % 100 as base", "cast(crc32(cast(conv_id as string)) % 6 as int) as h")
    return own.join(base, "base", "left").selectExpr(
        "conv_id",
        f"concat(substring(coalesce(opening, X''), 1, h * {WIDTH}), substring(key, h * {WIDTH} + 1)) as key",
        "concat(slice(coalesce(opening_sizes, array()), 1, h), slice(sizes, h + 1, size(sizes))) as sizes",
    )


def _name(prefix: bytes) -> bytes:
    return hashlib.sha256(prefix).digest()


class _Branch:
    """The radix tree of one partition's keys, which come in order."""

    def __init__(self, part: int, block: int):
        self.part, self.block = part, block
        self.tree = RadixTree(WIDTH)
        self.first: bytes | None = None
        self.last: bytes | None = None
        self.end: Node | None = None
        self.run = array("q")  # members that end where the last key does
        self.turns = 0
        self.out: list[dict] = []

    def add(self, member: int, key: bytes, sizes: list[int]) -> None:
        if key != self.last:
            self._close_run()
            if self.first is None:
                self.first = key
            if self.turns >= self.block:
                self._prune()
        self.last = key
        self.end = self.tree.add(key, sizes, member)
        self.run.append(member)
        self.turns += len(sizes) + 1

    def _close_run(self, final: bool = False) -> None:
        if not self.run:
            return
        if final or self.last == self.first:
            name = _name(self.last)
            for at in range(0, len(self.run), CHUNK_IDS):
                self.out.append(_EMPTY_ROW | {"kind": _MEMBERS, "part": self.part, "id": name, "seq": at, "members": self.run[at : at + CHUNK_IDS].tobytes()})
        else:
            self.end.ends = hashlib.sha256(",".join(map(str, self.run)).encode()).hexdigest()
        self.run = array("q")

    def _prune(self) -> None:
        """Emit and forget what lies off the paths to the first and the last key."""
        paths = [(self.first, self.tree.path_to(self.first)), (self.last, self.tree.path_to(self.last))]
        wanted: dict[int, set[int]] = {}
        where = {}
        for key, nodes in paths:
            for node in nodes:
                where[id(node)] = (node, key)
                if node.stop < len(key):
                    wanted.setdefault(id(node), set()).add(key[node.stop])
        for node, key in where.values():
            node.via = key
            if node.children is None:
                continue
            keep, parent = wanted.get(id(node), set()), None
            for byte, child in node.children.items():
                if byte not in keep:
                    parent = parent or _name(key[: node.stop // WIDTH * WIDTH])
                    heads, leaves, saved = self._whole(child, parent)
                    node.heads += heads
                    node.leaves += leaves
                    node.saved += saved
            node.children.keep(keep)
        self.turns = 0

    def _whole(self, top: Node, parent: bytes) -> tuple[int, int, int]:
        """Emit the nodes of a finished branch; its (topmost nodes, leaves, saved)."""
        order, stack = [], [(top, None)]
        while stack:
            node, above = stack.pop()
            order.append((node, above))
            if node.children is not None:
                below = node.low if node.weights else above
                stack += [(child, below) for _, child in node.children.items()]
        sums: dict[int, tuple[int, int, int]] = {}
        for node, above in reversed(order):
            heads, leaves, saved = node.heads, node.leaves, node.saved
            if node.children is not None:
                for _, child in node.children.items():
                    h, n, s = sums.pop(id(child))
                    heads, leaves, saved = heads + h, leaves + n, saved + s
            depth = node.start // WIDTH
            for i in range(len(node.weights) - 1, -1, -1):
                if not heads:
                    leaves = 1
                saved += (node.count - 1) * node.weights[i]
                ends = node.ends if (depth + i + 1) * WIDTH == node.stop else None
                up = above if i == 0 else node.low
                self.out.append(
                    _EMPTY_ROW
                    | {"id": _name(node.via[: (depth + i + 1) * WIDTH]) if node.via else None}  # may be named by rows emitted before
                    | {"kind": _WHOLE, "parent": parent if up is None else None, "depth": depth + i + 1, "conv_id": node.low, "parent_conv_id": up}
                    | {"n_convs": node.count, "heads": heads, "n_leaves": leaves, "saved": saved, "ends": ends or NOTHING}
                )
                heads = 1
            sums[id(node)] = (heads, leaves, saved)
        return sums[id(top)]

    def finish(self) -> None:
        """Emit what is left: finished branches, and the two paths as open nodes."""
        if self.first is None:
            return
        self._close_run(final=True)
        self._prune()
        made: dict[int, dict] = {}  # open row of the deepest number that a node's path reaches
        rows: list[dict] = []
        for key, flag in ((self.first, "on_first"), (self.last, "on_last")):
            row = None
            for node in self.tree.path_to(key):
                depth = node.start // WIDTH
                if id(node) not in made:
                    for i in range(len(node.weights) if node.stop else 1):
                        d = depth + i + 1 if node.stop else 0
                        parent = row["id"] if row else None
                        row = _EMPTY_ROW | {"kind": _OPEN, "part": self.part, "id": _name(key[: d * WIDTH]), "parent": parent, "depth": d}
                        row |= {"weight": node.weights[i] if d else 0, "conv_id": node.low, "n_convs": node.count}
                        row |= {"heads": 0, "n_leaves": 0, "saved": 0, "on_first": False, "on_last": False}
                        row["ends"] = node.ends if d * WIDTH == node.stop else None
                        rows.append(row)
                    made[id(node)] = row
                    row["heads"] += node.heads
                    row["n_leaves"] += node.leaves
                    row["saved"] += node.saved
                row = made[id(node)]
            up = {r["id"]: r for r in rows}
            while row:  # from the key's end to the root
                row[flag] = True
                row = up.get(row["parent"])
        self.out += rows

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        while len(self.out) >= max(least, 1):
            rows, self.out = self.out[:ROWS], self.out[ROWS:]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _grower(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch = _Branch(TaskContext.get().partitionId(), block)
        for batch in batches:
            for member, key, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                branch.add(member, key, sizes)
            yield from branch.batches(ROWS)
        branch.finish()
        yield from branch.batches(1)

    return task


def _merge(parts: pa.Table, final: bool) -> pa.Table:
    """Open nodes of neighbouring partitions: one row per node, whole where no other group
    of partitions can have a part of it."""
    rows = parts.to_pylist()
    first, last = min(r["part"] for r in rows), max(r["part"] for r in rows)
    nodes: dict[bytes, dict] = {}
    for r in rows:
        r["on_first"] = r["on_first"] and r["part"] == first
        r["on_last"] = r["on_last"] and r["part"] == last
        if (node := nodes.setdefault(r["id"], r)) is not r:
            for k in ("n_convs", "heads", "n_leaves", "saved"):
                node[k] += r[k]
            node["conv_id"] = min(node["conv_id"], r["conv_id"])
            node["ends"] = node["ends"] or r["ends"]
            node["on_first"] |= r["on_first"]
            node["on_last"] |= r["on_last"]
    for node in sorted(nodes.values(), key=lambda r: -r["depth"]):
        if not final and (node["on_first"] or node["on_last"]):
            continue
        node["kind"] = _WHOLE
        node["n_leaves"] = node["n_leaves"] if node["heads"] else 1
        node["saved"] += (node["n_convs"] - 1) * node["weight"]
        if node["parent"] is not None:
            up = nodes[node["parent"]]
            up["heads"] += 1
            up["n_leaves"] += node["n_leaves"]
            up["saved"] += node["saved"]
    return pa.Table.from_pylist(list(nodes.values()), schema=_ARROW)


def _merge_all(parts: pa.Table) -> pa.Table:
    return _merge(parts, final=True)


def _merge_group(parts: pa.Table) -> pa.Table:
    return _merge(parts, final=False)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ends) of members that come chunk by chunk, in order."""
    at, digest = None, None
    for batch in batches:
        done = []
        for name, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = ",".join(map(str, memoryview(members).cast("q"))).encode()
            if name == at:
                digest.update(b"," + text)
                continue
            if at is not None:
                done.append({"id": at, "ends": digest.hexdigest()})
            at, digest = name, hashlib.sha256(text)
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("id", pa.binary()), ("ends", pa.string())]))
    if at is not None:
        yield pa.RecordBatch.from_pylist([{"id": at, "ends": digest.hexdigest()}], schema=pa.schema([("id", pa.binary()), ("ends", pa.string())]))


def prefix_trie(keys: DataFrame, fan_in: int = FAN_IN, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of ``keys`` (conv_id, key, sizes): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens of its
    subtree, ends_sha256 of the members that end there."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = keys.select("conv_id", "key", "sizes").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows = written(in_order.mapInArrow(_grower(block), _ROWS))
    parts, merged = rows.filter(F.col("kind") == _OPEN), []
    width = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:  # log(width) rounds
        final = width <= fan_in
        group = (F.col("part") / fan_in).cast("long") if not final else F.lit(0).cast("long")
        step = written(parts.groupBy(group.alias("group")).applyInArrow(_merge_all if final else _merge_group, _ROWS))
        merged.append(step.filter(F.col("kind") == _WHOLE))
        if final:
            break
        parts = step.filter(F.col("kind") == _OPEN).withColumn("part", (F.col("part") / fan_in).cast("long"))
        width = -(-width // fan_in)
    whole = rows.filter(F.col("kind") == _WHOLE).drop("members")
    chunks = rows.filter(F.col("kind") == _MEMBERS).select("id", "part", "seq", "members").repartition("id").sortWithinPartitions("id", "part", "seq")
    ends = chunks.select("id", "members").mapInArrow(_hashed, "id binary, ends string").withColumnRenamed("ends", "run_ends")
    shared = merged[0]
    for more in merged[1:]:
        shared = shared.union(more)
    shared = written(shared.join(ends, "id", "left").withColumn("ends", F.coalesce("run_ends", "ends", F.lit(NOTHING))).select(*[c for c in _NAMES if c != "members"]))
    lows = shared.unionByName(whole.filter("id is not null")).select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_low"))
    lows = F.broadcast(lows) if lows.count() <= BROADCAST_ROWS else lows  # 40 bytes a row; else an ordinary join
    unset = whole.filter("parent is not null").unionByName(shared)
    found = unset.join(lows, "parent", "left").withColumn("parent_conv_id", F.col("parent_low")).select(*whole.columns)
    nodes = whole.filter("parent is null").unionByName(found)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("heads").alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations with shared openings (``with_shared_openings``)."""
    return prefix_trie(with_shared_openings(written(conversation_keys(conversations))))
