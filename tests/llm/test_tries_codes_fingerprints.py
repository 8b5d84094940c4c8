"""Conversation tries, fingerprints and vector codes against plain Python."""

from collections import Counter

import numpy as np
import pytest

from clipspark.llm.radix import RadixTree
from clipspark.llm.simhash import as_text, fingerprint_table, fingerprints, within
from clipspark.llm.turn_trie import conversation_keys, conversation_trie, prefix_trie, with_shared_openings
from clipspark.llm.vector_codes import Block, compress, vector_codes

from . import brute
from .conftest import edge_rows

TURNS = "conv_id long, turn long, role string, text string"


def talk():
    """Shared openings, equal conversations, ties, nulls, long texts, a long conversation."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 7 if t < 3 else c % 90}") for c in range(230) for t in range(c % 9)]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(300) for t in range(4)]
    rows += [(c, t, "user", "ab" * (t + 1)) for c in (5000, 5100, 5101, 5199) for t in range(150)]
    rows += [(7, None, None, None), (7, None, "", ""), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, None, "tie"), (None, 1, "user", "lost"), (-150, 0, "user", "below"), (-100, 0, "user", "zero")]
    return rows + [(9000, 0, "user", "é" * 200_000), (9001, 0, "user", "é" * 200_000), (9002, 0, "us", "er")]


@pytest.fixture(scope="module")
def talks(spark):
    df = spark.createDataFrame(talk(), TURNS).repartition(5)
    return df.selectExpr("*", *[f"1 as {c}" for c in ("key", "sizes", "KIND", "part", "base", "h", "id")])


def test_trie(talks):
    want = Counter(brute.trie({c: t for c, t in _python_order(talk()).items()}))
    assert Counter(tuple(r) for r in conversation_trie(talks).collect()) == want
    assert conversation_trie(talks.limit(0)).count() == 0


def _python_order(rows):
    """c % 100 has the sign of c in Spark and SQL."""
    own = brute.rebuilt([r for r in rows if r[0] is None or r[0] >= 0])
    below = brute.rebuilt([(c and -c, *r) for c, *r in rows if c is not None and c < 0])
    opened = {150: "-150", 100: "-100"}
    assert set(below) == set(opened)
    import zlib

    turns = {-c: [(r or "", x or "") for k, _, r, x in rows if k == -c] for c in below}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        own[c] = tuple(turns.get(c + -c % 100, [])[:h] + turns[c][h:])
    return own


@pytest.mark.parametrize("fan_in, block", [(2, 40), (64, 7), (3, 100_000)])
def test_trie_in_small_pieces(spark, talks, fan_in, block):
    """Many partitions, merged few at a time, and trees pruned every few turns."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = Counter(tuple(r) for r in prefix_trie(with_shared_openings(conversation_keys(talks)), fan_in, block).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == Counter(brute.trie(_python_order(talk())))


def test_radix_tree_layouts():
    rng, seen = np.random.default_rng(4), Counter()
    tree = RadixTree(2)
    keys = [bytes(rng.integers(0, m, 2 * n, np.uint8)) for m, n in zip([3, 12, 40, 256] * 500, rng.integers(0, 5, 2000))]
    for i, k in enumerate(keys):
        assert tree.add(k, [1] * (len(k) // 2), i).stop == len(k)
    stack, widths = [tree.root], set()
    while stack:
        node = stack.pop()
        if node.children is not None:
            widths.add(node.children.layout)
            found = list(node.children.items())
            assert [b for b, _ in found] == sorted(b for b, _ in found) and len(found) == node.children.count <= node.children.layout
            stack += [c for _, c in found]
    assert widths == {4, 16, 48, 256}
    for k in keys:
        seen.update(k[:n] for n in range(len(k) + 1))
    for k in set(keys):
        for node in tree.path_to(k):
            assert node.count == seen[k[: node.stop]] and node.low == min(i for i, x in enumerate(keys) if x.startswith(k[: node.stop]))
            assert len(node.weights) == node.stop // 2 - node.start // 2


def _hashes(spark, texts):
    pairs = sorted({p for t in texts for p in brute.pairs_of(t)})
    rows = spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", "xxhash64(a, b) as x", "xxhash64(b, a, 1) as y").collect()
    return {(r.a, r.b): (r.x, r.y) for r in rows}


def _digits(v):
    return f"{v % 2**64:016x}{v >> 64:016x}"


def test_fingerprints(spark, edge, nothing):
    data = [r for r in edge_rows() if r[0] != 30] + [(100, edge_rows()[0][1]), (200, edge_rows()[0][1] + " end"), (300, "alone")]
    df = edge.filter("doc_id is null or doc_id <> 30").select("doc_id", "text").union(spark.createDataFrame(data[-3:], "doc_id long, text string"))
    parts = brute.edits(data)
    hashes = _hashes(spark, [t for p in parts for t in p])
    own = {t: brute.simhash(t, hashes) for p in parts for t in p}
    import hashlib

    want = Counter()
    for (d, _), (t, e, n) in zip(data, parts):
        near = sum((own[x] ^ own[t]).bit_count() <= 6 for x, _, _ in parts) - 1 if d is not None and d % 100 == 0 else None
        want[d, len(t), hashlib.sha256(e.encode()).hexdigest(), _digits(own[t]), _digits(own[e]), round(brute.likeness(own[t], own[e]), 9), round(brute.likeness(own[t], own[n]), 9), near] += 1
    got = Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in fingerprint_table(df).collect())
    assert got == want and any(k[-1] for k in want)
    assert fingerprint_table(edge).count() == len(edge_rows())  # clashing names, a text of 60,000 words
    assert fingerprint_table(nothing).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    assert fingerprint_table(one).first().near_next == 1.0


def test_fingerprints_of_any_table(spark):
    df = spark.createDataFrame([("x", "one two", None), ("y", None, "one two")], "name string, row string, which string")
    got = {r.name: (r.a, r.b) for r in fingerprints(df, ["name"], ["row", "which"]).select("name", as_text("row_0", "row_1").alias("a"), as_text("which_0", "which_1").alias("b")).collect()}
    assert got["x"][0] == got["y"][1] != "0" * 32 and got["x"][1] == got["y"][0] == "0" * 32


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_block_tables_find_all(spark, radius):
    rng = np.random.default_rng(radius)
    base = [int.from_bytes(rng.bytes(16), "little") for _ in range(6)]
    prints = {b ^ sum(1 << int(i) for i in set(rng.integers(0, 128, rng.integers(0, 9)))) for b in base for _ in range(60)} | {0, 1, 2**128 - 1}
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    rows = [(signed(v % 2**64), signed(v >> 64)) for v in prints]
    df = spark.createDataFrame(rows, "f0 long, f1 long")
    got = Counter(tuple(r) for r in within(df.limit(100), df, radius).collect())
    asked = {(r.f0, r.f1) for r in df.limit(100).collect()}
    bits = {r: (r[0] % 2**64) | (r[1] % 2**64) << 64 for r in rows}
    want = Counter((*a, *b, (bits[a] ^ bits[b]).bit_count()) for a in asked for b in rows if (bits[a] ^ bits[b]).bit_count() <= radius)
    assert got == want and len(want) >= 100


def test_no_table_of_fingerprints_is_broadcast(spark, tmp_path):
    """28 rows of each fingerprint come out of the explode, which Spark sizes as one."""
    path = str(tmp_path / "prints")
    spark.range(3_000).selectExpr("id * 7919 as f0", "id * 104729 as f1").write.parquet(path)
    df = spark.read.parquet(path)
    found = within(df.limit(10), df)
    docs = spark.range(300).selectExpr("id as doc_id", "concat_ws(' ', 'text', id, id + 1, id * 3) as text")
    for out in (found, fingerprint_table(docs)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def vectors(n=400, dims=16):
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(0, 0.2, dims).tolist(), int(i) % 5 if i % 7 else None) for i in rng.permutation(n)]
    rows += [(n + i, rows[0][1], 1) for i in range(150)]  # copies
    rows += [(9001, None, 1), (9002, [None] * dims, 1), (9003, [float("nan")] * dims, 1), (9004, [float("-inf"), *[0.0] * (dims - 1)], 2)]
    return rows + [(None, rows[1][1], 3), (None, rows[2][1], 3), (3, rows[3][1], 1), (3, rows[3][1], 1), (9005, [], 4), (9006, [0.5] * 6, 4), (9007, [1e30, -1e30, *[0.0] * (dims - 2)], 9)]


VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("n", [400, 40])
def test_vector_codes(spark, n):
    df = spark.createDataFrame(vectors(n), VECTORS).selectExpr("*", "1 as xs", "2 as CODE", "3 as v").repartition(4)
    assert Counter(tuple(r) for r in vector_codes(df).collect()) == Counter(brute.vector_codes(vectors(n)))
    assert vector_codes(df.limit(0)).count() == 0
    assert [tuple(r)[:4] for r in vector_codes(df.filter("vec_id = 9005")).collect()] == [(9005, "00000000", 0, 0)]


def test_vector_codes_in_small_blocks(spark):
    df = spark.createDataFrame(vectors(), VECTORS).repartition(3)
    coded, book = compress(df, rounds=2, entries=16, block=37)
    want = brute.vector_codes(vectors(), 2, 16)
    assert Counter((r.vec_id, r.code, r.error) for r in coded.collect()) == Counter(w[:3] for w in want) and book.shape == (16, 16)


def test_dictionary_distances():
    rng = np.random.default_rng(2)
    x, book = rng.integers(-(2**26), 2**26, (50, 8)), rng.integers(-(2**26), 2**26, (10, 8))
    values, codes = zip(*[np.unique(x[:, d], return_inverse=True) for d in range(8)])
    block = Block(np.concatenate(values), np.cumsum([0, *map(len, values)]), np.array(codes).astype("<u2").tobytes())
    entry, far = block.assign(book)
    for p in range(4):
        gaps = ((x[:, None, 2 * p : 2 * p + 2] - book[None, :, 2 * p : 2 * p + 2]) ** 2).sum(2)
        assert (entry[p] == gaps.argmin(1)).all() and (far[p] == gaps.min(1)).all()
