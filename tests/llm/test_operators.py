"""Every operator on awkward tables, against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from clipspark.llm import near_duplicates, sharding, toxicity
from clipspark.llm.cotraining import quality_scores
from clipspark.llm.decontamination import find_leaks, leak_digests
from clipspark.llm.near_duplicates import class_digests, one_of_each
from clipspark.llm.packing import best_cuts, packed_digests
from clipspark.llm.quality import cleaned_table, quality_table
from clipspark.llm.repeats import removal_digests
from clipspark.llm.secrets import redacted, secret_digests
from clipspark.llm.token_counts import token_counts
from clipspark.llm.toxicity import learn, toxicity_table

from . import brute
from .conftest import edge_rows, prose

ITEMS = [(1, prose(60, 2)[:150]), (2, "two words"), (3, None), (4, ""), (5, prose(30, 5)), (6, "Two  WORDS!"), (None, "one")]


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns or df.columns).collect())


@pytest.mark.parametrize("block", [2_000_000, 7])
def test_decontamination(spark, edge, nothing, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as numbers", "2 as windows")
    found = find_leaks(edge, items, "found", block_windows=block).select("doc_id", "found.*").collect()
    want = Counter((d, n, h) for d, n, h, *_ in brute.leaks(edge_rows(), ITEMS))
    assert Counter((r.doc_id, r.n_words, len({p for a, b in zip(r.starts, r.ends) for p in range(a, b)})) for r in found) == want
    named = [i for i in ITEMS if i[0] is not None]
    items = items.filter("item_id is not null")
    assert rows(leak_digests(edge, items)) == Counter(brute.leaks(edge_rows(), named))
    assert leak_digests(nothing, items).count() == 0
    assert all(not r.contaminated for r in leak_digests(edge, items.limit(0)).collect())


def test_repeats(edge, nothing):
    assert rows(removal_digests(edge)) == Counter(brute.repeats(edge_rows()))
    assert rows(removal_digests(edge, window=5)) == Counter(brute.repeats(edge_rows(), 5))
    assert removal_digests(nothing).count() == 0


def test_near_duplicates(edge, nothing):
    assert rows(class_digests(edge)) == Counter(brute.classes(edge_rows()))
    assert class_digests(nothing).count() == 0 and one_of_each(nothing).count() == 0
    kept = one_of_each(edge)
    assert kept.columns == edge.columns
    want = brute.classes(edge_rows())
    first = {c for _, n, c in want if n}
    got = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    worded = [(d, t) for d, t in got if t and t.split()]
    assert {d for d, _ in worded} == first and len(worded) == len(set(worded))
    assert Counter(d for d, t in got if not (t and t.split())) == Counter(d for d, n, _ in want if not n)


def test_near_duplicates_in_chains_and_hot_groups(spark):
    """Copies with a growing number of edits: links only between neighbours."""
    base = prose(200, 50).split()
    data = [(0, " ".join(base))]
    for i in range(1, 60):
        base[(i * 3) % 200] = f"edit{i}"
        data.append((i, " ".join(base)))
    for i in range(60, 140):  # edits of their own
        w = prose(200, 50).split()
        for k in range(i % 9):
            w[(k * 20 + i) % 200] = f"own{i}x{k}"
        data.append((i, " ".join(w)))
    assert rows(class_digests(spark.createDataFrame(data, "doc_id long, text string").repartition(4))) == Counter(brute.classes(data))


def test_secrets(spark, edge, nothing):
    got = secret_digests(edge).collect()
    want = Counter()
    for doc, text in edge_rows():
        s = brute.base_spans(text)
        want[doc, *[sum(x.startswith(k) for x in s) for k in ("assign", "access", "hex")], hashlib.sha256(",".join(s).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    for r in got:
        assert sum(not x.startswith("random") for x in r.spans.split(",") if x) == r.n_assign + r.n_access + r.n_hex
    assert secret_digests(nothing).count() == 0
    clean = redacted(edge)
    assert clean.columns == edge.columns and clean.count() == edge.count()
    by_id = defaultdict(list)
    for r in clean.select("doc_id", "text").collect():
        by_id[r.doc_id].append(r.text)
    assert by_id[60] == ["x <secret>\" token:abcde secret=a1 <secret> <secret> <secret>"]
    assert by_id[4] == [None] and by_id[5] == [""]


def test_secrets_adds_what_passes_for_random(spark):
    rng = np.random.default_rng(3)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    keys = ["".join(rng.choice(letters, 40)) for _ in range(30)]
    dull = ["a1" * 20 + "Bb", "abcdefghij0123456789ABCDEFGHIJ", "theanderonthetionaningA1ontheandthe", "1234567890123456", "AAAAAAAAAAAAAAAAAAAAAAAAAAa1"]
    data = [(i, f"é key {k} end") for i, k in enumerate(keys + dull)]
    got = {r.doc_id: r.spans for r in secret_digests(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(got[i] == f"random:6:{6 + len(k)}" for i, k in enumerate(keys)) >= 27
    assert not any("random" in got[len(keys) + i] for i in range(len(dull)))


def test_quality(spark, edge, nothing):
    got = rows(quality_table(edge), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == Counter((d, *brute.quality(t)) for d, t in edge_rows())
    assert quality_table(nothing).count() == 0
    # a line in all documents of a host, and one in a few
    data = [(i, "a", "Home | About  us\n" + prose(60, i)) for i in range(40)] + [(i, "a", "\n".join(["home | about us " + "menu " * 50] * 1) + "\nshort " + prose(55, i)) for i in range(40, 60)]
    r = {x.doc_id: x for x in quality_table(spark.createDataFrame(data, "doc_id long, source string, text string")).collect()}
    assert all(r[i].n_boilerplate == 4 and r[i].kept == (not r[i].base_failed) for i in range(40))
    assert all(r[i].n_boilerplate == 54 for i in range(40, 60))


def test_cleaned_table_removes_lines(spark, edge, nothing):
    """46 of 90 words are left: fewer than the base rules ask for, though most words stay."""
    menu = "\n".join(f"Menu entry {k} " + "link " * 19 for k in range(2))  # 44 words
    data = [(i, "a", menu + "\n\n" + prose(46, i)) for i in range(30)] + [(i, "a", menu.upper() + "\n" + prose(60, i) + "\n \n" + menu) for i in range(30, 34)]
    data += [(i, "a", prose(60, i)) for i in range(34, 40)] + [(40, "a", None), (41, "a", menu), (41, "a", menu)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string").repartition(3)
    got = {x.doc_id: x for x in cleaned_table(df).collect()}
    for i in range(30):
        assert got[i].text == "\n" + prose(46, i) and (got[i].n_words, got[i].n_removed, got[i].kept) == (46, 44, False)
    for i in range(30, 34):
        assert got[i].text == prose(60, i) + "\n " and (got[i].n_words, got[i].n_removed, got[i].kept) == (60, 88, False)
    assert all(got[i].text == prose(60, i) and got[i].n_removed == 0 and got[i].kept == (not got[i].base_failed) for i in range(34, 40))
    assert got[40].text is None and got[41].text == "" and cleaned_table(df).count() == len(data)
    figures = {x.doc_id: x.n_boilerplate for x in quality_table(df).collect()}
    assert figures == {i: x.n_removed for i, x in got.items()}
    assert Counter((r.doc_id, r.text) for r in cleaned_table(edge).collect()) == Counter(edge_rows())
    assert cleaned_table(nothing).count() == 0


def test_cleaned_table_on_large_and_small_hosts(spark):
    """A line in 4 % of a large host goes; on a small host a share is enough, two documents aren't."""
    data = [(i, "large", ("Licensed to all\n" if i % 25 == 0 else "Seen in nine\n" if i % 50 == 1 and i < 450 else "") + prose(60, i)) for i in range(600)]
    data += [(1000 + i, "small", ("In three\n" if i < 3 else "In two\n" if i < 5 else "") + prose(60, 1000 + i)) for i in range(12)]
    got = {x.doc_id: x for x in cleaned_table(spark.createDataFrame(data, "doc_id long, source string, text string").repartition(4)).collect()}
    for i, _, text in data:
        gone = 3 if text.startswith("Licensed") else 2 if text.startswith("In three") else 0
        assert got[i].n_removed == gone and got[i].text == (text.split("\n")[1] if gone else text)


def test_removal_changes_the_verdict(spark):
    """A line in 4 % of a large host's documents: those it leaves under 50 words, or under half, are rejected."""
    menu = " ".join(f"entry{k}" for k in range(24))
    data = [(i, "large", f"{menu}\n{prose(45 + i % 30, i)}" if i % 25 == 0 else prose(70, i)) for i in range(1000)]
    got = quality_table(spark.createDataFrame(data, "doc_id long, source string, text string").repartition(4)).collect()
    changed = [r for r in got if not r.kept and not r.base_failed]
    assert {r.doc_id for r in changed} == {i for i in range(0, 1000, 25) if 45 + i % 30 < 50}
    assert all(r.n_boilerplate == (24 if r.doc_id % 25 == 0 else 0) for r in got)


def test_packing(spark, edge, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    one = Tokenizer.from_file(path)
    want = Counter()
    for d, t in edge_rows():
        want[d, np.array(one.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()] += 1
    from clipspark.llm.packing import pack

    pieces = pack(edge, path).collect()
    seqs, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id, p.doc_tokens].append((p.start, bytes(p.ids)))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 2048
    whole = Counter()
    for (d, total), parts in docs.items():
        copies = max(Counter(s for s, _ in parts).values())
        if d in (3, None, 33):  # rows that share an id
            continue
        assert b"".join(x for _, x in sorted(parts)) and copies == 1
        whole[d, b"".join(x for _, x in sorted(parts))] += 1
    assert whole == Counter({k: v for k, v in want.items() if k[0] not in (3, None, 33)})
    assert sum(p.length for p in pieces) == sum(len(k[1]) // 4 * v for k, v in want.items())
    digest = packed_digests(edge, path).filter("doc_id = 1").first()
    text = dict(edge_rows())[1]
    assert digest.ids_crc32 == zlib.crc32(np.array(one.encode(text, add_special_tokens=False).ids + [1], "<u4").tobytes()[4 * digest.start : 4 * (digest.start + digest.length)])
    assert pack(nothing, path).count() == 0


def test_cuts_cost_least():
    rng = np.random.default_rng(1)
    for _ in range(30):
        position = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 40))])
        penalty = rng.integers(0, 6, len(position))
        cost = [0] + [10**9] * 40
        for j in range(1, 41):
            cost[j] = min(cost[i] + 20 - (position[j] - position[i]) + penalty[j] for i in range(j) if position[j] - position[i] <= 20)
        cuts = best_cuts(position, penalty, 20)
        assert cuts[0] == 0 and cuts[-1] == 40
        assert sum(20 - (position[b] - position[a]) + penalty[b] for a, b in zip(cuts, cuts[1:])) == cost[40]


def _thue_morse(n):
    """Two different words of 2 ** n letters that many polynomial hashes can't tell apart."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [10, 12])
def test_words_that_look_alike(spark, n):
    a, b = _thue_morse(n)
    rest = prose(34, 80).split()
    data = [(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, a), (4, b), (5, " ".join([a, *prose(60, 81).split()])), (6, " ".join([b, *prose(60, 81).split()]))]
    one, two = ("one " + " ".join(_thue_morse(10)[k]).replace("a", "ka").replace("b", "lo") for k in (0, 1))
    data += [(7, one), (8, two)]  # the same pattern in words
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert rows(class_digests(df)) == Counter(brute.classes(data))
    assert rows(removal_digests(df)) == Counter(brute.repeats(data))
    assert not any(r.n_removed for r in removal_digests(df.filter("doc_id < 5")).collect())
    items = [(1, a), (2, " ".join([a, *rest[:9]]))]
    assert rows(leak_digests(df, spark.createDataFrame(items, "item_id long, text string"))) == Counter(brute.leaks(data, items))
    scores = {"▁": -1.0, "a": -2.0, "b": -3.0, "ab": -2.5, "▁a": -1.5}
    assert rows(token_counts(df, scores, keep=["doc_id"]), "doc_id", "n_tokens") == Counter((d, brute.unigram_tokens(t, scores)) for d, t in data)


def test_token_counts(edge, nothing):
    scores = {p: -float(i) for i, p in enumerate("▁ a b d o r the ▁the an d ▁an ▁k ba ban ▁ka kaban dor lo lodor n e f ▁t wo".split())}
    got = rows(token_counts(edge, scores, keep=["doc_id"]), "doc_id", "n_tokens")
    assert got == Counter((d, brute.unigram_tokens(t, scores)) for d, t in edge_rows())
    assert token_counts(nothing, scores).count() == 0


def test_sharding(spark):
    sizes = [(i, 10 + i * 7 % 90) for i in range(300)] + [(1000, 20)] * 150 + [(2000, 5000), (None, 3), (2001, None), (2002, 0)]
    df = spark.createDataFrame(sizes, "key long, bytes long").repartition(3)
    got = sharding.extendible_shards(df, limit=400).collect()
    assert Counter((r.key, r.bytes) for r in got) == Counter((k, b or 0) for k, b in sizes)
    sums, counts, depth = Counter(), Counter(), {}
    for r in got:
        sums[r.shard] += r.bytes
        counts[r.shard] += 1
        assert len(r.shard) == r.depth
    assert all(r.shard_bytes == sums[r.shard] for r in got)
    assert all(sums[s] <= 400 or counts[s] == 1 for s in sums)
    names = sorted(sums)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard inside another
    for s in names:  # a split was needed: the bucket above is over the limit
        if s:
            assert sum(v for k, v in sums.items() if k.startswith(s[:-1])) > 400
    assert sharding.extendible_shards(df.limit(0)).count() == 0


def _labelled(spark):
    """Toxic rows in two made-up languages; one of them only by word beginnings."""
    data, labels = [], []
    for i in range(600):
        toxic, text = i % 5 == 0, prose(60, i)
        if toxic:
            text += " " + ("You idiot moron" if i % 2 else f"grobnak{'xyz'[i % 3]}o grobnak{i % 7}i vrulzin{'abc'[i % 3]}e")
        if i % 11 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        data.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(toxic), int(i % 11 != 0)))
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity(spark, edge, nothing):
    docs, labels = _labelled(spark)
    got = toxicity_table(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 100 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all((r.predicted == 1) == (r.score >= 0.7) for r in got)
    assert sum(r.predicted != r.toxic for r in got) <= 0.02 * len(got)
    scored = toxicity_table(edge, labels.union(labels.limit(5))).collect()
    assert len(scored) == len(edge_rows()) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity_table(nothing, labels.limit(0)).count() == 0
    # without labels the fixed list decides
    by = {r.doc_id: r.predicted for r in toxicity_table(edge, labels.limit(0)).collect()}
    assert by[70] == 1 and sum(by.values()) == 1


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(5)
    y = rng.random(40_000) < 0.2
    rate = [(0.9, 0.02), (0.8, 0.05), (0.7, 0.01), (0.6, 0.1)]
    x = np.column_stack([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in rate] + [np.zeros(len(y), bool)])
    x = np.column_stack([x, x[:, 0]])  # a voter that repeats another
    weight, offset = toxicity.label_model(len(y), x.sum(0), x.T.astype(int) @ x.astype(int), 0.2)
    odds = x @ weight + offset
    assert ((odds > 0) == y).mean() > 0.95
    assert weight[0] < 0.9 * toxicity.label_model(len(y), x[:, :4].sum(0), x[:, :4].T.astype(int) @ x[:, :4].astype(int), 0.2)[0][0]


def test_cotraining(spark, edge, nothing):
    docs, labels = _labelled(spark)
    got = quality_scores(docs, labels.select("doc_id", "quality")).join(labels, "doc_id").filter("held_out").collect()
    assert sum((r.score > 0.5) != (r.quality == 1) for r in got) <= 0.03 * len(got)
    scored = quality_scores(edge, labels).collect()
    assert len(scored) == len(edge_rows()) and all(0 <= r.score <= 1 for r in scored)
    assert quality_scores(nothing, labels).count() == 0
    assert {r.score for r in quality_scores(edge, labels.limit(0)).collect()} == {0.0}


def test_frequent_words_are_bounded(spark):
    docs = spark.createDataFrame([(i, prose(300, i)) for i in range(20)], "doc_id long, text string")
    number, level = near_duplicates.frequent_words(docs, 1 / 16)
    assert 0 < len(number) <= 19 and (level >= 1).all()


def test_learn_returns_sorted_features(spark):
    docs, labels = _labelled(spark)
    model = learn(docs, labels)
    assert (np.diff(model.number.astype(float)) >= 0).all() and len(model.number) == len(model.weight)


def classes_by(data, shingle, percent):
    """Classes by brute force, for any shingle length and share."""
    words = [brute.SPACED.findall(brute.low(t)) for _, t in data]
    sets = [{tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set() for w in words]
    head = list(range(len(data)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if (both := len(x & y)) and 100 * both >= percent * (len(x) + len(y) - both) and head[i] != head[j]:
                head = [head[i] if h == head[j] else h for h in head]
    least = {h: min((d for (d, _), g in zip(data, head) if g == h and d is not None), default=None) for h in set(head)}
    return [(d, len(s), least[h] if s else d) for (d, _), s, h in zip(data, sets, head)]


def test_near_duplicates_by_another_rule(spark):
    """Copies that 0.9 of three words keeps apart and 0.8 of five words links, and sets short of either."""
    base = prose(200, 70).split()
    data = [(0, " ".join(base)), (1, " ".join(base[:100] + prose(12, 71).split() + base[100:])), (2, " ".join(base[:100] + prose(60, 72).split() + base[100:])), (3, "one two three four"), (4, "one two three four")]
    for i in range(10, 60):
        w = prose(200, 70 + i % 3).split()
        for k in range(i % 7):
            w[(k * 25 + i) % 200] = f"own{i}x{k}"
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    rule, want = near_duplicates.Rule(5, 80), classes_by(data, 5, 80)
    assert want[1][2] == 0 and want[4][2] == 3 and want != brute.classes(data)
    assert rows(near_duplicates.duplicate_classes(df, rule=rule), "doc_id", "n_shingles", "component_id") == Counter(want)
    assert {r.doc_id for r in one_of_each(df, rule=rule).collect()} == {c for _, _, c in want}
