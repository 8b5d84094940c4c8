"""Plain Python versions of the operators, for small tables of (doc_id, text) rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def leaks(rows, items, k=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(low(text))
        n = min(k, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = word.findall(low(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


def repeats(rows, k=35):
    texts = [SPACED.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in texts for i in range(len(w) - k + 1))
    out = []
    for (doc, _), w in zip(rows, texts):
        gone = {p for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for p in range(i, i + k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def classes(rows):
    sets = []
    for _, t in rows:
        w = SPACED.findall(low(t))
        sets.append(frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else []))
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            head[find(i)] = find(j)
    members = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        members[find(i)].append(doc)
    return [(doc, len(s), doc if not s else min((d for d in members[find(i)] if d is not None), default=None)) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def base_spans(text):
    t = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def quality(text):
    w, lines, seen, dups = SPACED.findall(text or ""), (text or "").split("\n"), set(), 0
    for x in lines:
        if SPACED.search(x):
            dups += x in seen
            seen.add(x)
    c = Counter(zip(w, w[1:], w[2:]))
    again = {p for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dups, len(again), failed


def unigram_tokens(text, scores):
    low_score, longest = min(scores.values()) - 10.0, max(map(len, scores))
    total = 0
    for word in SPACED.findall(text or ""):
        word = "▁" + word
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + low_score * n, best[end - 1][1] - n)]
            options += [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in scores]
            best.append(max(options))
        total -= best[-1][1]
    return total


def rebuilt(rows):
    """Turns (role, text) of each conversation in order, openings replaced."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    opened = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: tuple(own.get(c - c % 100, [])[: opened[c]] + own[c][opened[c] :]) for c in own}


def trie(convs):
    members, kids, below, out = defaultdict(list), defaultdict(list), {}, []
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[convs[c][:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=lambda k: -len(k)):
        under = kids.get(k, [])
        leaves = sum(below[x][0] for x in under) or 1
        saved = sum(below[x][1] for x in under) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        below[k] = leaves, saved
        ends = ",".join(str(c) for c in members[k] if len(convs[c]) == len(k))
        out.append((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(under), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def pairs_of(text):
    w = SPACED.findall(text or "")
    return list(zip(w, [*w[1:], ""]))


def simhash(text, hashes):
    """128 bits; ``hashes`` gives the two 64-bit hashes of a pair of words."""
    votes = [0] * 128
    for a, b in pairs_of(text):
        h, weight = (hashes[a, b][0] % 2**64) | (hashes[a, b][1] % 2**64) << 64, min(len(a) + len(b), 64)
        votes = [v + (weight if h >> i & 1 else -weight) for i, v in enumerate(votes)]
    return sum(1 << i for i, v in enumerate(votes) if v > 0)


def edits(rows):
    """(text, edited text, next text) of each row."""
    least = {}
    for d, t in rows:
        k = (d is not None, d or 0)
        least[k] = min(least.get(k, t or ""), t or "", key=lambda x: hashlib.md5(x.encode()).hexdigest())
    ids = sorted(least)
    after = {k: least[n] for k, n in zip(ids, [*ids[1:], ids[0]])} if ids else {}
    out = []
    for d, t in rows:
        t, nxt = t or "", after[d is not None, d or 0]
        q = len(t) // 4
        out.append((t, t[: len(t) - q] + nxt[:q], nxt))
    return out


def likeness(a, b):
    return max(0.0, math.cos((a ^ b).bit_count() * math.pi / 128))


def vector_codes(rows, rounds=4, entries=256):
    """(vec_id, code, error, label_error, digest) by plain loops."""
    kept = [(i, [max(-(2**26), min(2**26, math.floor(1024 * x))) if math.isfinite(x) else x for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    book, size = [v + [0] * (dims - len(v)) for _, v, _ in order[:entries]], dims // 4
    kept = [(i, v + [0] * (dims - len(v)), label) for i, v, label in kept]

    def nearest(v, p):
        return min((sum((x - y) ** 2 for x, y in zip(v[p * size : p * size + size], e[p * size : p * size + size])), k) for k, e in enumerate(book))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(4):
                groups[nearest(v, p)[1], p].append(v[p * size : p * size + size])
        for (k, p), parts in groups.items():
            book[k][p * size : p * size + size] = [sum(c) // len(parts) for c in zip(*parts)]
    coded = [(i, [nearest(v, p) for p in range(4)], label) for i, v, label in kept]
    sums = Counter()
    for _, near, label in coded:
        sums[label] += sum(d for d, _ in near)
    digest = hashlib.sha256(",".join(str(x) for p in range(4) for e in book for x in e[p * size : p * size + size]).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), sums[label], digest) for i, near, label in coded]
