"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text, pattern=SPACED, lower=False):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def decontamination(docs, items, window=13):
    owners = defaultdict(set)
    for item, text in items:
        w = words(text, ALNUM, True)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            owners[tuple(w[i : i + m])].add(item)
    sizes = {len(k) for k in owners}
    out = []
    for doc, text in docs:
        w = words(text, ALNUM, True)
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (o := owners.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= o
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def substrings(docs, window=50):
    first = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def near_duplicates(docs, share=75):
    sets = {}
    for doc, text in docs:
        w = words(text, lower=True)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    where, root = defaultdict(list), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for e in where[x]:
                common[e] += 1
            where[x].append(d)
        for e, c in common.items():
            if 100 * c >= share * (len(s) + len(sets[e]) - c):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]


def prefix_trie(rows):
    """Nodes of the rebuilt conversations from (conv_id, turn, role, text) rows."""
    import zlib

    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            conv[c].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    conv = {c: [v[3:] for v in sorted(turns)] for c, turns in conv.items()}
    built = {}
    for c, turns in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = conv.get(c - c % 20, [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(int)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for path in members:
        if path:
            children[path[:-1]] += 1
    below = {path: [0, 0] for path in members}
    for path, held in members.items():
        n = len(words(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            below[path[:d]][0] += (len(held) - 1) * n
            below[path[:d]][1] += path not in children
    return [
        (min(held), len(path), min(members[path[:-1]]) if path else None, len(held), children.get(path, 0), below[path][1], below[path][0],
         sha(",".join(str(c) for c in sorted(held) if len(built[c]) == len(path))))
        for path, held in members.items()
    ]


def alignment(texts, pair):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, from the whole encodings of the two libraries."""
    found, total = [], defaultdict(int)
    for text in texts:
        a, b = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids, pair.b.encode(text or "")
        parts = [[pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            found.append(None)
            continue
        ends = [[sum(map(len, p[: i + 1])) for i in range(len(p))] for p in parts]
        spans = [list(zip([0, *e], e)) for e in ends]
        links = [(a[i], b[j]) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if x[0] < y[1] and y[0] < x[1]]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for end in common:
            i2, j2 = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        for link in links:
            total[link] += 1
        found.append((len(a), len(b), links, groups))
    top = defaultdict(int)
    for (_, b), n in total.items():
        top[b] = max(top[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None else
        (f[0], f[1], len(f[3]), len(f[2]), sum(total[x] == top[x[1]] for x in f[2]), sum(total[x] for x in f[2]), sha(";".join(f[3])))
        for f in found
    ]


def lm_scores(rows, good, order=4, weight=5.0, least=2):
    """(doc_id, n_tokens, loss_target, loss_background, score) of interpolated character models, from plain dictionaries."""
    total = Counter(c for _, t in rows for c in t or "")
    known = {c for c, n in total.items() if n >= least}
    of = {}
    for i, (d, t) in enumerate(rows):
        of[i] = ["^"] * (order - 1) + [c if c in known else "" for c in t or ""]
    counts = {side: Counter() for side in "tb"}
    contexts = {side: Counter() for side in "tb"}
    for i, (d, _) in enumerate(rows):
        for side in "tb" if d in good else "b":
            for end in range(order, len(of[i]) + 1):
                for k in range(1, order + 1):
                    g = tuple(of[i][end - k : end])
                    counts[side][g] += 1
                    contexts[side][k, g[:-1]] += 1

    def loss(side, g):
        p = 1 / (len(known) + 1)
        for k in range(1, order + 1):
            own = g[-k:]
            p = (counts[side][own] + weight * p) / (contexts[side][k, own[:-1]] + weight)
        return -math.log2(p)

    out = []
    for i, (d, t) in enumerate(rows):
        grams = [tuple(of[i][end - order : end]) for end in range(order, len(of[i]) + 1)]
        a, b = (sum(loss(side, g) for g in grams) / len(grams) if grams else None for side in "tb")
        out.append((d, len(grams), a, b, a - b if grams else None))
    return out
