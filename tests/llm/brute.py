"""Plain single-process versions of the operators, to compare with."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def suffix_dedup(docs, length=100):
    """docs: (doc_id, text) in any order, no two alike -> sorted rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256). Texts of one
    doc_id must have no long string in common, for their order is free."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def jaccard_components(docs):
    """Rows are nodes -> sorted rows (doc_id, n_shingles, component_id)."""
    sets = [shingle_set(t) for _, t in docs]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    of, least = components(pairs, range(len(sets))), {}
    for at, c in of.items():
        if docs[at][0] is not None:
            least[c] = min(least.get(c, docs[at][0]), docs[at][0])
    return sorted(((d, len(sets[at]), least.get(of[at])) for at, (d, _) in enumerate(docs)), key=str)


def quality(text):
    """Base columns only."""
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def targets(sizes, cap=3):
    """sizes: {source: size} -> {source: target}, by repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def lm_losses(docs, good, strength=8.0):
    """(doc_id, tokens, loss under all other documents, loss under the other good ones) of every row, by counts of real words and pairs."""
    split = [(t or "").encode().lower().split() for _, t in docs]
    size = len({w for words in split for w in words})

    def counted(rows):
        words, before, pairs = Counter(), Counter(), Counter()
        for w in rows:
            words.update(w)
            before.update([None, *w][:-1] if w else [])
            pairs.update(zip([None, *w], w))
        return words, before, pairs

    chosen = [d in good for d, _ in docs]
    models = [counted(split), counted([w for w, g in zip(split, chosen) if g])]
    tokens = [sum(m[0].values()) for m in models]
    match = min(1.0, tokens[1] / tokens[0]) if tokens[1] else 1.0
    out = []
    for (doc_id, _), w, g in zip(docs, split, chosen):
        own, losses = counted([w]), []
        for model, n, weight, mine in ((models[0], tokens[0], match, 1), (models[1], tokens[1], 1.0, int(g))):
            total = 0.0
            for a, b in zip([None, *w], w):
                words, before, pairs = (m[k] - mine * o[k] for m, o, k in zip(model, own, (b, a, (a, b))))
                unigram = (weight * words + 0.5) / (weight * (n - mine * len(w)) + 0.5 * size)
                total -= math.log2((weight * pairs + strength * unigram) / (weight * before + strength))
            losses.append(total / max(1, len(w)))
        out.append((doc_id, len(w), *losses))
    return out


def mixture(docs, goal, quantum=lambda target: max(16, int(target // 256)), epochs=3):
    """docs: (doc_id, size, source rank) -> {doc_id: words taken}; goal: {rank: (target, source_size)}."""
    budget, packets, taken = sum(n for _, n, _ in docs), [], Counter()
    for rank, (target, size) in goal.items():
        at = 0
        queue = [(e, hashlib.md5(f"{e}-{d}".encode()).hexdigest(), d, n) for d, n, r in docs if r == rank and n for e in range(1, epochs + 1) if target > (e - 1) * size]
        for e, h, d, n in sorted(queue):
            q = quantum(target)
            for k in range(-(-n // q)):
                part = min(q, n - k * q)
                packets.append(((at + k * q + part) / target, rank, e, h, d, k, part))
            at += n
    for *_, d, _, part in sorted(packets):
        part = min(part, budget)
        budget -= part
        taken[d] += part
    return taken
