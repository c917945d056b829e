"""Whitening, decontamination and ranked search against plain versions, and their edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from reelspark.llm import decontamination, ranked_search, terms, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# columns named like the operators' own
DOCS = "doc_id long, text string, n_words int, runs string, items int, spans string, n int, terms string, tf int, item int, lane int, score int, rank int, _v string"
ITEMS = "item_id long, text string, item int, window string, w int, term int, doc_id int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", 2, "s", 3, "t", 4, 5, 6, 7, 8, "v") for i, t in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", 2, 3, 4) for i, t in rows], ITEMS)


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def said(rng, n, vocabulary=30):
    glue = [" ", ", ", ". ", "\n", " - ", "  "]
    return "".join(rng.choice(["Wort", "año", "x", "été", "b2", "東京", "naïve", "DOG"]) + str(rng.randrange(vocabulary)) + rng.choice(glue) for _ in range(n))


# ---- decontamination


def plain_windows(items, size):
    out = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[i : i + size]), set()).add(item)
    return out


def plain_hits(text, known):
    w, hit, named = words(text), set(), set()
    for size in {len(k) for k in known}:
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in known:
                hit |= set(range(i, i + size))
                named |= known[tuple(w[i : i + size])]
    return len(w), hit, sorted(str(n) for n in named if n is not None)


@pytest.fixture(scope="module")
def leaked():
    rng = random.Random(3)
    items = [(i, said(rng, rng.choice([3, 9, 10, 11, 25]))) for i in range(12)] + [(3, said(rng, 14)), (None, said(rng, 12)), (20, None), (21, " .!? "), (22, "x1")]
    docs = [(None, None), (1, ""), (2, " \n\t ")]
    for i in range(3, 60):
        parts = [said(rng, rng.randrange(12))]
        for _ in range(rng.randrange(4)):
            parts += [(rng.choice(items)[1] or "").lower() if rng.random() < 0.5 else (rng.choice(items)[1] or "").upper(), " ", said(rng, rng.randrange(4))]
        docs.append((i, " ".join(parts)))
    docs += [docs[10], docs[10], (docs[11][0], "other text of the same id"), (None, docs[12][1])]
    return docs, items


@pytest.mark.parametrize("most", [200_000, 40])
def test_decontamination_against_plain(spark, leaked, most):
    docs, items = leaked
    known = plain_windows(items, 10)
    got = decontamination.benchmark_spans(docs_of(spark, docs), items_of(spark, items), max_windows=most).collect()
    texts = {}
    for doc_id, text in docs:
        n, hit, named = plain_hits(text, known)
        texts.setdefault((doc_id, n, len(hit), tuple(named)), []).append(text)
    assert sorted(map(str, [(r.doc_id, r.n_words, sum(s.words for s in r.spans), tuple(r["items"])) for r in got])) == sorted(
        str(k) for k, rows in texts.items() for _ in rows)
    for r in got:  # spans cut the hit words out of the original text
        for text in texts[(r.doc_id, r.n_words, sum(s.words for s in r.spans), tuple(r["items"]))]:
            _, hit, _ = plain_hits(text, known)
            at = [m.span() for m in WORD.finditer((text or "").translate(UPPER))]
            runs = [i for i in sorted(hit) if i - 1 not in hit]
            stops = [i for i in sorted(hit) if i + 1 not in hit]
            if [(s.start, s.stop) for s in r.spans] == [(at[a][0], at[b][1]) for a, b in zip(runs, stops)]:
                break
        else:
            raise AssertionError(r)


def test_decontamination_digest_and_empty_tables(spark, leaked):
    docs, items = leaked
    known = plain_windows(items, 10)
    d, i = docs_of(spark, docs), items_of(spark, items)
    got = decontamination.decontamination(d, i).collect()
    assert len(got) == len(docs) and {r.contaminated for r in got} == {True, False}
    for r in got:
        plain = [plain_hits(t, known) for x, t in docs if x == r.doc_id]
        assert any(r.n_hit == len(h) and r.n_items == len(n) and r.items_sha256 == hashlib.sha256(",".join(n).encode()).hexdigest() for _, h, n in plain)
        assert r.contaminated == (r.n_hit > 0)
    assert decontamination.decontamination(d.limit(0), i).collect() == []
    clean = decontamination.decontamination(d, i.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.n_items for r in clean)


def test_matches_cross_blocks_of_a_long_text(spark, monkeypatch):
    rng = random.Random(5)
    text = said(rng, 4000, 6)
    items = [(i, " ".join(words(text)[k : k + 12])) for i, k in enumerate(range(0, 3900, 37))]
    monkeypatch.setattr(terms, "BLOCK", 64)
    pairs = [(str(i), list(w)) for w, named in plain_windows(items, 10).items() for i in named]
    n, runs, named = decontamination.Windows(pairs).scan(terms.normal(text.encode()))
    count, hit, plain = plain_hits(text, plain_windows(items, 10))
    assert (n, sorted(named)) == (count, plain)
    assert {w for a, b in runs for w in range(a, b + 1)} == hit
    assert all(b[0] > a[1] + 1 for a, b in zip(runs, runs[1:]))  # maximal


def test_very_long_text(spark):
    long = "filler " * 400_000 + "the quick brown fox jumps over the lazy dog tonight " + "Füller " * 400_000
    got = decontamination.benchmark_spans(docs_of(spark, [(1, long)]), items_of(spark, [(5, "The QUICK brown fox jumps; over the lazy dog tonight!")])).first()
    assert (got.n_words, got["items"], [tuple(s) for s in got.spans]) == (800_010, ["5"], [(2_800_000, 2_800_051, 10)])


# ---- ranked search


def plain_search(docs, items, k=10):
    bags = [(d, words(t)) for d, t in docs if words(t)]
    n_all, total = len(bags), sum(len(w) for _, w in bags)
    df = {}
    for _, w in bags:
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    out = []
    for item in {i for i, _ in items}:
        asked = {w for i, t in items if i == item for w in words(t)}
        found = []
        for d, w in bags:
            m = 10 + 90 * len(w) * n_all // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in asked if t in w)
            if s > 0:
                found.append((-s, d is None, d or 0))
        found.sort()
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    docs = [(i, said(rng, rng.choice([1, 5, 40, 200]), rng.choice([5, 40]))) for i in range(150)]
    docs += [(None, docs[3][1]), (200, docs[3][1]), (199, docs[3][1]), (None, None), (201, ""), (202, " ... "), docs[7], (7, docs[9][1])]
    items = [(i, said(rng, rng.choice([1, 8, 60]), 40)) for i in range(9)] + [(4, said(rng, 5)), (None, docs[3][1]), (50, None), (51, "!!"), (52, "unheard"), (53, " ".join(f"b2{i}" for i in range(40)) + said(rng, 150, 40))]
    return docs, items


@pytest.mark.parametrize("most, block", [(200_000, 4096), (60, 16)])
def test_search_against_plain(spark, corpus, most, block, monkeypatch):
    docs, items = corpus
    got = ranked_search.ranked_search(docs_of(spark, docs).repartition(3), items_of(spark, items), max_terms=most)
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()], key=str) == plain_search(docs, items)


def test_small_blocks_and_wide_masks(corpus):
    """Blocks carry the best so far; masks of over 64 terms; the search stops before the last mask."""
    docs, items = corpus
    bags = [(d, words(t)) for d, t in docs if words(t)]
    names = sorted({w for _, t in items for w in words(t)})
    number = {t: i for i, t in enumerate(names)}
    n_all, total = len(bags), sum(len(w) for _, w in bags)
    weight = np.array([ranked_search.weight_of(n_all, sum(t in w for _, w in bags)) for t in names], np.int64)
    rows = []
    for d, w in bags:
        mine = sorted({number[t] for t in w if t in number})
        rows.append((d, len(w), np.array(mine, np.uint32).tobytes(), np.array([w.count(names[j]) for j in mine], np.int64).tobytes()))
    plain = plain_search(docs, items)
    for item in {i for i, _ in items}:
        asked = np.array(sorted({number[w] for i, t in items if i == item for w in words(t)}), np.int64)
        best = []
        for at in range(0, len(rows), 16):
            best = ranked_search.best_of_block(ranked_search.Block(rows[at : at + 16], len(names), n_all, total), asked, weight[asked], best, 10)
        got = [(item, r, None if d == ranked_search._NO_ID else d, -s) for r, (s, d) in enumerate(best, 1)]
        assert sorted(got, key=str) == [p for p in plain if p[0] == item]


def test_search_empty_tables_and_long_text(spark, corpus):
    docs, items = docs_of(spark, corpus[0]), items_of(spark, corpus[1])
    assert ranked_search.ranked_search(docs.limit(0), items).collect() == []
    assert ranked_search.ranked_search(docs, items.limit(0)).collect() == []
    long = "filler " * 500_000 + "needle " + "filler " * 500_000
    got = ranked_search.ranked_search(docs_of(spark, [(1, long), (2, "needle"), (3, "hay")]), items_of(spark, [(1, "Needle")])).orderBy("rank").collect()
    assert [(r.doc_id, r["rank"]) for r in got] == [(2, 1), (1, 2)]


# ---- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], "vec_id long, embedding array<float>, n int, x string, component int, i int")


def plain_whitening(rows, k=16):
    """By eigh: x, n, S, deviations, covariance, eigenvalues and vectors."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    y = (n * fit - s) / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    return x, n, s, ((n * x - s) ** 2).sum(1), v, e[::-1], q[:, ::-1]


@pytest.mark.parametrize("d, size", [(24, 300), (8, 200)])
def test_whitening_against_eigh(spark, d, size):
    rng = np.random.default_rng(d)
    good = [(i, (rng.standard_normal(d) * (1 + np.arange(d)) * 3).tolist()) for i in range(size)]
    good += [good[0]] * 40 + [(None, good[1][1]), (5, good[2][1])]
    bad = [(1000, None), (1001, [float("nan")] + [1.0] * (d - 1)), (1002, [float("inf")] * d), (1003, [None] + [1.0] * (d - 1)), (1004, []), (1005, [1.0] * (d - 1))]
    got = whitening.whiten(vectors(spark, good + bad).repartition(3)).collect()
    x, n, s, deviation, v, e, q = plain_whitening(good)
    k = min(16, d)
    assert len(got) == len(good) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    signs = None
    for (vec_id, _), row, dev in zip(good, x, deviation):
        mine = by[(vec_id, int(dev))]
        white = np.array([mine[c].whitened for c in range(1, k + 1)])
        plain = ((n * row - s) / n) @ q[:, :k] / np.sqrt(e[:k])
        signs = np.sign(white * plain) if signs is None else signs
        assert np.allclose(white, plain * signs, rtol=1e-9, atol=1e-9)
        assert all(mine[c].n == n and abs(mine[c].explained / (e[c - 1] / np.trace(v)) - 1) < 1e-9 for c in range(1, k + 1))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_of_few_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no variance
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (2, [2.0, 4.0, 0.0])])).orderBy("vec_id").collect()
    assert [(r.vec_id, r.component, r.n, round(abs(r.whitened), 9), round(r.explained, 9)) for r in got] == [(1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0)]
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 2.0]), (2, [-1e30, 4.0]), (3, [5.0, 6.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(r.deviation is None for r in huge if r.vec_id < 3)


@pytest.mark.parametrize("d", [1, 2, 5, 33])
def test_spectrum_of_hard_matrices(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    several = np.repeat(2.0 ** -np.arange(d), 3)[:d]
    close = 1 + 1e-13 * np.arange(d)
    a = rng.standard_normal((d // 2 + 1, d))
    for v in (np.zeros((d, d)), np.eye(d), (q * several) @ q.T, (q * close) @ q.T, a.T @ a, np.diag(np.arange(d) * 1.0), np.ones((d, d))):
        v = (v + v.T) / 2
        e, u = whitening.spectrum(v)
        size = max(np.abs(v).max(), 1e-300)
        assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * d * size, rtol=0)
        assert np.allclose(u.T @ u, np.eye(d), atol=1e-12) and np.allclose(v @ u, u * e, atol=1e-12 * d * size)
