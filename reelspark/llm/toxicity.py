"""Operator 10: toxicity by a factorization machine over hashed terms.

Terms are lower-cased words and their prefixes, hashed into 2^18 slots. On a bounded sample of labelled rows two kinds of slots
are selected: those whose share differs most between the classes, and those of pairs whose joint share differs far more than that of
either term, such as an insult with a group mention that are both harmless alone. A factorization machine is fitted over
them: a linear weight for each slot plus a small vector whose inner products score pairs of terms, so that two terms together can
mean more (or less) than both apart. The intercept is set to the class shares of all labelled rows. Scoring reads every whole text
and nothing else.

Edge cases: null and empty texts have no terms and get the intercept's score; with no labelled rows of either
class all scores are the share of toxic labels (0 without labels); null labels and null doc_ids are never learned from;
repeated label rows count as often as they occur; repeated documents score alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .lang_id import held_out

SLOTS = 1 << 18
PREFIX = (4, 5, 6)
FACTORS = 8
MAX_POSITIVE, MAX_NEGATIVE = 3000, 6000
MAX_TERMS = 8192
MIN_Z = 3.5
#: Terms looked at in pairs (those of most varied presence, in SUPPORT texts at least), the least z of a pair, and how far above its terms' own.
PAIR_TERMS, SUPPORT, PAIR_Z, PAIR_LIFT = 2000, 10, 9.0, 2.0
CACHE = 400_000
_WORD = re.compile(r"[^\W_]+")


def word_slots(word: str) -> list[int]:
    terms = [word, *(f"{word[:n]}*" for n in PREFIX if len(word) > n)]
    return [xxhash.xxh32_intdigest(t) % SLOTS for t in terms]


def text_slots(text: str | None) -> list[int]:
    return sorted({s for w in set(_WORD.findall((text or "").lower())) for s in word_slots(w)})


class Machine:
    """score = intercept + sum of weights + (|sum of vectors|^2 - sum of |vector|^2) / 2 over the terms present."""

    def __init__(self, slots: np.ndarray, n_terms: int, rng: np.random.Generator):
        self.slots = slots  # selected slot -> position
        self.bias, self.w = 0.0, np.zeros(n_terms)
        self.v = rng.normal(0, 0.02, (n_terms, FACTORS))

    def margins(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(docs), self.bias)
        for i, d in enumerate(docs):
            if len(d):
                v = self.v[d]
                total = v.sum(0)
                out[i] += self.w[d].sum() + 0.5 * (total @ total - (v * v).sum())
        return out

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.15, decay: float = 2e-4):
        rng = np.random.default_rng(11)
        sw, sv, sb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
                slope = 1 / (1 + np.exp(-np.clip(self.margins([docs[i] for i in at]), -30, 30))) - y[at]
                gw, gv = np.zeros_like(self.w), np.zeros_like(self.v)
                for i, g in zip(at, slope):
                    d = docs[i]
                    if len(d):
                        v = self.v[d]
                        gw[d] += g
                        gv[d] += g * (v.sum(0) - v)
                used = np.flatnonzero(gw)
                gw, gv = gw[used] / len(at) + decay * self.w[used], gv[used] / len(at) + decay * self.v[used]
                sw[used] += gw * gw
                sv[used] += gv * gv
                self.w[used] -= rate * gw / np.sqrt(sw[used])
                self.v[used] -= rate * 0.3 * gv / np.sqrt(sv[used])
                gb = slope.mean()
                sb += gb * gb
                self.bias -= rate * gb / np.sqrt(sb)
        return self


def class_difference(hits: list[np.ndarray], n0: int, n1: int) -> np.ndarray:
    """z of the difference of shares between the classes."""
    both = (hits[0] + hits[1] + 0.5) / (n0 + n1 + 1)
    return (hits[1] / n1 - hits[0] / n0) / np.sqrt(both * (1 - np.minimum(both, 0.999)) * (1 / n0 + 1 / n1))


def paired(docs: list[np.ndarray], y: np.ndarray, hits: list[np.ndarray], z: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Slots of pairs that tell the classes apart much better than their terms do."""
    share = (hits[0] + hits[1]) / (n0 + n1)
    terms = np.argsort(-share * (1 - share), kind="stable")[:PAIR_TERMS]
    terms = np.sort(terms[(hits[0] + hits[1])[terms] >= SUPPORT])
    where = np.full(SLOTS, -1, np.int32)
    where[terms] = np.arange(len(terms))
    joint = []
    for k in (0, 1):
        present = np.zeros((int((y == k).sum()), len(terms)), np.float32)
        for row, d in zip(present, (d for d, v in zip(docs, y) if v == k)):
            row[where[d][where[d] >= 0]] = 1
        joint.append(present.T @ present)
    zz = np.abs(class_difference(joint, n0, n1))
    alone = np.abs(z[terms])
    good = (zz >= PAIR_Z) & (zz > PAIR_LIFT * np.maximum(alone[:, None], alone[None]))
    np.fill_diagonal(good, False)
    best = np.where(good, zz, 0).max(0, initial=0)
    order = np.argsort(-best, kind="stable")
    return terms[order[best[order] > 0]]


def select(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Position of each selected slot, -1 for the others."""
    hits = [np.bincount(np.concatenate([d for d, v in zip(docs, y) if v == k] or [np.zeros(0, np.int64)]), minlength=SLOTS) for k in (0, 1)]
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    z = class_difference(hits, n0, n1)
    best = np.argsort(-np.abs(z), kind="stable")[:MAX_TERMS]
    best = best[np.abs(z[best]) >= MIN_Z]
    pairs = paired(docs, y, hits, z, n0, n1) if len(docs) else best[:0]
    best = np.concatenate([best, pairs[~np.isin(pairs, best)]])[:MAX_TERMS]
    where = np.full(SLOTS, -1, np.int32)
    where[best] = np.arange(len(best))
    return where


def learn(ids: list[list[int]], y: np.ndarray, share: float) -> Machine:
    """share: of toxic rows among all labelled ones, for the intercept."""
    docs = [np.array(d, np.int64) for d in ids]
    where = select(docs, y)
    kept = [where[d][where[d] >= 0] for d in docs]
    m = Machine(where, int((where >= 0).sum()), np.random.default_rng(5))
    share = min(max(share, 1e-4), 1 - 1e-4)
    if len(set(y.tolist())) < 2:
        m.bias, m.w[:], m.v[:] = np.log(share / (1 - share)), 0, 0
        return m
    m.fit(kept, y)
    sampled = float(y.mean())
    m.bias += np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))
    return m


def labelled_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([text_slots(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["toxic", "slots"]
        )


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(5, 0))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = lambda k, most: (F.col("toxic") == k) & (F.pmod(F.xxhash64("doc_id"), F.lit(10_000_000)) < int(1 + 1e7 * most / max(1, n.get(k, 0))))
    # bounded: the hash range of each class is as wide as its limit allows
    picked = known.filter(part(1, MAX_POSITIVE) | part(0, MAX_NEGATIVE)).select("doc_id", "toxic")
    picked = picked.orderBy(F.xxhash64("doc_id"), "toxic").limit(2 * (MAX_POSITIVE + MAX_NEGATIVE)).collect()  # bites only where labels repeat
    picked = spark.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in picked], "id long, toxic int")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("toxic", "text")
    got = rows.mapInArrow(labelled_slots, "toxic int, slots array<int>").toArrow()
    y = np.array(got.column("toxic").to_pylist(), np.int64)
    total = sum(n.values())
    return learn(got.column("slots").to_pylist(), y, n.get(1, 0) / total if total else 0.0)


def scorer(m: Machine) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}

        def positions(word: str) -> tuple:
            got = tuple(int(p) for s in word_slots(word) if (p := m.slots[s]) >= 0)
            if len(cache) < CACHE:
                cache[word] = got
            return got

        for b in batches:
            docs = []
            for t in b.column(1).to_pylist():
                found: set[int] = set()
                for w in set(_WORD.findall(t.lower())) if t else ():
                    got = cache.get(w)
                    if got is None:
                        got = positions(w)
                    if got:
                        found.update(got)
                docs.append(np.array(sorted(found), np.int64))
            p = 1 / (1 + np.exp(-np.clip(m.margins(docs), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    m = train(docs, labels)
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scorer(m), "doc_id long, score double")
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
