"""Operator 8: language ID by error-correcting output codes.

Every learned language gets a codeword of bits. One binary classifier per bit (logistic regression on hashed byte
n-grams of the lower-cased text) predicts that bit; decoding adds each classifier's loss against each codeword, weighted by
how well the classifier did in training, and takes the language of least loss. Documents whose two best
languages are close are flagged ambiguous.

The fit takes a bounded sample of labelled rows (`MAX_TRAIN` in all, shared evenly over languages, chosen by a hash of
doc_id); prediction reads every whole text and nothing else.

Edge cases: null texts and texts without a letter are `und` with score 0; with one learned language every
other text gets it; with no labelled rows all texts are `und`; null lang rows are never learned from; repeated
rows get the same answer; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Tables

DIM_BITS = 12
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3, 4)
BLOCK = 1 << 20
MAX_TRAIN = 1000
MARGIN = 0.05
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)  # odd constants of multiplicative hashing


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Square roots of the relative frequencies of hashed byte n-grams, over the whole text, block by block."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(DIM, np.float64)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + ORDERS[-1] - 1].astype(np.uint32)
        gram = np.zeros(len(part), np.uint32)
        for n in ORDERS:
            if len(part) < n:
                break
            gram = (gram[: len(part) - n + 1] << np.uint32(8)) + part[n - 1 :]
            slots = (gram[:BLOCK] * np.uint32(_MULTIPLIERS[n - 1])) >> np.uint32(32 - DIM_BITS)
            counts += np.bincount(slots, minlength=DIM)
    return np.sqrt(counts / max(counts.sum(), 1.0)).astype(np.float32)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of -1/+1: all distinct splits up to 7 classes, beyond that the best of 50 random dense codes."""
    if k <= 1:
        return np.ones((k, 1), np.float32)
    if k <= 7:
        bits = [[1] + [1 - 2 * (s >> i & 1) for i in range(k - 1)] for s in range(1, 1 << (k - 1))]
        return np.array(bits, np.float32).T
    rng, best, found = np.random.default_rng(seed), -1, None
    width = int(np.ceil(10 * np.log2(k)))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, width)).astype(np.float32)
        far = ((width - code @ code.T) / 2 + width * np.eye(k)).min()
        if far > best and (abs(code.sum(0)) < k).all():
            best, found = far, code
    return found


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 120, rate: float = 20.0, decay: float = 1e-4):
    """Weights (DIM + 1, bits) of all bits' classifiers by accelerated gradient descent, and each bit's weight."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    goal = code[y]
    share = np.bincount(y, minlength=len(code)).astype(np.float32)
    row_weight = (1 / share[y] / len(code))[:, None]
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    ahead = w
    for t in range(steps):
        slope = -goal * row_weight / (1 + np.exp(np.clip(goal * (x @ ahead), -30, 30)))
        new = ahead - rate * (x.T @ slope + decay * ahead)
        ahead, w = new + t / (t + 3) * (new - w), new
    right = np.clip(((x @ w) * goal > 0).mean(0), 0.501, 0.999)
    return w, np.log(right / (1 - right))


def decode(margins: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Probability-like scores of the languages: softmax of minus the weighted losses."""
    loss = (np.logaddexp(0, -code[None] * margins[:, None, :]) * weight).sum(2) * code.shape[1] / weight.sum()
    e = np.exp(-(loss - loss.min(1, keepdims=True)))
    return e / e.sum(1, keepdims=True)


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = [features(t).tobytes() for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())], names=["place", "lang", "x"])


def train(docs: DataFrame, learn: Column, max_train: int = MAX_TRAIN):
    """(languages, code, weights, bit weights) from a bounded, hash-chosen sample of the rows where `learn` holds."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return langs, None, None, None
    each = max(max_train // len(langs), 8)
    chosen = None
    for lang in langs:  # a fixed share of each language's hash range: as many rows as asked for, whatever the size
        part = (F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(10_000_000)) < int(1 + 10_000_000 * each / counts[lang]))
        chosen = part if chosen is None else chosen | part
    sample = rows.filter(chosen).select(F.xxhash64("doc_id", "text").alias("place"), "lang", "text").mapInArrow(sample_features, "place long, lang string, x binary")
    got = sample.orderBy("place").limit(2 * each * len(langs)).toArrow()  # the bound holds where doc_ids repeat, too
    y = np.array([langs.index(v) for v in got.column("lang").to_pylist()], np.int64)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(y), DIM)
    present = sorted(set(y.tolist()))
    langs, y = [langs[i] for i in present], np.searchsorted(present, y)
    code = codewords(len(langs))
    return (langs, code, *fit(x, y, code))


def predictor(model, margin: float = MARGIN) -> Callable:
    langs, code, w, weight = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = part.column(1).to_pylist()
                known = [bool(langs) and t is not None and has_letter(t) for t in texts]
                pred, score, close = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
                at = [j for j, k in enumerate(known) if k]
                if at:
                    x = np.stack([features(texts[j]) for j in at])
                    p = decode(x @ w[:-1] + w[-1], code, weight)
                    top = np.sort(p, 1)[:, -2:]
                    for j, row, best in zip(at, p, top):
                        pred[j], score[j] = langs[int(row.argmax())], float(row.max())
                        close[j] = bool(len(best) > 1 and best[1] - best[0] < margin)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())],
                    names=["row", "lang_pred", "score", "ambiguous"],
                )

    return run


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, margin: float = MARGIN, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every document."""
    model = train(docs, ~held_out(4, 2), max_train)
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        predictor(model, margin), "row long, lang_pred string, score double, ambiguous boolean"
    )
    return out.withColumnRenamed("row", "doc_id").select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is recognised: neither `und` nor ambiguous. The text travels with its row."""
    model = train(docs, ~held_out(4, 2))
    decide = predictor(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            two = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), b.column("text")], names=["row", "text"])
            good = [p != "und" and not a for d in decide(iter([two])) for p, a in zip(d.column(1).to_pylist(), d.column(3).to_pylist())]
            yield b.filter(pa.array(good, pa.bool_()))

    return Tables(docs.sparkSession)(docs.mapInArrow(keep, docs.schema), "recognised")
