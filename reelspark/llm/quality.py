"""Operator 2: quality rules by repetition coverage.

For every whole text, rolling hashes of word n-grams of several lengths find the n-grams that occur earlier in the
same text; the words inside such repeats and the lines equal to an earlier line are measured in characters. A document
fails where the covered share passes the limit of that length, or where repeated separators and markup symbols
pass SYMBOL_LIMIT a word. Word ids are exact (a dictionary of the text),
each n-gram's 64-bit hash is rolled from the one before it in length.

Edge cases: null and empty texts have no words and fail the base rule; texts shorter than an n-gram have no
repeats of it; lines without a word never count as repeated; repeated rows are measured alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MIN_WORDS = 50
#: Most characters, as a share of all, inside repeated n-grams of each length.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_LIMIT = 0.30
#: Most symbols for each word; markup and separators repeat without forming equal n-grams.
SYMBOL_LIMIT = 0.35
WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
_ROLL = np.uint64(0x9E3779B97F4A7C15)  # odd 64-bit multipliers
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def repeats(h: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(is a later occurrence, is found twice or more) of each hash; None if all are different."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return None
    later, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return later, twice


def covered(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which words lie in the n-grams that start where `starts` is true."""
    steps = np.zeros(n_words + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(text: str | None) -> dict:
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # bytes split at exactly the six ASCII white space characters
    n = len(words)
    seen: dict = {}
    ids = np.fromiter(map(seen.setdefault, words, range(n)), np.uint64, n)
    lens = np.fromiter(map(len, words if text.isascii() else map(bytes.decode, words)), np.int64, n)
    chars = int(lens.sum())
    h = (ids + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    h *= _ROLL
    h ^= h >> np.uint64(32)
    rolled, repeat_words, coverage = h, 0, {}
    for size in range(2, max(NGRAM_LIMITS) + 1):
        if n < size:
            break
        rolled = rolled[:-1] * _ROLL + h[size - 1 :]
        if (size == 3 or size in NGRAM_LIMITS) and (found := repeats(rolled)):
            if size == 3:
                repeat_words = int(covered(found[1], 3, n).sum())
            else:
                coverage[size] = int(lens[covered(found[0], size, n)].sum())
    lines, n_dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            if line in lines:
                n_dup += 1
                dup_chars += len(line)
            lines.add(line)
    base_failed = n < MIN_WORDS or 100 * repeat_words > 50 * n
    share = {k: v / chars for k, v in coverage.items()} if chars else {}
    line_share = dup_chars / len(text) if text else 0.0
    n_symbols = sum(map(text.count, SYMBOLS))
    bad = any(share.get(k, 0.0) > limit for k, limit in NGRAM_LIMITS.items()) or line_share > LINE_LIMIT
    bad = bad or n_symbols > SYMBOL_LIMIT * n
    return {
        "n_words": n, "word_chars": chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
        "n_repeat_words": repeat_words, "base_failed": base_failed, "kept": not base_failed and not bad,
        "ngram_coverage": max(share.values(), default=0.0), "line_coverage": line_share,
    }


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ngram_coverage double, line_coverage double"
)


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t) for t in b.column(1).to_pylist()]
        cols = {k: [r[k] for r in rows] for k in measure("")}
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols.values())], names=["doc_id", *cols])


def quality(docs: DataFrame) -> DataFrame:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measured, SCHEMA).select(*columns)
