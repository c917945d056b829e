"""Operator 12: benchmark decontamination with one Aho-Corasick automaton.

The normalised words of test questions and answers give windows of `size` consecutive words (a shorter item is one window). All
windows make one automaton over word numbers, so matches begin and end at words. Every document is read once: its words, numbered
by the benchmark's vocabulary, run through the automaton, block by block with the state carried over, and the words inside
matches are mapped back to character offsets of the original text. No document is shuffled.

The automaton is broadcast, so its size is checked: (item, window) pairs beyond MAX_WINDOWS are dealt by hash into further
automata, and documents pass one after the other, keeping what was found before. One automaton is in memory at a time.

Edge cases: null and wordless texts have no words, spans or items; a null or wordless item has no window; rows of one item_id are one item
with the windows of each row; the windows of a row without item_id hit words but name no item; repeated documents get the same
answer; a null doc_id stays null; empty tables give an empty result or clean documents; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import terms
from .common import Tables

SIZE = 10
#: Pairs of item and window in one automaton.
MAX_WINDOWS = 200_000
SLICE = 500

STATE = "doc_id long, text string, n_words long, runs array<long>, items array<string>"
RESULT = "doc_id long, n_words long, spans array<struct<start:long,stop:long,words:long>>, items array<string>"
_LONGS, _STRINGS = pa.list_(pa.int64()), pa.list_(pa.string())
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64())])


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (item, window): the windows of each row's words, as arrays."""
    w = F.col("w")
    cut = F.when(F.size(w) <= size, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.slice(w, i, size)))
    said = items.select(F.col("item_id").cast("string").alias("item"), terms.words("text").alias("w")).filter(F.size(w) > 0)
    return said.select("item", F.explode(cut).alias("window")).distinct()


class Windows:
    """The automaton over word numbers; number 0 is any word that no window holds."""

    def __init__(self, pairs: list[tuple[str | None, list[str]]]):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], list[str]] = {}
        for item, window in pairs:
            key = tuple(self.number.setdefault(word.encode("utf-8", "replace"), len(self.number) + 1) for word in window)
            found.setdefault(key, []).extend([] if item is None else [item])
        self.items = list(found.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for place, key in enumerate(found):
            self.automaton.add_word(key, (len(key), place))
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[list[int]], set[str]]:
        """Number of words of a normal text, maximal runs of hit words as [first, last], and the items that occur."""
        n, runs, places, search = 0, [], set(), None
        for words in terms.blocks(text):
            numbers = tuple(map(self.number.get, words, repeat(0)))
            n += len(numbers)
            if not self.items or not numbers:
                continue
            if search is None:
                search = self.automaton.iter(numbers)
            else:
                search.set(numbers, False)  # the state and the count of words go on
            for last, (length, place) in search:
                places.add(place)
                join(runs, last - length + 1, last)
        return n, runs, {item for place in places for item in self.items[place]}


def join(runs: list[list[int]], first: int, last: int) -> None:
    """Add the words first..last, which end no earlier than any before, to ascending runs that stay maximal."""
    while runs and runs[-1][1] >= first - 1:
        first = min(first, runs.pop()[0])
    runs.append([first, last])


def merged(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(a + b, key=lambda r: r[1]):
        join(out, first, last)
    return out


def spans(text: bytes, runs: list[list[int]]) -> list[tuple[int, int, int]]:
    """Runs of words as character offsets of the text: (start, stop, words)."""
    if not runs:
        return []
    inside = np.frombuffer(terms.normal(text), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins, ends = edge[::2], edge[1::2]
    r = np.array(runs)
    at = np.stack([begins[r[:, 0]], ends[r[:, 1]]], 1).ravel()  # ascending byte positions
    leads = np.append((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, False)  # bytes that begin a character
    steps = np.add.reduceat(leads, np.concatenate([[0], at]), dtype=np.int64)[:-1]
    steps[np.diff(np.concatenate([[0], at])) == 0] = 0  # reduceat gives an element for an empty range
    chars = np.cumsum(steps).reshape(-1, 2)
    return [(int(a), int(b), int(y - x + 1)) for (a, b), (x, y) in zip(chars, runs)]


def scanner(shared, last: bool) -> Callable:
    """Adds what one automaton finds to (doc_id, text, n_words, runs, items); the last one turns runs into spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Windows(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                count, places, named = [], [], []
                texts = [t or b"" for t in terms.utf8(part.column(1))]
                for text, flat, old in zip(texts, part.column(3).to_pylist(), part.column(4).to_pylist()):
                    n, runs, items = known.scan(terms.normal(text))
                    before = list(map(list, zip(flat[::2], flat[1::2]))) if flat else []
                    count.append(n)
                    places.append(merged(before, runs) if before else runs)
                    named.append(sorted(items.union(old or [])))
                if last:
                    found = [[dict(zip(("start", "stop", "words"), s)) for s in spans(t, r)] for t, r in zip(texts, places)]
                    columns = [part.column(0), pa.array(count, pa.int64()), pa.array(found, pa.list_(_SPAN)), pa.array(named, _STRINGS)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "spans", "items"])
                else:
                    flat = [[x for r in runs for x in r] for runs in places]
                    columns = [*part.columns[:2], pa.array(count, pa.int64()), pa.array(flat, _LONGS), pa.array(named, _STRINGS)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "runs", "items"])

    return run


def benchmark_spans(docs: DataFrame, items: DataFrame, size: int = SIZE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document: maximal runs of hit words as character offsets [start, stop) of the
    original text with their number of words, and the sorted ids of the items that occur."""
    spark, t = docs.sparkSession, Tables(docs.sparkSession)
    pairs = t(windows(items, size), "windows")
    shards = max(1, -(-pairs.count() // max_windows))
    out = docs.select(F.col("doc_id").cast("long"), "text", F.lit(None).cast("long").alias("n_words"),
                      F.lit(None).cast("array<long>").alias("runs"), F.lit(None).cast("array<string>").alias("items"))
    for shard in range(shards):
        if shard:
            out = t(out, "scanned")
        mine = pairs.filter(F.pmod(F.xxhash64("item", "window"), F.lit(shards)) == shard).collect()  # about max_windows rows
        last = shard == shards - 1
        out = out.mapInArrow(scanner(spark.sparkContext.broadcast([tuple(r) for r in mine]), last), RESULT if last else STATE)
    t.drop(pairs)
    return out


def decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    found = benchmark_spans(docs, items).withColumn("n_hit", hit)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS win, least(len(w), 10) AS size
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
places AS (
  SELECT doc_id, i, size, list_slice(w, i, i + size - 1) AS win
  FROM words, (SELECT DISTINCT size FROM windows), unnest(range(1, len(w) - size + 2)) AS r(i)),
found AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows USING (size, win)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, size)) AS r(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
