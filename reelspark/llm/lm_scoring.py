"""Operator 4: language-model scoring by cross-entropy difference.

Two word bigram models of one order, one smoothing and one vocabulary, which is every word of the corpus: the background model is
counted on all documents, the target model on all documents labelled as good. The models are matched: the background's counts weigh
as those of a sample of the target's size would, so that the same smoothing has the same force in both. Every document is scored
by models that have not seen it: its own counts are taken out of both. The score is the loss per token under the background model
minus that under the target model (higher: more like the target); both losses are returned.

No count is held in one place, so all of them may grow with the input. Texts become words of 64-bit hashes, dealt into chunks of
about CHUNK_BYTES of text. A chunk counts its distinct items (pairs, words and histories, each with a key of 62 bits) and sends them,
cut by key range, to buckets. A bucket adds up its range over all chunks and answers each with the totals of just its items.
A chunk sends at most FAN rows, so beyond FAN ranges this takes two steps, each over the square root of the ranges: chunks of a
group send to cells, one for each (group, coarse range), which add up; cells send their sums to the fine ranges inside their own;
answers go back the same way. The results are the same. No task holds more than a chunk, a cell or a range; only the numbers of
tokens and of distinct words come to the driver.
The pair model backs off to the word model by absolute interpolation.

Edge cases: null and empty texts have 0 tokens and score 0; without labelled documents the target model is the uniform prior
of its smoothing; repeated rows count each time, and each is scored without itself but with its copies; labels without doc_id
are left out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Tables, WordHashes

CHUNK_BYTES = 5 << 20
#: Fine ranges: so many a shuffle partition, and more once one would come from more text than this.
BUCKETS, RANGE_BYTES = 4, 8 << 20
#: Most rows that a chunk sends in one step: its pieces then hold about a kilobyte.
FAN = 1 << 13
STRENGTH = 8.0  # how many counts of a history weigh as much as its word model
PAIR, WORD, HISTORY = 0, 1, 2
_START = np.uint64(0xD6E8FEB86659FD93)  # the history of a document's first word
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@cache
def compressor() -> zstandard.ZstdCompressor:
    """One for each Python worker."""
    return zstandard.ZstdCompressor(level=1)


def unzipped(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys as differences (modulo 2^64), all first bytes before all second ones: the high bytes of sorted keys take no room."""
    steps = np.diff(keys.astype("<u8"), prepend=np.uint64(0))
    return compressor().compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(unzipped(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def packed_ids(ids: np.ndarray) -> bytes:
    return compressor().compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked_ids(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(unzipped(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def packed_counts(counts: np.ndarray) -> bytes:
    """Two rows of counts, as narrow as they fit."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(counts.max(initial=0)) < 1 << 8 * w)
    return str(width).encode() + compressor().compress(counts.astype(f"<u{width}").tobytes())


def unpacked_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(unzipped(blob[1:]), f"<u{blob[:1].decode()}").astype(np.int64).reshape(2, -1)


def batch(columns: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch of the columns of a schema string."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
             "array<binary>": pa.list_(pa.binary())}
    fields = [f.split() for f in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def read(b: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows one by one: each holds a chunk, so only one is turned into Python values at a time."""
    columns = [b.column(n) for n in names]
    return (tuple(c[i].as_py() for c in columns) for i in range(b.num_rows))


CHUNKS = "chunk long, doc_ids array<long>, sizes array<int>, words binary, ids binary, bytes long"


def chunker(chunk_bytes: int) -> Callable:
    """Rows (doc_id, text) put together to chunks: their distinct words' hashes, and each token as a place among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        docs, held, size, k = [], [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            words, ids, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words get small numbers, which pack well
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return batch(CHUNKS, [(k, docs, [len(x) for x in held], packed_keys(words[order]), packed_ids(rank[ids]), size)])

        for b in batches:
            for doc, text in zip(*(c.to_pylist() for c in b.columns)):
                data = (text or "").encode("utf-8", "replace")
                split = data.lower().split()
                docs.append(doc)
                held.append(np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split)))
                size += len(data) + 16  # a row of its own, too
                if size >= chunk_bytes:
                    yield row()
                    docs, held, size, k = [], [], 0, k + 1
        if held:
            yield row()

    return run


def item_keys(mixed: np.ndarray, kind: int) -> np.ndarray:
    return mixed & np.uint64(~3 & (1 << 64) - 1) | np.uint64(kind)


class Items:
    """The pairs, words and histories of a chunk: `keys` are sorted, and `pair`, `word`, `history` are places in them for each token."""

    def __init__(self, sizes: list[int], words: bytes, ids: bytes):
        self.n = np.array(sizes, np.int64)
        token = unpacked_ids(ids)
        known = np.concatenate([unpacked_keys(words), [_START]]).astype(np.uint64)
        before = np.concatenate([[len(known) - 1], token[:-1]]) if len(token) else token
        before[(np.cumsum(self.n) - self.n)[self.n > 0]] = len(known) - 1
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        codes, pair = np.unique(before * len(known) + token, return_inverse=True)
        mixed = known[codes // len(known)] * _ODD + known[codes % len(known)]
        for shift, factor in zip((30, 27), _MIX):
            mixed = (mixed ^ mixed >> np.uint64(shift)) * factor
        own_words = known[:-1]
        histories = known if len(token) else known[:0]
        self.keys, place = np.unique(
            np.concatenate([item_keys(mixed ^ mixed >> np.uint64(31), PAIR), item_keys(own_words, WORD), item_keys(histories, HISTORY)]), return_inverse=True
        )
        place = place.astype(np.int32)  # less than 2^31 items in a chunk
        self.pair = place[pair]
        self.word = place[len(codes) + token]
        self.history = place[len(codes) + len(own_words) + before]

    def marked(self, good: list[int] | None) -> np.ndarray:
        """One flag a token: of a good document."""
        out = np.zeros(len(self.n), bool)
        out[np.array(good or [], np.int64)] = True
        return out[self.doc]

    def counts(self, marked: np.ndarray) -> np.ndarray:
        """Counts of all items, of all documents and of the good ones."""
        return np.stack([sum(np.bincount(x[m], minlength=len(self.keys)) for x in (self.pair, self.word, self.history)) for m in (slice(None), marked)])

    def own(self, places: np.ndarray) -> np.ndarray:
        """How often each token's item occurs in its own document."""
        _, at, n = np.unique(self.doc * max(1, len(self.keys)) + places, return_inverse=True, return_counts=True)
        return n[at]


def cuts(n: int, low: int = 0, width: int = 1 << 64) -> np.ndarray:
    """Inner borders of n ranges of the keys from low on."""
    return np.array([low + i * width // n for i in range(1, n)], np.uint64)


def pieces(keys: np.ndarray, counts: np.ndarray, borders: np.ndarray) -> Iterator[tuple]:
    """(range, keys, counts) of each range that has keys."""
    at = [0, *np.searchsorted(keys, borders).tolist(), len(keys)]
    return ((i, packed_keys(keys[a:z]), packed_counts(counts[:, a:z])) for i, (a, z) in enumerate(zip(at, at[1:])) if z > a)


SENT = "grp long, coarse int, chunk long, keys binary, counts binary"


def asker(n: int) -> Callable:
    """Of every chunk and coarse range with items: sorted keys and both counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, grp, sizes, words, ids, good in read(b, "chunk", "grp", "sizes", "words", "ids", "good"):
                p = Items(sizes, words, ids)
                if len(p.keys):
                    yield batch(SENT, [(grp, i, chunk, k, c) for i, k, c in pieces(p.keys, p.counts(p.marked(good)), cuts(n))])

    return run


def groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], *names: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of rows that come sorted by key; a group may span batches."""
    held, now = [], None
    for b in batches:
        for row in read(b, *key, *names):
            if row[: len(key)] != now:
                if held:
                    yield now, held
                held, now = [], row[: len(key)]
            held.append(row[len(key) :])
    if held:
        yield now, held


def added(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys of all rows, the sums of their counts, and each row's places in them."""
    parts = [unpacked_keys(k) for k, _ in rows]
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.concatenate([unpacked_counts(c) for _, c in rows], axis=1)
    sums = np.stack([np.bincount(place, c, len(keys)) for c in counts]).astype(np.int64)
    return keys, sums, np.split(place, np.cumsum([len(p) for p in parts])[:-1])


CELLS = "grp long, coarse int, keys binary, counts binary, chunks array<long>, places array<binary>"


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the chunks of a group in one coarse range, and which of them each chunk has."""
    for (grp, coarse), rows in groups(batches, ("grp", "coarse"), "chunk", "keys", "counts"):
        keys, sums, places = added([r[1:] for r in rows])
        yield batch(CELLS, [(grp, coarse, packed_keys(keys), packed_counts(sums), [r[0] for r in rows], [packed_keys(p) for p in places])])


FINE = "fine int, coarse int, grp long, keys binary, counts binary"


def refiner(n: int) -> Callable:
    """Of every cell and fine range with items: keys and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grp, coarse, keys, counts in read(b, "grp", "coarse", "keys", "counts"):
                low, high = ((coarse + i << 64) // n for i in (0, 1))
                yield batch(FINE, [(coarse * n + i, coarse, grp, k, c) for i, k, c in pieces(unpacked_keys(keys), unpacked_counts(counts), cuts(n, low, high - low))])

    return run


ANSWERS = "fine int, coarse int, grp long, sums binary, words long"


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals over all groups, sent back to each; the first row of a range tells its number of distinct words."""
    for (fine, coarse), rows in groups(batches, ("fine", "coarse"), "grp", "keys", "counts"):
        keys, sums, places = added([r[1:] for r in rows])
        words = int((keys & np.uint64(3) == WORD).sum())
        yield batch(ANSWERS, [(fine, coarse, r[0], packed_counts(sums[:, p]), 0 if i else words) for i, (r, p) in enumerate(zip(rows, places))])


def joined(answers: list[dict] | None, by: str) -> np.ndarray:
    """The counts of all answers, in the order of their ranges."""
    return np.concatenate([np.zeros((2, 0), np.int64), *(unpacked_counts(a["sums"]) for a in sorted(answers or [], key=lambda a: a[by]))], axis=1)


BACK = "chunk long, coarse int, sums binary"


def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A cell's answers, dealt to its chunks."""
    for b in batches:
        for coarse, chunks, places, answers in read(b, "coarse", "chunks", "places", "answers"):
            sums = joined(answers, "fine")
            yield batch(BACK, [(chunk, coarse, packed_counts(sums[:, unpacked_keys(p).astype(np.int64)])) for chunk, p in zip(chunks, places)])


SCORED = "doc_id long, n_tokens long, background_loss double, target_loss double, score double"


def losses(pair, word, history, tokens, own, n_doc, size: int, weight: float) -> np.ndarray:
    """Negative log2 probability of each token, under counts from which its document's own are taken out."""
    own_pair, own_word, own_history = own
    unigram = (weight * (word - own_word) + 0.5) / (weight * (tokens - n_doc) + 0.5 * size)
    return -np.log2((weight * (pair - own_pair) + STRENGTH * unigram) / (weight * (history - own_history) + STRENGTH))


def scorer(tokens: tuple[int, int], size: int) -> Callable:
    """Rows are chunks with all their answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = min(1.0, tokens[1] / tokens[0]) if tokens[1] else 1.0
        for b in batches:
            for docs, sizes, words, ids, good, answers in read(b, "doc_ids", "sizes", "words", "ids", "good", "answers"):
                p = Items(sizes, words, ids)
                sums = joined(answers, "coarse")
                items = p.pair, p.word, p.history
                own, n_doc = [p.own(x).astype(np.int32) for x in items], p.n[p.doc]
                out = []
                for i, weight, mine in ((0, match, True), (1, 1.0, p.marked(good))):
                    loss = losses(*(sums[i][x] for x in items), tokens[i], [o * mine for o in own], n_doc * mine, size, weight)
                    out.append(np.bincount(p.doc, loss, len(p.n)) / np.maximum(p.n, 1))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(p.n), *map(pa.array, out), pa.array(out[0] - out[1])],
                                                 names=[f.split()[0] for f in SCORED.split(", ")])

    return run


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    spark, t = docs.sparkSession, Tables(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    dealt = t(texts.mapInArrow(chunker(CHUNK_BYTES), CHUNKS), "chunks")
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct()
    # which places of a chunk hold good documents: a number for each
    places = dealt.select("chunk", F.posexplode("doc_ids").alias("place", "doc_id")).join(good, "doc_id").groupBy("chunk").agg(F.collect_list("place").alias("good"))
    places = t(places, "places")  # of a known size, so chunks are not shuffled while it is small
    size = dealt.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("chunks")).first()
    ranges = max(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), (size.bytes or 0) // RANGE_BYTES)
    one_step = ranges <= FAN
    n = ranges if one_step else isqrt(ranges - 1) + 1
    marked = t(dealt.join(places, "chunk", "left").withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(isqrt(size.chunks) + 1))), "marked")
    t.drop(dealt, places)
    added_up = F.expr("aggregate(sizes, 0L, (s, x) -> s + x)"), F.expr("aggregate(coalesce(good, array()), 0L, (s, i) -> s + sizes[i])")
    tokens = tuple(x or 0 for x in marked.agg(*map(F.sum, added_up)).first())

    asked = marked.select("chunk", "grp", "sizes", "words", "ids", "good").mapInArrow(asker(n), SENT)
    if one_step:
        finer = asked.select(F.col("coarse").alias("fine"), "coarse", F.col("chunk").alias("grp"), "keys", "counts")
    else:
        cell = t(asked.repartition("grp", "coarse").sortWithinPartitions("grp", "coarse").mapInArrow(cells, CELLS), "cells")
        finer = cell.select("grp", "coarse", "keys", "counts").mapInArrow(refiner(n), FINE)
    answers = t(finer.repartition("fine").sortWithinPartitions("fine").mapInArrow(totals, ANSWERS), "answers")
    distinct_words = answers.agg(F.sum("words")).first()[0] or 0
    if one_step:
        back = answers.select(F.col("grp").alias("chunk"), "coarse", "sums")
    else:
        to_cells = answers.groupBy("grp", "coarse").agg(F.collect_list(F.struct("fine", "sums")).alias("answers"))
        back = t(cell.select("grp", "coarse", "chunks", "places").join(to_cells, ["grp", "coarse"]).mapInArrow(told, BACK), "back")
        t.drop(cell, answers)
    # at most FAN answers a chunk, or the square root of the number of ranges
    gathered = back.groupBy("chunk").agg(F.collect_list(F.struct("coarse", "sums")).alias("answers"))
    rows = marked.join(gathered, "chunk", "left").select("doc_ids", "sizes", "words", "ids", "good", "answers")
    return rows.mapInArrow(scorer(tokens, distinct_words), SCORED)
