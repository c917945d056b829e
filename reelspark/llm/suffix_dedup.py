"""Operator 9: dedup of 100-byte strings, by minimizer-anchored grouping (README: it stands in for prefix doubling).

A byte is removed if a 100-byte string that covers it also starts earlier (smaller doc_id, or earlier in the same
document). Ranking every byte position at growing offsets would shuffle tens of bytes for each byte of text, many
times; so only one position in about forty takes part, chosen by content: the anchor of a 100-byte window is the position in it
whose 25-byte string has the least hash, so equal windows have their anchors at the same place.

Round 1 ranks anchors by their 25-byte strings (a rank is a 64-bit hash, the same in every task): a position whose string
is unique drops out, with all windows anchored there. Round 2 refines the rank by the pair (string, context), the context
reaching over all of the anchor's windows to both sides: of equal pairs all but the earliest are repeats past the threshold.
Round 3 takes the positions left, whose string recurs in another context, up to the full 100 bytes, window by
window. Each task ranks what it holds before anything is shuffled and sends one row for a rank and FLUSH bytes of text, so a hot
string sends that many rows, not one for each of its places.

Edge cases: null and empty texts have 0 bytes and keep the empty string's digest; texts under 100 bytes are never
cut; rows that repeat a doc_id and its text are one document and get the same answer; rows that repeat a doc_id with
another text are documents of their own, ordered by a hash of the text; rows with a null doc_id come first, as repeats of one id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Tables, running_total, text_hash

LENGTH = 100
GRAM = 25
BLOCK = 1 << 19  # windows handled at a time; positions in a block fit 20 bits
FLUSH = 12_000_000  # bytes of text ranked together in a task
#: A string with more contexts than this share of all (and MOST at any size) is dealt into groups of that size first.
HOT_SHARE = 1 / 2000
LEAST, MOST = 64, 4_000
_N = BLOCK + LENGTH
_BASE = 0x9E3779B97F4A7C15  # odd: invertible modulo 2^64
_POWER = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_N, _BASE, np.uint64)]))
_INVERSE = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(_N, pow(_BASE, -1, 1 << 64), np.uint64)]))
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 20) - 1)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def anchors(data: bytes) -> Iterator[tuple]:
    """(first window, number of windows, offset of the anchor, string hash, context hash) for each anchor, block by block."""
    for start in range(0, len(data) - LENGTH + 1, BLOCK):
        part = np.frombuffer(data[start : start + BLOCK + LENGTH - 1], np.uint8)
        n = len(part)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWER[:n], out=total[1:])
        gram = (total[GRAM:] - total[:-GRAM]) * _INVERSE[: n - GRAM + 1]
        least = gram ^ (gram >> np.uint64(32))
        least *= _MUL
        least = (least & ~_LOW) | np.arange(len(least), dtype=np.uint64)
        width, span = 1, LENGTH - GRAM + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        after = np.concatenate([first[1:], [len(at)]])
        context = (total[after - 1 + LENGTH] - total[first]) * _INVERSE[first]
        yield first + start, after - first, at[first] - first, gram[at[first]], context


def pack(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One long that sorts by first window and holds the number of windows (at most 128)."""
    return (first.astype(np.int64) << np.int64(7)) | (count.astype(np.int64) - 1)


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, doc_id, text) with texts as compressed bytes, to move less."""
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        for i in range(0, b.num_rows, 500):
            part = b.slice(i, 500)
            blobs = [z.compress((t or "").encode("utf-8", "replace")) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blobs, pa.binary())], names=["place", "doc_id", "z"])


def unsqueezed(blob: bytes, z=zstandard.ZstdDecompressor()) -> bytes:
    return z.decompress(blob)


def in_order(docs: DataFrame, t: Tables) -> tuple[DataFrame, DataFrame]:
    """(place, doc_id, text) of all rows, and of rows that are alike only one: places order the documents. That is the doc_id
    itself; where doc_ids are null or repeated, all documents are numbered by (doc_id, hashes of the text)."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    ids = texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if ids.limit(1).count() == 0:
        plain = texts.select(F.col("doc_id").alias("place"), "doc_id", "text")
        return plain, plain
    keyed = texts.withColumns({"t1": text_hash(1), "t2": text_hash(2)})
    key = ["doc_id", "t1", "t2"]
    distinct = keyed.select(*key).distinct().withColumn("one", F.lit(1))
    numbered, _ = running_total(distinct, [F.col("doc_id").isNotNull(), *map(F.col, key)], "one", "place", t)
    numbered = t(numbered.select(F.col("doc_id").alias("n_id"), F.col("t1").alias("n_1"), F.col("t2").alias("n_2"), F.col("place").cast("long").alias("place")), "places")
    same = keyed.doc_id.eqNullSafe(numbered.n_id) & (keyed.t1 == numbered.n_1) & (keyed.t2 == numbered.n_2)
    ordered = t(keyed.join(numbered, same).select("place", "doc_id", "text"), "ordered")
    return ordered, t(ordered.dropDuplicates(["place"]), "distinct")


ROUND_1 = "kind int, key long, context long, place long, at long, offset int"
REPEAT, SINGLE, SHARED, OPEN = 0, 1, 2, 3


def first_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind REPEAT (windows that are repeats of an earlier text of this task), SINGLE (the task's only context of
    a string), SHARED (one context of a string that has several here) and OPEN (all contexts of such a string)."""

    def ranked(held) -> pa.RecordBatch:
        doc, at, off, key, ctx = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((at, doc, ctx, key))
        doc, at, off, key, ctx = doc[order], at[order], off[order], key[order], ctx[order]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_ctx = new_key | np.concatenate([[True], ctx[1:] != ctx[:-1]])
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, weights=new_ctx)[group] > 1
        same_place = ~new_ctx & np.concatenate([[False], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])])
        picks = [(REPEAT, ~new_ctx & ~same_place), (SINGLE, new_ctx & ~several), (SHARED, new_key & several), (OPEN, new_ctx & several)]
        rows = np.concatenate([np.flatnonzero(m) for _, m in picks])
        kinds = np.concatenate([np.full(int(m.sum()), k, np.int32) for k, m in picks])
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds), pa.array(key[rows].view(np.int64)), pa.array(ctx[rows].view(np.int64)), pa.array(doc[rows]),
             pa.array(at[rows]), pa.array(off[rows].astype(np.int32))],
            names=["kind", "key", "context", "place", "at", "offset"],
        )

    held, size = [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            data = (text or "").encode("utf-8", "replace")
            if len(data) < LENGTH:
                continue
            for first, count, off, key, ctx in anchors(data):
                held.append((np.full(len(first), doc, np.int64), pack(first, count), off, key, ctx))
            size += len(data)
            if size >= FLUSH:
                yield ranked(held)
                held, size = [], 0
    if held:
        yield ranked(held)


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each open context: (key, place, at, bytes)."""
    for b in batches:
        out = []
        for doc, blob, open_ in zip(*(b.column(c).to_pylist() for c in ("place", "z", "open"))):
            data = unsqueezed(blob)
            for row in open_:
                at = row["at"]
                out.append((row["key"], doc, at, data[at >> 7 : (at >> 7) + (at & 127) + LENGTH]))
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                         names=["key", "place", "at", "bytes"])


ROUND_3 = "place long, at long, digest binary"


def last_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank the windows of each group (rows come sorted by group, place, at) by all their bytes.

    A row without digest is a repeat. In a group that is part of a hot string, the earliest window of each rank goes on
    with its digest, to be ranked against the string's other groups.
    """
    group, seen = None, set()
    for b in batches:
        out = []
        for key, part, doc, at, data in zip(*(b.column(c).to_pylist() for c in ("key", "part", "place", "at", "bytes"))):
            if (key, part) != group:
                group, seen = (key, part), set()
                last = None
            if (doc, at) == last:  # the same place of a repeated row
                continue
            last = (doc, at)
            first, run = at >> 7, 0
            for i in range(len(data) - LENGTH + 1):
                window = data[i : i + LENGTH]
                if window in seen:
                    run += 1
                    continue
                if run:
                    out.append((doc, (first + i - run) << 7 | run - 1, None))
                    run = 0
                seen.add(window)
                if part >= 0:
                    out.append((doc, (first + i) << 7, hashlib.blake2b(window, digest_size=16).digest()))
            if run:
                i = len(data) - LENGTH + 1
                out.append((doc, (first + i - run) << 7 | run - 1, None))
        cols = list(zip(*out)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))],
                                         names=["place", "at", "digest"])


def removals(texts: DataFrame, t: Tables) -> DataFrame:
    """(place, ats): the runs of repeated windows of each document that has any."""
    ranks = t(texts.select("place", "text").mapInArrow(first_ranks, ROUND_1), "ranks")
    # one row for a string and FLUSH bytes of text
    sent = ranks.filter(F.col("kind").isin(SINGLE, SHARED))
    by_key = W.partitionBy("key")
    met = sent.select(
        "*", F.count("*").over(by_key).alias("n"), F.min("context").over(by_key).alias("c0"), F.max("context").over(by_key).alias("c1"),
        F.max("kind").over(by_key).alias("most"),
    ).filter(f"n > 1 AND kind = {SINGLE}")
    met = met.withColumn("earliest", F.row_number().over(W.partitionBy("key", "context").orderBy("place", "at")) == 1)
    met = t(met.select("key", "place", "at", "earliest", ((F.col("c0") != F.col("c1")) | (F.col("most") == SHARED)).alias("several")), "met")
    repeats = ranks.filter(f"kind = {REPEAT}").select("place", "at").union(met.filter("NOT earliest").select("place", "at"))

    undecided = ranks.filter(f"kind = {OPEN}").select("key", "place", "at").union(met.filter("earliest AND several").select("key", "place", "at"))
    per_doc = undecided.groupBy("place").agg(F.collect_list(F.struct("key", "at")).alias("open"))
    blobs = texts.mapInArrow(squeezed, "place long, doc_id long, z binary")
    strings = t(blobs.join(per_doc, "place").select("place", "z", "open").mapInArrow(contexts, "key long, place long, at long, bytes binary"), "contexts")
    limit = min(max(LEAST, int(strings.count() * HOT_SHARE)), MOST)
    hot = t(strings.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > limit), "hot")
    part = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("place"), F.ceil(F.col("n") / limit))).otherwise(-1).cast("int")
    dealt = strings.join(hot, "key", "left").select("key", part.alias("part"), "place", "at", "bytes")
    last = t(dealt.repartition("key", "part").sortWithinPartitions("key", "part", "place", "at").mapInArrow(last_ranks, ROUND_3), "last")
    t.drop(strings, hot)
    first = last.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("place", "at")).alias("first"))
    again = last.filter("digest IS NOT NULL").join(first, "digest").filter((F.col("place") != F.col("first.place")) | (F.col("at") != F.col("first.at")))
    repeats = repeats.union(last.filter("digest IS NULL").select("place", "at")).union(again.select("place", "at"))
    runs = t(repeats.groupBy("place").agg(F.collect_list("at").alias("ats")), "runs")
    t.drop(ranks, met, last)
    return runs


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for blob, ats in zip(b.column("z").to_pylist(), b.column("ats").to_pylist()):
            data = unsqueezed(blob)
            kept, spans, removed, reach = [], 0, 0, 0
            for at in sorted(set(ats or ())):
                first = at >> 7
                end = first + (at & 127) + LENGTH
                if not spans or first > reach:
                    kept.append(data[reach:first])
                    spans += 1
                    removed += end - first
                elif end > reach:
                    removed += end - reach
                reach = max(reach, end)
            kept.append(data[reach:])
            rows.append((len(data), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def suffix_dedup(docs: DataFrame) -> DataFrame:
    t = Tables(docs.sparkSession)
    texts, distinct = in_order(docs, t)
    runs = removals(distinct, t)
    blobs = texts.mapInArrow(squeezed, "place long, doc_id long, z binary")
    out = blobs.join(runs, "place", "left").select("doc_id", "z", "ats").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return t(out, "removed")
