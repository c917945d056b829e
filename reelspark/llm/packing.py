"""Operator 3: packing documents into sequences of `size` tokens, shortest pack first over the length histogram.

Documents become token ids (byte-level BPE, then id 0) and are cut into pieces of at most `size`; only the histogram of
piece lengths (at most `size` rows) reaches the driver. There the longest lengths are placed first, each into the
shortest packs, as counts of packing patterns, never piece by piece; a piece longer than the room in the
shortest pack is cut, and its rest is placed as a shorter length. So the number of sequences is the least
possible, and all padding together is less than one sequence. The patterns come back as slots (length, range
of ranks, part, sequence, offset); pieces are ranked within their length by a distributed range sort and join the
slots by rank. Ids travel as compressed 16-bit numbers, once.

Edge cases: null and empty texts are one token (id 0); an empty table gives no pieces; repeated rows are packed
separately; the tokenizer's added tokens (end of text) in a text become their own ids, as the tokenizer does it; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Tables, running_total

SIZE = 1024
CACHE = 400_000
#: The slot table depends on the histogram's shape, not on the number of documents: a few thousand rows for full
#: histograms. Up to so many rows it is broadcast; a larger one is joined by length.
BROADCAST_SLOTS = 100_000
SLICE = 500  # rows handled at a time in a Python task
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_RUNS = re.compile(r"\s\s|^\s|\s$")


class UnitIds(dict):
    """Ids of each blank-separated unit as little-endian bytes; bounded, and units beyond the bound are encoded anew."""

    def __init__(self, encode, prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, unit: str) -> bytes:
        ids = array("I", self.encode(self.prefix + unit)).tobytes()
        if len(self) < CACHE:
            self[unit] = ids
        return ids


class Encoder:
    """Ids of byte_bpe_50k.json, computed unit by unit.

    Added tokens of the tokenizer file are ids of their own and part the text. A single blank between two other characters
    always starts a new token there, so units are encoded apart and their ids joined; single line breaks between two
    other characters are tokens of their own. Texts with longer white space are split at the safe blanks only.
    """

    def __init__(self, ranks_path: str | None = None, tokenizer_path: str | None = None):
        import public_tokenizers as tokens
        import tiktoken

        with open(ranks_path or tokens.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        with open(tokenizer_path or tokens.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in json.load(f)["added_tokens"]}
        self.parted = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        encode = tiktoken.Encoding("public", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.later = UnitIds(encode, ""), UnitIds(encode, " ")
        self.line = array("I", encode("\n")).tobytes()

    def __call__(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the text, then id 0."""
        out: list[bytes] = []
        if text and self.parted and any(t in text for t in self.added):
            for part in self.parted.split(text):
                if part in self.added:
                    out.append(self.added[part])
                elif part:
                    self.plain(part, out)
        elif text:
            self.plain(text, out)
        out.append(b"\0\0\0\0")
        return b"".join(out)

    def plain(self, text: str, out: list[bytes]) -> None:
        later = self.later.__getitem__
        if _RUNS.search(text):
            units = _BREAK.split(text)
            out.append(self.first[units[0]])
            out.extend(map(later, units[1:]))
            return
        for line in text.split("\n"):
            units = line.split(" ")
            out.append(self.first[units[0]])
            out.extend(map(later, units[1:]))
            out.append(self.line)
        out.pop()


@cache
def encoder() -> Encoder:
    """One encoder for each Python worker."""
    return Encoder()


def token_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, doc_tokens, z): ids as compressed unsigned 16-bit numbers, 32-bit ones where some id needs it."""
    encode, z = encoder(), zstandard.ZstdCompressor(level=1)
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            part = b.slice(i, SLICE)
            n, blobs = [], []
            for t in part.column(1).to_pylist():
                ids = np.frombuffer(encode(t), "<u4")
                n.append(len(ids))
                blobs.append(z.compress((ids.astype("<u2") if ids.max() < 1 << 16 else ids).tobytes()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "doc_tokens", "z"])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their placed pieces become one row per piece, with the checksum of its ids."""
    unz = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for doc, n, blob, pieces in zip(*(b.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "z", "pieces"))):
            raw = unz.decompress(blob)
            ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
            for x in pieces:
                at, size = x["start"], x["length"]
                rows.append((doc, at, size, zlib.crc32(ids[at : at + size].tobytes()), n, x["sequence_id"], x["offset"]))
        for i in range(0, len(rows), 50_000):
            cols = zip(*rows[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in PIECES.split(", ")])


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple]:
    """Slots (length, rank_from, rank_to, part_start, part_length, first_sequence, offset).

    The piece of rank r in [rank_from, rank_to] of a length has its tokens part_start .. part_start + part_length
    in sequence first_sequence + r - rank_from at that offset.
    """
    total = sum(n * c for n, c in histogram.items())
    n_packs = -(-total // size)
    bins: dict[int, list] = {n: [(n, 0, c, 0)] for n, c in histogram.items() if c}
    packs = [(-size, 0, n_packs)] if n_packs else []  # (-room, first sequence, how many)
    slots = []
    for length in range(max(bins, default=0), 0, -1):
        todo = bins.pop(length, [])
        while todo:
            kind, rank, count, part = todo.pop()
            room, seq, n = heapq.heappop(packs)
            room, m = -room, min(n, count)
            fits = min(room, length)
            slots.append((kind, rank, rank + m - 1, part, fits, seq, size - room))
            if n > m:
                heapq.heappush(packs, (-room, seq + m, n - m))
            if room > fits:
                heapq.heappush(packs, (fits - room, seq, m))
            if count > m:
                todo.append((kind, rank + m, count - m, part))
            if length > fits:
                bins.setdefault(length - fits, []).append((kind, rank, m, part + fits))
    return slots


def pack(docs: DataFrame, size: int = SIZE) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    t = Tables(spark)
    blobs = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(token_blobs, "doc_id long, doc_tokens long, z binary")
    tokens = t(blobs.withColumn("row", F.monotonically_increasing_id()), "tokens")
    piece = F.explode(F.expr(f"sequence(0L, (doc_tokens - 1) div {size})"))
    pieces = tokens.select("row", "doc_tokens", piece.alias("piece")).select(
        "row", "piece", F.least(F.lit(size), F.col("doc_tokens") - F.col("piece") * size).cast("int").alias("len"),
        F.lit(1).alias("one"),
    )
    # one row per length: at most `size` rows
    histogram = {r["len"]: r["n"] for r in pieces.groupBy("len").agg(F.count("*").alias("n")).collect()}
    slots, base, before = shortest_pack_first(histogram, size), [], 0
    for n in sorted(histogram):
        base.append((n, before))
        before += histogram[n]
    slot_table = spark.createDataFrame(
        slots, "slot_len int, rank_from long, rank_to long, part_start int, part_length int, first_sequence long, `offset` long"
    )
    base_table = spark.createDataFrame(base, "len int, base long")
    ranked, ranged = running_total(pieces, [F.col("len"), F.col("row"), F.col("piece")], "one", "upto", t)
    ranked = ranked.join(F.broadcast(base_table), "len").withColumn("rank", F.col("upto") - F.col("base") - 1)
    placed = ranked.join(
        F.broadcast(slot_table) if len(slots) <= BROADCAST_SLOTS else slot_table,
        (F.col("len") == F.col("slot_len")) & F.col("rank").between(F.col("rank_from"), F.col("rank_to")),
    ).select(
        "row", (F.col("piece") * size + F.col("part_start")).alias("start"), F.col("part_length").cast("long").alias("length"),
        (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset",
    )
    # a document has a piece for each `size` of its own tokens, and a few cuts
    placed = t(placed.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces")), "placed")
    t.drop(ranged)
    out = t(tokens.join(placed, "row").select("doc_id", "doc_tokens", "z", "pieces").mapInArrow(checked, PIECES), "packed")
    t.drop(tokens, placed)
    return out
