"""Operator 13: ranked lexical search by presence masks.

Terms of the items are numbered. One pass over the documents keeps, for each, its length and its counts of those terms (a stage
table), and with it the corpus statistics. A second pass takes the table in blocks of documents. For an item, the documents
holding each of its terms are a bitmap; the bitmaps, one bit a term, give every document its mask of matched terms, and documents of
equal mask are one group. No document of a mask can score more than the sum of its terms' weights times the term's
best factor in the block, so the masks are scored by falling bound until the item's k-th best score so far, carried from block to
block, is above the bound of all masks that are left. A task sends at most k documents for an item; they are ranked in two
steps, so the tasks that meet at an item are bounded, too.

Terms are broadcast, so their number is checked: items whose terms go beyond MAX_TERMS are dealt by hash, and documents are read
once for each share.

Edge cases: null and termless texts match nothing and do not count in N; a null or termless item has no rows; rows of one item_id (null
too) are one item with the terms of all; documents that repeat a doc_id are ranked each on its own, null doc_ids last among equal
scores; weights of 0 give no score, so no row; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import terms
from .common import Tables

K = 10
#: (item, term) pairs in one share of the items.
MAX_TERMS = 200_000
#: Documents in a block, and terms of documents that a block may hold.
BLOCK_DOCS, BLOCK_COUNTS = 4096, 4_000_000
MERGE = 64
_NO_ID = np.iinfo(np.int64).max

COUNTS = "doc_id long, n long, terms binary, tf binary"
FOUND = "item int, doc_id long, score long, lane int"


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    return items.select("item_id", F.explode(terms.words("text")).alias("term")).distinct()


def counter(shared) -> Callable:
    """Of every document with a term: its number of terms, and how often it holds each of the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode("utf-8", "replace"): i for i, t in enumerate(shared.value, 1)}
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                ids, sizes, held, counts = [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), terms.utf8(part.column(1))):
                    n, tf = 0, 0
                    for words in terms.blocks(terms.normal(text or b"")):
                        n += len(words)
                        tf = tf + np.bincount(np.fromiter(filter(None, map(number.get, words)), np.int64), minlength=len(number) + 1)
                    if n:
                        at = np.flatnonzero(tf)
                        ids.append(doc_id)
                        sizes.append(n)
                        held.append((at - 1).astype(np.uint32).tobytes())
                        counts.append(tf[at].astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary()), pa.array(counts, pa.binary())],
                                                 names=["doc_id", "n", "terms", "tf"])

    return run


def document_frequencies(size: int) -> Callable:
    """(term, df) of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            for blob in b.column("terms"):
                df[np.frombuffer(blob.as_buffer(), np.uint32)] += 1  # a document's terms are distinct
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["term", "df"])

    return run


class Block:
    """Counts of some documents, by term; what a term adds to a document's score, without its weight, is its factor."""

    def __init__(self, rows: list[tuple], size: int, n_all: int, length: int):
        self.ids = np.array([_NO_ID if r[0] is None else r[0] for r in rows], np.int64)
        term = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
        tf = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows])
        doc = np.repeat(np.arange(len(rows)), [len(r[2]) // 4 for r in rows])
        n = np.array([r[1] for r in rows], np.int64)
        long = np.array([90 * int(x) * n_all // length for x in n], np.int64)
        m = 100 - 90 + long
        factor = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.factor = doc[order], factor[order]
        self.starts = np.searchsorted(term[order], np.arange(size + 1))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that hold a term, and their factors."""
        part = slice(self.starts[term], self.starts[term + 1])
        return self.doc[part], self.factor[part]


def best_of_block(block: Block, wanted: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k best (-score, doc_id) among `best` and the block's documents, for an item's term numbers and weights."""
    held = [block.of(t) for t in wanted]
    some = [j for j, (docs, _) in enumerate(held) if len(docs) and weights[j]]
    if not some:
        return best
    # bitmaps: bit j of a document's mask tells whether it holds term j
    masks = np.zeros((len(block.ids), -(-len(some) // 64)), np.uint64)
    top = np.zeros(masks.shape[1] * 64, np.int64)
    for bit, j in enumerate(some):
        docs, factor = held[j]
        masks[docs, bit >> 6] |= np.uint64(1 << (bit & 63))
        top[bit] = weights[j] * factor.max()
    at = np.flatnonzero(masks.any(1))
    kinds, group = np.unique(masks[at], axis=0, return_inverse=True) if masks.shape[1] > 1 else np.unique(masks[at, 0], return_inverse=True)
    kinds = kinds.reshape(-1, masks.shape[1])
    bits = np.unpackbits(np.ascontiguousarray(kinds).view(np.uint8), axis=1, bitorder="little")
    bound = bits.astype(np.int64) @ top
    falling = np.argsort(-bound, kind="stable")
    by_group = np.argsort(group.ravel(), kind="stable")
    edges = np.searchsorted(group.ravel()[by_group], np.arange(len(kinds) + 1))
    done, step = 0, 8
    while done < len(falling):
        if len(best) == k and -best[-1][0] > bound[falling[done]]:
            break  # no mask that is left can reach the k-th best
        now = falling[done : done + step]
        chosen = np.zeros(len(block.ids), bool)
        for g in now:
            chosen[at[by_group[edges[g] : edges[g + 1]]]] = True
        score = np.zeros(len(block.ids), np.int64)
        for j in some:
            docs, factor = held[j]
            mine = chosen[docs]
            score[docs[mine]] += weights[j] * factor[mine]
        good = np.flatnonzero(score)
        if len(good) > k:
            good = good[np.lexsort((block.ids[good], -score[good]))[:k]]
        best = sorted(best + [(-int(score[d]), int(block.ids[d])) for d in good])[:k]
        done, step = done + step, step * 2
    return best


def searcher(shared, k: int) -> Callable:
    """The k best documents of a task for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_all, length, weight, wanted = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in wanted]

        def take(rows: list[tuple]) -> None:
            block = Block(rows, len(weight), n_all, length)
            for i, numbers in enumerate(wanted):
                best[i] = best_of_block(block, numbers, weight[numbers], best[i], k)

        rows, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(row)
                size += len(row[2]) // 4
                if len(rows) == BLOCK_DOCS or size >= BLOCK_COUNTS:
                    take(rows)
                    rows, size = [], 0
        if rows:
            take(rows)
        from pyspark import TaskContext

        lane = TaskContext.get().partitionId() % MERGE
        out = [(i, None if d == _NO_ID else d, -s, lane) for i, found in enumerate(best) for s, d in found]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["item", "doc_id", "score", "lane"])

    return run


def ranked(found: DataFrame, key: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def weight_of(n_all: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1)))


def search_share(docs: DataFrame, rows: list, kind: str, k: int, t: Tables) -> DataFrame | None:
    """(item_id, doc_id, score, rank) for one share of the items, given as rows (item_id, term); kind: type of item_id."""
    spark = docs.sparkSession
    names = sorted({r["term"] for r in rows})
    number = {term: i for i, term in enumerate(names)}
    by_item: dict = {}
    for r in rows:
        by_item.setdefault(r["item_id"], []).append(number[r["term"]])
    items = list(by_item)
    texts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counter(spark.sparkContext.broadcast(names)), COUNTS)
    counts = t(texts, "counts")
    n_all, length = counts.agg(F.count("*"), F.sum("n")).first()
    if not n_all:
        t.drop(counts)
        return None
    df = counts.select("terms").mapInArrow(document_frequencies(len(names)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = np.zeros(len(names), np.int64)
    for r in df.collect():  # one row for each term of the share
        weight[r["term"]] = weight_of(n_all, r["df"])
    shared = spark.sparkContext.broadcast((n_all, length, weight, [np.array(sorted(by_item[i]), np.int64) for i in items]))
    found = counts.mapInArrow(searcher(shared, k), FOUND)
    few = ranked(found, ["item", "lane"], k).drop("rank")
    best = ranked(few, ["item"], k).select("item", "rank", "doc_id", "score")
    labels = spark.createDataFrame(list(enumerate(items)), f"item int, item_id {kind}")
    out = t(best.join(F.broadcast(labels), "item").select("item_id", "rank", "doc_id", "score"), "found")
    t.drop(counts)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, max_terms: int = MAX_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    t = Tables(docs.sparkSession)
    pairs = t(item_terms(items), "terms")
    shares = max(1, -(-pairs.count() // max_terms))
    kind = items.schema["item_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for share in range(shares):
        mine = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(shares)) == share).collect()  # about max_terms rows
        if mine and (found := search_share(docs, mine, kind, k, t)) is not None:
            out = out.unionByName(found)
    t.drop(pairs)
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*)::BIGINT AS n_all, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, len(w)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY doc_id, w, term),
wt AS (SELECT term, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, c GROUP BY term, n_all),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_all) // total)))))::BIGINT AS score
  FROM it JOIN tf USING (term) JOIN wt USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10
"""
