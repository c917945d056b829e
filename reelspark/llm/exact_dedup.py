"""Operator 1: exact dedup over an extendible-hash index on shared files. DataFrame functions only.

Every distinct text becomes one index entry; copies are combined before the shuffle, so a hot text sends one row per task.
An entry's 64-bit key picks a directory row by its leading bits. The directory starts at a depth that suits the number of
entries; as long as a bucket holds more than `capacity` entries of different keys, the directory doubles: those buckets are
dealt out anew by one more bit, the others keep their local depth. Owner tasks hold ranges of keys: they chain the
entries of equal key and write the sorted range to the shared folder.

A document probes by key: directory row, bucket, chain. Where a chain has one entry, the document's text is that entry's:
entries were told apart by their bytes, and every text has one. Where texts of equal key are chained, the document's bytes are
compared with each of the chain.

Edge cases: null text counts as empty; all empty texts are one group; an empty table gives an empty result;
a repeated (doc_id, text) row counts as a copy, and all rows of that doc_id in a group carry kept = true; a null
doc_id never becomes keep_id unless the whole group has none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SPACE, Tables, text_hash, without

CAPACITY = 4096
BITS = 64


def keyed(docs: DataFrame, key_bits: int = BITS) -> DataFrame:
    """(doc_id, t1, t2, norm, key). key_bits < 64 makes keys collide (tests)."""
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    key = F.xxhash64("norm")
    return docs.select(F.col("doc_id").cast("long"), text_hash(1).alias("t1"), text_hash(2).alias("t2"), norm.alias("norm")).withColumn(
        "key", key if key_bits >= BITS else F.shiftleft(key, BITS - key_bits))


def leading(key: Column | str, depth: int) -> Column:
    return F.shiftrightunsigned(key, BITS - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, t: Tables, capacity: int = CAPACITY) -> DataFrame:
    """(local_depth, bucket, entries): one row per bucket."""
    n = entries.count()
    depth = min(max(0, (max(n - 1, 0) // capacity).bit_length()), BITS)
    open_, done = entries.select("key"), None
    while True:
        sizes = open_.groupBy(leading("key", depth).alias("bucket")).agg(
            F.count("*").alias("entries"), (F.min("key") != F.max("key")).alias("several"))
        sizes = t(sizes.select(F.lit(depth).alias("local_depth"), "bucket", "entries", "several"), "directory")
        overfull = sizes.filter((F.col("entries") > capacity) & F.col("several"))
        fits = sizes.filter((F.col("entries") <= capacity) | ~F.col("several"))
        done = fits if done is None else done.unionByName(fits)
        if depth == BITS or overfull.limit(1).count() == 0:
            return done.drop("several")
        # the directory doubles: overfull buckets split by one more bit
        open_ = open_.join(overfull.select("bucket"), leading("key", depth) == F.col("bucket"), "left_semi")
        depth += 1


def bucketed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (with a key) + local_depth and bucket: a key has one directory row. Rows that find none are lost."""
    depths = [r[0] for r in buckets.select("local_depth").distinct().collect()]  # at most 65 numbers
    if not depths:
        return rows.withColumn("local_depth", F.lit(0)).withColumn("bucket", F.lit(0).cast("long")).filter("false")
    slots = F.array(*[F.struct(F.lit(d).alias("d"), leading("key", d).alias("b")) for d in sorted(depths)])
    asked = rows.withColumn("_slot", F.explode(slots))
    known = buckets.select(F.col("local_depth"), F.col("bucket"))
    hit = (F.col("_slot.d") == F.col("local_depth")) & (F.col("_slot.b") == F.col("bucket"))
    return asked.join(known, hit).drop("_slot")


def build_index(docs: DataFrame, t: Tables, capacity: int = CAPACITY, key_bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(directory, index); index entries are (bucket, key, chain_pos, chain_length, text_sha256, keep_id, group_size) on shared files."""
    entries = t(
        keyed(docs, key_bits).groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"),
        "entries",
    )
    buckets = directory(entries, t, capacity)
    owned = bucketed(entries, buckets).repartitionByRange("key")
    chain = W.partitionBy("key")
    chained = owned.withColumn("chain_pos", F.row_number().over(chain.orderBy("text_sha256"))).withColumn("chain_length", F.count("*").over(chain))
    index = t(chained.sortWithinPartitions("key", "chain_pos"), "index")
    t.drop(entries)
    return buckets, index


def probe(docs: DataFrame, buckets: DataFrame, index: DataFrame, key_bits: int = BITS) -> DataFrame:
    """(doc_id, t1, t2, key, keep_id, group_size, text_sha256) of every row, through directory, bucket and chain."""
    rows = keyed(docs, key_bits)
    answer = ["keep_id", "group_size", "text_sha256"]
    at = ["bucket", "key"]
    single = index.filter("chain_length = 1").select(*at, *answer)
    out = bucketed(rows.drop("norm"), buckets).join(single, at).select("doc_id", "t1", "t2", "key", *answer)
    chains = index.filter("chain_length > 1")
    if chains.limit(1).count():
        # the bytes of the chained texts, each once; then the documents of these keys are compared with them
        mine = rows.join(chains.select("key").distinct(), "key", "left_semi")
        texts = mine.groupBy("key", "norm").agg(F.sha2("norm", 256).alias("text_sha256")).join(chains, ["key", "text_sha256"])
        compared = bucketed(mine, buckets).join(texts.withColumnRenamed("norm", "entry").select(*at, "entry", *answer), at)
        out = out.unionByName(compared.filter(F.col("norm") == F.col("entry")).select("doc_id", "t1", "t2", "key", *answer))
    return out


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = BITS) -> DataFrame:
    buckets, index = build_index(docs, Tables(docs.sparkSession), capacity, key_bits)
    return probe(docs, buckets, index, key_bits).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns: one row of each group of equal texts, that of the smallest doc_id."""
    t = Tables(docs.sparkSession)
    copies = probe(docs, *build_index(docs, t)).filter("group_size > 1")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    rows = copies.groupBy("key", "text_sha256", "doc_id", "t1", "t2", kept.alias("kept")).agg(F.count("*").alias("rows"))
    rows = t(rows, "rows")
    # a group may hold its smallest doc_id with several spellings of its text
    best = rows.filter("kept").groupBy("key", "text_sha256").agg(F.min("t1").alias("t1"))
    best = rows.filter("kept").join(best, ["key", "text_sha256", "t1"]).groupBy("key", "text_sha256", "t1").agg(F.min("t2").alias("t2")).withColumn("best", F.lit(True))
    marked = t(rows.join(best, ["key", "text_sha256", "t1", "t2"], "left").withColumn("stays", F.col("kept") & F.coalesce("best", F.lit(False))), "marked")
    key = ["doc_id", "t1", "t2"]
    dropped = t(marked.filter("NOT stays").select(*key).distinct(), "dropped")
    repeated = t(marked.filter("stays AND rows > 1").select(*key), "repeated")
    t.drop(rows, marked)
    return without(docs, dropped, repeated)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
