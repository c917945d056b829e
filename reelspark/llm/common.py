"""Shared helpers: stage tables in the cluster's shared folder, distributed running totals, components, kept rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..sources.stages import scratch

#: White space of the contracts, as a Java and as a DuckDB pattern.
SPACE = r"[\x20\x09-\x0D]+"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here, and a lost
    executor costs nothing that was already written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """While a table is written: rows hold whole texts, so a batch for a Python worker holds fewer of them than Spark's default
    of 10 000. The session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


class Tables:
    """The stage tables of one operator. drop() deletes those that nothing will read any more; what a returned
    DataFrame still reads stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            for made, path in self.paths:
                if made is table:
                    where = jvm.org.apache.hadoop.fs.Path(path)
                    where.getFileSystem(conf).delete(where, True)
        self.paths = [(made, path) for made, path in self.paths if not any(made is t for t in tables)]


class WordHashes(dict):
    """64-bit hashes of words, with a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_hash(seed: int, text: str = "text") -> Column:
    """One of the two 64-bit hashes that stand for a text where rows are told apart."""
    return F.xxhash64(F.lit(seed), F.coalesce(F.col(text), F.lit("")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them (Spark compares without case)."""
    known, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in known:
            name += "_"
        out.append(name)
        known.add(name.lower())
    return out


def without(docs: DataFrame, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows of docs, with their own columns, whose (doc_id, t1, t2) is not in `dropped`; of rows that share a key in
    `repeated`, one stays. Both tables hold distinct keys and grow with docs without a bound, so they are merged, not broadcast, at
    every size."""
    d, a, b = fresh(docs, "_row_id", "_row_t1", "_row_t2")
    keyed = docs.withColumns({a: text_hash(1), b: text_hash(2), d: F.col("doc_id").cast("long")})
    match = lambda keys: keyed[d].eqNullSafe(keys.doc_id) & (keyed[a] == keys.t1) & (keyed[b] == keys.t2)
    dropped = dropped.hint("merge")
    left = keyed.join(dropped, match(dropped), "left_anti")
    if repeated.limit(1).count():
        again = keyed.join(repeated, match(repeated), "left_semi").join(dropped, match(dropped), "left_anti")
        left = left.join(repeated, match(repeated), "left_anti").unionByName(again.dropDuplicates([d, a, b]))
    return left.drop(d, a, b)


def running_total(df: DataFrame, order: list[Column], value: str, out: str, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """df + the sum of `value` over all rows up to and including each row, in the given total order; and the stage table
    it reads.

    A range sort deals the rows out; one small row per range carries the sums of the ranges before it, so no
    task sees more than its own range. `order` must end in a unique column, else one tie could fill a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = tables(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.select(
        "_range",
        F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    # one row per range: bounded by the number of partitions, not by the data
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    total = (
        ranged.join(F.broadcast(before), "_range")
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_range", "_before")
    )
    return total, ranged


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """Connected components of `edges` (src, dst): rows (node, component), component = smallest node; a stage table.

    Labels are parents. In each round a node hears the least label of its neighbours, its parent takes the least
    label that any of its children heard, and then labels jump to their label's label; so whole trees hook at once and
    the rounds grow with the logarithm of a chain, whatever its ids. It ends only when a round changes nothing: then
    neighbours have equal labels, which are smallest nodes. Every round is written to the shared folder, and the tables of
    the round before are deleted; only one number (rows that changed) comes to the driver.
    """
    t = tables or Tables(edges.sparkSession)
    both = t(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).filter("src <> dst").distinct(), "edges")
    labels = t(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).select(F.col("src").alias("node"), "label"), "labels")
    while True:
        heard = both.join(labels, both.src == labels.node).groupBy("dst").agg(F.min("label").alias("heard"))
        told = t(
            labels.join(heard, labels.node == heard.dst, "left")
            .select("node", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label")),
            "told",
        )
        hooks = told.filter("label <> old").groupBy(F.col("old").alias("parent")).agg(F.min("label").alias("hook"))
        hooked = t(
            told.join(hooks, told.node == hooks.parent, "left")
            .select("node", "old", F.least("label", F.coalesce("hook", "label")).alias("label")),
            "hooked",
        )
        target = hooked.select(F.col("node").alias("t_node"), F.col("label").alias("t_label"))
        jumped = t(
            hooked.join(target, hooked.label == target.t_node, "left")
            .select("node", "old", F.least("label", F.coalesce("t_label", "label")).alias("label")),
            "jumped",
        )
        t.drop(labels, told, hooked)
        labels = jumped
        if jumped.filter("label <> old").limit(1).count() == 0:
            t.drop(both)
            return jumped.select("node", F.col("label").alias("component"))
