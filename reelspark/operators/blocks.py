"""Ordered work on long series, dealt into blocks: no task holds a whole series, only a block and what surrounds it.

A block is a fixed stretch of the series' own order (frame numbers or seconds). What must pass from block to block travels in a table
with one row a block, so the windows over a whole series see thousands of times fewer rows than the series has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Frames to a block, and seconds to a block where the order is a time.
FRAMES, SECONDS = 4096, 600.0


def block_of(order: Column | str, width: float) -> Column:
    return F.floor((F.col(order) if isinstance(order, str) else order) / width)


def neighbours(df: DataFrame, keys: list[str], order: str, columns: list[str], width: float = FRAMES) -> DataFrame:
    """df + _before and _after: the columns of the rows before and after in a series, as structs; null at the series' ends. `order` may be
    sparse: a block's neighbours are the next blocks that hold rows."""
    at = [*keys, "_block"]
    dealt = df.withColumn("_block", block_of(order, width)).withColumn("_row", F.struct(*columns))
    edges = dealt.groupBy(*at).agg(F.min_by("_row", order).alias("_first"), F.max_by("_row", order).alias("_last"))
    series = W.partitionBy(*keys).orderBy("_block")
    beyond = edges.select(*at, F.lag("_last").over(series).alias("_back"), F.lead("_first").over(series).alias("_ahead"))
    inside = W.partitionBy(*at).orderBy(order)
    near = dealt.withColumn("_before", F.lag("_row").over(inside)).withColumn("_after", F.lead("_row").over(inside)).join(beyond, at)
    return near.select(*df.columns, F.coalesce("_before", "_back").alias("_before"), F.coalesce("_after", "_ahead").alias("_after"))


def running_count(df: DataFrame, keys: list[str], order: str, flag: Column, out: str, width: float = FRAMES) -> DataFrame:
    """df + how many rows up to and including each one, and its equals in `order`, hold the flag."""
    at = [*keys, "_block"]
    dealt = df.withColumn("_block", block_of(order, width)).withColumn("_flag", F.when(flag, 1).otherwise(0))
    totals = dealt.groupBy(*at).agg(F.sum("_flag").alias("_sum"))
    before = totals.select(*at, F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    inside = F.sum("_flag").over(W.partitionBy(*at).orderBy(order).rangeBetween(W.unboundedPreceding, 0))
    return dealt.withColumn("_inside", inside).join(before, at).select(*df.columns, (F.col("_earlier") + F.col("_inside")).alias(out))


def moving_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, str], before: int, after: int, width: int = FRAMES) -> DataFrame:
    """df + for every {column: name}, the sum over the rows whose `order`, a whole number and unique in a series, is from `before` below
    to `after` above the row's own. Rows near a block's edge go to both blocks."""
    own = block_of(order, width)
    reached = F.sequence(block_of(F.col(order) - after, width), block_of(F.col(order) + before, width))
    dealt = df.withColumn("_own", own).withColumn("_block", F.explode(reached))
    around = W.partitionBy(*keys, "_block").orderBy(order).rangeBetween(-before, after)
    summed = dealt.select("*", *[F.sum(c).over(around).alias(name) for c, name in values.items()])
    return summed.filter("_block = _own").select(*df.columns, *values.values())


def per_series(df: DataFrame, keys: list[str], facts: DataFrame, order: str, width: float = FRAMES) -> DataFrame:
    """df + the columns of `facts`, one row a series. Facts are laid out by block first, so a long series is joined in its blocks, not
    in one task."""
    at = [*keys, "_block"]
    dealt = df.withColumn("_block", block_of(order, width))
    return dealt.join(dealt.select(*at).distinct().join(facts, keys), at).drop("_block")


def running_at(points: DataFrame, keys: list[str], at: str, events: DataFrame, when: str, value: str, out: str, inclusive: bool, width: float = SECONDS) -> DataFrame:
    """points + the sum of the events' values before each point's time (inclusive: and at it), 0 if there is none. Times are dealt
    into blocks; the sums of whole blocks before are added from one row a block. Decimal values give exact sums."""
    e = events.select(*keys, F.col(when).alias("_at"), F.col(value).alias("_value")).withColumn("_block", block_of("_at", width))
    zero = F.lit(0).cast(e.schema["_value"].dataType)
    totals = e.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    asked = points.select(*keys, F.col(at).alias("_at")).distinct().withColumn("_block", block_of("_at", width))
    # blocks of events and of points in one order, so that a point's block need not hold events
    marks = totals.unionByName(asked.select(*keys, "_block").distinct().withColumn("_sum", zero.cast(totals.schema["_sum"].dataType)))
    marks = marks.groupBy(*keys, "_block").agg(F.sum("_sum").alias("_sum"))
    series = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = marks.select(*keys, "_block", F.coalesce(F.sum("_sum").over(series), zero).alias("_before"))
    kind = F.lit(1 if inclusive else 0)
    rows = e.withColumn("_kind", F.lit(1 - (1 if inclusive else 0))).unionByName(asked.select("*", zero.alias("_value"), kind.alias("_kind")))
    inside = W.partitionBy(*keys, "_block").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum("_value").over(inside)).filter(F.col("_kind") == kind)
    found = summed.join(before, [*keys, "_block"]).select(*keys, F.col("_at").alias(at), (F.col("_before") + F.col("_inside")).alias(out))
    return points.join(found, [*keys, at])
