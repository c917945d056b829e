"""Operator 7: mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order (a hash of doc_id and epoch; a source whose target
exceeds its size is queued again, up to `max_epochs` times). Documents longer than 1/`SHARES` of their source's target are
served in packets of that size. A packet's virtual finish time is the running size of its source up to and including it,
divided by the source's target. All queues are merged by a global range sort on the finish time and cut where the running
size reaches the total budget, the sum of all sizes; the packet on the cut is taken in part. So a source ends within
about one packet of its target. With whole=True documents are never split: the one on the cut is taken if at least half of it fits.

Edge cases: null text has size 0 and takes 0 words; null source is a source of its own, ordered last; an empty
table gives an empty result; repeated rows are separate documents (a row number breaks ties); a table whose
sizes are all 0 takes nothing and has targets 0; documents of size 0 are never in the mix of whole documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Tables, fresh, running_total, text_hash

MAX_EPOCHS = 3
#: A packet is at most this part of its source's target, but never less than LEAST words.
SHARES, LEAST = 256, 16
WORD_COUNT = r"size(filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> ''))"


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"), F.col("source"), F.expr(WORD_COUNT).cast("long").alias("size"), text_hash(1).alias("t1"), text_hash(2).alias("t2")
    )


def targets(sizes: DataFrame, t: Tables, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, rank): one row per source. Weights 1, 2, 3, 1, ... by source in code point order.

    Water filling: the level of the sources that are not capped is what is left of the budget by weight; sources above
    their cap are capped, until none is. A round gives three sums to the driver; sources may be many.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked, ranged = running_total(s, [F.col("source").isNull(), F.col("source")], "one", "rank", t)
    weight = ((F.col("rank") - 1) % 3 + 1).cast("double")
    s = t(ranked.select("source", "source_size", "rank", weight.alias("weight"), (F.lit(max_epochs) * F.col("source_size")).cast("double").alias("cap")), "weights")
    t.drop(ranged)
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        capped, weights = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (total - capped) / weights if weights else level
        if new <= level:
            break
        level = new
    share = F.lit(level) * F.col("weight")
    return s.select("source", "source_size", F.when(share < F.col("cap"), share).otherwise(F.col("cap")).alias("target"), "rank")


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, whole: bool = False, t: Tables | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, row, t1, t2) of every row."""
    t = t or Tables(docs.sparkSession)
    sizes = t(sized(docs).withColumn("row", F.monotonically_increasing_id()), "sizes")
    goal = t(targets(sizes, t, max_epochs), "targets")
    # at most one row per source: joined plainly, so that its size need not be known
    known = sizes.join(goal, sizes.source.eqNullSafe(goal.source)).select("row", "doc_id", "size", "source_size", "target", "rank", "t1", "t2")
    known = t(known, "known")
    queue = known.filter("size > 0 AND target > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(1), F.lit(max_epochs)))
    ).filter(F.col("target") > (F.col("epoch") - 1) * F.col("source_size")).withColumn(
        "shuffled", F.md5(F.concat_ws("-", F.col("epoch"), F.col("doc_id")))
    ).select("row", "size", "target", "rank", "epoch", "shuffled")
    place = [F.col("rank"), F.col("epoch"), F.col("shuffled"), F.col("row")]
    # a source's queue is a run of this order; what all queues before it hold is taken off again
    upto, ranged = running_total(queue, place, "size", "upto", t)
    upto = t(upto, "upto")
    t.drop(ranged, sizes)
    base = t(upto.groupBy("rank").agg(F.min(F.col("upto") - F.col("size")).alias("base")), "base")
    quantum = F.lit(1 << 62) if whole else F.greatest(F.lit(LEAST), F.floor(F.col("target") / SHARES)).cast("long")
    served = upto.join(base, "rank").select(
        "row", "size", "target", "rank", "epoch", "shuffled", (F.col("upto") - F.col("size") - F.col("base")).alias("before"), quantum.alias("quantum"))
    packets = served.withColumn("packet", F.explode(F.expr("sequence(0L, (size - 1) div quantum)"))).select(
        "row", "target", "rank", "epoch", "shuffled", "packet", F.least("quantum", F.col("size") - F.col("packet") * F.col("quantum")).alias("words"),
        (F.col("before") + F.least("size", (F.col("packet") + 1) * F.col("quantum"))).alias("finished") if not whole else (F.col("before") + F.col("size")).alias("finished"))
    packets = packets.withColumn("finish", F.col("finished") / F.col("target"))
    budget = known.agg(F.sum("size")).first()[0] or 0
    merged, again = running_total(packets, [F.col("finish"), *place, F.col("packet")], "words", "spent", t)
    rest = F.greatest(F.lit(budget) - (F.col("spent") - F.col("words")), F.lit(0))
    if whole:
        rest = F.when(rest * 2 >= F.col("words"), F.col("words")).otherwise(F.lit(0))
    taken = merged.select("row", F.when(F.col("spent") <= budget, F.col("words")).otherwise(rest).cast("long").alias("words"))
    taken = t(taken.groupBy("row").agg(F.sum("words").alias("words")), "taken")
    t.drop(upto, base, again)
    return known.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "row", "t1", "t2", "rank"
    )


def mixed(docs: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (whole documents)."""
    t = Tables(docs.sparkSession)
    plan = mix(docs, max_epochs, whole=True, t=t).filter("size > 0").select("doc_id", "t1", "t2", F.floor(F.col("taken") / F.col("size")).alias("copies"))
    # rows of one doc_id, source and text are alike: they share what is taken of them
    key = ["doc_id", "t1", "t2"]
    plan = t(plan.groupBy(*key).agg(F.sum("copies").cast("int").alias("copies"), F.count("*").cast("int").alias("rows")), "plan")
    a, b, c, n, place, one = fresh(docs, "_t1", "_t2", "_copies", "_rows", "_place", "_one")
    ours = docs.withColumns({a: text_hash(1), b: text_hash(2)})

    def planned(p: DataFrame) -> DataFrame:
        p = p.select(F.col("doc_id").alias("p_id"), F.col("t1").alias("p_t1"), F.col("t2").alias("p_t2"), F.col("copies").alias(c), F.col("rows").alias(n))
        got = ours.join(p, ours.doc_id.eqNullSafe(F.col("p_id")) & (ours[a] == F.col("p_t1")) & (ours[b] == F.col("p_t2")))
        return got.select(*[ours[x] for x in docs.columns], ours[a], ours[b], c, n)

    out = planned(plan.filter("rows = 1"))
    if plan.filter("rows > 1").limit(1).count():
        alike = W.partitionBy("doc_id", a, b).orderBy(F.xxhash64(*docs.columns))
        shared = planned(plan.filter("rows > 1")).withColumn(place, F.row_number().over(alike))
        mine = F.floor(F.col(c) / F.col(n)) + (F.col(place) <= F.col(c) % F.col(n)).cast("int")
        out = out.unionByName(shared.withColumn(c, mine.cast("int")).drop(place))
    return out.filter(F.col(c) > 0).withColumn(one, F.explode(F.sequence(F.lit(1), F.col(c)))).select(*docs.columns)


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap FROM (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank,
      ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
    FROM sizes GROUP BY source)),
l AS (
  SELECT *, (total - cap_before) / (weights - weight_before) AS level FROM (
    SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights,
      coalesce(sum(cap) OVER w, 0)::DOUBLE AS cap_before, coalesce(sum(weight) OVER w, 0)::DOUBLE AS weight_before
    FROM s WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
t AS (
  SELECT source, source_size, rank, CASE WHEN final * weight < cap THEN final * weight ELSE cap END AS target
  FROM (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS final FROM l)),
q AS (
  SELECT d.doc_id, d.size, t.target, t.rank, e.epoch, md5(e.epoch || '-' || d.doc_id) AS shuffled, greatest(16, floor(t.target / 256))::BIGINT AS quantum
  FROM sizes d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (SELECT unnest([1, 2, 3]) AS epoch) e
  WHERE d.size > 0 AND t.target > (e.epoch - 1) * t.source_size),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY rank ORDER BY epoch, shuffled, doc_id ROWS UNBOUNDED PRECEDING) - size AS served FROM q),
p AS (
  SELECT *, least(quantum, size - packet * quantum) AS words, (served + least(size, (packet + 1) * quantum))::DOUBLE / target AS finish
  FROM (SELECT *, unnest(range(0, (size - 1) // quantum + 1)) AS packet FROM c)),
m AS (
  SELECT *, sum(words) OVER (ORDER BY finish, rank, epoch, shuffled, doc_id, packet ROWS UNBOUNDED PRECEDING) AS spent FROM p),
k AS (
  SELECT doc_id, sum(CASE WHEN spent <= (SELECT sum(size) FROM sizes) THEN words ELSE greatest((SELECT sum(size) FROM sizes) - (spent - words), 0) END)::BIGINT AS taken FROM m GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM sizes d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON k.doc_id = d.doc_id
"""
