"""Mixing sources to target weights by hash-threshold histograms.

Each row gets a 36-bit hash of its key. Tokens are summed by source and hash bucket; the bucket in which the running
sum of a source passes its budget is found, and only that bucket is split further, 12 bits a level. What lies below
the threshold is taken: a filter, with no sort of the rows. Budgets nest: a smaller budget takes a subset.

Budgets above a source's size take every row floor(budget / size) times and the rest by the threshold.

Defined results: null and empty texts have size 0 and are taken 0 words; texts are counted whole, whatever their length;
null sources are one source, last in the order; rows equal in key and text share one decision, and so do rows of one
source whose 36-bit hashes tie; a source without words gets target 0; an empty table gives an empty result. Extra
columns, whatever their names, pass by mixed_documents() and are left out by the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, n_words, set_aside, written

LEVEL_BITS, LEVELS = 12, 3


def row_hash(key: Column, text: Column) -> Column:
    """The first LEVELS * LEVEL_BITS bits of an MD5 of key and text."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, LEVELS * LEVEL_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, share: float, limit: float) -> DataFrame:
    """sources(source, source_size, weight) with target: share of all sizes dealt by weight, at most limit times a
    source's size, the excess dealt again by weight until nothing is above. Sorted by size / weight, the capped
    sources are a prefix; the level is what remains after the prefix, by the remaining weight. One row a source."""
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    x = sources.select(
        "source", "source_size", "weight",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_s"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("_w"),
        F.sum("source_size").over(every).alias("_all_size"), F.sum("weight").over(every).alias("_all_weight"),
    )
    level = (F.lit(share) * F.col("_all_size") - F.lit(limit) * F.col("_s")) / (F.col("_all_weight") - F.col("_w"))
    x = x.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("weight") <= F.lit(limit) * F.col("source_size"))
    x = x.withColumn("_final", F.max(F.when(F.col("_fits"), F.col("_level"))).over(every))
    capped = F.lit(limit) * F.col("source_size")
    return x.select("source", "source_size", F.coalesce(F.least(capped, F.col("_final") * F.col("weight")), capped).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets(source, budget) with threshold: rows of sized(source, hash, size) with hash below it sum to the budget
    within the last boundary bucket. A level sums only what lies in the boundary bucket of the level above."""
    state = budgets.select("source", F.col("budget").alias("_rest"), F.lit(0).cast("long").alias("_prefix"))
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * LEVEL_BITS
        rows = sized.select(F.col("source").alias("_src"), F.shiftright("hash", shift).alias("_bucket"), "size")
        if level:
            keep = state.select(F.col("source").alias("_of"), F.col("_prefix").alias("_in"))
            rows = rows.join(keep, F.col("_src").eqNullSafe(F.col("_of")) & (F.shiftright("_bucket", LEVEL_BITS) == F.col("_in")))
        sums = rows.groupBy("_src", "_bucket").agg(F.sum("size").alias("_sum"))
        run = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("_run", F.sum("_sum").over(run))
        cut = state.join(sums, F.col("_src").eqNullSafe(F.col("source")), "left")
        over = F.col("_run") > F.col("_rest")
        past = F.coalesce(F.max("_bucket") + 1, F.shiftleft(F.first("_prefix"), LEVEL_BITS))
        found = cut.groupBy("source").agg(
            F.coalesce(F.min(F.when(over, F.col("_bucket"))), past).alias("_prefix"),
            (F.first("_rest") - F.coalesce(F.max(F.when(~over, F.col("_run"))), F.lit(0))).alias("_rest"),
        )
        state = written(found, "state")  # a row for each source: small enough to be sent to the rows, not the rows to it
    return state.select("source", F.col("_prefix").alias("threshold"))


def plan_of(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A stored row for each source: targets(source, source_size, target) with whole, how often every row is taken, and
    threshold, the hash below which rows are taken once more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("_whole", whole)
    cuts = thresholds(sized, plan.select("source", (F.col("target") - F.col("_whole") * F.col("source_size")).alias("budget")))
    plan = plan.join(cuts.withColumnRenamed("source", "_cs"), F.col("source").eqNullSafe(F.col("_cs")), "left").drop("_cs")
    return written(plan.withColumnRenamed("source", "_ps"), "plan")


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(source, hash, size, ...) where they stand, with source_size, target, copies (how often the mix takes the row)
    and taken (words: copies * size). The plan is a row for each source; Spark sends it along if it is small."""
    out = rows.join(plan, rows["source"].eqNullSafe(F.col("_ps")), "left")
    copies = F.col("_whole") + (F.col("hash") < F.coalesce(F.col("threshold"), F.lit(0))).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("_ps", "_whole", "threshold")


def mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    return taken(sized, plan_of(sized, targets))


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", row_hash(F.col("doc_id"), F.col("text")).alias("hash"), n_words(F.col("text")).alias("size"))


def cycled_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Targets of the sources by code point, null last, with weights in turn. UTF-8 order is code point order."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    return water_fill(sources.withColumn("weight", weight), share, limit)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written(sized_documents(documents(spark, sf_dir)), "sized")
    return mix(sized, written(cycled_targets(sized), "targets")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as often as the mix of the pipeline takes them (copies repeat as rows). Only hashes and sizes are summed; a
    row's copies follow from its own hash and the plan of its source, so texts stay where they are."""
    docs, back = set_aside(docs, "doc_id", "text", "source")
    sized = written(sized_documents(docs), "sized")
    plan = plan_of(sized, written(cycled_targets(sized), "targets"))
    full = docs.withColumns({"hash": row_hash(F.col("doc_id"), F.col("text")), "size": F.lit(0).cast("long")})
    out = taken(full, plan).filter("copies > 0")
    return back(out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


ORACLE_OP2 = """
WITH d AS (
  SELECT doc_id, source,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')), 1, 9))::BIGINT AS h,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
f AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY source_size / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, max(CASE WHEN level * w <= 2.0::DOUBLE * source_size THEN level END) OVER () AS final FROM f),
t AS (SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, final * w), 2.0::DOUBLE * source_size) AS target FROM g),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN run <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
