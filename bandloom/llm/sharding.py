"""Sharding by sampled splitters, after the law `bytes`: shards of near equal size.

Keys are (hash of the text, hash of the id, a number that tells equal rows apart), so equal texts lie side by side and
even one row that is repeated many times can be cut. Keys are sampled with a chance that grows with the row's size, the
quantiles of the sample are the splitters of many ranges, and each range is measured exactly. Ranges that turn out
overfull are subdivided by splitters sampled within them. Running sums inside the ranges then place each row: its shard
is where the middle of its bytes falls in the whole. Shards are runs of the key order, so slots are positions in it.

There are RANGES_PER_SHARD ranges a shard, and more where the table is large, but MAX_RANGES at most (subdividing can
double that). So what the driver sees and what is sent to the rows is bounded: SAMPLES_PER_RANGE * MAX_RANGES keys of 40
bytes, and a table of the splitters.

Defined results: null texts count as empty (8 bytes); texts are hashed whole, whatever their length; a null id is an id of
its own; rows equal in id and text are told apart at random, which only decides which of them gets which of their slots;
an empty table gives an empty result; other columns than doc_id and text, whatever their names, are left out.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, text_or_empty, written

RANGES_PER_SHARD, SAMPLES_PER_RANGE, RANGE_BYTES, RANGE_ROWS, MAX_RANGES, OVERFULL = 16, 20, 1 << 34, 1 << 22, 8192, 3.0
PREFIX = 3


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key) of docs(doc_id, text); to be stored before use, as keys differ from run to run."""
    text = text_or_empty()
    name = F.md5(F.concat(F.lit("id:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    apart = F.substring(F.md5(F.monotonically_increasing_id().cast("string")), 1, 8)
    key = F.concat(F.substring(F.md5(text.cast("binary")), 1, 16), F.substring(name, 1, 16), apart)
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"))


def uniform(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the row itself: a lost task draws the same sample again."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def quantile_keys(rows: list, parts: int) -> list[str]:
    """Splitters at the quantiles of a sample of keys (each drawn in proportion to its size, so all weigh alike)."""
    keys = sorted(rows)
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def ranged(rows: DataFrame, splitters: list[str]) -> DataFrame:
    """rows with range: the number of splitters at or below the key. A map from the key's first digits to the few
    splitters that share them keeps the search short; it has one entry for each prefix, whatever the table's size."""
    spark = rows.sparkSession
    table = []
    for p in range(16**PREFIX):
        low = f"{p:0{PREFIX}x}"
        a, b = bisect.bisect_left(splitters, low), bisect.bisect_left(splitters, low + "g")
        table.append((low, a, splitters[a:b]))
    search = F.broadcast(spark.createDataFrame(table, "_p string, _base int, _cuts array<string>"))  # at most 2 * MAX_RANGES splitters
    x = rows.join(search, F.substring("key", 1, PREFIX) == F.col("_p"))
    inside = F.when(F.size("_cuts") == 0, F.lit(0)).otherwise(F.size(F.filter("_cuts", lambda s: s <= F.col("key"))))
    return x.withColumn("range", F.col("_base") + inside).drop("_p", "_base", "_cuts")


def sampled(rows: DataFrame, chance: Column) -> list[str]:
    return [r.key for r in rows.filter(uniform(F.lit("s"), F.col("key")) < chance).select("key").collect()]


def splitters_of(rows: DataFrame, total: int, parts: int) -> list[str]:
    cuts = quantile_keys(sampled(rows, F.col("size") * F.lit(parts * SAMPLES_PER_RANGE / max(total, 1))), parts)
    fill = ranged(rows, cuts).groupBy("range").agg(F.sum("size").alias("b")).filter(F.col("b") > OVERFULL * total / parts).collect()
    if fill:  # at most parts / OVERFULL ranges
        over = {r.range: r.b for r in fill}
        within = ranged(rows, cuts).filter(F.col("range").isin(list(over)))
        keys: dict[int, list[str]] = {r: [] for r in over}
        for r in within.filter(uniform(F.lit("t"), F.col("key")) < F.col("size") * F.lit(parts * SAMPLES_PER_RANGE / total)).select("range", "key").collect():
            keys[r.range].append(r.key)
        for r, k in keys.items():
            cuts += quantile_keys(k, max(2, round(over[r] * parts / total)))
    return sorted(set(cuts))


def shard_by_bytes(rows: DataFrame, shards: int) -> DataFrame:
    """rows(key, size, ...), a stored table, with shard and slot."""
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = min(MAX_RANGES, max(shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES), -(-n // RANGE_ROWS)))
    parts = ranged(rows, splitters_of(rows, total, ranges))
    sums = parts.groupBy("range").agg(F.sum("size").alias("_b"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("range").alias("_r"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"))
    inner = Window.partitionBy("range").orderBy("key")
    run = F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    x = parts.withColumn("_run", run).join(F.broadcast(sums), F.col("range") == F.col("_r"))  # a row for each range
    middle = F.col("_b0") + F.col("_run") - F.col("size") / 2
    x = x.withColumn("shard", F.least(F.floor(middle * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int"))
    x = x.drop("_run", "_r", "_b0")
    counts = x.groupBy("shard", "range").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("shard").alias("_s"), F.col("range").alias("_r"), offset.alias("_o"))  # at most ranges + shards rows
    nth = F.row_number().over(Window.partitionBy("range", "shard").orderBy("key"))
    x = x.withColumn("_nth", nth).join(F.broadcast(counts), (F.col("shard") == F.col("_s")) & (F.col("range") == F.col("_r")))
    return x.withColumn("slot", (F.col("_o") + F.col("_nth") - 1).cast("long")).drop("_s", "_r", "_o", "_nth", "range")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(keyed(documents(spark, sf_dir)), "keyed")
    return shard_by_bytes(rows, 24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 by half-bytes, the low one of each byte first; a table of 16 from the polynomial.
ORACLE_OP8 = """
WITH nibble AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c FROM range(16) r(i))),
d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 8 AS size,
  substr(md5(coalesce(text, '')), 1, 16) || substr(md5('id:' || coalesce(doc_id::VARCHAR, '-')), 1, 16) AS key FROM documents),
h AS (SELECT t, list_transform(string_split(hex(encode(t)), ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS ns FROM (SELECT DISTINCT t FROM d)),
s AS (SELECT t, CASE WHEN t = '' THEN [] ELSE list_transform(range(len(ns)), lambda i: ns[i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END]) END AS ns FROM h),
c AS (SELECT t, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(ns, lambda x: x::UBIGINT)), lambda a, b: xor(a >> 4, tab[(xor(a, b) & 15)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS crc FROM s, nibble),
r AS (SELECT d.*, crc, (sum(size) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS run, (sum(size) OVER ())::BIGINT AS total FROM d JOIN c USING (t)),
p AS (SELECT *, least(floor((run - size / 2) * 24 / greatest(total, 1)::DOUBLE), 23)::INT AS shard FROM r)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY run) - 1 AS slot, NULL::INT AS grown_shard FROM p
"""
