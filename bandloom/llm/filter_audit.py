"""Interaction audit of five filters: what each one removes in every order, by masks counted once.

Each document gets a mask of the filters it fails (FILTERS, in the order of their bits). A to D come from its text alone;
E, identical to the text of a smaller id, comes from partition refinement: documents are split by their length in code
points, then by the hashes of successive BLOCKS of their bytes, and after each split those alone in their class are
dropped. Hashes only drop: the texts of the surviving classes are then compared whole, by grouping on the text itself,
which merges copies where they stand, so a text with many copies sends one row a task. Documents above the least id of
their text fail E. A class that turns out to hold several texts (a hash collision) is resolved by a join on the texts.
All that the 120 orders and 5 steps need are the counts of the 32 masks of a part, so they are worked out from those.

To keep singletons from being shuffled as texts, the classes that survive are sent along as at most 2**SIEVE_BITS numbers;
where more classes survive the sieve lets more through, and the grouping on whole texts stays exact.

Defined results: null texts count as empty (which fails A alone, and E where a smaller id has an empty text); texts are taken
whole, whatever their length; a null language is the part ''; a null id is neither smaller nor larger than any; rows equal
in id and text don't fail E on each other's account; a document with several label rows is good or toxic if one of them
says so; an empty table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.plans.ship import ship

from .common import documents, text_or_empty, written

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes from and to; the last block goes to the end.
BLOCKS = ((0, 256), (256, 8192), (8192, (1 << 31) - 1 - 8192))
CLASS = ["n_chars", *(f"block{i}" for i in range(len(BLOCKS)))]
SIEVE_BITS = 18
HOT = 1000


def in_classes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """docs(text) with CLASS: the length and a hash of each block. Fewer bits make collisions, for tests."""
    raw = F.col("text").cast("binary")
    cut = lambda h: h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))
    hashes = {f"block{i}": cut(F.xxhash64(F.substring(raw, a + 1, b - a))) for i, (a, b) in enumerate(BLOCKS)}
    return docs.withColumns({"n_chars": F.length("text").cast("long"), **hashes})


def own_mask(raw: bytes, n_chars: int) -> int:
    """The bits of A to D. bytes.split() knows the same six blanks as the contract."""
    words = raw.split()
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        BIT["A"] * (n < MIN_WORDS) + BIT["B"] * (100 * len(set(words)) < MIN_DISTINCT * n)
        + BIT["C"] * (100 * capitals > MAX_CAPITALS * n_chars) + BIT["D"] * (len(raw.translate(None, SYMBOLS)) < len(raw))
    )


def with_own_masks(docs: DataFrame) -> DataFrame:
    """docs(..., text, n_chars) with mask in place of text."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            texts, lengths = batch.column("text").cast(pa.binary()), batch.column("n_chars")
            mask = pa.array([own_mask(t.as_py(), n.as_py()) for t, n in zip(texts, lengths)], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), mask], names=[*kept, "mask"])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept) + ", mask int")


def refined(rows: DataFrame) -> DataFrame:
    """CLASS of the rows that aren't alone: one split a column, each over what the last one left."""
    live = rows.select(*CLASS)
    for i in range(len(CLASS)):
        often = live.groupBy(*CLASS[: i + 1]).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        live = written(live.join(often, CLASS[: i + 1], "left_semi"), f"split{i}")
    return live


def bucket() -> Column:
    return F.xxhash64(*CLASS).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1)).alias("_bucket")


def equal_texts(docs: DataFrame, live: DataFrame) -> DataFrame:
    """(CLASS, text, first, n) of the texts in classes of live, and perhaps of some others: first is their least id."""
    sieve = F.broadcast(live.select(bucket()).distinct())  # at most 2**SIEVE_BITS numbers
    return docs.join(sieve, bucket() == F.col("_bucket"), "left_semi").groupBy(*CLASS, "text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


def with_first(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with first, the least id of their class. Classes of more than one row in HOT, which are fewer than HOT, are sent
    along, so that their rows don't meet in one task; the others are joined."""
    hot = F.col("_n") * HOT > rows.count()
    sent = F.broadcast(classes.filter(hot).select(*CLASS, "first"))
    rest = rows.join(sent, CLASS, "left_anti").join(classes.filter(~hot).select(*CLASS, "first"), CLASS, "left")
    return rows.join(sent, CLASS).select(*rows.columns, "first").unionByName(rest.select(*rows.columns, "first"))


def with_masks(docs: DataFrame, bits: int = 64) -> DataFrame:
    """docs(doc_id, part, text) as (doc_id, part, mask): all five bits."""
    docs = in_classes(docs, bits)
    rows = written(with_own_masks(docs), "masks")
    texts = equal_texts(docs, refined(rows))
    classes = texts.groupBy(*CLASS).agg(F.min("first").alias("first"), F.sum("n").alias("_n"), F.count("*").alias("texts"))
    classes = written(classes.filter("_n > 1"), "classes")
    above = F.when(F.col("doc_id") > F.col("first"), BIT["E"]).otherwise(0)
    found = lambda x: x.select("doc_id", "part", (F.col("mask") + above).alias("mask"))
    mixed = classes.filter("texts > 1").select(*CLASS)
    if mixed.isEmpty():
        return found(with_first(rows, classes))
    some = docs.join(mixed, CLASS, "left_semi")
    least = some.groupBy(F.col("text").alias("_text"), *(F.col(c).alias(f"_{c}") for c in CLASS)).agg(F.min("doc_id").alias("first"))
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}") for c in ["text", *CLASS]))
    told = some.join(least, same).select("doc_id", "part", "text", "n_chars", "first")
    rest = with_first(rows.join(mixed, CLASS, "left_anti"), classes)
    return found(rest).unionByName(found(with_own_masks(told)))


def audit(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """masks(doc_id, part, mask) and labels(doc_id, quality, toxic): a row for each part, order and step."""
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(said("quality").alias("_good"), said("toxic").alias("_toxic")).filter("_good + _toxic > 0")
    x = masks.join(known, F.col("doc_id") == F.col("_id"), "left")
    counts = x.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic"))
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "bit": BIT[f], "before": sum(BIT[g] for g in order[:i])}
        for order in permutations(FILTERS) for i, f in enumerate(order)
    ]
    each = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    x = counts.select("*", F.inline(each))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0)).alias
    # a document that fails k filters is removed by each of them in 120 / k orders
    return x.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier)("kept"), total(fails & ~earlier)("removed"), total(fails & earlier)("redundant"), total(F.col("mask") == F.col("bit"))("unique_fails"),
        total(fails & ~earlier, "good")("good_lost"), total(fails & ~earlier, "toxic")("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * F.expr("120 div bit_count(mask)")).otherwise(0)).alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, part: str = "lang", bits: int = 64) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text_or_empty().alias("text"))
    return audit(with_masks(rows, bits), labels)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(string_split('ABCDE', '')) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM o, range(1, 6) r(step)),
x AS (SELECT c.*, s.*, contains(fails, f) AS bad, len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0 AND fails <> '' AND before <> '' AS gone FROM c, s),
t AS (SELECT part, filter_order, step, any_value(f) AS f, sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN bad AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM t
"""
