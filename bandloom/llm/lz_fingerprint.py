"""Lempel-Ziv phrase fingerprints.

A text is parsed into LZ78 phrases: each is the shortest run of characters, from where the last phrase ended, that isn't
a phrase yet. Phrases are hashed by a polynomial over code points that prefix sums give for all phrases at once, and the
set of hashes is kept as a minimum-hash signature of SLOTS bytes (the low byte of each minimum). Signatures agree in
about the share of phrases that two texts have in common, as they would compress each other; the chance agreement of
single bytes (1/256) is taken out of the likeness.

Documents are dealt to runs of descending doc_id, each with its follower, the first document of the next run, so a
text is compared with the next one in a stream of rows. Runs are cut at sampled (doc_id, hash of the text), about
RUN_BYTES each and MAX_RUNS at most; an id that many rows share, or none, is cut too. The parse of an edited text goes
on from the state of the original's parse where the two part.

Defined results: null texts count as empty; texts without a phrase have the fingerprint of zeros, likeness 1 to each
other and 0 to all others; texts are parsed whole, and one text's phrases are held in memory; of rows with one doc_id
the order is by a hash of the text, and equal rows follow each other in one run; null ids come last; one document is its
own next; an empty table gives an empty result; other columns than doc_id and text, whatever their names, are left out.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandloom.plans.ship import ship

from .common import documents, text_or_empty

SLOTS = 128
RUN_BYTES, MAX_RUNS, SAMPLES_PER_RUN = 1 << 25, 1 << 16, 16
LEAST_ID = -(1 << 63)
BASE = 0x9E3779B97F4A7C15
_seeds = np.random.Generator(np.random.PCG64(20240)).integers(1, 1 << 32, (2, SLOTS), dtype=np.uint32)
FACTORS, SHIFTS = _seeds[0] | np.uint32(1), _seeds[1]
NONE = np.full(SLOTS, 0xFFFFFFFF, np.uint32)


def parse(text: str, start: int, known: set[str]) -> list[int]:
    """Ends of the phrases of text from start on; known gets them. A rest that is a phrase already is left."""
    ends: list[int] = []
    w = ""
    for i, c in enumerate(text[start:] if start else text, start + 1):
        w += c
        if w not in known:
            known.add(w)
            ends.append(i)
            w = ""
    return ends


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Hashes of runs of one text: sums of code point * BASE^place, shifted to place 0 by the inverse power. Powers are kept
    for texts of KEPT characters; longer ones have their own."""

    KEPT, INVERSE = 1 << 18, pow(BASE, -1, 1 << 64)
    tables: tuple[np.ndarray, np.ndarray] | None = None

    def __init__(self, text: str):
        n = len(text)
        if Hasher.tables is None:
            Hasher.tables = _powers(BASE, Hasher.KEPT), _powers(Hasher.INVERSE, Hasher.KEPT)
        powers, self.back = Hasher.tables if n < Hasher.KEPT else (_powers(BASE, n + 1), _powers(Hasher.INVERSE, n + 1))
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * powers[:n], dtype=np.uint64)))

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)).astype(np.uint32)


def minima(hashes: np.ndarray) -> np.ndarray:
    """Per slot, the least value of its permutation of 32-bit numbers over the hashes."""
    least = NONE.copy()
    for at in range(0, len(hashes), 2048):
        h = hashes[at : at + 2048]
        np.minimum(least, (FACTORS[:, None] * h[None, :] + SHIFTS[:, None]).min(axis=1), out=least)
    return least


def signature_bytes(least: np.ndarray, empty: bool) -> bytes:
    return bytes(SLOTS) if empty else (least & np.uint32(0xFF)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes, a_empty: bool, b_empty: bool) -> float:
    if a_empty or b_empty:
        return float(a_empty and b_empty)
    same = float(np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))) / SLOTS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


class Fingerprint:
    """A text's signature, and enough of its parse to go on from a cut."""

    def __init__(self, text: str):
        self.text, known = text, set()
        self.ends = parse(text, 0, known)
        ends = np.array([0, *self.ends], np.int64)
        self.hashes = Hasher(text).runs(ends[:-1], ends[1:])
        self.least = minima(self.hashes)
        self.bytes = signature_bytes(self.least, not self.ends)

    def edited(self, text: str, common: int) -> bytes:
        """The signature of a text that has the first `common` code points of this one."""
        n = bisect.bisect_right(self.ends, common)
        starts = [0, *self.ends[:n]]
        known = {self.text[a:b] for a, b in zip(starts, self.ends[:n])}
        more = np.array([starts[-1], *parse(text, starts[-1], known)], np.int64)
        both = np.minimum(minima(self.hashes[:n]), minima(Hasher(text).runs(more[:-1], more[1:])))
        return signature_bytes(both, not text)


def run_of(cuts: list[tuple[int, int]], ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many cuts (id, hash) are at or below each row, by binary search."""
    if not cuts:
        return np.zeros(len(ids), np.int32)
    c1, c2 = (np.array(c, np.int64) for c in zip(*cuts))
    low, high = np.searchsorted(c1, ids, "left"), np.searchsorted(c1, ids, "right")
    out = low.copy()
    for i in np.unique(low[low < high]).tolist():  # ids that stand in a cut
        rows = (low == i) & (high > i)
        out[rows] += np.searchsorted(c2[i : high[rows][0]], hashes[rows], "right")
    return out.astype(np.int32)


def spread_keys(parts: int) -> np.ndarray:
    """For each of so many partitions an int that Spark's hash partitioning deals to it (Murmur3 of an int, seed 42)."""
    out, n = np.full(parts, -1, np.int32), 0
    with np.errstate(over="ignore"):
        while (out < 0).any():
            k = np.arange(n, n + 16 * parts, dtype=np.uint32)
            n += 16 * parts
            h = k * np.uint32(0xCC9E2D51)
            h = (h << np.uint32(15) | h >> np.uint32(17)) * np.uint32(0x1B873593) ^ np.uint32(42)
            h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
            h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
            h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
            place = (h ^ h >> np.uint32(16)).view(np.int32) % parts
            new = np.flatnonzero(out[place] < 0)
            out[place[new]] = k[new]  # any of those that meet
    return out


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (run, doc_id, hash, text, halo), and about how many runs: runs of descending (doc_id, hash), each ended by a halo
    row that is the next run's first. Only sampled keys reach the driver, and a row for each run is sent to the rows."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    rows = rows.select("doc_id", key.alias("key"), F.xxhash64("text").alias("hash"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = max(1, min(total // RUN_BYTES, MAX_RUNS), min(256, total >> 20))
    cuts: list[tuple[int, int]] = []
    if runs > 1:
        chance = (F.octet_length("text") + 64) * F.lit(runs * SAMPLES_PER_RUN / total)
        draw = F.shiftrightunsigned(F.xxhash64(F.lit("run"), "key", "hash"), 11) / F.lit(float(1 << 53))
        sample = sorted((r.key, r.hash) for r in rows.filter(draw < chance).select("key", "hash").distinct().collect())
        cuts = sorted({sample[i * len(sample) // runs] for i in range(1, runs)}) if sample else []

    @F.pandas_udf("int")
    def run(key: pd.Series, hash_: pd.Series) -> pd.Series:
        return pd.Series(run_of(cuts, key.to_numpy(), hash_.to_numpy()))

    rows = rows.withColumn("run", run("key", "hash"))
    first = rows.groupBy("run").agg(F.max(F.struct("key", "hash")).alias("_k")).select("run", "_k.key", "_k.hash")
    down = Window.orderBy("run")  # a row for each run
    first = first.select(F.coalesce(F.lead("run").over(down), F.min("run").over(Window.partitionBy())).alias("to"), F.col("run").alias("of"), F.col("key").alias("_k"), F.col("hash").alias("_h"))
    halos = rows.join(F.broadcast(first), (F.col("run") == F.col("of")) & (F.col("key") == F.col("_k")) & (F.col("hash") == F.col("_h")))
    names = ["run", "doc_id", "hash", "text", "halo"]
    halos = halos.withColumn("run", F.col("to")).withColumn("halo", F.lit(1)).select(*names).dropDuplicates(["run"])
    return rows.withColumn("halo", F.lit(0)).select(*names).unionByName(halos), max(runs, 1)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    ship(docs.sparkSession)
    rows, runs = with_next(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def stream(batches) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c) for c in ("run", "doc_id", "text", "halo")))

    def pairs(batches) -> Iterator[tuple]:
        """(id, text, next text); of a run's halo rows only the first counts."""
        held = None
        for run, doc_id, text, halo in stream(batches):
            run, halo = run.as_py(), halo.as_py()
            if held is not None and held[0] == run:
                yield held[1], held[2], (now := text.as_py())
                held = None if halo else (run, doc_id, now)
            elif not halo:
                held = (run, doc_id, text.as_py())

    def work(batches):
        known: tuple[str, Fingerprint] | None = None
        out: list[tuple] = []
        kept = []
        for doc_id, text, then in pairs(batches):
            own = known[1] if known and known[0] == text else Fingerprint(text)
            after = Fingerprint(then)
            known = (then, after)
            n = len(text)
            edited = text[: n - n // 3] + then[: n // 3]
            print_ = own.edited(edited, n - n // 3)
            near = likeness(own.bytes, print_, not text, not edited)
            out.append((n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.bytes.hex(), print_.hex(), near, likeness(own.bytes, after.bytes, not text, not then)))
            kept.append(doc_id)
            if len(out) >= 1000:
                yield batch(kept, out)
                out, kept = [], []
        if out:
            yield batch(kept, out)

    def batch(ids: list, rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array([i.as_py() for i in ids], ids[0].type), *map(pa.array, cols, kinds)], names=names)

    keys = spread_keys(runs)

    @F.pandas_udf("int")
    def key(run: pd.Series) -> pd.Series:
        return pd.Series(keys[run.to_numpy()])

    dealt = rows.repartition(runs, key("run")).sortWithinPartitions(F.col("run"), F.col("halo"), F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), F.col("text"))
    return dealt.mapInArrow(work, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(documents(spark, sf_dir))
