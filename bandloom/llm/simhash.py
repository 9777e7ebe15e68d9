"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are made once per row and compared once per distinct value. Two 64-bit values within radius 2 agree on at
least three of five bands, so each value goes to the ten groups named by three bands; no pair is lost and no cap is
set. In a group the values are stored vertically: plane b holds bit b of 64 values a word. One value's distance to all
values of a block is counted at once by carry-save counters (ones, twos, and a sticky `over`), and a block is abandoned
as soon as every lane is over the radius. Groups over BLOCK values are compared as pairs of blocks, in separate tasks,
so a hot group is spread; a block pair emits a spanning forest of its links, not all pairs.

Components of the links are found by components(); a link between different fingerprints is never lost.

The pipeline stage, one_of_each(), asks for texts whose sets of WORDS-word shingles have a Jaccard similarity of
SIMILARITY or more. At 0.8 the bits of fingerprints differ with a chance of 0.15 (0.19 for sets of four and five), too
often for bands of 64 bits. So the stage takes fingerprints of WIDE bits, and candidates are compared that meet in one
of PARTS groups of ROWS minimum hashes (a pair at 0.8 misses all of them once in 3e5). In a group the same vertical
comparison counts distances up to LOOSE bits (six deviations above 0.8), 64 fingerprints a word and many words at once,
and words whose lanes are all over the radius are abandoned. What is near makes loose components, and in these the sets
are compared exactly; links again make the components.

Defined results: null and blank texts have fingerprint zero and link like any other; repeated rows share a component; ties
go to the least id; a component whose ids are all null has component_id null; texts are taken whole, whatever their
length; an empty table gives an empty result. Extra columns, whatever their names, pass by one_of_each() and are left
out by near_duplicates(), which gives prints' columns. Of a component one row stays: the least id (nulls last), then the
least hash of the text; of rows equal in id and text one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from bandloom.plans.ship import ship

from .common import documents, set_aside, written
from .components import components

SHINGLE, RADIUS, BLOCK = 3, 2, 4096
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
LANES = np.uint64(0x0101010101010101)
#: Near-duplicates of the pipeline stage: words of a shingle, least similarity, and how candidates are found.
WORDS, SIMILARITY = 5, 0.8
ROWS, PARTS, WIDE, LOOSE, SETS, SET_BYTES = 4, 24, 256, 76, 512, 1 << 25
FACTORS = np.random.default_rng(42).integers(0, 2**63, PARTS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows of a batch of comparisons, and how many (fingerprint, word) pairs are compared at once.
HELD, UNITS = 20_000, 1 << 16


def bit_totals(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set. Eight bits are counted at once in the bytes of a word, 255 rows at a time."""
    totals = np.zeros(64, np.int64)
    starts = np.arange(0, len(h), 255)
    for bit in range(8):
        sums = np.add.reduceat((h >> np.uint64(bit)) & LANES, starts)
        totals[bit::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return totals


def shingles(text: str | None, size: int) -> np.ndarray:
    """The hashes of the text's shingles, in order; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    k = min(size, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    return np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: str | None) -> int:
    h = shingles(text, SHINGLE)
    if not len(h):
        return 0
    bits = bit_totals(h) * 2 > len(h)
    return int.from_bytes(np.packbits(bits[::-1]).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def masks() -> list[int]:
    """For each choice of three bands, their bits."""
    bits = [((1 << n) - 1) << at for at, n in BANDS]
    return [sum(c) for c in combinations(bits, len(BANDS) - RADIUS)]


def planes(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """Row b: bit bits[b] of all values, 64 a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    cut = [np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for b in bits]
    return np.array(cut)


def near(value: int, stored: np.ndarray, bits: list[int], live: np.ndarray) -> np.ndarray:
    """Indices of the stored lanes within RADIUS of value on the given bits."""
    ones, twos, over = np.zeros_like(live), np.zeros_like(live), ~live
    flip = np.uint64(0xFFFFFFFFFFFFFFFF)
    for row, b in zip(stored, bits):
        differ = row ^ flip if value >> b & 1 else row
        carry = ones & differ
        ones = ones ^ differ
        over = over | (twos & (carry | ones)) | (twos & carry)
        twos = twos | carry
        if b & 3 == 3 and (over == flip).all():
            return np.zeros(0, np.int64)
    return np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little"))


class Forest:
    """Sets of linked values, each known by its least."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def top(self, x: int) -> int:
        root = self.root
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.top(x), self.top(y)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def links(self) -> pa.Table:
        found = [(x, self.top(x)) for x in self.root if self.top(x) != x]
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())})


def links(left: np.ndarray, right: np.ndarray, mask: int) -> pa.Table:
    """A spanning forest of the links between values of left and right, which agree on the bits of mask."""
    bits = [b for b in range(64) if not mask >> b & 1]
    stored = planes(right, bits)
    live = np.zeros(stored.shape[1] * 64, np.uint8)
    live[: len(right)] = 1
    live = np.packbits(live, bitorder="little").view(np.uint64)
    forest = Forest()
    names = right.view(np.int64).tolist()
    for value, own in zip(left.tolist(), left.view(np.int64).tolist()):
        for i in near(value, stored, bits, live).tolist():
            forest.link(own, names[i])
    return forest.links()


def in_blocks(rows: DataFrame, size: int, weight: Column | None = None) -> DataFrame:
    """rows(mask, key, fp, ...) of groups with several rows, in pairs (a, b) of blocks; block is a row's own. A block has
    about size rows, or less where their weights, as shares of a block, sum to more than 1."""
    blocks = F.ceil(F.count("*") / size) if weight is None else F.ceil(F.greatest(F.count("*") / size, F.sum(weight)))
    sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n"), blocks.cast("int").alias("blocks")).filter("n > 1")
    sizes = sizes.select(F.col("mask").alias("_m"), F.col("key").alias("_k"), "blocks")
    x = rows.join(sizes, (F.col("mask") == F.col("_m")) & (F.col("key") == F.col("_k"))).drop("_m", "_k")
    block = F.when(F.col("blocks") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64(F.col("fp")), F.col("blocks")).cast("int"))
    x = x.withColumn("block", block).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    x = x.select(*rows.columns, F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block")
    return x.repartition("mask", "key", "a", "b")  # by key alone, as they lie, all blocks of a group would be one task


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(u, v) between distinct values fp at most RADIUS bits apart: enough of them to connect whatever is linked."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks()))))
    rows = distinct.select("fp", each.alias("_g")).select("fp", "_g.mask", "_g.key")
    rows = in_blocks(rows, BLOCK)
    all_masks = masks()

    def compare(table: pa.Table) -> pa.Table:
        mask, a, b = (table.column(c)[0].as_py() for c in ("mask", "a", "b"))
        fp = table.column("fp").to_numpy().view(np.uint64)
        block = table.column("block").to_numpy()
        return links(fp[block == a], fp[block == b], all_masks[mask])

    return rows.groupBy("mask", "key", "a", "b").applyInArrow(compare, "u long, v long")


def near_duplicates(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fp), a stored table, with component_id: the least doc_id reachable by links."""
    by_print = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    return with_components(prints, by_print, components(fingerprint_links(by_print.select("fp")))).drop("root")


def with_components(prints: DataFrame, by_print: DataFrame, roots: DataFrame) -> DataFrame:
    """prints with root and component_id, given the components of by_print(fp, first_id)."""
    labelled = written(by_print.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "labelled")
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "_root")
    named = labelled.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "root", "component_id")
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(written(fingerprints(documents(spark, sf_dir)), "fingerprints"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_name(s: np.ndarray) -> int:
    """A set of shingles in 64 bits, as a signed long."""
    return int(np.uint64(xxh64_intdigest(s.tobytes(), 7)).view(np.int64))


def least_hashes(s: np.ndarray) -> np.ndarray:
    """PARTS * ROWS minimum hashes of a set; an empty one has the greatest."""
    least = np.full(len(FACTORS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(least, (s[at : at + 1024, None] * FACTORS).min(axis=0), out=least)
    return least


def wide_print(s: np.ndarray) -> np.ndarray:
    """The SimHash of a set in WIDE bits, as words."""
    out = np.zeros(WIDE // 64, np.uint64)
    for k in range(WIDE // 64):
        h = (s ^ (s >> np.uint64(31))) * FACTORS[k]
        h = (h ^ (h >> np.uint64(29))) * FACTORS[~k]
        out[k] = np.packbits(bit_totals(h ^ (h >> np.uint64(32))) * 2 > len(s), bitorder="little").view(np.uint64)[0] if len(s) else 0
    return out


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits by which texts are told apart; a null text counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole).alias("_h1"), F.xxhash64(F.lit("second"), whole).alias("_h2")


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, _h1, _h2, fp, n, parts, print): the text's key, the name and size of its set of shingles, the keys of its
    groups, and its wide fingerprint."""

    def run(batches):
        for b in batches:
            names, sizes, parts, prints = [], [], [], []
            for t in b.column("text"):
                s = np.unique(shingles(t.as_py(), WORDS))
                names.append(set_name(s))
                sizes.append(len(s))
                parts.append([xxh64_intdigest(p.tobytes(), 9) for p in least_hashes(s).reshape(PARTS, ROWS)])
                prints.append(wide_print(s).tobytes())
            keys = np.array(parts, np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, PARTS), pa.int32()), pa.array(keys))
            made = [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "_h1", "_h2")), *made], names=["doc_id", "_h1", "_h2", "fp", "n", "parts", "print"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", *text_keys(F.col("text")), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, _h1 long, _h2 long, fp long, n long, parts array<long>, print binary")


def added(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A full adder: the sum and the carry of three bits in each lane."""
    u = x ^ y
    return u ^ z, (x & y) | (u & z)


def within(left: np.ndarray, word: np.ndarray, live: np.ndarray, stored: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (unit, lane) at most radius bits apart. Unit i compares the wide fingerprint left[i] with the lanes live[i] of
    column word[i] of stored, whose row b holds bit b. Distances run up in vertical counters that start so that the one
    past the radius overflows; a unit goes as soon as all its lanes have."""
    planes = radius.bit_length()
    at, over = np.arange(len(left)), ~live
    start = (1 << planes) - 1 - radius
    count = [np.full(len(left), FLIP if start >> k & 1 else 0, np.uint64) for k in range(planes)]
    for bit in range(0, WIDE, 4):
        d = [stored[b].take(word) ^ (np.uint64(0) - (left[:, b >> 6] >> np.uint64(b & 63) & np.uint64(1))) for b in range(bit, bit + 4)]
        count[0], x = added(count[0], d[0], d[1])
        count[0], y = added(count[0], d[2], d[3])
        count[1], carry = added(count[1], x, y)
        for k in range(2, planes):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over = over | carry
        if bit % 32 == 28:
            alive = over != FLIP
            if 4 * np.count_nonzero(alive) < 3 * len(alive):
                at, over, word, left = at[alive], over[alive], word[alive], left[alive]
                count = [c[alive] for c in count]
    some = np.flatnonzero(over != FLIP)
    unit, lane = np.nonzero(np.unpackbits((~over[some]).view(np.uint8), bitorder="little").reshape(-1, 64))
    return at[some[unit]], lane


def near_links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, n: np.ndarray, prints: np.ndarray) -> pa.Table:
    """A spanning forest of the links between near rows of a group. Rows are sorted by group; side has bit 0 for rows
    that are compared, bit 1 for rows that they are compared with."""
    column = np.flatnonzero(side & 2)
    starts = np.flatnonzero(np.concatenate(([True], group[column][1:] != group[column][:-1])))
    ends = np.append(starts[1:], len(column))
    first = starts >> 6  # a group's lanes begin where the one before ends; its words may hold lanes of others
    words = (ends - 1 >> 6) - first + 1
    padded = np.zeros((-(-len(column) // 64) * 64, WIDE // 64), np.uint64)
    padded[: len(column)] = prints[column]
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    stored = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    rows = np.flatnonzero(side & 1)
    known = group[column][starts]
    which = np.searchsorted(known, group[rows])
    keep = (which < len(known)) & (known[np.minimum(which, len(known) - 1)] == group[rows])
    rows, which = rows[keep], which[keep]
    units = np.repeat(np.arange(len(rows)), words[which])
    last = np.cumsum(words[which])
    word = np.arange(len(units)) - np.repeat(last - words[which], words[which]) + first[which][units]
    low = np.maximum(starts[which][units] - 64 * word, 0).astype(np.uint64)
    high = np.minimum(ends[which][units] - 64 * word, 64).astype(np.uint64)
    live = (FLIP >> (np.uint64(64) - high)) & (FLIP << low)
    forest = Forest()
    for x in range(0, len(units), UNITS):
        u, w = rows[units[x : x + UNITS]], word[x : x + UNITS]
        unit, lane = within(prints[u], w, live[x : x + UNITS], stored, LOOSE)
        i, j = u[unit], column[w[unit] * 64 + lane]
        good = (fp[i] != fp[j]) & (np.minimum(n[i], n[j]) >= SIMILARITY * np.maximum(n[i], n[j]))
        for a, b in zip(fp[i[good]].tolist(), fp[j[good]].tolist()):
            forest.link(a, b)
    return forest.links()


def loose_links(distinct: DataFrame) -> DataFrame:
    """(u, v) between names fp of candidates: enough of them to connect whatever is near."""
    rows = distinct.select("fp", "n", "print", F.posexplode("parts").alias("mask", "key")).select("mask", "key", "fp", "n", "print")
    rows = in_blocks(rows, BLOCK)
    names = ["mask", "key", "a", "b"]

    def run(batches):
        """Whole groups are compared together, about HELD rows at a time; a group has at most two blocks."""
        held: list[pa.RecordBatch] = []

        def compared(part: pa.Table) -> Iterator[pa.RecordBatch]:
            if part.num_rows < 2:
                return
            keys = np.stack([part.column(c).to_numpy().astype(np.int64) for c in names])
            group = np.concatenate(([0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))))
            block = part.column("block").to_numpy()
            side = (block == keys[2]) * 1 + (block == keys[3]) * 2
            prints = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint64).reshape(part.num_rows, -1)
            yield from near_links(group, side, part.column("fp").to_numpy(), part.column("n").to_numpy(), prints).to_batches()

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) < HELD:
                continue
            whole = pa.Table.from_batches(held)
            keys = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in names])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
            if len(cuts):
                yield from compared(whole.slice(0, int(cuts[-1]) + 1))
                held = whole.slice(int(cuts[-1]) + 1).to_batches()
        if held:
            yield from compared(pa.Table.from_batches(held))

    return rows.sortWithinPartitions(*names).mapInArrow(run, "u long, v long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(fp, shingles) of each text."""

    def run(batches):
        for b in batches:
            for t in b.column("text"):
                s = np.unique(shingles(t.as_py(), WORDS))
                yield pa.RecordBatch.from_arrays([pa.array([set_name(s)], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["fp", "shingles"])

    return docs.select("text").mapInArrow(run, "fp long, shingles binary")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of SIMILARITY or more."""
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def exact_links(sets: DataFrame) -> DataFrame:
    """(u, v) between names fp of similar sets(key, fp, shingles) with one key: enough to connect whatever is similar."""

    def compare(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        fp, block = table.column("fp").to_numpy(), table.column("block").to_numpy()
        values = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        forest = Forest()
        right = np.flatnonzero(block == b).tolist()
        for i in np.flatnonzero(block == a).tolist():
            for j in right:
                if forest.top(int(fp[i])) != forest.top(int(fp[j])) and similar(values[i], values[j]):
                    forest.link(int(fp[i]), int(fp[j]))
        return forest.links()

    rows = in_blocks(sets.select(F.lit(0).alias("mask"), "key", "fp", "shingles"), SETS, F.octet_length("shingles") / SET_BYTES)
    return rows.groupBy("mask", "key", "a", "b").applyInArrow(compare, "u long, v long")


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, _h1, _h2, fp, root, component_id) of docs(doc_id, text): the least doc_id reachable by links between
    similar texts."""
    prints = written(sketches(docs), "sketches")
    first = F.min(F.struct("_h1", "_h2")).alias("_text")
    by_set = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), first, *(F.first(c).alias(c) for c in ("n", "parts", "print")))
    by_set = written(by_set, "sets")
    loose = components(loose_links(by_set))
    loose = written(loose.union(loose.select("root", "root").distinct()).select(F.col("node").alias("_fp"), F.col("root").alias("key")), "loose")
    # one text of each set is read again, found by its key; copies of it come along
    texts = by_set.join(loose, F.col("fp") == F.col("_fp"), "left_semi").select(F.col("_text._h1").alias("_t1"), F.col("_text._h2").alias("_t2"))
    keyed = docs.select("text", *text_keys(F.col("text")))
    sets = shingle_sets(keyed.join(texts, (F.col("_h1") == F.col("_t1")) & (F.col("_h2") == F.col("_t2")), "left_semi"))
    sets = written(sets.join(loose, F.col("fp") == F.col("_fp")).select("key", "fp", "shingles").dropDuplicates(["fp"]), "shingles")
    found = prints.select("doc_id", "_h1", "_h2", "fp")
    return with_components(found, by_set.select("fp", "first_id"), components(exact_links(sets)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of similar texts. Only keys of rows are compared and shuffled; texts are read
    where they stand, but for rows that are repeated in full, of which one is chosen."""
    docs, back = set_aside(docs, "doc_id", "text")
    found = written(similar_documents(docs.select("doc_id", "text")), "similar")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h1", "_h2")).alias("_k")
    kept = found.groupBy("root").agg(least).select("_k.*")
    times = found.groupBy("doc_id", "_h1", "_h2").agg(F.count("*").alias("times"))
    same = kept["doc_id"].eqNullSafe(times["doc_id"]) & (kept["_h1"] == times["_h1"]) & (kept["_h2"] == times["_h2"])
    kept = kept.join(times, same).select(kept["doc_id"].alias("_id"), kept["_h1"].alias("_k1"), kept["_h2"].alias("_k2"), "times")
    kept = written(kept, "kept")
    keyed = docs.select("*", *text_keys(F.col("text")))
    chosen = lambda k: keyed.join(k, keyed["doc_id"].eqNullSafe(k["_id"]) & (keyed["_h1"] == k["_k1"]) & (keyed["_h2"] == k["_k2"]), "left_semi")
    once, repeated = chosen(kept.filter("times = 1")), chosen(kept.filter("times > 1"))
    return back(once.unionByName(repeated.dropDuplicates(["doc_id", "_h1", "_h2"])))
