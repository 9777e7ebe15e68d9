"""Language-model scores by deleted interpolation.

p(w | v) = l2 c(v,w)/c(v) + l1 c(w)/N + l0 /(V+1): maximum-likelihood estimates of orders 2, 1 and 0, mixed with weights
that depend on how often the context v was seen (a bucket for each power of two). The weights are learned by
expectation-maximisation on held-out counts: documents of class 3 are set aside, the estimates come from the other
training documents, and the weights that make class 3 most likely are found on its tokens, gathered as cells of (bucket,
size of both estimates). The scores then use the counts of all training documents. A text's context before its first
word is its start.

Counting is spread twice. Documents are packed into units (by hash, so no source or copied text is one unit); a unit
sends its distinct n-grams, as sorted arrays of 63-bit hashes with counts, to shards of the hash space; a shard adds up
and answers each unit with the corpus counts in the unit's own order. A frequent word is one number from each unit.
Large corpora send by way of nodes, which add up what several units have for several shards (corpus_counts).
Only N, V and the cells of the weights, whose number is bounded, reach the driver.

Hashes: 63 bits keep n-grams apart; at 10^8 distinct n-grams a collision is expected in one corpus of a thousand.

Defined results: null and empty texts are the end token alone; texts are scored whole, whatever their length; a null doc_id
is the empty text in the class rule; rows equal in id and text are separate documents; buckets without held-out tokens
have the weights of all; without training documents N and V are 0 and only order 0 counts; an empty table gives an empty
result; other columns than doc_id and text, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from bandloom.plans.ship import ship

from .common import documents, text_or_empty, written

CLASSES, HELD_OUT, TUNING = 7, 2, 3
UNIT_BYTES, SHARD_KEYS, PACK_BYTES, KEPT = 12 << 20, 1 << 20, 16 << 20, 500_000
BUCKETS, FINE, ROUNDS = 24, 4, 60
HOP_LOG2 = 10
END, START = np.uint64(0x9AE16A3B2F90404E), np.uint64(0xC949C7DEFD6B3F81)
TWO = np.uint64(0x9FB21C651E98DF25)
EVEN, ONE = ~np.uint64(1), np.uint64(1)


class Hashes(dict):
    """Words to 64-bit hashes; emptied when it holds KEPT words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        self[word] = h = xxh64_intdigest(word, 7)
        return h


_hashes = Hashes()


def unit_of(crc: int, text: bytes, units: int, tuning: int) -> int:
    """Documents of the tuning class have units of their own, after the others."""
    h = zlib.crc32(text, crc)
    return units + h % tuning if crc % CLASSES == TUNING else h % units


def packed(docs: DataFrame, units: int, tuning: int) -> DataFrame:
    """(unit, blob): documents of a unit, compressed together."""

    def blobs(ids: list, texts: list) -> Iterator[tuple[int, bytes]]:
        place: dict[int, list[int]] = {}
        for i, (d, t) in enumerate(zip(ids, texts)):
            place.setdefault(unit_of(zlib.crc32(b"" if d is None else str(d).encode()), t, units, tuning), []).append(i)
        z = zstandard.ZstdCompressor(level=1)
        for unit, rows in place.items():
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], pa.int64()), pa.array([texts[i] for i in rows], pa.large_binary())], names=["doc_id", "text"])
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield unit, z.compress(sink.getvalue())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            found = list(blobs(ids, texts))
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["unit", "blob"])

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())):
                ids.append(d)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= PACK_BYTES:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "unit int, blob binary")


class Unit:
    """The tokens of a unit's documents: their hashes, n-gram keys, and where documents end."""

    def __init__(self, blobs: list[bytes]):
        self.ids, sizes, hashes = [], [], []
        z = zstandard.ZstdDecompressor()
        for blob in blobs:
            for batch in pa.ipc.open_stream(z.decompress(blob)):
                self.ids += batch.column("doc_id").to_pylist()
                for t in batch.column("text"):
                    words = t.as_py().lower().split()  # bytes: A-Z and the six ASCII blanks only
                    sizes.append(len(words) + 1)
                    hashes.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
                    hashes.append(END[None])
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        before = np.concatenate((START[None], h[:-1])) if len(h) else h
        before[self.begins] = START
        self.words = h & EVEN
        self.contexts = before & EVEN
        x = (before * TWO) ^ (h + (before >> np.uint64(31)))
        x *= np.uint64(0xFF51AFD7ED558CCD)
        self.pairs = (x ^ (x >> np.uint64(32))) | ONE
        self.classes = np.array([zlib.crc32(b"" if d is None else str(d).encode()) % CLASSES for d in self.ids], np.int64)
        starts = np.full(len(self.ids), START & EVEN)
        self.keys, where = np.unique(np.concatenate((self.words, self.pairs, starts)), return_inverse=True)
        self.at_words, self.at_pairs, self.at_starts = np.split(where, [len(h), 2 * len(h)])
        self.at_contexts = np.empty(len(h), np.int64)  # a context is the word before, or the start
        if len(h):
            self.at_contexts[1:] = self.at_words[:-1]
            self.at_contexts[self.begins] = self.at_starts

    def counts(self, classes: np.ndarray) -> np.ndarray:
        """How often each key stands in the unit's documents of these classes; the start counts as a word of each."""
        docs = np.isin(self.classes, classes)
        tokens = np.repeat(docs, self.sizes)
        n = len(self.keys)
        all_ = np.concatenate((self.at_words[tokens], self.at_pairs[tokens], self.at_starts[docs]))
        return np.bincount(all_, minlength=n).astype(np.uint32)


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes first: sorted or small numbers then compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def whole(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


TRAIN = np.array([c for c in range(CLASSES) if c != HELD_OUT])
ESTIMATE = np.array([c for c in range(CLASSES) if c not in (HELD_OUT, TUNING)])


def split_by(keys: np.ndarray, bits: int, skip: int = 0) -> tuple[np.ndarray, list[slice]]:
    """Sorted keys of 64 bits cut by `bits` bits after the first `skip`: the numbers that occur, and where."""
    if not bits or not len(keys):
        return np.zeros(min(1, len(keys)), np.int64), [slice(0, len(keys))][: len(keys)]
    number = (keys >> np.uint64(64 - skip - bits) & np.uint64((1 << bits) - 1)).astype(np.int64)
    names, first = np.unique(number, return_index=True)
    cut = [*first.tolist(), len(keys)]
    return names, [slice(x, y) for x, y in zip(cut, cut[1:])]


def added(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
    """The keys of each row, all distinct keys, the place of each row's keys among them, and the sums of both counts."""
    keys = [whole(k, np.uint64) for k in table.column("keys").to_pylist()]
    names, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(where, np.concatenate([whole(x, np.uint32) for x in table.column(c).to_pylist()]), len(names)) for c in ("full", "estimate")]
    return keys, names, where, sums


SENT = "source long, shard int, keys binary, full binary, estimate binary"
ANSWERED = "source long, shard int, full binary, estimate binary, n long, v long, n_estimate long, v_estimate long"


def sent(source: int, keys: np.ndarray, counts: list[np.ndarray], bits: int, skip: int, base: int) -> pa.Table:
    """A row for each shard that keys fall in: the shards of these bits, numbered from base."""
    names, parts = split_by(keys, bits, skip)
    cols = [pa.array([source] * len(parts), pa.int64()), pa.array(names + base, pa.int32())]
    cols += [pa.array([planes(x[p]) for p in parts], pa.binary()) for x in (keys, *(c.astype(np.uint32) for c in counts))]
    return pa.table(cols, names=["source", "shard", "keys", "full", "estimate"])


def answers(table: pa.Table) -> pa.Table:
    """The sums of a shard for each source that sent keys to it, in their order, and a row -1 with the shard's numbers."""
    keys, names, where, sums = added(table)
    sums = [x.astype(np.uint64) for x in sums]
    word = ((names & ONE) == 0) & (names != (START & EVEN))
    places = np.split(where, np.cumsum([len(k) for k in keys])[:-1])
    shard, n = table.column("shard")[0].as_py(), len(keys)
    stats = [[0] * n + [int(x[word].sum())] for x in sums], [[0] * n + [int((x[word] > 0).sum())] for x in sums]
    return pa.table(
        [
            pa.array([*table.column("source").to_pylist(), -1], pa.int64()), pa.array([shard] * (n + 1), pa.int32()),
            *(pa.array([*(planes(x[p]) for p in places), b""], pa.binary()) for x in sums),
            pa.array(stats[0][0]), pa.array(stats[1][0]), pa.array(stats[0][1]), pa.array(stats[1][1]),
        ],
        names=["source", "shard", "full", "estimate", "n", "v", "n_estimate", "v_estimate"],
    )


def of_units(answered: DataFrame) -> DataFrame:
    """unit is an int as in the units: a long would be dealt to other tasks."""
    return answered.withColumn("unit", F.col("source").cast("int")).drop("source")


def corpus_counts(units: DataFrame, shards_log2: int) -> DataFrame:
    """(unit, shard, full, estimate, n, v, n_estimate, v_estimate): for each unit and shard the corpus counts of the
    unit's keys, in their order; rows of unit -1 have the shard's numbers of word tokens and distinct words.

    Units and shards both grow with the corpus, and a row for each pair of them would grow with its square. So beyond
    1 << HOP_LOG2 shards there are two hops: a unit sends a row to each of 1 << first groups of shards, a node adds up
    what as many units sent to a group and passes it on to the group's shards, and answers go back the same way."""
    first = shards_log2 if shards_log2 <= HOP_LOG2 else -(-shards_log2 // 2)
    rest = shards_log2 - first

    def count(table: pa.Table) -> pa.Table:
        u = Unit(table.column("blob").to_pylist())
        return sent(table.column("unit")[0].as_py(), u.keys, [u.counts(TRAIN), u.counts(ESTIMATE)], first, 0, 0)

    keyed = units.groupBy("unit").applyInArrow(count, SENT)
    if not rest:
        return of_units(keyed.groupBy("shard").applyInArrow(answers, ANSWERED))

    def merge(table: pa.Table) -> pa.Table:
        _, names, _, sums = added(table)
        node, group = table.column("node")[0].as_py(), table.column("shard")[0].as_py()
        return sent(node << first | group, names, sums, rest, first, group << rest)

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows:
            keys, names, where, _ = added(left)
            counts = [unit_counts(right, c).astype(np.uint64) for c in ("full", "estimate")]
            places = np.split(where, np.cumsum([len(k) for k in keys])[:-1])
            rows = [(u, s, *(planes(c[p]) for c in counts), 0, 0, 0, 0) for u, s, p in zip(left.column("source").to_pylist(), left.column("shard").to_pylist(), places)]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
        names = ["source", "shard", "full", "estimate", "n", "v", "n_estimate", "v_estimate"]
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    keyed = written(keyed.withColumn("node", F.shiftright("source", first)), "sent")
    by_node = keyed.groupBy("node", "shard").applyInArrow(merge, SENT)
    done = written(by_node.groupBy("shard").applyInArrow(answers, ANSWERED), "answers")
    mine = done.filter("source >= 0").select((F.shiftright("source", first)).alias("node"), F.col("source").bitwiseAND((1 << first) - 1).cast("int").alias("group"), "shard", "full", "estimate")
    out = keyed.groupBy("node", "shard").cogroup(mine.groupBy("node", "group")).applyInArrow(back, ANSWERED)
    return of_units(out.unionByName(done.filter("source = -1")))


def unit_counts(counts: pa.Table, name: str) -> np.ndarray:
    """A unit's corpus counts in the order of its keys, from the answers of all shards."""
    rows = sorted(zip(counts.column("shard").to_pylist(), counts.column(name).to_pylist()))
    return np.concatenate([whole(x, np.uint64) for _, x in rows]).astype(np.float64) if rows else np.zeros(0)


def estimates(u: Unit, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: bucket of its context, and the estimates of orders 2 and 1."""
    context = c[u.at_contexts]
    bucket = np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)
    return bucket, c[u.at_pairs] / np.maximum(context, 1), c[u.at_words] / max(n, 1)


def tuning_cells(units: DataFrame, counts: DataFrame, n: int) -> list:
    """Cells (bucket, bins of both estimates) of all tokens of the tuning class: how many, and sums of the estimates."""

    def bins(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, 1 + np.floor(-np.log2(np.where(p > 0, p, 1)) * FINE), 0).astype(np.int64)

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["bucket", "q2", "q1", "n", "p2", "p1"]
        if not left.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.float64())] * 2, names=names)
        u = Unit(left.column("blob").to_pylist())
        bucket, p2, p1 = estimates(u, unit_counts(right, "estimate"), n)
        q2, q1 = bins(p2), bins(p1)
        key, where = np.unique((bucket << 32) | (q2 << 16) | q1, return_inverse=True)
        sums = [np.bincount(where, w, len(key)) for w in (None, p2, p1)]
        return pa.table([key >> 32, key >> 16 & 0xFFFF, key & 0xFFFF, sums[0].astype(np.int64), sums[1], sums[2]], names=names)

    found = units.groupBy("unit").cogroup(counts.groupBy("unit")).applyInArrow(cells, "bucket long, q2 long, q1 long, n long, p2 double, p1 double")
    return found.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).orderBy("bucket", "q2", "q1").collect()


def learn_weights(cells: list, p0: float) -> np.ndarray:
    """Weights (order 2, 1, 0) of each bucket, by expectation-maximisation. Buckets without cells get those of all."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not cells:
        return weights
    bucket, n = np.array([c.bucket for c in cells]), np.array([c.n for c in cells], float)
    p = np.array([(c.p2 / c.n, c.p1 / c.n, p0) for c in cells])

    def fit(rows: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = p[rows] * w
            share *= (n[rows] / share.sum(axis=1))[:, None]
            w = np.maximum(share.sum(axis=0) / n[rows].sum(), 1e-7)
            w /= w.sum()
        return w

    weights[:] = fit(np.arange(len(cells)))
    for b in np.unique(bucket):
        weights[b] = fit(np.flatnonzero(bucket == b))
    return weights


def scored(units: DataFrame, counts: DataFrame, n: int, v: int, weights: np.ndarray) -> DataFrame:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        u = Unit(left.column("blob").to_pylist())
        c = unit_counts(right, "full")
        bucket, p2, p1 = estimates(u, c, n)
        w = weights[bucket]
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1)
        own = c[u.at_words]
        add = lambda x: np.add.reduceat(x, u.begins)
        cols = [u.ids, u.classes == HELD_OUT, u.sizes, add((own > 0).astype(np.int64)), np.full(len(u.ids), n), add(np.log10((own + 1) / (n + v + 1))), add(np.log10(p))]
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds)], names=names)

    return units.groupBy("unit").cogroup(counts.groupBy("unit")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def interpolated_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, text)."""
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units = max(2, -(-total // UNIT_BYTES), min(256, total >> 18))
    tuning = max(1, units // CLASSES)
    shards_log2 = max(2, int(total // 6 // SHARD_KEYS).bit_length(), min(7, int(total >> 19).bit_length()))
    counts = written(corpus_counts(packed(docs, units, tuning), shards_log2), "counts")
    n, v, n_estimate, v_estimate = (x or 0 for x in counts.filter("unit = -1").agg(*(F.sum(c) for c in ("n", "v", "n_estimate", "v_estimate"))).first())
    answers = counts.filter("unit >= 0")
    tuned = docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % CLASSES == TUNING)
    cells = tuning_cells(packed(tuned, units, tuning), answers.filter(F.col("unit") >= units).select("unit", "shard", "estimate"), n_estimate)
    weights = learn_weights(cells, 1 / (v_estimate + 1))
    return scored(packed(docs, units, tuning), answers.select("unit", "shard", "full"), n, v, weights)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(documents(spark, sf_dir).select("doc_id", "text"))
