"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated scores.

Words here are runs of letters, of digits or of other signs, told apart by a hash in BUCKETS buckets, case included. Each
bucket has a sparse random index vector (NONZERO entries of +1 or -1 in DIMENSIONS). A word's vector is the sum of the index
vectors of its neighbours up to WINDOW words away, over all documents. Tasks add up one matrix each, of fixed size, and send
it in blocks, which are summed as they stream by, so neither vocabulary nor corpus size matters to memory. The sums are
integers: their order leaves no trace.

A document is pooled as the mean and the deviation of its words' unit vectors, the length of the mean, the logarithm of
the number of words, and the likeness of words to those up to WINDOW places on (the mean of their vectors' products and of
the products' eighth powers, which only equal words keep near 1). A network with one hidden layer learns from labelled documents whose crc32 class isn't held out:
MAX_LABELLED of them at most (a hash of the id draws them), so that the driver's share is bounded. A quarter of these
calibrates: one temperature, which divides the network's output, is chosen for the least log loss on it. Only texts enter a
score.

Defined results: null and empty texts have no words, and the score of an all-zero pool; texts are read whole, whatever their
length: beyond PIECE bytes in pieces cut at blanks, whose edges no window crosses; a null id is held out, as crc32 of an
empty text is 0; of rows with one id, the one with the least pool trains; of several labels of an id the greatest counts;
without labels, or with one class only, all scores are that class's share (one half without any); rows equal in text get
equal scores; an empty table gives an empty result; other columns than doc_id and text, whatever their names, are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.plans.ship import ship

from .common import documents, written

BUCKETS, DIMENSIONS, NONZERO, WINDOW = 1 << 15, 32, 4, 2
BLOCK = 256  # buckets a row of sums
PIECE, CHUNK = 1 << 20, 1 << 20
HELD_OUT, CALIBRATING, CLASSES = 0, 1, 5
MAX_LABELLED, HIDDEN, ROUNDS, RATE, DECAY, SEED, THRESHOLD = 20_000, 24, 400, 0.02, 1e-4, 13, 0.3
FAN = 256  # matrices that one stream adds up
POOL = 2 * DIMENSIONS + 2 + 2 * WINDOW

BLANKS = b" \t\n\x0b\x0c\r"
KIND = np.full(256, 3, np.uint8)
KIND[list(BLANKS)] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[list(range(48, 58))] = 2
#: An odd multiplier has an inverse modulo 2**64, so powers by place in the chunk can be taken back to a word's own.
MULTIPLIER = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Cuts bytes into words and hashes them, all at once."""

    def __init__(self):
        self.up, self.down = (powers(b, CHUNK + PIECE + 2) for b in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where words start, and their buckets."""
        data = np.frombuffer(raw, np.uint8)
        kinds = KIND[data]
        starts = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1]))) if len(data) else np.zeros(0, int)
        sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], starts) if len(starts) else np.zeros(0, np.uint64)
        word = kinds[starts] > 0
        starts, h = starts[word], sums[word] * self.down[starts[word]]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return starts, (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def pieces(text: bytes) -> list[bytes]:
    """A text in pieces of PIECE bytes at most, cut behind a blank where there is one."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(bytes([b]), at, at + PIECE) for b in BLANKS) + 1
        cut = cut if cut > at else at + PIECE
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def chunks(texts: pa.Array):
    """(row of each piece, pieces) of about CHUNK bytes; every piece depends on its own text only."""
    rows, found, size = [], [], 0
    for row, text in enumerate(texts):
        for piece in pieces(text.as_py() or b""):
            rows.append(row)
            found.append(piece)
            size += len(piece) + 1
            if size > CHUNK:
                yield np.array(rows), found
                rows, found, size = [], [], 0
    if rows:
        yield np.array(rows), found


def cut(words: Words, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words of pieces, and the piece that each is in."""
    begin = np.concatenate(([0], np.cumsum([len(p) + 1 for p in found])[:-1]))
    starts, buckets = words(b"\n".join(found))
    return buckets, np.searchsorted(begin, starts, "right") - 1


def context_sums(docs: DataFrame) -> np.ndarray:
    """The word vectors, BUCKETS by DIMENSIONS, over docs(text)."""

    def add(batches):
        words, (place, sign) = Words(), index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            for _, found in chunks(batch.column("text").cast(pa.binary())):
                b, piece = cut(words, found)
                keys, weights = [], []
                for d in range(1, WINDOW + 1):
                    near = piece[d:] == piece[:-d]
                    one, two = b[:-d][near], b[d:][near]
                    keys += [one[:, None] * DIMENSIONS + place[two], two[:, None] * DIMENSIONS + place[one]]
                    weights += [sign[two], sign[one]]
                total += np.bincount(np.concatenate(keys).ravel(), np.concatenate(weights).ravel(), len(total))
        rows = total.astype(np.int64).reshape(-1, BLOCK * DIMENSIONS)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows[i].tobytes() for i in some], pa.binary())], names=["block", "sums"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, s in zip(batch.column("block").to_pylist(), batch.column("sums")):
                total[i] = total.get(i, 0) + np.frombuffer(s.as_py(), np.int64)
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["block", "sums"])

    ship(docs.sparkSession)
    schema, blocks = "block int, sums binary", BUCKETS // BLOCK
    sums = written(docs.select("text").mapInArrow(add, schema), "contexts")
    fan = math.ceil(sums.count() / blocks / FAN)
    if fan > 1:
        salted = sums.withColumn("_salt", F.pmod(F.xxhash64("sums"), F.lit(fan)))
        sums = salted.repartition(blocks * fan, "block", "_salt").drop("_salt").mapInArrow(merge, schema)
    out = np.zeros((blocks, BLOCK * DIMENSIONS), np.int64)
    for r in sums.repartition(blocks, "block").mapInArrow(merge, schema).collect():  # `blocks` rows
        out[r.block] += np.frombuffer(r.sums, np.int64)
    return out.reshape(BUCKETS, DIMENSIONS)


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    """Of length 1, about the mean of all; zeros where a bucket has no neighbours."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.divide(sums, norm, out=np.zeros(sums.shape), where=norm > 0).astype(np.float32)


def pool(words: Words, vectors: np.ndarray, texts: pa.Array) -> np.ndarray:
    """A row of POOL numbers for each text."""
    n, total, squares, like = (np.zeros((len(texts), k)) for k in (1, DIMENSIONS, DIMENSIONS, 2 * WINDOW))
    for rows, found in chunks(texts):
        b, piece = cut(words, found)
        if not len(b):
            continue
        first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
        v, at = vectors[b], rows[piece[first]]
        np.add.at(n[:, 0], at, np.diff(np.append(first, len(b))))
        np.add.at(total, at, np.add.reduceat(v, first, axis=0, dtype=np.float64))
        np.add.at(squares, at, np.add.reduceat(v * v, first, axis=0, dtype=np.float64))
        for d in range(1, WINDOW + 1):
            near = piece[d:] == piece[:-d]
            product = np.einsum("ij,ij->i", v[:-d], v[d:])[near]
            for k, x in enumerate((product, product**8)):
                np.add.at(like[:, 2 * d - 2 + k], rows, np.bincount(piece[d:][near], x, len(rows)))
    many = np.maximum(n, 1)
    mean = total / many
    deviation = np.sqrt(np.maximum(squares / many - mean**2, 0))
    return np.column_stack((mean, deviation, np.linalg.norm(mean, axis=1), np.log1p(n), like / many))


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """docs(..., text) with pool, an array, in place of text."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        words = Words()
        for batch in batches:
            x = pool(words, vectors, batch.column("text").cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(list(x), pa.list_(pa.float64()))], names=[*kept, "pool"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", pool array<double>")


@dataclass
class Network:
    """Standardised inputs, HIDDEN tanh units, one output over a temperature. Without layers, a constant score."""

    share: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature) if self.layers else np.full(len(x), self.share)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, calibrating: np.ndarray) -> Network:
    """Adam over all rows that don't calibrate; the temperature from those that do, or 1 if they are none."""
    share = float(y.mean()) if len(y) else 0.5
    tx, ty = x[~calibrating], y[~calibrating]
    if not 0 < ty.sum() < len(ty):
        return Network(share)
    mean, scale = tx.mean(axis=0), np.maximum(tx.std(axis=0), 1e-6)
    z = (tx - mean) / scale
    rng = np.random.default_rng(SEED)
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, ROUNDS + 1):
        h = np.tanh(z @ p[0] + p[1])
        e = (sigmoid(h @ p[2] + p[3]) - ty) / len(ty)
        back = np.outer(e, p[2]) * (1 - h**2)
        for i, g in enumerate((z.T @ back + DECAY * p[0], back.sum(axis=0), h.T @ e + DECAY * p[2], e.sum(keepdims=True))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g**2
            p[i] = p[i] - RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(share, mean, scale, tuple(p))
    if calibrating.any():
        net.temperature = temperature(net.logits(x[calibrating]), y[calibrating])
    return net


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Of least log loss between e**-3 and e**3, by golden section on its logarithm (the loss has one minimum in 1/T). The
    targets are those of Platt's rule, so that scores stay off 0 and 1 where the classes part cleanly."""
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if log_loss(z / math.exp(c), y) <= log_loss(z / math.exp(d), y) else (c, b)
    return math.exp((a + b) / 2)


def crc_class(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % CLASSES


def labelled(labels: DataFrame, most: int) -> DataFrame:
    """(_id, y) of about `most` ids at most that may train; a hash draws them."""
    x = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_class("doc_id") != HELD_OUT))
    x = written(x.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("double").alias("y")), "labels")
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 30))
    return x.filter(draw < (1 << 30) * min(1.0, most / max(1, x.count())))


def trained(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = MAX_LABELLED) -> Network:
    sample = F.broadcast(labelled(labels, most))  # `most` ids and labels
    rows = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id")).select("_id", "y", "text")
    rows = pooled(rows, vectors).groupBy("_id").agg(F.min("y").alias("y"), F.min("pool").alias("pool"))
    rows = rows.withColumn("calibrating", crc_class("_id") == CALIBRATING).orderBy("_id").collect()  # at most `most`
    x = np.array([r["pool"] for r in rows]).reshape(-1, POOL)
    return fit(x, np.array([r.y for r in rows]), np.array([r.calibrating for r in rows], bool))


def scored(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs(doc_id, text), learning from labels(doc_id, quality)."""
    docs = docs.select("doc_id", "text")
    vectors = unit_vectors(context_sums(docs))
    net = trained(docs, labels, vectors, most)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        words = Words()
        for batch in batches:
            s = net.scores(pool(words, vectors, batch.column("text").cast(pa.binary())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    out = crc_class("doc_id") == HELD_OUT
    return docs.withColumn("held_out", out).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
