"""Fill-in-middle transformation, by bit-parallel boolean operations on big integers.

A text's UTF-8 bytes become masks with a bit a byte: bytes.translate() tells which bytes are of a class (lead bytes of two,
three and four bytes; blanks; line feeds), and shifted boolean operations on the masks mark where units start: code points
where no lead byte reaches, words where a byte that isn't blank follows one that is, lines after line feeds. A mask's
bit_count() is the number of units, and the byte where a unit starts is found by halving: the half that holds the ranked bit
is kept, so the work is linear in the text.

The cuts, the form (plain, psm or spm) and their chances come from the SHA-256 of seed and id, so that reruns agree; the texts'
order and partitions don't matter. `restored` gives the exact texts back from output and form alone: texts that hold a
sentinel stay plain, and no sentinel can arise across a joint, as none ends as another begins.

Defined results: null and empty texts are plain, with no units; texts are cut whole, whatever their length; a null id counts
as an empty string; rows equal in id and text get equal results; an empty table gives an empty result; other columns than
doc_id and text, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.plans.ship import ship

from .common import documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, TRANSFORMED, SPM = 1, 90, 20
UNITS = ("char", "word", "line")
BLANK = b" \t\n\x0b\x0c\r"


def members(which) -> bytes:
    """A table for bytes.translate(): the digit 1 for the bytes of a class, 0 for others."""
    return bytes(48 + (b in which) for b in range(256))


#: Lead bytes of sequences of two bytes or more, of three or more, and of four.
LEADS = members(range(0xC0, 0x100)), members(range(0xE0, 0x100)), members(range(0xF0, 0x100))
NOT_BLANK, FEEDS = members(set(range(256)) - set(BLANK)), members(b"\n")


def class_mask(raw: bytes, table: bytes) -> int:
    """Bit i is set if byte i is of the class. (A power of two as base makes int() linear.)"""
    return int(raw.translate(table)[::-1], 2)


def unit_starts(raw: bytes, unit: str = "char") -> int:
    """A mask of the bytes where units start; units cover the text. The first word has the blanks before it, the others
    those after them."""
    if not raw:
        return 0
    full = (1 << len(raw)) - 1
    if unit == "char":
        two, three, four = (class_mask(raw, t) for t in LEADS)
        return full ^ (full & (two << 1 | three << 2 | four << 3))
    if unit == "word":
        word = class_mask(raw, NOT_BLANK)
        starts = word & ~(word << 1)
        return (starts & (starts - 1)) | 1  # the first start moves to the text's
    if unit == "line":
        return (full & (class_mask(raw, FEEDS) << 1)) | 1
    raise ValueError(f"units are {', '.join(UNITS)}")


def ranked(mask: int, k: int, width: int) -> int:
    """The place of the k-th set bit, from 0, of a mask of width bits."""
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        n = low.bit_count()
        if k < n:
            mask, width = low, half
        else:
            mask, width, k, at = mask >> half, width - half, k - n, at + half
    return at


def draws(doc_id, seed: int) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def moved(doc_id, raw: bytes, unit: str = "char", seed: int = SEED, transformed: int = TRANSFORMED, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """(n units, form, code points of the prefix and of the middle, output) of a text."""
    starts = unit_starts(raw, unit)
    n = starts.bit_count()
    h = draws(doc_id, seed)
    if not raw or any(s.encode() in raw for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= transformed:
        return n, "plain", None, None, raw
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = (ranked(starts, k, len(raw)) if k < n else len(raw) for k in (a, b))
    if unit != "char":
        points = unit_starts(raw)
        below = lambda at: (points & ((1 << at) - 1)).bit_count()
        a, b = below(i), below(j)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, b"".join((s, raw[j:], p, raw[:i], m, raw[i:j]))
    return n, "psm", a, b - a, b"".join((p, raw[:i], s, raw[j:], m, raw[i:j]))


def put_back(form: str, out: bytes) -> bytes:
    """The text of an output."""
    if form == "plain":
        return out
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    first, second = (p, s) if form == "psm" else (s, p)
    one, rest = out[len(first) :].split(second, 1)
    two, middle = rest.split(m, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def filled_in(docs: DataFrame, unit: str = "char", seed: int = SEED, transformed: int = TRANSFORMED, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of docs(doc_id, text). Of 100 documents `transformed` are
    moved, and of 100 of these `spm` have the suffix first."""
    if unit not in UNITS:
        raise ValueError(f"units are {', '.join(UNITS)}")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rows = [moved(d.as_py(), t.as_py() or b"", unit, seed, transformed, spm) for d, t in zip(batch.column("doc_id"), texts)]
            n, form, prefix, middle, out = zip(*rows) if rows else [()] * 5
            arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(moved_docs: DataFrame) -> DataFrame:
    """moved_docs(form, output, ...) with the texts that the outputs were made of."""
    names, kinds = moved_docs.columns, dict(moved_docs.dtypes)

    def run(batches):
        for batch in batches:
            outs = batch.column("output").cast(pa.binary())
            texts = [put_back(f.as_py(), o.as_py()) for f, o in zip(batch.column("form"), outs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, "restored"])

    return moved_docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", restored string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = restored(filled_in(documents(spark, sf_dir)))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS k1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS k2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(k1, k2) AS a, greatest(k1, k2) AS b FROM k),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
