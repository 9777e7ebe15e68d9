"""SentencePiece encoding and decoding with a vocabulary file: an Aho-Corasick automaton over the pieces drives a
single-pass Viterbi search.

The automaton reads a text once. At each position it reports, along its output links, all pieces that end there, and
each relaxes the best score of the position; the best path is read back from the end. Characters that no piece covers
become byte pieces, at a cost below that of any piece. Blanks are written as the mark U+2581 and a dummy blank is put in
front, as the vocabulary expects; the mark itself, where a text has it, is spelled in bytes, so decoding gives every
text back exactly.

No piece reaches past a place where a blank follows another character, or across a newline, so the best path of a text
is the best paths of its segments. This is proven for a vocabulary when it is loaded (Pieces.cuts), else texts are
searched whole. Segments repeat, so their paths are kept, in a table that is emptied when it holds KEPT segments.

A piece costs its score in the file; ties go to the longer piece. (In a BPE vocabulary scores are merge ranks, so this
is the best-scored segmentation and not the order of merges.)

Defined results: null and empty texts have no ids and decode to the empty text; very long texts are encoded whole;
repeated rows give repeated results; an empty table gives an empty result; extra columns pass by.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType

from bandloom.plans.ship import ship

from .common import documents

MARK, KEPT, CHUNK = "▁", 600_000, 1 << 20
SEGMENT, WHOLE = re.compile(r" *[^ \n▁]+|\n|▁| +"), re.compile(r"[^▁]+|▁")
_loaded: dict[str, Pieces] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces(dict):
    """A vocabulary, and as a dictionary the table of segments: segment to its place in the table."""

    def __init__(self, model: str):
        import sentencepiece

        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.automaton = ahocorasick.Automaton()
        self.byte_ids, texts, least, self.cuts = [0] * 256, [], 0.0, True
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                texts.append(b"")
            else:
                score = sp.get_score(i)
                least = min(least, score)
                self.automaton.add_word(piece, (len(piece), score, i))
                texts.append(piece.replace(MARK, " ").encode())
                self.cuts &= not re.search(f"[^{MARK}]{MARK}|\n", piece)
        self.automaton.make_automaton()
        self.unknown = least - 10.0
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.length = np.array([len(b) for b in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.paths, self.ends = array("i"), array("q", [0])

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path over text, in which blanks are marks."""
        n = len(text)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        done, unknown = 0, self.unknown
        for last, found in self.automaton.iter(text):
            while done <= last:  # open the positions up to this one: by a byte spelling of one character
                done += 1
                best[done] = best[done - 1] + unknown
            value = best[done - found[0]] + found[1]
            if value > best[done]:
                best[done], back[done] = value, found
        ids: list[int] = []
        at = n
        while at:
            if (found := back[at]) is None:
                at -= 1
                ids.extend(self.byte_ids[b] for b in reversed((" " if text[at] == MARK else text[at]).encode()))
            else:
                ids.append(found[2])
                at -= found[0]
        ids.reverse()
        return ids

    def __missing__(self, segment: str) -> int:
        ids = [self.byte_ids[b] for b in MARK.encode()] if segment == MARK else self.viterbi(segment.replace(" ", MARK))
        place = self[segment] = len(self)
        self.paths.extend(ids)
        self.ends.append(len(self.paths))
        return place

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and the offsets of the texts in them."""
        if len(self) > KEPT:
            self.clear()
            self.paths, self.ends = array("i"), array("q", [0])
        split = SEGMENT if self.cuts else WHOLE
        counts: list[int] = []

        def places() -> Iterator[int]:
            for t in texts:
                if len(t) > 4 * CHUNK:
                    n = 0
                    for n, m in enumerate(chain(split.finditer(" " + t)), 1):  # noqa: B007
                        yield self[m.group()]
                    counts.append(n)
                else:
                    found = split.findall(" " + t) if t else []
                    counts.append(len(found))
                    yield from map(self.__getitem__, found)

        at = np.fromiter(places(), np.int64)
        ends = np.frombuffer(self.ends, np.int64).copy()
        starts, lengths = ends[at], ends[at + 1] - ends[at]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        ids = np.frombuffer(self.paths, np.int32)[np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)] if len(at) else np.zeros(0, np.int32)
        return ids, total[np.concatenate((np.zeros(1, np.int64), np.cumsum(np.array(counts, np.int64))))]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each text. The first byte is the dummy blank's."""
        lengths = self.length[ids]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        out = self.flat[np.arange(total[-1]) + np.repeat(self.start[ids] - total[:-1], lengths)].tobytes()
        cut = total[offsets].tolist()
        return [out[a + 1 : b] for a, b in zip(cut, cut[1:])]


def pieces(model: str | None) -> Pieces:
    """The vocabulary of a file, loaded once for each Python worker."""
    name = model or default_model()
    if name not in _loaded:
        _loaded[name] = Pieces(name)
    return _loaded[name]


def chunks(batches, name: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches cut to about CHUNK characters of the column, with its values."""
    for b in batches:
        values = b.column(name).to_pylist()
        at = size = 0
        for i, v in enumerate(values, 1):
            size += len(v or "")
            if size >= CHUNK or i == len(values):
                yield b.slice(at, i - at), values[at:i]
                at, size = i, 0


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with ids (array of int) in place of text."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("text", "ids")]

    def run(batches):
        for b, texts in chunks(batches, "text"):
            ids, offsets = pieces(model).encode([t or "" for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), lists], names=[*kept, "ids"])

    schema = docs.select(*kept).schema.add("ids", ArrayType(IntegerType()))
    return docs.select(*kept, "text").mapInArrow(run, schema)


def decoded(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """tokens with text in place of ids; null ids decode to the empty text."""
    ship(tokens.sparkSession)
    kept = [c for c in tokens.columns if c not in ("text", "ids")]

    def run(batches):
        for b, lists in chunks(batches, "ids"):
            offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x or ()) for x in lists]))).astype(np.int64)
            ids = np.fromiter(chain.from_iterable(x or () for x in lists), np.int32)
            texts = [x.decode("utf-8", "replace") for x in pieces(model).decode(ids, offsets)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    schema = tokens.select(*kept).schema.add("text", StringType())
    return tokens.select(*kept, "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_ids, n_byte_ids, ids_crc32, decoded_crc32, exact): digests of the ids and of the text decoded from
    them, and whether that is the document's own text."""

    def run(batches):
        for b, texts in chunks(batches, "text"):
            p = pieces(model)
            ids, offsets = p.encode([t or "" for t in texts])
            back = p.decode(ids, offsets)
            spelled = np.zeros(len(p.length), bool)
            spelled[p.byte_ids] = True
            spelled = np.concatenate((np.zeros(1, np.int64), np.cumsum(spelled[ids])))[offsets]
            cut, raw = offsets.tolist(), ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cut, cut[1:])]
            exact = [(t or "").encode() == x for t, x in zip(texts, back)]
            cols = [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(spelled)), pa.array(crc, pa.int64()), pa.array(list(map(zlib.crc32, back)), pa.int64()), pa.array(exact, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded_crc32", "exact"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids long, n_byte_ids long, ids_crc32 long, decoded_crc32 long, exact boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
