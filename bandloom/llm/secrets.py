"""Secret scanning: fixed patterns, and dictionary-primed zstandard novelty.

The patterns give spans of the kinds assign, access and hex. Novelty looks at tokens in sensitive context: a token of
MIN_TOKEN or more characters that starts at most CONTEXT characters after a sensitive word. Its marginal size is what
it adds to the compressed context, with a compressor primed by a dictionary: common code, and the most frequent identifier
words of the corpus (LEARNED of them, counted in all documents; secrets are too rare to get in). A token is taken apart
first: words of either dictionary and pieces that are built like words are plain, as names, paths and versions are made of
them. A token of which too little is left (LEFT characters, and LEFT_SHARE of the letters or a number of five digits, are the
least) is explained; one of which more is left is a span of the kind `novel` if the dictionary and the surroundings can't
explain it either (MIN_NOVELTY compressed bits a character or more). Its surroundings are AROUND characters on both sides,
without other copies of it: a secret that stands twice doesn't explain itself. Short inputs leave letters uncoded, so tokens
of plain words also look new; a token must hold a digit or change from small to capital letters to be reported. Pattern spans
always stay; novelty only adds spans that overlap none.

Spans are kind:start:end in code points, end exclusive, by start, then by kind in the order of KINDS.

Defined results: null and empty texts have no spans; whole texts are scanned, whatever their length, in time that grows
with it, also where sensitive words or pattern spans fill the text; spans that start together are told apart by kind;
repeated rows give repeated results; an empty table gives an empty result; other columns than doc_id and text, whatever
their names, are left out.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.plans.ship import ship

from .common import documents

KINDS = ("assign", "access", "hex", "novel")
#: The patterns of the contract, with their least lengths.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS = 8, 16

CONTEXT, AROUND, MIN_TOKEN, MIN_NOVELTY = 48, 1024, 16, 5.2
SENSITIVE = re.compile(r"(?ai:passphrase|passw|secret|token|bearer|credential|private|signature|api.?key|access.?key|auth)")
#: Where a token starts, and how far it goes.
START = re.compile(r"(?<![A-Za-z0-9+/_~$!-])[A-Za-z0-9+/_~$!-]")
REST = re.compile(r"[A-Za-z0-9+/_.=~$!-]+")
#: A token's pieces: words (with a capital or without, or all capitals), numbers, and signs.
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^A-Za-z0-9]+")
RUN = re.compile("[A-Za-z0-9]+")
TURN = re.compile("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
VOWEL, CLUSTER = re.compile("[aeiouy]"), re.compile("[^aeiouy]{5}")
LEARNED, LEARN_TIMES, LEFT, LEFT_SHARE, TURNS = 4096, 5, 4, 0.2, 3
KEYLIKE = re.compile(r"[0-9]|[a-z][A-Z]")
#: Parts of a token that may stand elsewhere without the rest: between dots and equals signs.
PIECE = re.compile(r"[A-Za-z0-9+/_~$!-]{%d,}" % MIN_TOKEN)
#: What common source code and configuration look like; the compressor knows these bytes beforehand.
CODE = """import os sys json re time datetime collections typing pathlib subprocess logging argparse functools itertools
public static void private protected class interface extends implements package return const let var function async await
if else for while switch case break continue default try catch finally raise except lambda yield global self this null None
true false True False string int float double boolean char long list dict map set array vector object struct enum union
getElementById addEventListener innerHTML document window console.log module.exports require export from __init__ __name__
username user_name password passwd secret token api_key apikey access_key client_id client_secret refresh_token bearer
Authorization: Bearer Content-Type: application/json charset=utf-8 User-Agent Mozilla/5.0 https://www.example.com/index.html
http://localhost:8080/api/v1/users/ /usr/local/bin/python /home/user/.ssh/id_rsa.pub /etc/ssl/certs .com .org .net .json .yaml
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0000000000000000 xxxxxxxxxxxxxxxx ****************
changeme placeholder your_api_key_here INSERT_TOKEN_HERE example_secret test_password dummy_value default_configuration
SELECT FROM WHERE INSERT INTO VALUES UPDATE DELETE CREATE TABLE PRIMARY KEY FOREIGN REFERENCES INDEX UNIQUE NOT NULL
environment variable configuration parameter authentication authorization certificate fingerprint description implementation
initialize connection database transaction response request handler controller service repository component application
getUserInformation setConfigurationValue create_session_manager process_request_data validate_input_parameters
""".encode()
KNOWN = frozenset(w.lower() for w in re.findall("[A-Z]?[a-z]+|[A-Z]+(?![a-z])", CODE.decode()) if len(w) > 1)


def compressor(learned: Sequence[str] = ()) -> zstandard.ZstdCompressor:
    content = " ".join(reversed(learned)).encode() + b"\n" + CODE  # what comes last is cheapest to refer to
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)


def learned_words(docs: DataFrame) -> list[str]:
    """The most frequent identifier words of docs(text), most frequent first. A task counts its words before they are sent."""
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z]?[a-z]{2,15}"), F.lit(0))).alias("w"))
    often = found.groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") >= LEARN_TIMES)
    return [r.w for r in often.orderBy(F.desc("n"), "w").limit(LEARNED).collect()]


def remainder(token: str, known: frozenset[str]) -> str:
    """A token without its plain words; empty if less than LEFT_SHARE of its letters are left and no long number is. Plain are
    words of three letters or more that are known, and pieces built like words: four letters or more with a vowel and
    without five consonants in a row. Where letters and digits take turns (TURNS times without a sign between them),
    nothing is plain."""
    if any(len(TURN.findall(run)) >= TURNS for run in RUN.findall(token)):
        return token
    left, letters, kept = [], 0, 0
    for piece in PIECES.findall(token):
        low = piece.lower()
        if not low.isalpha():
            left.append(piece if len(piece) > 4 or low.isdigit() else "")
            continue
        letters += len(low)
        if (len(low) > 2 and low in known) or (4 <= len(low) <= 16 and VOWEL.search(low) and not CLUSTER.search(low)):
            continue
        kept += len(low)
        left.append(piece)
    long = any(len(p) > 4 and p.isdigit() for p in left)
    return "".join(left) if long or kept >= LEFT_SHARE * letters else ""


def novelty(z: zstandard.ZstdCompressor, context: str, token: str) -> float:
    """Compressed bits that a character of token adds to its context."""
    base = context.encode("utf-8", "replace")
    return 8 * (len(z.compress(base + token.encode())) - len(z.compress(base))) / len(token)


def surroundings(text: str, start: int, end: int) -> str:
    """AROUND characters on both sides of a token, with blanks for its other copies, so that they can't explain it."""
    token = text[start:end]
    sides = text[max(0, start - AROUND - len(token)) : start], text[end : end + AROUND + len(token)]  # whole copies at the edges
    pieces = set(PIECE.findall(token))
    blank = lambda m: " " * len(m[0]) if m[0] in pieces else m[0]
    sides = [PIECE.sub(blank, s.replace(token, " " * len(token))) for s in sides]
    return sides[0][-AROUND:] + sides[1][:AROUND]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end), unsorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order."""
    starts, ends = [], []
    for a, _, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def novel_spans(text: str, base: list[tuple[int, int, int]], z: zstandard.ZstdCompressor, known: frozenset[str] = KNOWN) -> list[tuple[int, int, int]]:
    """Tokens are looked at once each, and a token's end is looked for only from its start, so time grows with the text."""
    found, done = [], 0
    starts, ends = merged(base)
    for m in SENSITIVE.finditer(text):
        for s in START.finditer(text, max(m.end(), done), min(len(text), m.end() + CONTEXT + 1)):
            start = s.start()
            if start < done:
                continue
            end = done = REST.match(text, start).end()
            at = bisect.bisect_right(ends, start)  # the first pattern span that ends after the token's start
            if end - start < MIN_TOKEN or (at < len(starts) and starts[at] < end) or not KEYLIKE.search(text, start, end):
                continue
            left = remainder(text[start:end], known)
            if len(left) < LEFT:
                continue
            if novelty(z, surroundings(text, start, end), text[start:end]) >= MIN_NOVELTY:
                found.append((start, 3, end))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans)."""

    learned = learned_words(docs.select("text"))
    known = KNOWN | set(learned)

    def run(batches):
        z = compressor(learned)
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                new = novel_spans(text, base, z, known)
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*counts, len(new), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + new)))
            cols = list(zip(*rows)) or [()] * 6
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
