"""Quality rules from cross-document line frequency, in DataFrame operations only.

Lines are normalised (lower case, blanks collapsed) and hashed. A line is removed from a host's documents when it stands
in more than MAX_DOCS distinct documents of the host. Equal texts are one document, and near-copies (texts whose five-word
passages are 0.8 similar) count once, too, however many there are of each document. A document is depleted, and rejected,
when the removed lines hold more than MAX_REMOVED of its words; base rules reject short documents and those of repeated
word windows. `source` is the host.

Near-copies are told without comparing texts. Versions of a line that differ in a few words are of one kind: each line has
six hashes of its passages, and lines that share the most common ones are of one kind. A text is known by its rarest
kinds of lines that hold a ninth of its words (two texts that differ in a ninth each are 0.8 similar): kinds in MAX_DOCS
texts or fewer are equally rare, and the least stands for them; where they hold too little, the frequent kind that reaches
the ninth stands for the text (for a line of that kind itself, its neighbour). Near-copies share all but a few kinds, and so
are known by one or a few. What a line counts are the things its texts are known by. The SQL beside the query states the
definition, with similarities worked out in full.

Lines are counted by (host, hash) with map-side sums, so no hot line meets in one task. Rows and removals are joined by
host and text key: metrics without the text in the query; with the text in the pipeline stage, where the removals are too
many to be sent along.

Defined results: null texts count as empty, have no words and fail the base rules; texts are taken whole, whatever their
length, in time that grows with their lines (times the logarithm, as they are sorted); a null host is one host; blank lines are never counted or removed; lines that are equally rare are told apart by
their hashes; repeated rows count as one document and share one decision; an empty table gives an empty result; extra
columns, whatever their names, pass by, and give way where they have the name of a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_CHARS, documents, set_aside, text_or_empty, words_of, written

MAX_DOCS, MAX_REMOVED = 10, 0.5
#: Two texts that differ in a ninth of their words each are 0.8 similar.
NINTH = 9
#: Words that tell a passage of a line.
WINDOW = 4
MIN_WORDS, MAX_REPEATED = 50, 0.5
SYMBOLS = "[#*$%&|<>]"


def with_text_key(docs: DataFrame) -> DataFrame:
    """docs with the 128 bits by which texts are told apart."""
    text = text_or_empty()
    return docs.withColumns({"_h1": F.xxhash64(text), "_h2": F.xxhash64(F.lit("second"), text)})


def line_hash(words: Column) -> Column:
    """60 bits of the MD5 of a normalised line, given its words."""
    return F.conv(F.substring(F.md5(F.array_join(words, " ")), 1, 15), 16, 10).cast("long")


def base_metrics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long), and _row, a row number. Its use
    keeps a filter on the metrics from being pushed below them, where the lambdas would hold them once an element."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANK_CHARS)) != "")
    x = docs.withColumns({"_words": words_of(text), "_lines": lines})
    after = lambda i, n: F.get("_words", i + n)
    windows = F.transform("_words", lambda w, i: F.xxhash64(w, after(i, 1), after(i, 2)))  # within one text 64 bits tell windows apart
    x = x.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.when(F.size("_words") > 3, F.slice(windows, F.lit(1), F.greatest(F.size("_words") - 2, F.lit(1)))),
    }).drop("_lines")
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    x = x.withColumn("_sorted", F.when(twice, F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    near = lambda p, j, n: F.coalesce(p["w"] == F.get("_sorted", j + n)["w"], F.lit(False))
    starts = F.transform("_sorted", lambda p, j: F.when(near(p, j, -1) | near(p, j, 1), F.array(p["i"], p["i"] + 1, p["i"] + 2)).otherwise(F.array().cast("array<int>")))
    covered = F.coalesce(F.size(F.array_distinct(F.flatten(starts))), F.lit(0))
    covered = F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(covered)
    return x.withColumns({"n_repeat_words": covered.cast("long"), "_row": F.monotonically_increasing_id()}).drop("_words", "_windows", "_sorted")


def host_key(host: str) -> Column:
    """The host as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def sketches(words: Column) -> Column:
    """Six hashes of WINDOW-word windows of a line: those next to six points of the hash space. Lines that differ in a word
    share most of them. A shorter line is one window."""
    window = lambda i: F.xxhash64(*(F.coalesce(F.get(words, i + k), F.lit("")) for k in range(WINDOW)))
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - WINDOW, F.lit(0))), window)
    turned = lambda hs, point: F.transform(hs, lambda h: h.bitwiseXOR(F.lit(point)))
    # lambdas name what they use more than once: an expression would be worked out again at each use
    each = F.transform(F.array(hashes), lambda hs: F.array(hs, turned(hs, 1 << 61), turned(hs, 1 << 62)))
    return F.flatten(F.transform(F.flatten(each), lambda hs: F.array(F.array_min(hs), F.array_max(hs))))


def host_lines(docs: DataFrame, host: str) -> DataFrame:
    """A row for each line with a word: host, text key, pos (among all lines of the text), line (its hash), words, own (the
    words where the line stands first in its text, 0 where it repeats) and sketch. Lines are sorted once, so that repeats
    follow each other."""
    lines = F.transform(F.split(F.lower(text_or_empty()), "\n", -1), words_of)
    each = F.transform("_lines", lambda ws, i: F.struct(line_hash(ws).alias("line"), i.alias("pos"), ws.alias("ws")))
    x = with_text_key(docs).select(host_key(host).alias("host"), "_h1", "_h2", lines.alias("_lines"))
    each = F.filter(each, lambda s: F.size(s["ws"]) > 0)
    each = F.transform(each, lambda s: F.struct(s["line"], s["pos"], F.size(s["ws"]).alias("words"), sketches(s["ws"]).alias("sketch")))
    x = x.select("host", "_h1", "_h2", F.array_sort(each).alias("_each"))
    again = lambda s, j: (j > 0) & (F.get("_each", j - 1)["line"] == s["line"])
    full = F.transform("_each", lambda s, j: F.struct(s["pos"], s["line"], s["words"], F.when(again(s, j), 0).otherwise(s["words"]).alias("own"), s["sketch"]))
    return x.select("host", "_h1", "_h2", F.inline(full))


TEXT = ["host", "_h1", "_h2"]


def kinds_of_lines(held: DataFrame) -> DataFrame:
    """(host, line, kind, n) of the lines of held(host, text key, line, sketch): kind stands for all versions of a line that
    differ in a few words, n for how many texts hold one. Of a line's sketches the one shared with the most texts counts;
    among the lines that share this one, the line in the most texts gives its own to all."""
    each = held.groupBy("host", "line").agg(F.count("*").alias("_n"), F.min("sketch").alias("sketch"))
    each = written(each.select("host", "line", "_n", F.posexplode("sketch").alias("_s", "_v")), "sketches")
    texts = each.groupBy("host", "_s", "_v").agg(F.sum("_n").alias("n"))
    best = each.join(texts, ["host", "_s", "_v"]).groupBy("host", "line").agg(F.max(F.struct("n", "_v", "_s")).alias("_best"), F.max("_n").alias("_n"))
    best = written(best.select("host", "line", "_n", "_best.*"), "best")
    lead = each.select("host", "line", "_s", "_v").join(best.select("host", "line", "_n", "n", F.col("_v").alias("kind")), ["host", "line"])
    lead = lead.groupBy("host", "_s", "_v").agg(F.max(F.struct("_n", "n", "kind")).alias("_lead"))
    return best.select("host", "line", "_s", "_v").join(lead, ["host", "_s", "_v"]).select("host", "line", "_lead.kind", "_lead.n")


def known_lines(held: DataFrame, often: DataFrame) -> DataFrame:
    """(host, line, known_by, n): for the lines that stand often, by what their texts are known, and how many texts."""
    kinds = kinds_of_lines(held).join(often.withColumn("_often", F.lit(True)), ["host", "line"], "left")
    x = held.select(*TEXT, "line", "own").join(written(kinds, "kinds"), ["host", "line"])
    rare = F.col("n") <= MAX_DOCS
    x = x.groupBy(*TEXT).agg(
        F.sum("own").alias("_words"), F.coalesce(F.sum(F.when(rare, F.col("own"))), F.lit(0)).alias("_rare"), F.min(F.when(rare, F.col("kind"))).alias("_least"),
        F.sort_array(F.collect_list(F.when(~rare, F.struct("n", "kind", "own")))).alias("_sorted"), F.collect_list(F.when(F.col("_often"), F.struct("line", "kind"))).alias("_lines"),
    )
    start = F.struct(F.col("_rare").alias("sum"), F.lit(0).alias("k"))
    more = lambda a, s: F.struct((a["sum"] + s["own"]).alias("sum"), (a["k"] + (NINTH * (a["sum"] + s["own"]) < F.col("_words")).cast("int")).alias("k"))
    x = x.withColumn("_k", F.aggregate("_sorted", start, more)["k"])
    at = lambda i: F.get("_sorted", i)["kind"]
    other = lambda kind: F.when(at(F.col("_k")) != kind, at(F.col("_k"))).otherwise(F.coalesce(at(F.col("_k") + 1), at(F.col("_k") - 1), F.col("_least"), F.lit(0).cast("long")))
    known = lambda kind: F.when(NINTH * F.col("_rare") >= F.col("_words"), F.col("_least")).otherwise(other(kind))
    each = x.select("host", F.inline(F.transform("_lines", lambda s: F.struct(s["line"], known(s["kind"]).alias("known_by")))))
    return each.groupBy("host", "line", "known_by").agg(F.count("*").alias("n"))


def removed_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, _h1, _h2, removed_words, gone): for each text with removed lines, their words and places. host is host_key()."""
    lines = written(host_lines(docs, host), "lines")
    often = lines.groupBy("host", "line").agg(F.count("*").alias("_n")).filter(F.col("_n") > MAX_DOCS).select("host", "line")
    often = written(often, "often")
    with_some = written(lines.select(*TEXT, "line").join(often, ["host", "line"], "left_semi").select(*TEXT).distinct(), "texts")
    held = lines.filter("own > 0").join(with_some, TEXT, "left_semi").groupBy(*TEXT, "line").agg(F.min("own").alias("own"), F.min("sketch").alias("sketch"))
    known = known_lines(written(held, "held"), often)
    over = written(known.groupBy("host", "line").agg(F.count("*").alias("_docs")).filter(F.col("_docs") > MAX_DOCS).select("host", "line"), "over")
    gone = lines.join(over, ["host", "line"], "left_semi").groupBy(*TEXT, "pos").agg(F.min("words").alias("words"))  # repeated rows once
    return gone.groupBy(*TEXT).agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("pos")).alias("gone"))


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "gone", "base_failed", "kept")


def apply_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """docs with METRICS: the base metrics, removed_words, gone (places of the lines to remove), base_failed and kept."""
    docs, back = set_aside(docs, "text", host, made=METRICS)
    gone = written(removed_lines(docs, host).withColumnsRenamed({"_h1": "_g1", "_h2": "_g2", "host": "_host"}), "gone")
    x = with_text_key(base_metrics(docs))
    x = x.join(gone, (host_key(host) == F.col("_host")) & (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2")), "left")
    x = x.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    x = x.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    return back(x.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= MAX_REMOVED * F.col("n_words")) & (F.col("_row") >= 0)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = apply_rules(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, without the removed lines; n_chars follows the text."""
    safe, back = set_aside(docs, "text", "source", "n_chars")
    x = apply_rules(safe).filter("kept")
    # the lines between one removed place and the next, so that each line is looked at once
    ends, lines = F.concat("gone", F.array(F.size("_cut"))), F.col("_cut")
    before = lambda i: F.coalesce(F.get("_ends", i - 1), F.lit(-1))
    left = F.flatten(F.transform("_ends", lambda e, i: F.slice(lines, before(i) + 2, e - before(i) - 1)))
    x = x.withColumn("_cut", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1))).withColumn("_ends", ends)
    x = x.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(x)


ORACLE_OP1 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1) GROUP BY rid),
ln AS (SELECT rid, source, t, pos, l, regexp_extract_all(lower(l), '[^\x20\x09-\x0D]+') AS lw FROM (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)),
lines AS (SELECT *, array_to_string(lw, ' ') AS n, ('0x' || substr(md5(array_to_string(lw, ' ')), 1, 15))::BIGINT AS h FROM ln WHERE len(lw) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY rid),
one AS (SELECT coalesce('=' || source, '') AS host, t, min(rid) AS rid FROM d GROUP BY source, t),
often AS (SELECT source, h FROM lines GROUP BY source, h HAVING count(*) > 10),
held AS (SELECT DISTINCT rid, host, h FROM lines JOIN one USING (rid) WHERE EXISTS (SELECT 1 FROM often o WHERE o.h = lines.h AND o.source IS NOT DISTINCT FROM lines.source)),
sw AS (SELECT rid, host, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS w FROM one WHERE rid IN (SELECT rid FROM held)),
sh AS (SELECT DISTINCT rid, host, hash(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT rid, host, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM sw)),
sz AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
lk AS (SELECT a.rid AS p, b.rid AS q FROM sh a JOIN sh b ON a.host = b.host AND a.s = b.s AND a.rid <> b.rid JOIN sz x ON x.rid = a.rid JOIN sz y ON y.rid = b.rid GROUP BY a.rid, b.rid HAVING 9 * count(*) >= 4 * (any_value(x.n) + any_value(y.n))),
reach AS (SELECT rid AS p, rid AS q FROM sw UNION SELECT r.p, k.q FROM reach r JOIN lk k ON k.p = r.q),
doc AS (SELECT p AS rid, min(q) AS doc FROM reach GROUP BY p),
cut AS (SELECT CASE WHEN host = '' THEN NULL ELSE substr(host, 2) END AS source, h FROM held JOIN doc USING (rid) GROUP BY host, h HAVING count(DISTINCT doc) > 10),
gone AS (SELECT lines.rid, sum(len(lw)) AS n FROM lines JOIN cut ON lines.h = cut.h AND lines.source IS NOT DISTINCT FROM cut.source GROUP BY lines.rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5 * n_words AS kept FROM m
"""
