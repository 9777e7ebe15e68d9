"""The native table operators: SQL in DuckDB on the small tables, and planted cases."""

import os
from collections import Counter, defaultdict
from random import Random

import duckdb
import pytest
from corpus_tables import table

from bandloom.llm import quality, sharding
from bandloom.llm.common import written
from bandloom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    same = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert Counter(map(same, found)) == Counter(same(tuple(r[n] for n in names)) for r in df.collect())


def by_sql(name, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    return Counter(tuple(sorted(zip(names, r))) for r in found.fetchall())


def test_line_rules_same_as_sql(spark):
    """Shared, repeated and equally rare lines, near-copies, null hosts and repeated rows, by the SQL of the query."""
    rng = Random(4)
    shared = [" ".join(f"shared{k}x{j}" for j in range(3 + 3 * (k % 4))) for k in range(40)]
    rows = []
    for i in range(400):
        own = [" ".join(f"own{i}x{j}x{k}" for k in range(2 + rng.randrange(12))) for j in range(rng.randrange(4))]
        lines = own + rng.sample(shared, rng.randrange(25)) + rng.choices(shared, k=rng.randrange(3))
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "b", None])))
    rows += rows[:40] + [(1000 + i, rows[5][1] + f"\n{i}", rows[5][2]) for i in range(50)] + [(2000, None, "a"), (2001, "", None)]
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")
    out = quality.apply_rules(table(spark, rows)).select(*names).collect()
    got = Counter(tuple(sorted(r.asDict().items())) for r in out)
    assert got == by_sql("op1_quality", rows) and sum(r.removed_words > 0 for r in out) > 50


def words(i, n=60):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_boilerplate_goes_and_copies_stay(spark):
    notice = "All rights reserved by the owner of this site"
    rows = [(i, f"{words(i)}\n{notice}\n{words(i + 1000)}", "h") for i in range(30)]
    rows += [(100 + i, f"{words(7)} \n{words(8)}\n{words(9)}\n{words(10)}" + f"\nend {i}", "h") for i in range(30)]  # near copies
    rows += [(200 + i, (notice + "\n") * 9 + words(i + 500, 10), "h") for i in range(5)]  # depleted
    rows += [(300 + i, words(3), "h") for i in range(30)]  # exact copies
    rows += [(400, f"{words(1)}\n{notice}", "other host")]
    out = {r.doc_id: r for r in quality.apply_rules(table(spark, rows)).collect()}
    assert all(out[i].kept and out[i].removed_words == 9 for i in range(30))
    assert all(out[i].kept and not out[i].removed_words for i in (*range(100, 130), *range(300, 330), 400))
    assert not any(out[200 + i].kept for i in range(5)) and out[200].n_dup_lines == 8
    texts = {r.doc_id: r.text for r in quality.good_documents(table(spark, rows)).collect()}
    assert texts[3] == f"{words(3)}\n{words(1003)}" and 200 not in texts and len(texts) == 91


@pytest.mark.parametrize(("shared", "own"), [(1, 5), (5, 5), (10, 5), (8, 2), (20, 3), (20, 20)])
def test_several_boilerplate_lines_go(spark, shared, own):
    """Documents with several lines in common and few of their own lose all of the former, on every host."""
    rows = [(1000 * h + i, "\n".join([words(f"b{h}x{k}", 12) for k in range(shared)] + [words(f"{h}x{i}x{k}", 12) for k in range(own)]), f"h{h}") for h in range(6) for i in range(60)]
    rows += rows[:3]  # repeated rows change nothing
    out = quality.apply_rules(table(spark, rows)).collect()
    assert {r.removed_words for r in out} == {12 * shared}
    assert not any(r.kept for r in out if shared > own)


def edited(rng, text, edits):
    """A near-copy: some words replaced, wherever they stand."""
    lines = [line.split(" ") for line in text.split("\n")]
    for _ in range(edits):
        line = rng.choice(lines)
        line[rng.randrange(len(line))] = f"edit{rng.random()}"
    return "\n".join(" ".join(line) for line in lines)


def page(i, lines=10, words=12):
    return "\n".join(" ".join(f"p{i}l{k}w{j}" for j in range(words)) for k in range(lines))


@pytest.mark.parametrize(("pages", "copies", "edits"), [(20, 3, 2), (20, 5, 0), (20, 5, 3), (12, 40, 2)])
def test_near_copies_dont_dilute_boilerplate(spark, pages, copies, edits):
    """A notice in many distinct documents goes, however many near-copies each of them has; their own lines stay."""
    rng = Random(9)
    notice = "all rights are reserved by the owner of this very site"
    rows = [(100 * i + k, edited(rng, page(i), edits) + f"\n{notice}\nend {i}x{k}", "h") for i in range(pages) for k in range(copies)]
    out = quality.apply_rules(table(spark, rows)).collect()
    assert {r.removed_words for r in out} == {11} and all(r.kept for r in out)


@pytest.mark.parametrize(("lines", "words", "edits"), [(10, 12, 0), (10, 12, 1), (10, 12, 2), (3, 130, 2), (40, 5, 3)])
def test_near_copies_of_one_page_stay(spark, lines, words, edits):
    """Near-copies of one page lose nothing, also where the edits touch most versions of a line."""
    rng = Random(5)
    rows = [(k, edited(rng, page(1, lines, words), edits) + f"\nend {k}", "h") for k in range(300)] + [(1000 + i, page(i + 2), "h") for i in range(5)]
    out = quality.apply_rules(table(spark, rows)).collect()
    assert {r.removed_words for r in out} == {0} and all(r.kept for r in out)


def test_time_grows_with_the_lines(spark):
    """A text of 200,000 lines, a third of them repeats, and another that loses half of its lines."""
    import time

    shared = [f"shared{i} number{i} line{i}" for i in range(20_000)]
    rows = [(i, "\n".join(x for k, line in enumerate(shared) for x in (line, f"own{i}x{k} text{k}y{i} z{i}x{k} q{i}{k}")), "h") for i in range(12)]
    rows.append((99, "\n".join(f"line {i % 130_000} here" for i in range(200_000)), "h"))
    start = time.monotonic()
    out = {r.doc_id: r for r in quality.good_documents(table(spark, rows)).collect()}
    assert time.monotonic() - start < 120
    assert out[3].text == "\n".join(f"own3x{k} text{k}y3 z3x{k} q3{k}" for k in range(20_000)) and out[3].n_chars == len(out[3].text)
    assert len(out) == 12  # the other repeats itself too much


def test_lines_are_cut_out_where_they_stand(spark):
    notice = "this line is on every page of the host"
    rows = [(i, f"{notice}\n\n{words(i)}\n {notice.upper()} \n{notice}\n\n", "h") for i in range(20)] + [(50, f"{words(50)}\n{notice}", "h"), (51, f"{notice}\n{words(51)}", "h")]
    rows += rows[:2]
    out = Counter((r.doc_id, r.text) for r in quality.good_documents(table(spark, rows)).collect())
    want = Counter([(i, f"\n{words(i)}\n\n") for i in (*range(20), 0, 1)] + [(50, words(50)), (51, words(51))])
    assert out == want


def test_base_metrics(spark):
    rows = [(1, "a b c a b c a b", "s"), (2, "x#*\n \nx#*\ny", "s"), (3, None, "s"), (4, "a a a a", "s"), (5, "a b", "s")]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.base_metrics(table(spark, rows)).collect()}
    assert got == {1: (8, 8, 0, 0, 8), 2: (3, 7, 4, 1, 0), 3: (0, 0, 0, 0, 0), 4: (4, 4, 0, 0, 4), 5: (2, 2, 0, 0, 0)}


def test_shards_are_even_and_gapless(spark):
    rows = [(i, "copy " * 50, "s") for i in range(700)] + [(1000 + i, f"text {i} " * (1 + i % 40), "s") for i in range(1300)]
    out = sharding.shard_by_bytes(written(sharding.keyed(table(spark, rows))), 24).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in out:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean, top = sum(sizes.values()) / 24, max(r.size for r in out)
    assert len(out) == 2000 and set(sizes) == set(range(24)) and max(abs(s - mean) for s in sizes.values()) <= 2 * top
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_overfull_ranges_are_subdivided(spark):
    rows = written(sharding.keyed(table(spark, [(i, "the same", "s") for i in range(3000)])))
    cuts = sharding.splitters_of(rows, 3000 * 16, 64)
    fill = [r["count"] for r in sharding.ranged(rows, cuts).groupBy("range").count().collect()]
    assert max(fill) < 3000 / 8
