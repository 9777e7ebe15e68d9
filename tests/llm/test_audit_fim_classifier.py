"""Filter audit, fill-in-middle and quality classifier, against plain versions, and with planted documents."""

import hashlib
from collections import Counter
from random import Random

import numpy as np
import pytest
from corpus_tables import table

from bandloom.llm import fill_in_middle as fim
from bandloom.llm import filter_audit, quality_classifier


def copies(spark):
    """Groups of copies, and texts that agree in length and in their first or last block only."""
    rng = Random(3)
    long = "".join(rng.choice("abc é") for _ in range(9000))
    texts = ["", "x", "y", "same text", long, long[:-1] + "Z", "Q" + long[1:], long[:5000] + "#" + long[5001:], "é" * 300, "e" * 300]
    rows = [(rng.randrange(60), rng.choice(texts), "s") for _ in range(150)] + [(i, f"alone {i}", "s") for i in range(20)] + [(100, None, "s"), (None, "x", "s"), (None, "x", "s")]
    return rows, table(spark, rows)


@pytest.mark.parametrize("bits", [64, 2, 0])
def test_duplicates_by_refinement(spark, bits):
    """Also where block hashes collide, in some classes or in all of one length: whole texts decide."""
    rows, docs = copies(spark)
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    want = Counter((d, d is not None and d > least[t or ""]) for d, t, _ in rows)
    out = filter_audit.with_masks(docs.selectExpr("doc_id", "lang AS part", "coalesce(text, '') AS text"), bits).collect()
    assert Counter((r.doc_id, r.mask >= 16) for r in out) == want


def test_no_class_survives_without_copies(spark):
    docs = table(spark, [(i, f"text {i}", "s") for i in range(50)])
    rows = filter_audit.in_classes(docs.selectExpr("doc_id", "text"))
    assert filter_audit.refined(rows).count() == 0
    assert {r.mask for r in filter_audit.with_masks(docs.selectExpr("doc_id", "lang AS part", "text")).collect()} == {1}


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(i, "copy " * 120 if i % 3 == 0 else f"own {i}", "s") for i in range(3000)]
    out = filter_audit.audited(table(spark, rows), spark.createDataFrame([(3, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int"))
    first = next(r for r in out.collect() if r.filter_order == "EABCD" and r.step == 1)
    assert (first.removed, first.kept, first.good_lost, first.toxic_lost) == (999, 2001, 1, 1)


def plain_starts(text, unit):
    if unit == "char":
        return list(range(len(text)))
    at = [i for i in range(1, len(text)) if (text[i] not in " \t\n\x0b\x0c\r" and text[i - 1] in " \t\n\x0b\x0c\r" if unit == "word" else text[i - 1] == "\n")]
    if unit == "word" and text[:1] in tuple(" \t\n\x0b\x0c\r"):
        at = at[1:]  # the blanks before the first word belong to it
    return [0, *at] if text else []


@pytest.mark.parametrize("unit", fim.UNITS)
def test_units_and_cuts(unit):
    rng = Random(7)
    for i in range(400):
        text = "".join(rng.choice("aé日😀 \n\tx \x00") for _ in range(rng.randrange(60)))
        raw, starts = text.encode(), plain_starts(text, unit)
        assert fim.unit_starts(raw, unit).bit_count() == len(starts)
        for k, at in enumerate(starts):
            assert fim.ranked(fim.unit_starts(raw, unit), k, len(raw)) == len(text[:at].encode())
        n, form, prefix, middle, out = fim.moved(i, raw, unit, transformed=100)
        assert n == len(starts) and fim.put_back(form, out) == raw
        h = fim.draws(i, 1)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        x, y = ((starts + [len(text)])[k] if text else 0 for k in (a, b))
        p, m, s = text[:x], text[x:y], text[y:]
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert out.decode() == want and (form == "plain" or (prefix, middle) == (len(p), len(m)))


def test_long_texts_and_sentinels(spark):
    long = "日é x" * 500_000
    rows = [(i, long[i:], "s") for i in range(4)] + [(10 + i, t, "s") for i, t in enumerate(("<P>", "a<S>b", "x<M>", "<", "<S", "<P<S<M", "S>", ">" * 30, "<" * 30, None, ""))]
    got = fim.restored(fim.filled_in(table(spark, rows), transformed=100)).collect()
    for r, (d, t, _) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        assert r.doc_id == d and r.restored == (t or "") and r.n == len(t or "")
        assert (r.form == "plain") == (not t or any(x in t for x in ("<P>", "<S>", "<M>")))
    with pytest.raises(ValueError):
        fim.filled_in(table(spark, rows), unit="page")


def test_shares_of_forms(spark):
    out = Counter(r.form for r in fim.filled_in(table(spark, [(i, f"text {i}", "s") for i in range(4000)])).collect())
    assert abs(out["plain"] - 400) < 80 and abs(out["spm"] - 720) < 120
    h = hashlib.sha256(b"1:5").hexdigest()
    assert fim.draws(5, 1) == [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def plain_words(text):
    import re

    return re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9 \t\n\x0b\x0c\r]+", text)


def test_words_and_contexts_are_those_of_a_plain_scan(spark):
    rng = Random(1)
    words = quality_classifier.Words()
    texts = [" ".join(rng.choice(["the", "The", "x1", "é", "##", "a.b", "\0", "\n"]) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", " ", "one"]
    bucket = {}
    for t in texts:
        starts, b = words(t.encode())
        found = plain_words(t.encode())
        assert len(b) == len(found) and all(t.encode()[s:].startswith(w) for s, w in zip(starts, found))
        for w, k in zip(found, b):
            assert bucket.setdefault(w, k) == k
    assert len(set(bucket.values())) > 0.8 * len(bucket)
    place, sign = quality_classifier.index_vectors()
    want = np.zeros((quality_classifier.BUCKETS, quality_classifier.DIMENSIONS), int)
    for t in texts:
        b = [bucket[w] for w in plain_words(t.encode())]
        for i, x in enumerate(b):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(b):
                    np.add.at(want[x], place[b[j]], sign[b[j]].astype(int))
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(99, None, "s")]).repartition(5)
    assert (quality_classifier.context_sums(docs) == want).all()


def test_sums_of_many_tasks_go_in_two_hops(spark, monkeypatch):
    docs = table(spark, [(i, f"a b{i} c", "s") for i in range(64)])
    one = quality_classifier.context_sums(docs.repartition(1))
    monkeypatch.setattr(quality_classifier, "FAN", 1)
    assert (quality_classifier.context_sums(docs.repartition(16)) == one).all()


def test_pieces_of_long_texts(monkeypatch):
    """A long text's pool is that of its words, but for windows at the edges of pieces; other texts are untouched."""
    import pyarrow as pa

    words = quality_classifier.Words()
    vectors = quality_classifier.unit_vectors(np.random.default_rng(0).normal(size=(quality_classifier.BUCKETS, quality_classifier.DIMENSIONS)))
    texts = pa.array([b"ab cd 12 ## " * 3000, b"short text", b"", b"q" * 40_000], pa.binary())
    whole = quality_classifier.pool(words, vectors, texts)
    monkeypatch.setattr(quality_classifier, "PIECE", 1000)
    monkeypatch.setattr(quality_classifier, "CHUNK", 4000)
    assert b"".join(quality_classifier.pieces(texts[0].as_py())) == texts[0].as_py() and max(map(len, quality_classifier.pieces(texts[3].as_py()))) == 1000
    cut = quality_classifier.pool(words, vectors, texts)
    n = 2 * quality_classifier.DIMENSIONS + 2
    assert np.allclose(whole[:3, :n], cut[:3, :n]) and np.allclose(whole[:3], cut[:3], atol=0.05) and (whole[1] == cut[1]).all()


def test_held_out_quality(spark):
    """Junk of four kinds is told from prose on ids that never trained, and chances are calibrated."""
    rng = Random(5)
    stems = ["ra", "lo", "mi", "ten", "sur", "ka", "do", "vel"]
    word = lambda: "".join(rng.choices(stems, k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(1500):
        ws = [word() for _ in range(rng.randint(15, 200))]
        kind = rng.randrange(8)
        text = {0: " ".join(w + "##" for w in ws), 1: " ".join(w.upper() + "!!" for w in ws), 2: " | ".join(ws), 3: " ".join([ws[0]] * len(ws))}.get(kind, " ".join(ws).capitalize() + ".")
        rows.append((i, text, "s"))
        labels.append((i, int(kind > 3)))
    out = quality_classifier.scored(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in out if r.held_out]
    y = dict(labels)
    assert 200 < len(held) < 400 and np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.98
    assert abs(np.mean([r.score for r in held]) - np.mean([y[r.doc_id] for r in held])) < 0.05
    few = quality_classifier.scored(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), most=300).collect()
    assert np.mean([r.predicted == y[r.doc_id] for r in few if r.held_out]) > 0.95


def test_labels_of_held_out_ids_change_nothing(spark):
    docs = table(spark, [(i, f"text {i} " + "ab " * (i % 9) + "##" * (i % 2), "s") for i in range(200)])
    import zlib

    told = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0)) for i in range(200)], "doc_id long, quality int")
    one, two = ({r.doc_id: r.score for r in quality_classifier.scored(docs, told(f)).collect()} for f in (False, True))
    assert one == two


def test_one_class_or_no_labels(spark):
    docs = table(spark, [(i, f"text {i}", "s") for i in range(20)])
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.scored(docs, ones).collect()} == {1.0}
    assert {r.score for r in quality_classifier.scored(docs, ones.limit(0)).collect()} == {0.5}


def test_temperature_is_the_least_loss():
    rng = np.random.default_rng(2)
    z = rng.normal(size=4000) * 2
    y = (rng.random(4000) < quality_classifier.sigmoid(z)).astype(float)
    assert abs(quality_classifier.temperature(3 * z, y) - 3) < 0.3
