"""Every operator and pipeline stage on odd rows (nulls, empty and long texts, ties, repeated rows, clashing names) and on an
empty table. All columns are evaluated, and what must come out is computed here."""

import hashlib
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from bandloom.llm import fill_in_middle, filter_audit, lm, lz_fingerprint, mixing, pii, quality, quality_classifier, secrets, sentencepiece_viterbi, sharding, simhash, token_output
from bandloom.llm.common import shared_dir, written

BLANK = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in (text or "").translate({ord(c): " " for c in BLANK}).split(" ") if w]


def tokens(docs):
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    token_output.write_tokens(docs, path)
    return token_output.with_starts(token_output.document_digests(spark, path))


def mixed(docs):
    sized = written(mixing.sized_documents(docs))
    return mixing.mix(sized, mixing.cycled_targets(sized))


LABELS = [(1, 1, 0), (1, 0, 1), (4, 1, None), (4, None, 1), (5, 0, 0), (None, 1, 1), (99, 1, 1)]


def labels_of(docs):
    """Labels with nulls, several of one id, ids without documents, and a clashing name."""
    return docs.sparkSession.createDataFrame(LABELS, "doc_id long, quality int, toxic int").selectExpr("*", "'mask' AS mask")


OPERATORS = {
    "quality": quality.apply_rules,
    "mixing": mixed,
    "tokens": tokens,
    "lz": lz_fingerprint.fingerprinted,
    "sentencepiece": sentencepiece_viterbi.round_trip,
    "pii": lambda d: pii.with_surrogates(d, "secret"),
    "lm": lm.interpolated_scores,
    "sharding": lambda d: sharding.shard_by_bytes(written(sharding.keyed(d)), 24),
    "secrets": secrets.scan,
    "simhash": lambda d: simhash.near_duplicates(written(simhash.fingerprints(d))),
    "audit": lambda d: filter_audit.audited(d, labels_of(d)),
    "fim": lambda d: fill_in_middle.restored(fill_in_middle.filled_in(d)),
    "classifier": lambda d: quality_classifier.scored(d, labels_of(d)),
}


def extras(df, row, made=()):
    """Columns that operators must leave alone hold their own names."""
    kept = [c for c in df.columns if c not in ("doc_id", "text", "lang", "source", "n_chars", *made)]
    return all(row[c] == c for c in kept) and len(kept) > 10


def check_quality(rows, out, df):
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in rows)
    assert df.columns.count("gone") == df.columns.count("kept") == 1
    for r in out:
        w = words(r.text)
        windows = Counter(zip(w, w[1:], w[2:]))
        again = len({k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in (i, i + 1, i + 2)})
        lines = [x for x in (r.text or "").split("\n") if x.strip(BLANK)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), len("".join(w)), again, len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * again > 50 * len(w)) and r.kept == (not r.base_failed) and r.removed_words == 0 and r.gone is None
        assert extras(df, r, quality.METRICS)


def check_mixing(rows, out, df):
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r.doc_id, len(words(r.text))) for r in rows)
    total = sum(len(words(r.text)) for r in rows)
    own = Counter()
    for r in rows:
        own[r.source] += len(words(r.text))
    targets = {r.source: r.target for r in out}
    assert sum(targets.values()) == pytest.approx(min(1.5 * total, 2 * total)) and all(r.source_size == own[r.source] for r in out)
    assert all(r.taken == r.copies * r["size"] and r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size + 1e-6 for r in out)


def check_tokens(rows, out, df):
    tokenizer = token_output.words_of_file(None).tokenizer
    ids = [[*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows]
    want = Counter((r.doc_id, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == sorted((r.doc_id for r in rows), key=lambda d: -1 if d is None else d)


def check_lz(rows, out, df):
    prints = {}
    for r in rows:
        prints.setdefault(r.doc_id, set()).add(lz_fingerprint.Fingerprint(r.text or "").bytes.hex())
    assert Counter((r.doc_id, r.n_chars) for r in out) == Counter((r.doc_id, len(r.text or "")) for r in rows)
    assert all(r.fingerprint in prints[r.doc_id] and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    empty = [r for r in out if not r.n_chars]
    assert {r.edited_sha256 for r in empty} == {hashlib.sha256(b"").hexdigest()} and {r.fingerprint for r in empty} == {"00" * lz_fingerprint.SLOTS}


def check_sentencepiece(rows, out, df):
    assert Counter((r.doc_id, r.decoded_crc32) for r in out) == Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in rows)
    assert all(r.exact for r in out) and {r.n_ids for r in out if r.decoded_crc32 == 0} == {0}


def check_pii(rows, out, df):
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in rows)
    assert all(r[f"n_{k}"] == 0 for r in out for k in pii.KINDS) and all(extras(df, r, [f"n_{k}" for k in pii.KINDS]) for r in out)


def check_lm(rows, out, df):
    cls = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7
    low = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)]
    c = Counter(w for r in rows if cls(r.doc_id) != 2 for w in [*low(r.text), None])
    n, v = sum(c.values()), len(c)
    want = Counter((r.doc_id, cls(r.doc_id) == 2, len(words(r.text)) + 1, sum(c[w] > 0 for w in [*low(r.text), None]), n) for r in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in out) == want
    base = sorted(round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in [*low(r.text), None]), 6) for r in rows)
    assert np.allclose(sorted(r.base_score for r in out), base) and all(np.isfinite(r.score) and r.score < 0 for r in out)


def check_sharding(rows, out, df):
    raw = [(r.doc_id, (r.text or "").encode()) for r in rows]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((d, len(t) + 8, zlib.crc32(t)) for d, t in raw)
    for s in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == s)
        assert 0 <= s < 24 and slots == list(range(len(slots)))


def check_secrets(rows, out, df):
    none = hashlib.sha256(b"").hexdigest()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in rows)
    assert all((r.n_assign, r.n_access, r.n_hex, r.n_novel, r.base_sha256, r.spans) == (0, 0, 0, 0, none, "") for r in out)


def check_simhash(rows, out, df):
    prints = {r.doc_id: set() for r in rows}
    for r in rows:
        prints[r.doc_id].add(simhash.fingerprint(r.text))
    least = {}
    for d, ps in prints.items():
        for p in ps:
            least[p] = min((x for x in (least.get(p), d) if x is not None), default=None)
    for r in out:
        p = r.fp % (1 << 64)
        assert p in prints[r.doc_id] and r.component_id == least[p]
    assert len(out) == len(rows) and least[0] == 2


def check_audit(rows, out, df):
    by_part, good, toxic = {}, {d for d, q, _ in LABELS if q == 1}, {d for d, _, t in LABELS if t == 1}
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    for r in rows:
        t, w = r.text or "", words(r.text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in t for c in "#$%&*|")}
        fails["E"] = r.doc_id is not None and r.doc_id > least[t]
        by_part.setdefault(r.lang or "", []).append(({f for f, x in fails.items() if x}, r.doc_id in good and r.doc_id is not None, r.doc_id in toxic and r.doc_id is not None))
    assert len(out) == 600 * len(by_part)
    shapley = Counter()
    for r in out:
        shapley[r.part, r.filter_order[r.step - 1]] += r.removed
    for r in out:
        f, before = r.filter_order[r.step - 1], set(r.filter_order[: r.step - 1])
        ds = by_part[r.part]
        gone = [d for d in ds if f in d[0] and not d[0] & before]
        want = (sum(not d[0] & (before | {f}) for d in ds), len(gone), sum(f in d[0] and bool(d[0] & before) for d in ds), sum(d[0] == {f} for d in ds), sum(d[1] for d in gone), sum(d[2] for d in gone), shapley[r.part, f])
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == want


def check_fim(rows, out, df):
    assert Counter((r.doc_id, r.restored, r.n) for r in out) == Counter((r.doc_id, r.text or "", len(r.text or "")) for r in rows)
    assert all(r.form == "plain" and r.prefix_chars is None for r in out if not r.restored) and {r.form for r in out} == {"plain", "psm", "spm"}


def check_classifier(rows, out, df):
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 0
    assert Counter((r.doc_id, r.held_out) for r in out) == Counter((r.doc_id, held(r.doc_id)) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    rows, out = odd.collect(), OPERATORS[name](odd)
    globals()[f"check_{name}"](rows, out.collect(), out)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


def kept_by_quality(rows):
    return Counter((r.doc_id, r.text) for r in rows if len(words(r.text)) >= 50)


def one_of_each(rows):
    """Of equal word sequences the row with the least id, null ids last."""
    best = {}
    for r in rows:
        k = tuple(w.lower() for w in words(r.text))
        rank = (r.doc_id is None, r.doc_id or 0)
        if k not in best or rank < best[k][0]:
            best[k] = (rank, r.doc_id)
    return Counter(d for _, d in best.values())


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(spark, odd, empty, name, stage):
    rows, out = odd.collect(), stage(spark, odd, "")
    found = out.collect()
    same = Counter((r.doc_id, r.text) for r in rows)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
        assert all(extras(out, r) and r.n_chars == (None if r.text is None else len(r.text)) and r.lang == "en" for r in found)
    match name.split()[0]:
        case "quality":
            assert Counter((r.doc_id, r.text) for r in found) == kept_by_quality(rows)
        case "simhash":
            assert Counter(r.doc_id for r in found) == one_of_each(rows)
        case "pii":
            assert Counter((r.doc_id, r.text) for r in found) == same
        case "source":
            sized = mixed(odd).collect()
            want = Counter()
            for r in sized:
                want[r.doc_id, r["size"]] += r.copies
            assert Counter((r.doc_id, len(words(r.text))) for r in found) == +want
        case _:
            back = sentencepiece_viterbi.decoded(out).collect()
            assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.text or "") for r in rows)
            assert all(r.n_ids == len(r.ids) for r in found)
    assert stage(spark, empty, "").collect() == []


def test_whole_pipeline_by_content(spark, tmp_path):
    """Planted documents through all stages: depleted and short ones go, copies leave one, personal data goes, and ids give
    the texts back."""
    import itertools

    from corpus_tables import table

    prose = lambda i, n=80: " ".join(f"word{(i * 7919 + k * k * 31) % 50021}" for k in range(n))
    notice = "this notice stands on every page of the site"
    rows = [(i, f"{prose(i)}\n{notice}\nWrite to user{i}@mail.org", "site") for i in range(40)]
    rows += [(100 + i, rows[i % 3][1], "site") for i in range(9)]  # copies
    rows += [(200 + i, prose(i + 900, 100) if i else prose(900, 100) + " and one word more", "other") for i in range(2)]
    rows += [(300, prose(900, 100), "other"), (301, "too short", "other"), (302, None, "other"), (303, "same words here " * 40, "other")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    back = sentencepiece_viterbi.decoded(out).collect()
    texts = {}
    for r in back:
        texts.setdefault(r.doc_id, set()).add(r.text)
    assert all(len(t) == 1 for t in texts.values())  # what the mix repeats is the same text
    assert set(texts) <= {*range(40), 200, 201} and max(Counter(r.doc_id for r in back).values()) <= 2
    mails = []
    for d, (t,) in texts.items():
        if d < 40:
            first, mail = t.split("\nWrite to ")
            assert first == prose(d) and mail != f"user{d}@mail.org" and "@" in mail and notice not in t
            mails.append(mail)
    assert len(set(mails)) == len(mails) > 20
    own = {"site": 0, "other": 0}
    for d, (t,) in texts.items():
        own["site" if d < 40 else "other"] += len(words(t))
    taken = Counter()
    for r in back:
        taken[r.source] += len(words(r.text))
    total = 40 * 83 + 104 + 100
    for name, weight, size in (("other", 3, 204), ("site", 1, 40 * 83)):
        target = min(2 * size, 1.5 * total * weight / 4) if name == "other" else 1.5 * total - 2 * 204
        assert abs(taken[name] - target) <= 110
    assert list(itertools.chain(out.columns)) == ["doc_id", "lang", "source", "ids", "n_ids"]
