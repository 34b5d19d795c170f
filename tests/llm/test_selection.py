"""Resampling, collocations and packing: against brute force, their guarantees, and odd rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftmart.llm import collocations, packing, resampling, words
from driftmart.llm.common import string_bytes
from tests.llm.test_documents import ODD, documents

FEATURE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
TEXTS = [
    "Hello wörld  foo-BAR 12",
    "",
    None,
    "x" * 70 + " yy " + "z" * 200 + " ü",
    " ".join("é" * (i % 40) + "ab9"[i % 3] for i in range(300)),
    "É É é. a,b",
    "same same",
]


# ---- words ---------------------------------------------------------------------


@pytest.mark.parametrize("limit", [7, 50, 1 << 20])
def test_checksums_of_words_and_pairs(limit):
    raw, starts = string_bytes(pa.array(TEXTS * 3)[1:])
    found = [[] for _ in range(3 * len(TEXTS) - 1)]
    carry = None
    for text, first, length, row in words.word_steps(raw, starts, resampling._BLANK, limit):
        crc, pair, pair_row, carry = words.crc_of_words_and_pairs(text, first, length, row, carry)
        for value, r in [*zip(crc, row), *zip(pair, pair_row)]:
            found[r].append(int(value))
    for text, own in zip((TEXTS * 3)[1:], found):
        w = FEATURE_WORD.findall((text or "").translate(ASCII_LOWER))
        features = [*w, *map(" ".join, zip(w, w[1:]))]
        assert sorted(own) == sorted(zlib.crc32(x.encode()) for x in features)


def test_word_steps_are_bounded_within_one_text():
    raw, starts = string_bytes(pa.array(["ab " * 100_000, "c" * 5_000]))
    steps = list(words.word_steps(raw, starts, collocations._BLANK, 1000))
    assert max(len(text) for text, *_ in steps[:-1]) <= 1000
    assert sum(len(first) for _, first, *_ in steps) == 100_001


# ---- resampling ----------------------------------------------------------------


def test_highest_reached_is_exact(spark):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)] + [5] * 200
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for wanted in (1, 77, 250, 500):
        assert resampling.highest_reached(df, F.col("v"), wanted) == sorted(values, reverse=True)[wanted - 1]


def test_ranks_with_ties_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 7)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        doc_id = None if i % 3 == 0 else int(rng.integers(0, 60))
        rows.append((doc_id, int(rng.integers(15, 30)), int(rng.integers(0, 5)), 0, int(rng.integers(-2, 3))))
    df = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = resampling.draw(df).collect()
    able = sorted(
        (r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2])
    )
    wanted = len(able) * 25 // 100
    drawn = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in drawn] == list(range(1, wanted + 1))
    assert [(r.score, r.doc_id, r.n_features) for r in drawn] == [(r[4], r[0], r[2]) for r in able[:wanted]]
    assert sorted(map(str, (tuple(r)[:-1] for r in got))) == sorted(map(str, rows))


def test_resampling_prefers_what_the_target_has(spark):
    plain, wanted = "the cat sat on the mat and slept " * 4, "quantum field theory of gauge bosons in space " * 4
    docs = documents(spark, [plain, wanted] * 200)
    target = spark.createDataFrame([(wanted,)] * 50, "text string")
    drawn = resampling.resample(docs, target).where("rank IS NOT NULL").collect()
    assert len(drawn) == 100
    assert sum(r.doc_id % 2 for r in drawn) >= 95


def test_resampling_of_odd_and_no_rows(spark):
    docs = documents(spark, ODD, ids=[0, 1, 2, 3, 4, 5, None])
    nothing = spark.createDataFrame([], "text string")
    rows = {r.doc_id: r for r in resampling.resample(docs, nothing, percent=100).collect()}
    assert len(rows) == len(ODD)
    assert [rows[i].n_features for i in (0, 1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1, 5999]
    assert {i for i, r in rows.items() if r.rank is not None} == {5, None}
    assert rows[0].weight == 0 and rows[0].rank is None
    assert resampling.resample(documents(spark, []), nothing).count() == 0


# ---- collocations --------------------------------------------------------------


@pytest.mark.parametrize("least", [5, 20])
def test_summaries_keep_every_frequent_key(least):
    rng = np.random.default_rng(3)
    shares = [rng.zipf(1.3, 30_000) % 5_000 for _ in range(6)]
    everything = Counter(np.concatenate(shares).tolist())
    summary = collocations.Summary(sum(everything.values()) // least + 1)
    for own in shares:  # counts of one task each
        keys, counts = np.unique(own.astype(np.uint64), return_counts=True)
        summary.merge(*collocations._unpacked(collocations._packed(keys, counts)))
        summary.cut()
        assert len(summary.keys) <= summary.capacity
    kept = set(summary.reaching(least).tolist())
    assert summary.error < least
    assert {k for k, n in everything.items() if n >= least} <= kept


def test_summaries_of_little_room_take_off_little():
    summary = collocations.Summary(10)
    keys = np.arange(1000, dtype=np.uint64)
    counts = np.where(keys < 5, 500, 1).astype(np.int64)
    summary.merge(keys, counts)
    assert set(summary.reaching(500).tolist()) == set(range(5))
    assert summary.error == 1


def _pieces(text):
    for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(ASCII_LOWER)):
        yield [w for w in re.split("[\x20\x09]+", piece) if w]


@pytest.mark.parametrize("flush", [5, 64, 1 << 20])
def test_ngrams_across_steps_and_flushes(monkeypatch, flush):
    monkeypatch.setattr(collocations, "FLUSH_WORDS", flush)
    texts = ["A b, c\td e f g h.i j", None, "", " ;; ", "a b c d e f g", "k"] * 9
    langs = ["x", "y", "x", "y", "y", "x"] * 9
    batches = [
        pa.RecordBatch.from_arrays([pa.array(texts[k : k + 20]), pa.array(langs[k : k + 20])], names=["text", "lang"])
        for k in range(0, len(texts), 20)
    ]
    names, totals, found = [], {}, Counter()
    for run, starts in collocations.task_words(iter(batches), names, True, totals):
        for size, places, hashed in run.orders():
            for at, value in zip(places[places < starts], hashed[places < starts]):
                phrase = b" ".join(run.word(i) for i in range(at, at + size)).decode()
                found[names[run.langs[at]], phrase, int(value)] += 1
    wanted, words_of = Counter(), Counter()
    for text, lang in zip(texts, langs):
        for w in _pieces(text):
            words_of[lang] += len(w)
            for size in range(1, 6):
                wanted.update((lang, " ".join(w[i : i + size])) for i in range(len(w) - size + 1))
    assert Counter({k[:2]: n for k, n in found.items()}) == wanted
    assert len({k[2] for k in found}) == len(wanted)
    assert {k: n for k, n in totals.items() if n} == dict(words_of)


def _brute_collocations(texts, langs, least, top):
    out = []
    named = ["und" if x is None else x for x in langs]
    for lang in set(named):
        f, n = Counter(), 0
        for text, own in zip(texts, named):
            if own == lang:
                for w in _pieces(text):
                    n += len(w)
                    for size in range(1, 6):
                        f.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
        able = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        rows = []
        for p, a in able.items():
            inside = any(
                len(d) > len(p) and b >= a and any(d[i : i + len(p)] == p for i in range(len(d) - len(p) + 1))
                for d, b in able.items()
            )
            if not inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def test_collocations_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["a", "B", "é", "dd", "of", "New", "York", "x-1", " z"]
    texts, langs = [], []
    for i in range(300):
        w = [vocabulary[k] for k in rng.zipf(1.4, 40) % len(vocabulary)]
        glue = rng.choice([" ", "  ", "\t", ", ", ".\n"], 40, p=[0.7, 0.1, 0.1, 0.05, 0.05])
        texts.append("".join(a + b for a, b in zip(w, glue)) + " New York City")
        langs.append([None, "en", "en", "", "und"][i % 5])
    docs = documents(spark, [*texts, None, ""], langs=[*langs, "en", "fr"])
    got = collocations.collocations(docs, least=30, top=25)
    assert sorted(map(tuple, got.collect())) == _brute_collocations(texts, langs, 30, 25)


def test_collocations_of_odd_and_no_rows(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0
    rows = collocations.collocations(documents(spark, ODD), least=3000).collect()
    assert {(r.lang, r.phrase, r.a) for r in rows} == {("und", " ".join(["word"] * k), 6002 - 2 * k) for k in range(2, 6)}
    assert {r.n for r in rows} == {6002}


# ---- packing -------------------------------------------------------------------


def _place(histogram):
    plan = packing.plan(histogram)
    size = np.repeat(np.arange(len(histogram)), histogram)
    number = np.concatenate([np.arange(n) for n in histogram]) if len(size) else np.zeros(0, np.int64)
    return plan, size, *plan.place(size, number)


HISTOGRAMS = {
    "nothing": np.zeros(33, np.int64),
    "even": np.bincount(np.random.default_rng(5).integers(1, 2049, 20_000), minlength=2049),
    "short": np.bincount(np.random.default_rng(6).integers(1, 90, 20_000), minlength=2049),
    "one length": np.bincount(np.full(1000, 700), minlength=2049),
    "tiny": np.bincount(np.random.default_rng(7).integers(1, 33, 500), minlength=33),
    "skewed": np.bincount(np.clip(np.random.default_rng(8).lognormal(6, 1, 300_000).astype(int), 1, 2048), minlength=2049),
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_plans_fill_sequences_without_gaps(name):
    histogram = HISTOGRAMS[name]
    length = len(histogram) - 1
    plan, size, sequence, offset = _place(histogram)
    order = np.lexsort((offset, sequence))
    sequence, offset, size = sequence[order], offset[order], size[order]
    first = np.append(True, sequence[1:] != sequence[:-1])[: len(sequence)]
    assert (offset[first] == 0).all()
    assert (offset[1:][~first[1:]] == (offset + size)[:-1][~first[1:]]).all()
    assert (offset + size).max(initial=0) <= length
    assert len(np.unique(sequence)) == plan.sequences
    lower = -(-int((histogram * np.arange(length + 1)).sum()) // length)
    if name in ("even", "short", "skewed"):
        assert plan.sequences <= 1.007 * lower
    if name == "one length":
        assert plan.sequences == 500


def test_most_of_a_varied_table_is_packed_by_fitted_patterns():
    left = HISTOGRAMS["skewed"].astype(np.int64).copy()
    runs = packing._fitted_runs(left, 2048, packing.CELLS, packing.DOCUMENTS)
    assert all(run.room == 0 for run in runs)
    assert sum(run.count for run in runs) > 0.4 * packing.plan(HISTOGRAMS["skewed"]).sequences


def test_least_squares_against_every_active_set():
    rng = np.random.default_rng(9)
    for _ in range(20):
        matrix, wanted = rng.random((5, 6)), rng.normal(size=5)
        x = packing.nonnegative_least_squares(matrix, wanted)
        assert x.min() >= 0
        best = np.linalg.norm(wanted)
        for mask in range(1, 64):
            use = [k for k in range(6) if mask >> k & 1]
            z = np.linalg.lstsq(matrix[:, use], wanted, rcond=None)[0]
            if z.min() >= 0:
                best = min(best, np.linalg.norm(matrix[:, use] @ z - wanted))
        assert np.linalg.norm(matrix @ x - wanted) == pytest.approx(best, abs=1e-6)


def _library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_encoder_equals_the_library(monkeypatch):
    rng = np.random.default_rng(10)
    letters = [*"ab1ȷʼªº²×ß̈я \n\t\r\x0b\x0c\x1c\x1f\x85\xa0  　​!'s.,é日😀", "  ", "\n\n", "<|endoftext|>", "'ll"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    texts += ["word " * 3000, "a" * 5000, "\n" * 100]
    wanted = [np.array(x.ids, "<u4").tobytes() for x in _library().encode_batch(texts, add_special_tokens=False)]
    encoder = packing.Encoder(packing.default_tokenizer())
    assert list(map(encoder.encode, texts)) == wanted
    monkeypatch.setattr(packing, "STEP_CHARS", 5)  # long texts, cut
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    assert list(map(encoder.encode, texts)) == wanted


def test_packed_ids_come_back(spark, monkeypatch, texts):
    for most in (packing.MOST_TASKS, 0):
        monkeypatch.setattr(packing, "MOST_TASKS", most)
        docs = documents(spark, [t for _, t in texts], ids=[i for i, _ in texts]).repartition(5)
        rows = packing.pack(docs, length=512).collect()
        by_id, by_sequence = {}, {}
        for r in rows:
            by_id.setdefault(r.doc_id, []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append(r)
            assert len(r.ids) == 4 * r.length and 0 < r.length <= 512
        wanted = _library().encode_batch([t or "" for _, t in texts], add_special_tokens=False)
        for (doc_id, _), x in zip(texts, wanted):
            own = sorted(by_id.pop(doc_id), key=lambda r: r.piece)
            ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
            assert ids == [*x.ids, 0]
            assert [r.piece for r in own] == list(range(len(own)))
            assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
            assert all(r.length == 512 for r in own[1:])
        assert not by_id
        for own in by_sequence.values():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
            assert sum(r.length for r in own) <= 512
        total = sum(r.length for r in rows)
        assert len(by_sequence) <= 1.03 * -(-total // 512)


def test_packing_of_odd_and_no_rows(spark):
    rows = packing.pack(documents(spark, ODD, ids=[0, 1, 2, 3, 4, 5, None])).collect()
    assert {(r.doc_id, r.piece, r.length) for r in rows if r.doc_id in (0, 1)} == {(0, 0, 1), (1, 0, 1)}
    assert sum(r.length for r in rows if r.doc_id is None) == sum(r.length for r in rows if r.doc_id == 5)
    assert packing.pack(documents(spark, [])).count() == 0


@pytest.fixture(scope="module")
def texts(small):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()
