"""The corpus operators on small tables, against brute force and for odd rows."""

from __future__ import annotations

import hashlib
import pickle
import re
import time

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from driftmart.llm import language, licenses, mixing, near_dups, pieces, pii, queries, repeats, secret_links

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies long, bucket string, cluster int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, texts, ids=None, langs=None, sources=None):
    """Rows with extra columns whose names the operators use themselves."""
    rows = [
        (
            i if ids is None else ids[i],
            t,
            None if langs is None else langs[i],
            None if sources is None else sources[i],
            None if t is None else len(t),
            7,
            "x",
            None,
        )
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", "   \n", "é", "a" * 5000, "word " * 3000, "word " * 3000]


@pytest.fixture(scope="module")
def texts(small):
    return duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()


def everything(docs):
    model = language.fit(docs)
    yield mixing.mix(docs)
    yield mixing.mixed_documents(docs)
    yield pieces.encode(docs)
    yield pii.scan(docs)
    yield secret_links.scan(docs)
    yield secret_links.redact(docs)
    yield licenses.scan(docs)
    yield language.identify(docs, model)
    yield repeats.without_repeats(docs)
    yield near_dups.near_duplicates(docs)


def test_empty_table(spark):
    assert [df.count() for df in everything(documents(spark, []))] == [0] * 10


def test_odd_rows_give_a_row_each(spark):
    ids = [0, 1, 2, 3, 4, 5, None]
    docs = documents(spark, ODD, ids=ids, sources=[None, "a", "a", None, "b", "b", "b"])
    for i, df in enumerate(everything(docs)):
        rows = df.collect()
        if i == 1:
            assert set(df.columns) == set(docs.columns)
        else:
            assert len(rows) == len(ODD)


def test_mixing_meets_targets_and_reruns_agree(spark):
    sizes = [(i * 37) % 90 + 1 for i in range(600)]
    sources = [[None, "a", "b", "c"][min(3, i % 7)] for i in range(600)]
    docs = documents(spark, ["w " * n for n in sizes], sources=sources)
    rows = mixing.mix(docs).collect()
    assert sorted(rows) == sorted(mixing.mix(docs).collect())
    total = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        assert r.target <= 2 * r.source_size + 1e-6
        total.setdefault(r.source, [0, r.target])[0] += r.taken
    assert sum(t for _, t in total.values()) == pytest.approx(1.5 * sum(sizes))
    assert all(abs(taken - target) <= 90 for taken, target in total.values())
    mixed = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {r.doc_id: r.copies for r in rows if r.copies}


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    docs = documents(spark, ["w " * (i % 9 + 1) for i in range(300)], sources=[f"s{i % 5}" for i in range(300)])
    few = sorted(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "SMALL_TABLE_ROWS", 2)
    assert sorted(mixing.mix(docs).collect()) == few


@pytest.mark.parametrize("broadcast", [True, False])
def test_mixing_meets_targets_where_rows_share_an_id(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "SMALL_TABLE_ROWS", 1)
    sizes = [(i * 37) % 90 + 1 for i in range(600)]
    # A source's rows: half without an id, some sharing one, some all alike; another source absorbs the rest.
    ids = [None if i % 2 else (7 if i % 6 == 0 else 8 if i % 10 == 0 else i + 100) for i in range(600)]
    docs = documents(
        spark,
        [*("w " * n for n in sizes), *["same text here"] * 300, *["w " * 50] * 400],
        ids=[*ids, *[None] * 300, *range(1000, 1400)],
        sources=["a"] * 900 + ["b"] * 400,
    )
    for seed in ("mix", "m2", "m3", "m4") if broadcast else ("mix",):
        rows = mixing.mix(docs, weights=(1, 2), share=0.9, seed=seed).collect()
        total = {}
        for r in rows:
            total.setdefault(r.source, [0, r.target])[0] += r.taken
        assert all(abs(taken - target) <= 90 for taken, target in total.values()), (seed, total)
    again = mixing.mix(docs, weights=(1, 2), share=0.9, seed=seed).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixing_of_many_sources_is_fast(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'two words' AS text", "concat('s', id) AS source")
    start = time.perf_counter()
    assert mixing.source_targets(docs.selectExpr("source", "2L AS size")).agg(F.sum("target")).first()[0] == pytest.approx(60_000)
    assert time.perf_counter() - start < 20


def test_many_secrets_in_one_text_are_linked_in_linear_time(spark):
    text = " ".join(f"password=abcdefgh{i}" for i in range(60_000))
    start = time.perf_counter()
    assert secret_links.scan(documents(spark, [text])).first().n_assign == 60_000
    assert time.perf_counter() - start < 60


def test_sentencepiece_equals_the_library_and_comes_back(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    given = [t for _, t in texts] + ["  two  spaces ", "日本語 🙂\t\x00", "a\n\nb", "▁literal", "aaaaaaaaaaaa" * 9]
    docs = documents(spark, given)
    encoded = pieces.encode(docs)
    rows = {r.doc_id: r for r in encoded.collect()}
    for i, text in enumerate(given):
        assert rows[i].ids == library.encode(text), text[:40]
        assert rows[i].round_trip == ("▁" not in text)
    back = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert all(back[i] == t for i, t in enumerate(given) if "▁" not in t)


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_pii(text):
    found = []
    for order, (kind, pattern) in enumerate(PII):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


def test_personal_data_base_spans(texts):
    rng = np.random.RandomState(0)
    noise = ["".join(rng.choice(list("a@.@.1 -+2(5)é0b_%9."), rng.randint(60))) for _ in range(4000)]
    for text in [t for _, t in texts] + noise:
        assert [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.base_spans(text)] == plain_pii(text)


def test_personal_data_long_texts_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1.2" * 70_000, "+1 " * 70_000, "((((1" * 40_000):
        pii.base_spans(text)


def test_skip_chain_finds_the_number_without_its_country_code():
    text = "phone +1 (659) 555-3949 is known. Much later: call 659-555-3949 again, or 111-222-3333."
    base, every = pii.find(pii.default_field(), text)
    added = [text[a:b] for a, _, b in every if (a, _, b) not in base]
    assert added == ["659-555-3949"]
    assert pii.find(pii.default_field(), "call 659-555-3949 or 659-555-3949")[1] == []


@pytest.mark.parametrize(
    "text",
    [
        "+1 (659) 555-3949 and 659-555-3949 12:30",
        "call +1 (659) 555-3949, room 12 659-555-3949",
        "+1 (659) 555-3949; 1 2 3 659-555-3949 111-222-3333 4 5",
        "+1 (659) 555-3949 | " + "12 " * 20 + "659-555-3949",
    ],
)
def test_skip_chain_finds_a_number_among_others(text):
    base, every = pii.find(pii.default_field(), text)
    assert [text[a:b] for a, k, b in every if (a, k, b) not in base] == ["659-555-3949"]


def test_weak_secrets_only_with_their_complement(spark):
    bare = "aB3" * 13 + "Z"
    given = [
        f"see {bare} here",
        f"client_id = robot7 and {bare} here",
        f"client_id = robot7 {'x ' * 200} {bare} here",
        "https://api.example.org alone",
        f"https://api.example.org client_id=robot7 key {bare}",
        'PassWord: "hunter22"',
        "token: secret = abcdefghijkl",
    ]
    rows = {r.doc_id: r for r in secret_links.scan(documents(spark, given)).collect()}
    kinds = {i: [s.split(":")[0] for s in r.spans.split(",") if s] for i, r in rows.items()}
    assert kinds[0] == kinds[2] == kinds[3] == []
    assert kinds[1] == ["identifier", "bare"]
    assert kinds[4] == ["endpoint", "identifier", "bare"]
    assert kinds[5] == ["assign"]
    assert rows[6].n_assign == 0
    redacted = {r.doc_id: r for r in secret_links.redact(documents(spark, given)).collect()}
    assert redacted[0].text == given[0] and redacted[0].n_chars == len(given[0])
    assert redacted[1].text == "[secret] and [secret] here" and redacted[1].n_chars == 26


def test_licenses_are_found_where_they_are(spark, texts):
    statement = licenses.TEMPLATES["GPL-3.0"]
    noisy = statement.replace("work", "wrok").upper()
    given = [t for _, t in texts] + [f"é {statement} and {noisy} end", licenses.TEMPLATES["MIT-grant"], "license of nothing"]
    rows = {r.doc_id: r for r in licenses.scan(documents(spark, given)).collect()}
    two = rows[len(texts)].spans.split(",")
    assert [s.split(":")[0] for s in two] == ["GPL-3.0", "GPL-3.0"]
    assert two[0].split(":")[1:3] == ["2", str(2 + len(statement) - 1)]
    assert rows[len(texts) + 1].licenses == "MIT-grant" and rows[len(texts) + 2].n_matches == 0
    for i, (_, text) in enumerate(texts):
        assert (rows[i].n_matches > 0) == ("icense" in text)


def test_licenses_of_a_similar_name(spark):
    given = {
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0",
        "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
        "Released under the ISC License.": "ISC-statement",
        "Released under the XYZ License.": "",
        "Licensed under CC BY-XX 4.0.": "",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        "This work is licensed under the GNU General Public License, version 2.1.": "",
        "Licensed under the Apache License, Version 1.1.": "",
    } | {text: name for name, text in licenses.TEMPLATES.items()}
    rows = {r.doc_id: r.licenses for r in licenses.scan(documents(spark, list(given))).collect()}
    assert [rows[i] for i in range(len(given))] == list(given.values())


@pytest.mark.parametrize("between", ["\n", " ", " 1) ", " and also "])
def test_licenses_repeated_back_to_back(spark, between):
    given, wanted = [], []
    for name, text in licenses.TEMPLATES.items():
        given.append(between.join([text] * 7))
        step = len(text) + len(between)
        wanted.append([(name, k * step) for k in range(7)])
    rows = {r.doc_id: r for r in licenses.scan(documents(spark, given)).collect()}
    for i, spans in enumerate(wanted):
        found = [s.split(":") for s in rows[i].spans.split(",")]
        assert [(s[0], int(s[1])) for s in found] == spans


def test_language_on_held_out_documents(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = queries.op7_language(spark, medium).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_a_mixed_document(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    model = language.fit(docs)
    parts = {r.lang: r.text for r in docs.where("n_chars > 3000 AND NOT contains(text, '#')").collect()}
    mixed = documents(spark, [parts["de"][:2000] + " " + parts["fr"][:1000], "123 456", "ß"])
    rows = {r.doc_id: r for r in language.identify(mixed, model).collect()}
    assert rows[0].lang_pred == "de" and "fr" in rows[0].languages and 0.5 < rows[0].score < 0.85
    assert rows[1].lang_pred == "und" and rows[1].score == 0


def test_language_of_short_texts(spark, medium):
    model = language.fit(spark.read.parquet(f"{medium}/documents.parquet"))
    given = ["I", "ok", "ß", "a b", "1", " ", ""]
    rows = {r.doc_id: r for r in language.identify(documents(spark, given), model).collect()}
    assert all(rows[i].lang_pred in model.languages and rows[i].score > 0 for i in range(4))
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in range(4, 7))


def test_readable_keeps_mixtures_of_known_languages(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    model = language.fit(docs)
    parts = {r.lang: r.text for r in docs.where("n_chars > 3000 AND NOT contains(text, '#')").collect()}
    three = sorted(parts)[:3]
    given = [" ".join(parts[x][:n] for x, n in zip(three, (1200, 900, 900))), "123 456", None]
    score = language.identify(documents(spark, given), model).where("doc_id = 0").first().score
    assert 0 < score < 0.5
    assert [r.doc_id for r in language.readable(documents(spark, given), model).collect()] == [0]


def plain_repeats(rows):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - 49):
            if seen.setdefault(raw[j : j + 50], doc) < doc:
                gone[j : j + 50] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[doc] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("bucket_bytes", [5_000, 10**7])
def test_repeats_against_brute_force(spark, texts, bucket_bytes):
    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(400))
    more = [long, "x" + long[50:120] + "y", long[:49], long[:50], "z" * 500, "z" * 300, "ab" * 200, long + long, None, ""]
    rows = texts + [(10_000 + i, t) for i, t in enumerate(more)]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    found = {r[0]: tuple(r)[1:] for r in repeats.without_repeats(docs, bucket_bytes).collect()}
    assert found == plain_repeats(rows)


@pytest.mark.parametrize("unit", ["a line of thirty bytes, twice\n", " " * 12, "-" * 15, None])
def test_repeats_of_a_passage_that_holds_its_minimizer_twice(spark, unit):
    rng = np.random.RandomState(8)

    def own(n):
        return "".join(chr(97 + k) for k in rng.randint(26, size=n))

    given = []
    for _ in range(300):
        line, shared = unit or own(rng.randint(12, 39)), own(60)
        given += [own(45) + line + line + shared + own(20), own(45) + line + shared + own(20)]
    rows = list(enumerate(given))
    found = {r[0]: tuple(r)[1:] for r in repeats.without_repeats(documents(spark, given)).collect()}
    assert found == plain_repeats(rows)


def test_repeats_of_a_line_in_most_documents_fill_no_bucket(spark):
    rng = np.random.RandomState(9)

    def own(n):
        return "".join(chr(97 + k) for k in rng.randint(26, size=n))

    line, other = own(70), own(140)
    given = [own(60) + (line, other, line + " " * 90)[i % 3] + own(60) for i in range(3000)]
    docs = documents(spark, given)
    # A step sees few documents, as on a large input most steps see a passage seldom.
    dealt_out = docs.repartition(100, "doc_id")
    size = {}
    for bucket, payload in repeats.dealt(dealt_out, repeats.text_key(docs), 20_000).collect():
        content = pickle.loads(zstandard.ZstdDecompressor().decompress(bytes(payload)))[7]
        if bucket >= 0:
            size[bucket] = size.get(bucket, 0) + len(content)
    assert max(size.values()) < 2 * sum(size.values()) / len(size)
    found = {r[0]: tuple(r)[1:] for r in repeats.without_repeats(dealt_out, 20_000).collect()}
    assert found == plain_repeats(list(enumerate(given)))


def plain_components(rows):
    sets, root = {}, {}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for doc, text in sorted(rows):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        root[doc] = doc
        for other, theirs in sets.items():
            both = len(sets[doc] & theirs)
            if other != doc and both and 100 * both >= 75 * len(sets[doc] | theirs):
                a, b = find(doc), find(other)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates_against_brute_force(spark, texts, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    monkeypatch.setattr(near_dups, "ANCHORS", 2)
    rng = np.random.RandomState(3)
    base = [f"w{k}" for k in range(60)]
    chain, copies = list(base), []
    for _ in range(60):
        chain[rng.randint(60)] = f"n{rng.randint(1000)}"
        copies.append(" ".join(chain))
    rows = texts + [(20_000 + i, t) for i, t in enumerate(copies + ["A b", "a B", "c", None, " "])]
    docs = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(docs).collect()}
    assert found == plain_components(rows)


def test_rows_of_one_id_share_their_links(spark):
    one, two = "a b c d e f g h", "p q r s t u v w"
    docs = documents(spark, [one, two, one, two], ids=[5, 5, 3, 9])
    found = {(r.doc_id, r.component_id) for r in near_dups.near_duplicates(docs).collect()}
    assert found == {(5, 3), (3, 3), (9, 3)}
