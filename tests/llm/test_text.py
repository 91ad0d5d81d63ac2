"""Operators 3, 4, 5, 7 and 10."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import bpe, ctph, pii
from panelforge.llm.langid import N, Filters, detect_languages, fit_languages, grams
from panelforge.llm.quality import fit_quality, fold, keep_good, quality_scores

from .common import awkward, docs, empty, prose

SF = "/root/testdata/sf0.01"


# 3 ---------------------------------------------------------------------------

def reference_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.resolve(None)), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_tiktoken(text):
    tok, table = bpe.coder(None, None)
    ids = tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
    assert ids == reference_encoding_cached().encode_ordinary(text)
    assert bpe.decode_bytes(ids, table).decode() == text


_kept = []


def reference_encoding_cached():
    if not _kept:
        _kept.append(reference_encoding())
    return _kept[0]


def test_bpe_tables(spark):
    table, want = awkward(spark), reference_encoding_cached()
    got = sorted(map(tuple, bpe.bpe_digest(table).collect()), key=str)
    rows = []
    for r in table.collect():
        ids = want.encode_ordinary(r.text or "")
        rows.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(rows, key=str)
    assert bpe.bpe_digest(empty(spark)).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(table)).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id) == sorted((r.doc_id, r.text or "") for r in table.collect() if r.doc_id)


def test_bpe_offsets_cover_split_characters(spark):
    row = bpe.bpe_encode(docs(spark, ["x 🙂 漢"]), offsets=True).first()
    assert max(row.ends) == 5 and all(0 <= a < b <= 5 for a, b in zip(row.starts, row.ends, strict=True))


def test_another_vocabulary(spark):
    tok, table = bpe.coder("byte_bpe_multi_50k.tiktoken", None)
    assert bpe.decode_bytes(tok.encode("für elle", add_special_tokens=False).ids, table) == "für elle".encode()


# 4 ---------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="aB@.-+0123456789 ()%é/:", max_size=70))
def test_base_spans_equal_the_expressions(text):
    assert [x for x in pii.find_pii(text) if x[1] < 4] == brute_spans(text)


def test_added_spans_and_masks():
    text = "see https://u:p@host.example/x?y=1). IBAN: DE89 3704 0044 0532 0130 00, token = \"ab12cd34\" and 4111 1111 1111 1111"
    kinds = {pii.KINDS[k]: text[s:e] for s, k, e in pii.find_pii(text)}
    assert kinds["url"] == "https://u:p@host.example/x?y=1" and kinds["card"] == "4111 1111 1111 1111"
    assert [text[s:e] for s, k, e in pii.find_pii(text) if pii.KINDS[k] == "account"][-1] == "ab12cd34"
    masked = pii.mask_pii(text, pii.find_pii(text))
    assert "4111" not in masked and "ab12cd34" not in masked and "<CARD>" in masked


def test_pii_tables(spark):
    table = awkward(spark)
    got = pii.pii_spans(table, text=True).collect()
    assert len(got) == table.count() and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert sum(r.masked is None for r in got) == sum(r.text is None for r in table.collect())
    assert pii.pii_spans(empty(spark)).count() == 0
    row = pii.pii_spans(docs(spark, ["é a.b@c.de 1.2.3.4"])).first()
    assert row.spans == "email:2:10,ip:11:18" and (row.n_email, row.n_ip) == (1, 1)
    assert row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
    assert pii.mask_column(table).schema == table.schema


def test_pii_on_the_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(r.text)) for r in table.collect()}
    assert {r.doc_id: r.base_sha256 for r in pii.pii_spans(table).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


# 5 ---------------------------------------------------------------------------

def test_quality_held_out(spark):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_quality(table, labels, train=fold("doc_id", 3) != 1)
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    got = {r.doc_id: r for r in quality_scores(table, model).collect()}
    assert len(got) == table.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert np.mean([got[i].predicted == q for i, q in truth.items()]) >= 0.95
    kept = keep_good(table, model)
    assert kept.schema == table.schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    again = fit_quality(table.repartition(5), labels.repartition(3), train=fold("doc_id", 3) != 1)
    assert np.allclose(again.weights, model.weights)


def test_quality_scores_equal_brute_force(spark):
    """Dictionaries, compressed sizes and scores worked out anew, row by row, without the operator's helpers."""
    import math
    import struct

    import xxhash
    import zstandard

    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_quality(table, labels, train=fold("doc_id", 3) != 1)
    texts = {r.doc_id: r.text for r in table.collect()}
    order = lambda i: (struct.unpack("<q", xxhash.xxh64(struct.pack("<q", i), seed=42).digest()[::-1])[0], i)
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    raw = []
    for y in (0, 1):
        drawn = sorted((i for i, q in known.items() if q == y), key=order)[::2]
        raw.append("\n".join(texts[i] for i in drawn if len(texts[i].encode()) <= 20_000).encode())
    assert (model.bad, model.good) == tuple(raw)
    sizes = []
    for text in texts.values():
        both = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress((text or "").encode())) for d in raw]
        sizes.append((len((text or "").encode()), *both))
    got = {r.doc_id: r.score for r in quality_scores(table, model).collect()}
    for i, (n, c0, c1) in zip(texts, sizes, strict=True):
        gap, size = (c0 - c1) / (c0 + c1), math.log(1 + n) / 10
        z = sum(w * x for w, x in zip(model.weights, (1, gap, (c0 - c1) / (n + 20), c1 / (n + 20), size, gap * size), strict=True))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_logistic_fit_is_at_the_optimum():
    from panelforge.llm.quality import fit_logistic

    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 3))])
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [0.3, 2.0, -1.0, 0.0])))).astype(float)
    w = fit_logistic(x, y)
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 1e-3 * w).max() < 1e-6


def test_quality_without_labels_is_a_constant(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    model = fit_quality(awkward(spark), none)
    assert {r.score for r in quality_scores(awkward(spark), model).collect()} == {0.5}
    good = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 7)], "doc_id bigint, quality int")
    assert {r.score for r in quality_scores(awkward(spark), fit_quality(awkward(spark), good)).collect()} == {1.0}
    assert quality_scores(empty(spark), model).count() == 0


def test_quality_on_awkward_rows(spark):
    rng = random.Random(1)
    texts = {i: prose(rng, 60) if i % 2 else "%%% !!! " * 40 + str(i) for i in range(100, 160)}
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, quality int")
    model = fit_quality(docs(spark, texts), labels)
    assert quality_scores(awkward(spark), model).count() == awkward(spark).count()


# 7 ---------------------------------------------------------------------------

def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_equal_brute_force():
    rng = np.random.default_rng(0)
    left = [rng.integers(0, 4, rng.integers(0, 65)).astype(np.uint8) for _ in range(200)]
    right = [rng.integers(0, 4, rng.integers(0, 65)).astype(np.uint8) for _ in range(200)]
    assert ctph.edit_distances(left, right).tolist() == [levenshtein(a.tolist(), b.tolist()) for a, b in zip(left, right, strict=True)]


def test_fingerprints_ignore_what_stands_beside_a_text():
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (0, 1, 5, 60, 700)] + ["Der " * 300, "é" * 50]
    alone = [ctph.written(ctph.fingerprints_of([t])[0]) for t in texts]
    assert alone == [ctph.written(f) for f in ctph.fingerprints_of(texts)]
    for f in ctph.fingerprints_of(texts):
        back = ctph.read_back(ctph.written(f))
        assert back[0] == f[0] and np.array_equal(back[1], f[1]) and len(f[1]) <= ctph.MOST
        assert ctph.likeness([f], [f])[0] == 1.0


def plain_prints(text):
    """Block size and signatures of a text, byte by byte: the definition, without the operator's arrays."""
    mask, data = (1 << 64) - 1, text.encode()

    def mixed(x):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * times) & mask
        return x ^ (x >> 31)

    code = [mixed((b + 0x9E3779B97F4A7C15) & mask) for b in range(256)]
    ones = []
    for i in range(len(data)):
        h = 0
        for j in range(i - 6, i + 1):
            h = (h * 0x01000193 + (code[data[j]] >> 32 if j >= 0 else 0)) & 0xFFFFFFFF
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        h ^= h >> 12
        ones.append(min(30, (len(t) - len(t.rstrip("1"))) if (t := f"{h:032b}") else 0))
    level = 0
    while sum(x >= level for x in ones) >= 64:
        level += 1
    prints = []
    for size in range(level, level + 3):
        cuts = [i + 1 for i, x in enumerate(ones) if x >= size]
        cuts = cuts if cuts and cuts[-1] == len(data) else [*cuts, len(data)]
        letters, a = "", 0
        for b in cuts if data else []:
            total = 0
            for k, byte in enumerate(data[a:b]):
                total = (total + code[byte] * pow(0x5851F42D4C957F2D, k, 1 << 64)) & mask
            letters += ctph.LETTERS[mixed((total + b - a + 0x9E3779B97F4A7C15) & mask) >> 58]
            a = b
        prints.append(letters)
    return ":".join([str(1 << level), *prints])


def test_fingerprints_equal_a_plain_reading_of_the_definition():
    rng = random.Random(6)
    for text in ["", "a", "abcdefg", "é ü 漢字 🙂", prose(rng, 40), prose(rng, 900), "Der " * 400, "ab" * 3000]:
        assert ctph.written(ctph.fingerprints_of([text])[0]) == plain_prints(text)


def test_likeness_is_the_best_over_shared_sizes():
    rng = random.Random(7)
    pairs = [(prose(rng, n), prose(rng, m)) for n, m in ((30, 40), (30, 900), (100, 160), (5, 5000))] + [((t := prose(rng, 300)), t + " more")]
    for x, y in pairs:
        fx, fy = (plain_prints(t).split(":") for t in (x, y))
        shared = [(u, v) for k, u in enumerate(fx[1:]) for m, v in enumerate(fy[1:]) if int(fx[0]) << k == int(fy[0]) << m]
        want = max((1 - levenshtein(u, v) / max(len(u), len(v)) for u, v in shared), default=0.0)
        assert ctph.likeness(ctph.fingerprints_of([x]), ctph.fingerprints_of([y]))[0] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("parts", [1, 4])
def test_edited_rows_equal_brute_force(spark, parts):
    rng = random.Random(3)
    texts = {i * 3: prose(rng, rng.randrange(0, 200)) for i in range(150)}
    got = {r.doc_id: r for r in ctph.ctph_edited(docs(spark, texts, parts)).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        f, e, a = ctph.fingerprints_of([t, edited, after])
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), ctph.written(f), ctph.written(e))
        assert r.near_edited == ctph.likeness([f], [e])[0] and r.near_next == ctph.likeness([f], [a])[0]


def test_edited_rows_on_awkward_rows(spark):
    table = awkward(spark)
    got = ctph.ctph_edited(table).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in table.collect())
    assert ctph.ctph_edited(empty(spark)).count() == 0
    one = ctph.ctph_edited(docs(spark, {5: "abcdefgh"})).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0
    assert ctph.ctph_fingerprints(table).count() == table.count()


# 10 --------------------------------------------------------------------------

def test_language_held_out(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    filters = fit_languages(table, train=fold("doc_id", 4) != 2)
    truth = {r.doc_id: r.lang for r in table.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    got = {r.doc_id: r for r in detect_languages(table, filters).collect()}
    assert np.mean([got[i].lang_pred == lang for i, lang in truth.items()]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_masks_lose_no_language():
    f = Filters([f"l{i}" for i in range(11)], bits=14)
    own = [grams(np.frombuffer(f"text of language {i} only".encode(), np.uint8)) for i in range(11)]
    for i, h in enumerate(own):
        f.add(i, h)
    f.close()
    assert all(((f.masks(h) >> np.uint16(i)) & 1).all() for i, h in enumerate(own))
    assert (f.rates > 0).all() and (f.rates < 1).all()


def test_language_counts_equal_brute_force(spark):
    texts = ["the cat sat on the mat and the dog", "der hund und die katze sind da", "x", "", "12 34", "the dog und die katze"]
    table = spark.createDataFrame([(i, t, "en" if i == 0 else "de" if i == 1 else None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    f = fit_languages(table)
    got = {r.doc_id: r for r in detect_languages(table, f).collect()}
    held = [{t[i:i + n] for t in [f" {texts[k]} "] for n in range(1, N + 1) for i in range(len(t) - n + 1)} for k in (1, 0)]
    for i, t in enumerate(texts):
        if any(c.isalpha() for c in t):
            counts = [0, 0]
            for own, n in ((t, N), *((f" {t} ", n) for n in range(N, 1, -1)), (t, 1)):
                counts = [sum(own[j:j + n] in g for j in range(len(own) - n + 1)) for g in held]
                if max(counts):
                    break
            assert got[i].lang_pred == f.languages[int(np.argmax(counts))]
            assert got[i].score == pytest.approx(max(counts) / sum(counts) if sum(counts) else 0.0, abs=1e-3)
        else:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert len(grams(np.frombuffer(b"abc", np.uint8))) == 0 and N == 6


def test_more_languages_than_bits_of_a_word(spark):
    words = {f"l{k:03d}": [hashlib.sha256(f"{k} {i}".encode()).hexdigest()[:9] for i in range(30)] for k in range(150)}
    rows = [(k * 10 + i, " ".join(w), name) for k, (name, w) in enumerate(words.items()) for i in range(2 + k % 3)]
    f = fit_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert f.languages == sorted(words) and f.main.words.shape[1] == 3
    unseen = [(k, " ".join(w[5:25]), None) for k, w in enumerate(words.values())]
    got = detect_languages(spark.createDataFrame(unseen, "doc_id bigint, text string, lang string"), f).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == list(words)


def test_short_texts_have_a_language(spark):
    f = fit_languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = {0: "the", 1: "und", 2: "привет", 3: "que", 4: "der die", 5: "les"}
    got = {r.doc_id: r for r in detect_languages(docs(spark, texts), f).collect()}
    assert [got[i].lang_pred for i in (0, 1, 4)] == ["en", "de", "de"] and all(got[i].score > 0 for i in (0, 1, 3, 4, 5))
    assert (got[2].lang_pred, got[2].score) == (f.languages[f.usual], 0.0)


def test_language_on_awkward_rows(spark):
    table = awkward(spark)
    got = detect_languages(table, fit_languages(table)).collect()
    assert len(got) == table.count()
    assert {r.lang_pred for r in detect_languages(table, fit_languages(empty(spark))).collect()} == {"und"}
    assert detect_languages(empty(spark), fit_languages(table)).count() == 0
