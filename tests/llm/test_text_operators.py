"""Operators 3, 4 and 6 against brute force, held-out accuracy, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from conftest import DATA
from llm_helpers import as_list, documents, edge_rows, prose

from lamina.llm import langid, quality, secrets
from lamina.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---- language


def test_bundle_is_the_sum_of_bound_trigrams():
    texts = ["Ab c!", "déjà VU vu", "", "123 --"]
    got = langid.bundle([t.encode() for t in texts], 256)
    for text, vector in zip(texts, got):
        want = np.zeros(256)
        for word in re.findall(r"[^\W\d_]+", text):
            marked = [0, *(ord(c.lower()) for c in word), 0]
            for a, b, c in zip(marked, marked[1:], marked[2:]):
                base = [langid.letter_vector(x, 256, langid.SEED) for x in (a, b, c)]
                want += np.roll(base[0], 2) * np.roll(base[1], 1) * base[2]
        assert np.array_equal(vector, want)


def test_a_long_text_is_the_sum_of_its_pieces(monkeypatch):
    text = prose(4, 3000).encode()
    want = langid.bundle([text], 128)
    monkeypatch.setattr(langid, "PIECE", 1000)
    monkeypatch.setattr(langid, "CELLS", 5000)
    assert np.array_equal(langid.bundle([text, b""], 128)[:1], want)


def test_a_long_word_is_not_cut(monkeypatch):
    raws = [("ab" * 900 + "déjà" * 300).encode(), ("x" * 1500 + " " + "yz" * 700).encode()]
    want = langid.bundle(raws, 128)
    monkeypatch.setattr(langid, "PIECE", 1000)
    assert np.array_equal(langid.bundle(raws, 128), want)


def test_held_out_accuracy(spark):
    docs = read(spark, f"{DATA}/sf0.01", "documents")
    got = langid.languages(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    held = [r for r in got if r.held_out and r.lang and r.lang_pred != "und"]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_held_out_languages_are_not_learned(spark):
    docs = read(spark, f"{DATA}/sf0.001", "documents")
    changed = docs.selectExpr("doc_id", "text", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, 'xx', lang) as lang", "source")
    assert as_list(langid.languages(changed)) == as_list(langid.languages(docs))


FOREIGN = ["αβγ δεζ ηθι κλμ νξο " * 20, "Привет мир это русский текст о погоде и людях", "日本語のテキストです。今日は天気がいい。", "zxqj kqwx vzzk qqjx " * 10, "12 34 !", ""]


def test_other_languages_go_and_prose_stays(spark):
    docs = read(spark, f"{DATA}/sf0.01", "documents").select("doc_id", "text", "lang", "source", "n_chars")
    more = documents(spark, [(5000 + i, t, None, "a", 0) for i, t in enumerate(FOREIGN)])
    kept = {r.doc_id for r in langid.keep_known(docs.union(more), train=langid.training_rows(docs)).collect()}
    assert not kept & set(range(5000, 6000))
    gone = [r.text for r in docs.collect() if r.doc_id not in kept]
    assert len(gone) <= 5 and all(len(t) < 40 for t in gone)


def test_language_odd_rows(spark):
    plain = as_list(langid.languages(documents(spark)))
    assert len(plain) == len(edge_rows())
    assert {r[2] for r in plain if r[0] in (2, 3, 4)} == {"und"}
    assert as_list(langid.languages(documents(spark, clash=True))) == plain
    assert langid.languages(documents(spark, [])).collect() == []
    nothing = documents(spark, [(1, "words", None, None, None)])
    assert [tuple(r)[2:] for r in langid.languages(nothing).collect()] == [("und", 0.0)]
    kept = langid.keep_known(documents(spark, clash=True), least_score=0)
    assert kept.columns == documents(spark, clash=True).columns
    assert {r.doc_id for r in kept.collect()} == {1, 5, 6, 7, 8, 9, None}


# ---- quality


def brute_quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 500 else len(lines) - len(set(lines))
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    places = {}
    for i, w in enumerate(windows):
        places.setdefault(w, []).append(i)
    covered = {j for found in places.values() if len(found) > 1 for i in found for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_repeat_words_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        assert quality.repeat_words(words) == brute_quality(b" ".join(words).decode())[4]


def test_quality_brute_force(spark):
    docs = read(spark, f"{DATA}/sf0.001", "documents").select("doc_id", "text").union(documents(spark).select("doc_id", "text"))
    want = sorted(((r.doc_id, *brute_quality(r.text)) for r in docs.collect()), key=repr)
    got = quality.quality(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_the_order_of_rules_changes_no_verdict():
    rng = random.Random(7)
    texts = [prose(i, 40).encode() for i in range(20)] + [b"", b"a " * 40, b"# $ % " * 20, b"!! what ... " * 15, "long".encode() * 300]
    rules = list(quality.RULES)
    want = [quality.first_rejection(quality.Features(t), quality.RULES) is None for t in texts]
    for _ in range(10):
        rng.shuffle(rules)
        assert [quality.first_rejection(quality.Features(t), tuple(rules)) is None for t in texts] == want
    assert sorted(map(id, quality.ordered(texts))) == sorted(map(id, quality.RULES))


def test_rules_are_ordered_by_rejections_per_cost():
    def rule(name: str, cost: float, rejects: bool):
        return quality.Rule(name, lambda f: (sum(range(int(cost))), 0 if rejects else 1)[1], least=1)

    rules = (rule("dear", 400_000, True), rule("cheap", 10, True), rule("never", 10, False))
    assert [r.name for r in quality.ordered([b"x"] * 5, rules)] == ["cheap", "dear", "never"]
    assert quality.ordered([], rules) == rules


def test_quality_odd_rows(spark):
    plain = as_list(quality.quality(documents(spark)))
    assert len(plain) == len(edge_rows()) and as_list(quality.quality(documents(spark, clash=True))) == plain
    assert quality.quality(documents(spark, [])).collect() == []
    kept = {r[0] for r in plain if r[-1]}
    assert {r.doc_id for r in quality.keep_good(documents(spark, clash=True)).collect()} == kept


# ---- secrets


def brute_base(text: str) -> list[tuple]:
    found = []
    at = 0
    word = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    while m := word.search(text, at):
        if len(m[1]) >= 6:
            found.append((m.start(), m.end(), "assign"))
        at = m.end()
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        found += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(found, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


SAMPLES = [
    'password = "hunter2hunter2" and api_key:abc', "PASSWD=abcdef;SECRET : 'a.b-c_d/e+f='", "token=AKIA" + "Z9" * 12, "AKIA" + "A" * 15, "AKIA" + "A" * 16,
    "deadbeef" * 8, "0" * 23, "0" * 24, "sha " + "a1" * 20, "123e4567-e89b-12d3-a456-426614174000", "secretſ=abcdef1", "toKen=abcdef1",
    "key Zx9Qw3Lk8Vb2Nm5Rt7Yp1 here", "an_identifier_with_words_only and/path/like/this/one", "é" * 5 + " api_key=" + "Ab1" * 9 + " \U0001f600 token: 'xxxxxx'",
]


@pytest.mark.parametrize("text", SAMPLES)
def test_base_spans_brute_force(text):
    base, every = secrets.scan(text)
    assert base == brute_base(text)
    assert [s for s in every if s[2] != "random"] == base


def test_random_strings_are_found_and_known_ones_left():
    found = lambda t: [t[a:b] for a, b, _ in secrets.random_spans(t)]
    assert found("key Zx9Qw3Lk8Vb2Nm5Rt7Yp1 here") == ["Zx9Qw3Lk8Vb2Nm5Rt7Yp1"]
    for known in ("a1" * 16, "a1" * 20, "A1" * 32, "123e4567-e89b-12d3-a456-426614174000", "2026-11-25-2026-11-25", "some_long_identifier_name", "internationalization", "version_release_2026"):
        assert found(f"see {known} there") == []


def random_key(seed: int, n: int, digits: str = "0123456789") -> str:
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + digits) for _ in range(n))


def test_keys_joined_to_words_are_found():
    path = "/home/deploy/projects/customer-service/configuration/production/credentials/"
    for i in range(100):
        key = random_key(i, 24)
        for before, after in ((path, ""), ("https://example.com/production/customer-service/settings/", ""), ("customer_service_production_key=", "/configuration/production")):
            at = [(a, b) for a, b, _ in secrets.random_spans(before + key + after)]
            assert at and at[0][0] <= len(before) and at[0][1] >= len(before + key)
    for known in (f"{path}123e4567-e89b-12d3-a456-426614174000", f"{path}2026/11/25/how-to-do-it-in-a-day"):
        assert secrets.random_spans(known) == []


def test_random_letters_without_digits_are_found():
    for i in range(100):
        for n in (16, 20, 32):
            key = random_key(i, n, "")
            assert secrets.random_spans(f"key {key} here") == [(4, 4 + n, "random")]


def test_secrets_brute_force(spark):
    docs = read(spark, f"{DATA}/sf0.001", "documents").select("doc_id", "text").union(documents(spark).select("doc_id", "text"))
    want = []
    for r in docs.collect():
        base = brute_base(r.text or "")
        counts = [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
        want.append((r.doc_id, *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()))
    got = secrets.find_secrets(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.spans.count("random:") == r.n_random and r.spans.count(":") == 2 * (r.n_assign + r.n_access + r.n_hex + r.n_random)


def test_redaction(spark):
    secret = "api_key=" + "Ab1" * 9
    rows = [(1, f"use {secret} now", "en", "a", 40), (2, "clean text", "en", "a", 999), (3, None, None, None, None), (None, "", None, None, 0)]
    docs = documents(spark, rows, clash=True)
    out = secrets.redact_secrets(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("use [SECRET] now", 16), 2: ("clean text", 999), 3: (None, None), None: ("", 0)}
    for text in SAMPLES:
        left = secrets.redact(text, secrets.scan(text)[1])
        assert not secrets.scan(left)[1]
    assert secrets.redact("abcdef", [(1, 3, "hex"), (2, 5, "random")], "#") == "a#f"


def test_secrets_odd_rows(spark):
    plain = as_list(secrets.find_secrets(documents(spark)))
    assert len(plain) == len(edge_rows()) and as_list(secrets.find_secrets(documents(spark, clash=True))) == plain
    assert secrets.find_secrets(documents(spark, [])).collect() == []


def test_a_very_long_run_is_scanned_in_linear_time():
    began = time.time()
    secrets.scan("password" * 100_000 + "a" * 500_000)
    assert time.time() - began < 30


def test_short_and_dotted_keys_are_found_and_plain_runs_are_not():
    keys = ["xKjQzWvPmNbRtLcYdHgF", "QzXvKjWqPmNbRtLcYdHgFsTa", "Zx9Qw3Lk8Vb2Nm5", "Zx9.Qw3Lk8Vb.2Nm5Rt7Yp1Kd9"]
    for key in keys:
        for text in (key, f"see {key}.", f"https://example.com/download/documents/archive/{key} x", f"NAME={key}"):
            found = [text[a:b] for a, b, _ in secrets.random_spans(text)]
            assert any(key.endswith(f) and len(f) >= len(key) - 4 for f in found), (text, found)
            assert all("download" not in f for f in found)
    for text in ("10.0.0.1234567", "version 1.2.3-alpha.45", "2024-01-01T00:00:00Z", "233.254.104.120", "reader.01@example.com", "d41d8cd98f00b204e9800998ecf8427e."):
        assert secrets.random_spans(text) == [], text


def test_rules_of_one_name_all_apply(spark):
    rules = (quality.Rule("a", lambda f: f.n_words, least=3), quality.Rule("a", lambda f: f.n_words, most=10_000))
    docs = documents(spark, [(1, "one", None, "a", 0), (2, "three words here", None, "a", 0), (3, None, None, "a", 0)])
    assert [r.doc_id for r in quality.keep_good(docs, rules).collect()] == [2]
    assert sorted(quality.order_of([b"one", b"three words here"], rules)) == [0, 1]
    assert quality.keep_good(documents(spark, []), rules).collect() == []


def test_the_sample_is_of_all_rows_and_of_long_texts_too(spark):
    rows = [(i, f"text {i} " + "x" * 100_000 * (i == 7), None, "a", 0) for i in range(40)] + [(None, None, None, None, None)]
    sample = quality.sample_of(documents(spark, rows), 20)
    assert len(sample) == 20 and sample == quality.sample_of(documents(spark, rows[::-1]), 20)
    assert max(map(len, quality.sample_of(documents(spark, rows), 100))) == 65_536
