import random
import zlib

import numpy as np
import pytest

from veriframe.llm import language
from veriframe.llm.queries import op6_language

from .texts import ROWS, frame


def slow_grams(text):
    s = f" {' '.join(text.lower().split())} "
    return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)}


def number(gram):
    return sum(ord(c) << 21 * i for i, c in enumerate(gram))


def test_kernel_equals_definition(monkeypatch):
    rng = random.Random(11)
    texts = ["".join(rng.choice("abé😀 \n") for _ in range(rng.randint(1, 80))) for _ in range(30)]
    for t in texts:
        assert language.grams(t).tolist() == sorted(map(number, slow_grams(t)))
    monkeypatch.setattr(language, "BLOCK", 7)
    assert all(language.grams(t).tolist() == sorted(map(number, slow_grams(t))) for t in texts)
    vocabulary, matrix, dropped = language.place_landmarks([language.grams(t) for t in texts[:5]])
    assert dropped == 0
    got = language.Model([], vocabulary, matrix, np.empty((5, 0))).kernel(texts)
    want = [[len(slow_grams(a) & slow_grams(b)) / (len(slow_grams(a)) * len(slow_grams(b))) ** 0.5 for b in texts[:5]] for a in texts]
    assert np.allclose(got, want, atol=1e-5)
    monkeypatch.setattr(language, "BATCH_BYTES", 1)
    assert np.allclose(language.Model([], vocabulary, matrix, np.empty((5, 0))).kernel(texts), want, atol=1e-5)


def test_awkward_rows_and_nothing_to_learn(spark):
    model = language.train(frame(spark))
    rows = language.identify(frame(spark), model).select("doc.doc_id", "doc.text", "lang_pred", "score").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    nothing = language.train(frame(spark, []))
    assert {r["lang_pred"] for r in language.identify(frame(spark), nothing).collect()} == {"und"}
    assert language.identify(frame(spark, []), model).count() == 0


def test_held_out_languages_change_nothing(spark):
    docs = [(i, f"{'uno dos tres' if i % 2 else 'one two three'} {i}", "es" if i % 2 else "en", "a") for i in range(120)]
    flipped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s) for i, t, lang, s in docs]
    a, b = (language.train(frame(spark, d)) for d in (docs, flipped))
    assert a.languages == b.languages == ["en", "es"] and np.array_equal(a.weights, b.weights)


def test_query_on_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_language(spark, sf).collect()
    assert len(rows) == 1000
    held = [(r["lang_pred"], truth[r["doc_id"]]) for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([a == b for a, b in held]) == pytest.approx(1, abs=0.05)


def test_landmarks_stay_under_their_bytes(monkeypatch):
    texts = ["abcd", "abce", "abxy", "zzz"]
    monkeypatch.setattr(language, "MODEL_BYTES", 4 * len(texts) * 6)
    vocabulary, matrix, dropped = language.place_landmarks([language.grams(t) for t in texts])
    assert dropped == len(set().union(*map(slow_grams, texts))) - 6 > 0
    assert len(vocabulary) == 6 and matrix.nbytes == language.MODEL_BYTES and number("ab") in vocabulary and number("ce") not in vocabulary


def test_languages_of_long_texts_only_are_learned(spark, monkeypatch):
    rng = random.Random(12)
    words = {"de": ["der", "und", "nicht", "schon", "zwischen", "über"], "en": ["the", "and", "not", "already", "between", "over"]}
    said = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))
    docs = [(i, said("de", 12_000), "de", "a") for i in range(40)] + [(100 + i, said("en", 30), "en", "a") for i in range(39)]
    assert min(len(t) for _, t, lang, _ in docs if lang == "de") > 60_000
    for most in (language.LANDMARK_GRAMS, 300):
        monkeypatch.setattr(language, "LANDMARK_GRAMS", most)
        model = language.train(frame(spark, docs))
        assert model.languages == ["de", "en"] and model.landmarks.shape[1] > 2
        got = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame(spark, docs), model).select("doc.doc_id", "lang_pred").collect()}
        assert got == {i: lang for i, _, lang, _ in docs}


def test_sketches_are_even_samples():
    found = np.arange(0, 5000, dtype=np.uint64) * np.uint64(3)
    some = language.sketch(found, 500)
    assert len(some) == 500 and (np.diff(some.astype(np.int64)) > 0).all() and np.isin(some, found).all()
    assert 150 < (some < 7500).sum() < 350 and (language.sketch(found, 5000) == found).all()
