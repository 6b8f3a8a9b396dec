import math
import random
import re
import zlib

import numpy as np
import pytest

from veriframe.llm import toxicity
from veriframe.llm.queries import op4_toxicity

from .texts import ROWS, frame


def test_gradient_descent_finds_the_toxic_feature():
    rng = random.Random(9)
    docs = []
    for _ in range(400):
        y = float(rng.random() < 0.3)
        clean = [(tuple(sorted(rng.sample(range(1, 6), 2))), rng.randint(1, 3)) for _ in range(4)]
        docs.append((y, 1.0, clean + ([((0, 3), 1)] if y else [])))
    w, b = toxicity.noisy_or_fit(docs, 6)
    assert w[0] > 3 * max(abs(w[1:])) and b < 0


def corpus(spark, n=800):
    rng = random.Random(10)
    words = ["".join(rng.choice("aeioutnrs") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        if bad:
            sentences[rng.randrange(len(sentences))] += " vileword" + rng.choice(["ing", "s", "ly", "ish"])
        docs.append((i, ". ".join(sentences) + ".", "en", "a"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_documents_and_sentences(spark):
    docs, labels = corpus(spark)
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, docs), table)
    rows = toxicity.score(frame(spark, docs), model).select("doc.doc_id", "doc.text", "score", "offending").collect()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2:
            assert (r["score"] >= 0.3) == ("vileword" in r["text"])
            assert [("vileword" in r["text"][x["start"] : x["end"]]) for x in r["offending"]] == ["vileword" in r["text"]] * len(r["offending"])
            assert bool(r["offending"]) == ("vileword" in r["text"])
    other = toxicity.train(frame(spark, docs), table)
    assert other.weights == model.weights and other.bias == model.bias


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = corpus(spark, 300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    fits = [toxicity.train(frame(spark, docs), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped)]
    assert fits[0].weights == fits[1].weights


def test_awkward_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark), none)
    rows = toxicity.score(frame(spark), model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(frame(spark, []), model).count() == 0
    assert toxicity.train(frame(spark, []), none).weights == {}


def test_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op4_toxicity(spark, sf).collect()
    assert len(rows) == 10_000
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = np.array([s for s, t in held if t]), np.array([s for s, t in held if not t])
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert pytest.approx(0.1, abs=0.1) == np.mean([r["predicted"] for r in rows])


@pytest.mark.parametrize("bag,long_and_clean", [(toxicity.BAG, False), (toxicity.BAG, True), (8, True)])
def test_a_class_of_long_texts_only_is_learned(spark, bag, long_and_clean):
    rng = random.Random(13)
    words = ["".join(rng.choice("aeioutnrs") for _ in range(5)) for _ in range(300)]
    said = lambda n: [" ".join(rng.choice(words) for _ in range(8)) for _ in range(n)]
    docs, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        sentences = said(1200) if bad or long_and_clean and i % 4 == 1 else said(rng.randint(1, 8))
        if bad:
            sentences[rng.randrange(len(sentences))] += " vileword" + rng.choice(["ing", "s", "ly"])
        docs.append((i, ". ".join(sentences) + ".", "en", "a"))
        labels.append((i, 1, int(bad)))
    assert min(len(t) for (_, t, *_), (*_, y) in zip(docs, labels, strict=True) if y) > 50_000
    model = toxicity.train(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), bag=bag)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, docs), model).select("doc.doc_id", "score").collect()}
    assert all(found[i] >= 0.3 for i in range(0, 240, 4)) and np.mean([found[i] < 0.3 for i in range(240) if i % 4]) > 0.95


def test_bags_stand_for_all_sentences():
    rng = random.Random(14)
    for most in (1, 3, 10, 500):
        found = toxicity.Counter({tuple(sorted(rng.sample(range(30), rng.randint(0, 4)))): rng.randint(1, 5) for _ in range(200)})
        got = toxicity.bounded(found, most)
        assert sum(got.values()) == sum(found.values()) and len(got) <= max(2 * most + 1, min(len(found), most))
        assert set(got) <= set(found) | {x[:1] for x in found} | {()}


def test_scores_equal_the_definition_over_a_table(spark):
    """Noisy-or of the sentences' logistic scores, sentence by sentence in plain Python."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def slow(text):
        stays = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            if sentence:
                z = model.bias + sum(model.weights.get(f, 0.0) for w in re.findall(r"\w+", sentence.lower()) for f in toxicity.features_of(w))
                stays *= 1 - 1 / (1 + math.exp(-z))
        return 1 - stays

    for r in toxicity.score(docs, model).select("doc.text", "score").collect():
        assert r["score"] == pytest.approx(slow(r["text"]), abs=1e-9)
