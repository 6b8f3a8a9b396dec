import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.operators import grams, groups, joins


def slow_pairs(texts, threshold):
    """Cosine of all pairs by definition: counts of character grams times smoothed idf."""
    def grams(t):
        s = " ".join(t.lower().split())
        return Counter(s[i : i + n] for n in (3, 4, 5) for i in range(len(s) - n + 1))

    tf = [grams(t) for _, t in texts]
    df = Counter(g for c in tf for g in c)
    n = sum(bool(c) for c in tf)
    w = [{g: k * (np.log((1 + n) / (1 + df[g])) + 1) for g, k in c.items()} for c in tf]
    norm = [np.sqrt(sum(x * x for x in v.values())) for v in w]
    out = {}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if norm[i] and norm[j]:
                s = sum(x * w[j].get(g, 0) for g, x in w[i].items()) / norm[i] / norm[j]
                if s >= threshold:
                    out[tuple(sorted((texts[i][0], texts[j][0])))] = s
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéо") for _ in range(rng.randint(2, 6))) for _ in range(30)]
    texts = ["the same beginning of all " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(n)]
    for i in range(0, n - 1, 3):  # near copies
        t = list(texts[i])
        t[rng.randrange(len(t))] = rng.choice("xyz")
        texts[i + 1] = "".join(t) + rng.choice(["", " end"])
    return [(f"t{i:03}", t) for i, t in enumerate(dict.fromkeys(texts))]


@pytest.mark.parametrize("seed,threshold,postings", [(0, 0.9, 2000), (1, 0.9, 4), (2, 0.7, 9), (3, 0.5, 3)])
def test_pairs_equal_all_pairs_with_hot_grams_in_blocks(spark, monkeypatch, seed, threshold, postings):
    monkeypatch.setattr(groups, "POSTINGS", postings)
    texts = corpus(seed, 70)
    got = {(r["a"], r["b"]): r["similarity"] for r in groups.near_pairs(spark.createDataFrame(texts, "id string, text string"), threshold).collect()}
    want = slow_pairs(texts, threshold)
    assert got == pytest.approx(want) and len(want) > 5


def test_blocks_of_a_hot_key_meet_once_each_and_stay_small(spark, monkeypatch):
    rows = spark.range(600).selectExpr("cast(id as string) id", "if(id < 500, 'hot', concat('k', id % 7)) k").union(spark.createDataFrame([("x", None), (None, "hot"), ("5", "hot")], "id string, k string"))
    met = joins.self_pairs(rows, "k", "id", F.lit(True), 40)
    found = Counter((r["a_id"], r["b_id"]) for r in met.collect())
    by = {}
    for r in rows.where("id is not null and k is not null").collect():
        by.setdefault(r["k"], []).append(r["id"])
    want = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    assert found == want
    plan = joins.self_pairs(rows, "k", "id", F.lit(True), 40)._jdf.queryExecution().optimizedPlan().toString()
    assert "_low" in plan and "Cartesian" not in plan


def test_texts_and_not_their_grams_go_to_disk(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    texts = [(f"t{i:03}", " ".join(rng.choice(words) for _ in range(300))) for i in range(300)]
    df = spark.createDataFrame([*texts, ("u", texts[0][1][:-9]), ("v", ""), ("w", "ab")], "id string, text string")
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    assert [(r["a"], r["b"]) for r in groups.near_pairs(df).collect()] == [("t000", "u")]
    assert size() - before < 2 * sum(len(t) for _, t in texts)


@pytest.mark.parametrize("common,chars", [(40, 300), (0, 10**6)])
def test_texts_bring_counts_of_rare_grams_and_blocks_meet_once(spark, monkeypatch, common, chars):
    monkeypatch.setattr(grams, "COMMON", common)
    monkeypatch.setattr(grams, "BLOCK_CHARS", chars)
    texts = [*corpus(4, 50), ("u0", "ѩѩѩѩѩ ѭѭѭ"), ("u1", "😀😀😀x"), ("u2", "😀😀😀X  ")]
    found = groups.near_pairs(spark.createDataFrame(texts, "id string, text string"), 0.6).collect()
    got = {(r["a"], r["b"]): r["similarity"] for r in found}
    assert got == pytest.approx(slow_pairs(texts, 0.6)) and len(got) == len(found) > 5 and got["u1", "u2"] == pytest.approx(1)
