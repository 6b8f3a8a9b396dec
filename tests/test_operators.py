"""Operators without SQL against brute force, sources and streams against what was written."""

import io
import math
import random
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe import schemas
from veriframe.operators import graph, groups, joins, learned, sampling
from veriframe.sources import readers, writers
from veriframe.streaming import incremental


def slow_near_pairs(texts, threshold):
    def grams(x):
        x = " ".join(x.lower().split())
        return Counter(x[i : i + n] for n in (3, 4, 5) for i in range(len(x) - n + 1))

    bags = {i: grams(x) for i, x in texts.items()}
    bags = {i: b for i, b in bags.items() if b}
    df = Counter(g for b in bags.values() for g in b)
    w = {i: {g: tf * (math.log((1 + len(bags)) / (1 + df[g])) + 1) for g, tf in b.items()} for i, b in bags.items()}
    norm = {i: math.sqrt(sum(v * v for v in x.values())) for i, x in w.items()}
    out = {}
    for a in w:
        for b in w:
            if a < b:
                s = sum(v * w[b].get(g, 0) for g, v in w[a].items()) / norm[a] / norm[b]
                if s >= threshold:
                    out[a, b] = s
    return out


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("абвгдеёж") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    texts = {}
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 20))]
        texts[f"a{i:02}"] = " ".join(base)
        if i % 2:
            base[rng.randrange(len(base))] = rng.choice(words)
            texts[f"b{i:02}"] = " ".join(base)
    texts["empty"] = ""
    got = groups.near_pairs(spark.createDataFrame(list(texts.items()), "id string, text string"), 0.8).collect()
    want = slow_near_pairs(texts, 0.8)
    assert {(r["a"], r["b"]): pytest.approx(r["similarity"]) for r in got} == want and want


def test_groups_follow_links_of_every_kind(spark):
    rows = [("A", "один вопрос", "x"), ("B", "один вопрос", "y"), ("C", "другое совсем", "y"), ("D", "ничего общего тут", "z"), ("E", "", "w")]
    cases = spark.createDataFrame(rows, "id string, q string, c string")
    got = {r["id"]: r["grp"] for r in groups.build_groups(cases, F.nullif("q", F.lit("")), F.col("c"), near=0.9).collect()}
    assert got["A"] == got["B"] == got["C"] and len({got["A"], got["D"], got["E"]}) == 3


def test_components(spark):
    edges = [(f"n{i + 1:03}", f"n{i:03}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert all(got.get(f"n{i:03}", f"n{i:03}") == "n000" for i in range(41)) and got["y"] == "x" and "z" not in got


def test_folds_keep_groups_whole_and_leave_out_the_oversized(spark):
    rows = [(f"c{i:03}", int(i % 10 < 7), f"g{0 if i < 40 else i // 2}") for i in range(200)]
    cases = spark.createDataFrame([(a, b) for a, b, _ in rows], "id string, y int")
    grp = spark.createDataFrame([(a, g) for a, _, g in rows], "id string, grp string")
    folds = groups.assign_folds(cases, grp, "y", 5, 2)
    placed = folds.join(grp, "id").collect()
    assert len(placed) == 2 * 160
    assert all(len({r["fold"] for r in placed if r["grp"] == g and r["repeat"] == 0}) <= 1 for g in {r["grp"] for r in placed})
    stats = groups.fold_stats(cases, folds, "y", 5, 2).collect()
    assert sum(r["size"] for r in stats) == 320 and all(27 <= r["size"] <= 37 and abs(r["pos_rate"] - 0.7) < 0.1 for r in stats)
    assert groups.check_folds(cases, folds, grp, "y", 5, 0.1, 0.2).count() == 0
    broken = folds.withColumn("fold", F.when(F.col("id") == "c040", (F.col("fold") + 1) % 5).otherwise(F.col("fold")))
    assert "error" in {r["level"] for r in groups.check_folds(cases, broken, grp, "y", 5).collect()}


def slow_head(x, y):
    """Weighted ridge logistic regression by plain Newton steps."""
    mean, std = x.mean(0), x.std(0)
    z = np.hstack([(x - mean) / np.where(std > 0, std, 1), np.ones((len(x), 1))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ beta)
    return lambda t: 1 / (1 + np.exp(-np.hstack([(t - mean) / np.where(std > 0, std, 1), np.ones((len(t), 1))]) @ beta))


def test_out_of_fold_heads_equal_separate_fits(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(90, 3)) * [1, 5, 0.1] + [0, 3, 9]
    y = (x[:, 0] + rng.normal(size=90) > 0.5).astype(int)
    fold = rng.integers(0, 3, (90, 2))
    df = spark.createDataFrame([(f"{i:02}", int(y[i]), *map(float, x[i])) for i in range(90)], "id string, y int, a double, b double, c double")
    folds = spark.createDataFrame([(f"{i:02}", r, int(fold[i, r])) for i in range(90) for r in range(2)], "id string, repeat int, fold int")
    got = {r["id"]: r["p"] for r in learned.oof_logistic(df, folds, ["a", "b", "c"], "y").collect()}
    want = np.zeros((90, 2))
    for r in range(2):
        for k in range(3):
            train = fold[:, r] != k
            want[~train, r] = slow_head(x[train], y[train])(x[~train])
    assert [got[f"{i:02}"] for i in range(90)] == pytest.approx(want.mean(1).tolist(), abs=1e-6)


def test_stratum_ranks_are_whole(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    ranks = sampling.stratum_rank(df, ["y"], "1").collect()
    for y in (0, 1):
        mine = sorted(r["rank"] for r in ranks if r["y"] == y)
        assert mine == list(range(1, len(mine) + 1)) and {r["size"] for r in ranks if r["y"] == y} == {len(mine)}


def test_readers(spark, tmp_path):
    assert readers.detect_format("a/b.JSONL") == "jsonl" and readers.detect_format("x.zip") == "csv"
    with pytest.raises(ValueError):
        readers.detect_format("x.parquet")
    (tmp_path / "s.jsonl").write_text('{"id": "1", "scores": {"m.a": 1}}\n\n{"id": "2", "p_faith": 0.5, "p_rel": 0.25, "meta": {"x": 1}}\n')
    got = {r["id"]: r["scores"] for r in readers.score_source(spark, str(tmp_path / "s.jsonl")).collect()}
    assert got == {"1": {"m.a": 1.0}, "2": {"legacy.p_faith": 0.5, "legacy.p_rel": 0.25}}
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n{"id": \n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), schemas.CASE).collect()
    assert readers.bad_lines(spark, str(tmp_path / "bad.jsonl"), schemas.CASE).count() == 1
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("__MACOSX/x.csv", "junk")
        z.writestr("t.csv", '﻿a,b\n1,"two\nlines"\n3,')
    (tmp_path / "t.zip").write_bytes(data.getvalue())
    assert [tuple(r) for r in readers.zipped_csv(spark, str(tmp_path / "t.zip"), ["a", "b"], strict=True).collect()] == [("1", "two\nlines"), ("3", "")]
    (tmp_path / "t.csv").write_bytes('﻿a,b\n1,"x ""y"""\n'.encode())
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "t.csv")).select("a", "b").collect()] == [("1", 'x "y"')]
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "id1.json").write_text('{"samples": ["a", "b"]}')
    assert [tuple(r) for r in readers.sample_cache(spark, str(tmp_path / "cache")).collect()] == [("id1", ["a", "b"])]
    (tmp_path / "runs" / "m3" / "zero").mkdir(parents=True)
    (tmp_path / "runs" / "m3" / "zero" / "val.jsonl").write_text("{}")
    assert [(r["prefix"], r["split"]) for r in readers.legacy_runs(spark, str(tmp_path / "runs")).collect()] == [("m3", "val")]
    assert readers.config("a: [1, 2]") == {"a": [1, 2]}
    with pytest.raises(ValueError):
        readers.config("")


def test_response_cache_misses(spark, tmp_path):
    choice = '{"text": "PASS", "finish_reason": "stop", "tokens": []}'
    (tmp_path / "r.json").write_text(f'{{"key": "k1", "choices": [{choice}]}}\n{{"key": "k2", "choices": [{choice}, {choice}]}}\n{{"key": "k3", "choi\n')
    cache = readers.response_cache(spark, str(tmp_path), 1)
    wanted = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    assert sorted(r["key"] for r in readers.misses(wanted, cache).collect()) == ["k2", "k3"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("1", 0.5)], "id string, s double")
    writers.provenance(df, str(tmp_path / "runs"), method="m", args={"b": 1, "a": 2}, seed=3, partial=False)
    assert spark.read.json(str(tmp_path / "runs")).first()["n"] == 1
    writers.cache_entries(spark.createDataFrame([("k", 1)], "key string, v int"), str(tmp_path / "c"))
    writers.cache_entries(spark.createDataFrame([("k", 2)], "key string, v int"), str(tmp_path / "c"))
    assert [tuple(r) for r in writers.newest(spark.read.parquet(str(tmp_path / "c"))).collect()] == [("k", 2)]
    with pytest.raises(Exception, match="no interval"):
        writers.report(spark.createDataFrame([(0.5, None, 0.6)], "value double, lo double, hi double"), method="m", variant="v").collect()
    assert writers.report(spark.createDataFrame([(0.5, 0.4, 0.6)], "value double, lo double, hi double"), method="m", variant="v").first()["primary"]["ci95"] == [0.4, 0.6]


def test_stream_scores_each_id_once(spark, tmp_path):
    source, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    score = lambda df: df.select("id", F.length("answer").cast("double").alias("score"))
    for part in ([("1", "a"), ("2", "bb")], [("2", "bb"), ("3", "ccc"), ("3", "ccc")]):
        spark.createDataFrame(part, "id string, answer string").write.mode("append").json(source)
        incremental.score_stream(spark, source, "id string, answer string", sink, check, score).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.schema("id string, score double").json(sink).collect()) == [("1", 1.0), ("2", 2.0), ("3", 3.0)]


def test_join_counted_deals_hot_keys_and_keeps_all_rows(spark):
    rows = [(1, i) for i in range(500)] + [(2, 0), (2, 0), (3, 1), (None, 7)]
    left = spark.createDataFrame(rows, "k long, v long")
    table = spark.createDataFrame([(1, "a", 500), (2, "b", 2), (4, "d", 0), (None, "n", 1)], "k long, name string, n long")
    for limit in (1, 50, 1000):
        got = Counter(map(tuple, joins.join_counted(left, table, "k", "n", F.col("v"), limit).select("k", "v", "name").collect()))
        assert got == Counter((k, v, {1: "a", 2: "b"}[k]) for k, v in rows if k in (1, 2))
    assert joins.join_counted(left.limit(0), table, "k", "n", F.col("v")).count() == 0
    assert joins.join_counted(left, table.limit(0), "k", "n", F.col("v")).count() == 0
