import random
import re
from collections import Counter, defaultdict

import pytest

from veriframe.llm import mixing
from veriframe.llm.queries import op8_mixing

from .texts import ROWS, frame


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """By the stated rule itself: share out, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), [s for s in names]
    while open_ and left > 1e-9:
        whole = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / whole
        left = sum(max(0, target[s] - 2 * sizes[s]) for s in open_)
        target = {s: min(t, 2.0 * sizes[s]) for s, t in target.items()}
        open_ = [s for s in open_ if target[s] < 2 * sizes[s]]
    return target


def by_source(rows):
    sizes = defaultdict(int)
    for source, text in rows:
        sizes[source] += words(text)
    return sizes


def test_targets_and_copies_on_awkward_rows(spark):
    got = mixing.systematic_copies(frame(spark)).select("doc.doc_id", "doc.source", "size", "source_size", "target", "copies").collect()
    sizes = by_source((r[3], r[1]) for r in ROWS)
    want = targets(sizes)
    assert len(got) == len(ROWS)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2


def test_whole_table_follows_targets_and_reruns_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = op8_mixing(spark, sf).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op8_mixing(spark, sf).collect()))
    sizes = by_source((d["source"], d["text"]) for d in docs)
    want, source, taken = targets(sizes), {d["doc_id"]: d["source"] for d in docs}, defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.1)


def test_copies_step_once_for_each_whole_number_passed(spark):
    docs = [(i, "w " * (1 + i * i % 40), "en", f"s{i % 3}") for i in range(600)]
    got = mixing.systematic_copies(frame(spark, docs)).select("doc.source", "size", "target", "source_size", "copies").collect()
    for s in ("s0", "s1", "s2"):
        mine = [r for r in got if r["source"] == s]
        due = mine[0]["target"] / mine[0]["source_size"]
        assert {r["copies"] for r in mine} <= {int(due), int(due) + 1}
        assert abs(sum(r["copies"] for r in mine) - due * len(mine)) <= 1
        assert sum(r["copies"] * r["size"] for r in mine) == pytest.approx(mine[0]["target"], rel=0.05)


def test_mix_emits_rows_and_empty_table(spark):
    out = mixing.mix(frame(spark))
    assert out.columns == frame(spark).columns and out.count() > 0
    assert mixing.systematic_copies(frame(spark, [])).count() == 0


def test_any_order_of_rows_gives_the_same_mix(spark, monkeypatch):
    """Rows of one id and size, rows without an id, and ids whose buckets all collide."""
    rows = [(i % 40, f"{'w ' * (i % 5)}x{i}", "en", f"s{i % 3}") for i in range(300)] + [(None, f"y{i} z", "en", "s1") for i in range(50)]
    rows += [(7, "a b", None, "s0"), (7, "a b", "en", "s0"), (7, "a b", "de", "s0"), (7, None, "en", "s0"), (7, "", "en", "s0")] * 2
    for collide in (False, True):
        if collide:
            monkeypatch.setattr(mixing, "number", lambda digest: mixing.F.lit(5).cast("bigint") + mixing.F.length(digest) * 0)
        mixes = []
        for seed in range(3):
            random.Random(seed).shuffle(rows)
            mixes.append(Counter(mixing.mix(frame(spark, rows).repartition(3 + seed)).collect()))
        assert mixes[0] == mixes[1] == mixes[2]


def test_rows_without_an_id_are_dealt_over_buckets(spark):
    docs = frame(spark, [(None, f"y{i} z", "en", "s1") for i in range(200)])
    keys = docs.select(mixing.number(mixing.order_key(mixing.F.col("doc_id"), mixing.row_digest(docs.columns))).alias("h"))
    assert keys.selectExpr("h div 67108864 as bucket").distinct().count() > 40
