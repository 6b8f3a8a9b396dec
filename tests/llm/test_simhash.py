import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from veriframe.llm import simhash
from veriframe.llm.queries import op10_simhash

from .texts import ROWS, frame


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """doc_id to smallest reachable doc_id, by comparing all pairs of fingerprints."""
    unique = sorted(set(fps.values()))
    at = {f: i for i, f in enumerate(unique)}
    parent = list(range(len(unique)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    u = np.array(unique, np.uint64)
    for i in range(len(u)):
        for j in np.nonzero(np.bitwise_count(u[i] ^ u[:i]) <= 3)[0]:
            parent[find(i)] = find(int(j))
    least = {}
    for d, f in fps.items():
        r = find(at[f])
        least[r] = min(least.get(r, d), d)
    return {d: least[find(at[f])] for d, f in fps.items()}


def linked(spark, fps):
    unique = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in sorted(set(fps))], "fp long")
    named = {r["node"]: r["root"] for r in simhash.components(simhash.links(unique)).collect()}
    signed = {f: int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps}
    return {d: named.get(signed[f], signed[f]) for d, f in enumerate(fps)}


@pytest.mark.parametrize("part", [4096, 24])
def test_every_link_within_three_bits_is_found(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng, fps = random.Random(part), [0, (1 << 64) - 1, 7, 8]
    for _ in range(40):
        center = rng.getrandbits(64)
        fps += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(6)]
    dense = rng.getrandbits(64)
    fps += [dense ^ sum(1 << b for b in rng.sample(range(48), rng.randint(0, 6))) for _ in range(150)]
    got, want = linked(spark, fps), slow_components(dict(enumerate(fps)))
    assert sorted(map(sorted, grouped(got).values())) == sorted(map(sorted, grouped(want).values()))


@pytest.mark.parametrize("part", [17, 300])
def test_crowded_buckets_are_split_without_loss(spark, monkeypatch, part):
    """Thousands of fingerprints in one bucket, a neighbour with few plain rows, and clusters in both."""
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(3)
    half = rng.getrandbits(32) & ~(1 << 20)
    fps = {half | rng.getrandbits(32) << 32 for _ in range(3000)}
    near = [half | 1 << 20 | (f >> 32 ^ (1 << rng.randrange(32))) << 32 for f in sorted(fps)[:60]]
    fps |= {*near, *[f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for f in sorted(fps)[:400]]}
    fps = sorted(fps)
    got, want = linked(spark, fps), slow_components(dict(enumerate(fps)))
    classes = lambda m: Counter(frozenset(x) for x in [*grouped(m).values()])
    assert classes(got) == classes(want)
    unique = spark.createDataFrame([(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in fps], "fp long")
    cells = simhash.cells_of(unique)
    sizes = cells.groupBy(*simhash.CELL).count().agg({"count": "max"}).first()[0]
    assert sizes <= 3 * part + 200 and cells.count() < 37 * 37 * len(fps)


def grouped(m):
    out = {}
    for d, c in m.items():
        out.setdefault(c, []).append(d)
    return out


def test_many_copies_are_dealt_when_they_meet_their_component(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 20)
    rows = [(i, "", "en", "a") for i in range(100, 400)] + [(i, f"one two three {i % 7}", "en", "a") for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == slow_components({d: slow_fingerprint(t) for d, t, *_ in rows})


def test_ring_condition_holds_for_all_links():
    rng = random.Random(5)
    for _ in range(4000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        seg = [bin(x >> 16 * i & 0xFFFF).count("1") for i in range(4)]
        assert any(seg[i] == 0 and seg[i] + seg[(i + 1) % 4] <= 1 and seg[i] + seg[(i + 1) % 4] + seg[(i + 2) % 4] <= 2 for i in range(4))


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(60)] + [(1000 + i, 999) for i in range(80)] + [(5000, 4000), (5000, 4500), (4000, 5000)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got.get(i, i) == 0 for i in range(61)) and all(got.get(1000 + i) == 999 for i in range(80))
    assert got[5000] == 4000 and got[4500] == 4000


def test_awkward_rows(spark):
    rows = simhash.near_duplicates(frame(spark)).collect()
    assert len(rows) == len(ROWS)
    by_id = {r["doc_id"]: r for r in rows}
    for doc_id, text, *_ in ROWS:
        assert by_id[doc_id]["fp"] & (1 << 64) - 1 == slow_fingerprint(text)
    assert by_id[4]["component_id"] == by_id[5]["component_id"] == by_id[11]["component_id"] == 4
    assert by_id[None]["component_id"] is None
    kept = simhash.deduplicate(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, None} <= set(ids) and not {5, 11} & set(ids)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.deduplicate(frame(spark, [])).count() == 0


def test_query_equals_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {d: slow_fingerprint(t) for d, t in docs.items()}
    want = slow_components(fps)
    rows = op10_simhash(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", want[r["doc_id"]])
