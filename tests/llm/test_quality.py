import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from veriframe.llm import quality
from veriframe.llm.queries import op3_quality

from .texts import LONG, ROWS, frame


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def slow_kept(texts, limits=quality.Limits()):
    """By the stated rule itself, over a list of texts."""
    pack = zstandard.ZstdCompressor(level=limits.level).compress
    cut = []
    for t in texts:
        data = (t or "").encode()
        n = len(data) // limits.chunk
        parts = [data] if n < 2 else [data[i * limits.chunk : (i + 1) * limits.chunk if i < n - 1 else len(data)] for i in range(n)]
        cut.append([(len(p), len(pack(p))) for p in [data, *parts]])
    place = lambda n: math.floor(math.log2(max(n, 1)) * limits.steps)
    groups, bands = defaultdict(list), {}
    for n, packed in {x for t, c in zip(texts, cut, strict=True) if not brute(t)[-1] for x in c}:
        groups[place(n)].append(math.floor(n / packed * quality.BINS))
    found = {k: (len(v), *((x + 0.5) / quality.BINS for x in np.percentile(v, [25, 50, 75]))) for k, v in groups.items()}
    for k in {place(n) for c in cut for n, _ in c}:
        near = {j: v[0] * limits.decay ** abs(j - k) for j, v in found.items() if abs(j - k) <= limits.reach}
        others = sum(w for j, w in near.items() if j != k)
        near = {j: w if j == k else w * min(1, limits.support / max(1e-9, others)) for j, w in near.items()}
        if near:
            mean = lambda f: sum(near[j] * f(found[j]) for j in near) / sum(near.values())
            m = mean(lambda v: v[2])
            wide = max(limits.spread * mean(lambda v: ((v[3] - v[1]) / 1.349) ** 2 + (v[2] - m) ** 2) ** 0.5, limits.slack * m)
            bands[k] = m - wide, m + wide, sum(near.values()) / (sum(near.values()) + limits.support)

    def fits(n, packed):
        _, low, high = next(x for x in limits.outer if n <= x[0])
        a, b, share = bands.get(place(n), (low, high, 0))
        return max(share * a + (1 - share) * low, low) <= n / packed <= min(share * b + (1 - share) * high, high)

    odd = lambda c: sum(not fits(*x) for x in c[1:])
    return [not brute(t)[-1] and fits(*c[0]) and odd(c) <= limits.odd_chunks * (len(c) - 1) for t, c in zip(texts, cut, strict=True)]


def test_base_equals_brute_force_on_awkward_rows(spark):
    rng = random.Random(1)
    extra = [(100 + k, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + "\n\x1c  x\n", "en", "a") for k in range(60)]
    rows = quality.assess(frame(spark, [*ROWS, *extra])).select("doc.text", *NAMES).collect()
    assert len(rows) == len(ROWS) + 60
    for r in rows:
        assert tuple(r[n] for n in NAMES) == brute(r["text"])


def test_bands_reject_repeats_and_noise_but_keep_prose(spark):
    rng = random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    noise = " ".join("".join(rng.choice(alphabet) for _ in range(60)) for _ in range(400))
    repeats = " ".join(f"again and again {i % 3} the same" for i in range(3000))
    vocabulary = ["".join(rng.choice(["the", "an", "er", "on", "ti", "re", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(3000))
    out = {r["doc_id"]: r["kept"] for r in quality.assess(frame(spark, [(1, noise, "en", "a"), (2, repeats, "en", "a"), (3, prose, "en", "a")])).select("doc.doc_id", "kept").collect()}
    assert out == {1: False, 2: False, 3: True}


def test_stage_keeps_columns_and_empty_table(spark):
    assert quality.keep(frame(spark)).columns == frame(spark).columns
    assert quality.assess(frame(spark, [])).count() == 0
    assert quality.assess(frame(spark, [(1, LONG * 5, "en", "a")])).collect()[0]["n_words"] == len((LONG * 5).split())


def test_query_over_the_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_quality(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[n] for n in NAMES) == brute(docs[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    assert pytest.approx(1, abs=0.4) == sum(r["kept"] for r in rows) / len(rows)


def test_kept_equals_brute_force_over_a_table_and_the_bands_decide(spark):
    sf = "/root/testdata/sf0.1"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = dict(zip([d for d, _ in docs], slow_kept([t for _, t in docs]), strict=True))
    rows = {r["doc_id"]: r for r in op3_quality(spark, sf).collect()}
    assert {d: r["kept"] for d, r in rows.items()} == want
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    reached = {d: r["kept"] for d, r in rows.items() if not r["base_failed"] and good.get(d) is not None}
    assert sum(reached[d] for d in reached if good[d] == 1) > 0.99 * sum(good[d] == 1 for d in reached)
    assert sum(not reached[d] for d in reached if good[d] == 0) > 0.5 * sum(good[d] == 0 for d in reached)


def test_copies_have_one_voice(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(190, 200))) for _ in range(120)]
    copied = " ".join(rng.choice(words[:25]) for _ in range(400))[: len(prose[0])]
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate([*prose, *[copied] * 2000])])
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(docs).select("doc.doc_id", "kept").collect()}
    assert sum(kept[i] for i in range(120)) >= 118 and not any(kept[i] for i in range(120, 2120))
    assert quality.fit(quality.measure(frame(spark, []))) == {}


def test_bands_tighten_steadily_with_texts(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(195)) for _ in range(80)]
    limits, bands = quality.Limits(), []
    measured = quality.assess(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).select("doc.doc_id", "base_failed", "n_bytes", "packed", "chunks").collect()
    schema = "doc_id long, base_failed boolean, n_bytes long, packed long, chunks array<struct<n_bytes:long,packed:long>>"
    k = math.floor(math.log2(measured[0]["n_bytes"]) * limits.steps)
    for n in (1, 10, 49, 50, 51, 80):
        low, _, share = quality.fit(spark.createDataFrame(measured[:n], schema))[k]
        bands.append(share * low + (1 - share) * 1.15)
    assert all(a <= b + 0.02 for a, b in zip(bands, bands[1:], strict=False)) and bands[0] < 1.3 < bands[-1]
    assert max(bands[2:5]) - min(bands[2:5]) < 0.05
    alone = quality.fit(spark.createDataFrame(measured[:60], schema))
    assert alone[k - 3][2] > 0 and alone[k - 3][2] < alone[k - 1][2] < alone[k][2]  # rare lengths borrow
