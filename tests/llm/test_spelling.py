import random
import re
import zlib
from collections import Counter

import pytest

from veriframe.llm import spelling
from veriframe.llm.queries import op11_spelling

from .texts import frame


def near(a: str, b: str) -> bool:
    """By the definition: one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(counts: dict[str, int]) -> dict[str, tuple]:
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, out = {}, {}
    for w, n in words.items():
        best = min((v for v in words if near(w, v)), key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, n, sum(near(w, v) for v in words), words[forms[w]] if forms[w] else None)
    return out


def counted(rows) -> Counter:
    out = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            out[low] += 1
    return out


def rows_of(df) -> dict:
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("seed,parts", [(0, None), (1, 7), (2, 3), (3, 40)])
def test_equals_brute_force_however_words_are_dealt(spark, monkeypatch, seed, parts):
    rng = random.Random(seed)
    alphabet = ["a", "b", "é"] if seed % 2 else ["a", "b"]
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(5, 10))) for _ in range(250)}
    counts = {w: rng.choice([4, 5, 5, 6, 7, 25, 30, 30, 150, 900, 5000]) for w in sorted(words)}
    if parts:
        monkeypatch.setattr(spelling, "PART_WORDS", -(-len(counts) // parts))
    got = rows_of(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == expected(counts)
    assert any(r[0] and r[0] != r[1] for r in got.values())


def test_nodes_have_one_number_in_all_parts(monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    for splitters in ([], [words[40]], words[20::30], ["b"], ["abz"], sorted(["a", "ab", "aba", *words[100::50]])):
        splitters = sorted(set(splitters))
        trie, numbers, ids = spelling.Trie(splitters), {}, []
        for w in words:
            part = sum(s <= w for s in splitters)
            place, nodes = trie.nodes(part, w)
            ids.append(part * spelling.SPAN + place)
            for d, node in enumerate(nodes):
                assert numbers.setdefault(w[:d], node) == node
        assert len(set(numbers.values())) == len(numbers)
        assert ids == sorted(set(ids))


def test_runs_of_one_letter_count_once(spark):
    counts = {"aaaaaa": 500, "aaaaaaa": 90, "aaaaaaaa": 5, "baaaaaa": 6, "aaabaaa": 30}
    assert rows_of(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == expected(counts)


def test_awkward_rows(spark):
    assert spelling.variants(spelling.count_words(frame(spark, []), drop_every=199)).count() == 0
    given = frame(spark)
    pairs = [(r["doc_id"], r["text"]) for r in given.select("doc_id", "text").collect()]
    got = spelling.count_words(given, drop_every=199)
    assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in counted(pairs).items() if len(w) >= 6}
    assert rows_of(spelling.variants(got)) == expected(counted(pairs))
    long = "x" * 3000
    counts = {long: 5, long[:-1] + "y": 40, long + "x": 5}
    assert rows_of(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == expected(counts)


def test_counts_passed_on_early_are_whole(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    rows = [(i, f"Spelling variant{'abcdefgh'[i % 8]} Étéété SPELLING", "en", "a") for i in range(50)]
    got = spelling.count_words(frame(spark, rows), drop_every=7)
    want = Counter()
    for k, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{k}:{low}".encode())
            want[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 7 == 0 else low] += 1
    assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 6}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(op11_spelling(spark, sf))
    assert got == expected(counted([tuple(r) for r in rows])) and len(got) > 100
