import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veriframe.operators import diffs, perchunk
from veriframe.sources import samples


def unit(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32


def test_chunks_are_judged_in_batches_and_fail_alone(spark):
    rows = [("a", "q", "x", "[CHUNK 1]\none\n\n[CHUNK 2]\nbad\n\n[CHUNK 3]\nthree"), ("b", None, "y", "plain"), ("c", "q", "z", ""), ("d", "q", "z", None), ("a2", "q", None, "[CHUNK 1]\nshort")]

    def scorer(asked):
        if len(asked) > 1 and any("short" in c for *_, c in asked):
            return [0.5]
        if any(c == "bad" for *_, c in asked):
            raise RuntimeError("refused")
        return [unit(f"{q}|{a}|{c}") for q, a, c in asked]

    cases = spark.createDataFrame([(*r, 1) for r in rows], "id string, question string, answer string, context string, chunk int")
    for batch in (1, 2, 16):
        got = {(r["id"], r["chunk"]): (r["score"], r["error"]) for r in perchunk.judged_chunks(cases, scorer, batch).collect()}
        assert got == {("a", 1): (unit("q|x|one"), None), ("a", 2): (None, "RuntimeError: refused"), ("a", 3): (unit("q|x|three"), None), ("b", 1): (unit("|y|plain"), None), ("a2", 1): (unit("q||short"), None)}
        by = {r["id"]: r for r in perchunk.by_case(perchunk.judged_chunks(cases, scorer, batch)).collect()}
        assert (by["a"]["n_chunks"], by["a"]["n_failed"], by["a"]["max_chunk_score"]) == (3, 1, max(unit("q|x|one"), unit("q|x|three"))) and by.keys() == {"a", "b", "a2"}
    many = spark.createDataFrame([("m", "q", "a", "\n\n".join(f"[CHUNK {i}]\nc{i}" for i in range(1, 60)))], "id string, question string, answer string, context string")
    assert [r["chunk"] for r in perchunk.judged_chunks(many, scorer, 7).orderBy("chunk").collect()] == list(range(1, 60))
    assert perchunk.judged_chunks(cases.limit(0), scorer).count() == 0


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = next_row(row, x, b)
    return row[-1]


def next_row(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1]))
    return out


def applied(old, found):
    """Text that the hunks make of old, checking every line they name."""
    lines, out, at = (old or "").split("\n") if old else [], [], 0
    for h in found:
        head, *body = h.split("\n")
        begin, size = [*map(int, head.split(" ")[1][1:].split(",")), 1][:2]
        begin -= size > 0
        out += lines[at:begin]
        at = begin
        for s in body:
            if s[:1] in "- ":
                assert lines[at] == s[1:]
                at += 1
            if s[:1] in "+ ":
                out.append(s[1:])
    return "\n".join(out + lines[at:])


@pytest.mark.parametrize("seed", range(40))
def test_scripts_are_shortest_and_hunks_apply(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abcdefgh"
    a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 40))] for _ in range(2))
    if seed % 2:
        b = [x for x in a if rng.random() < 0.8] + [rng.choice(letters) for _ in range(3)]
    old, new = "\n".join(a), "\n".join(b)
    removed, added, found = diffs.hunks(old, new, rng.choice([0, 1, 3]))
    common = longest(old.split("\n") if old else [], new.split("\n") if new else [])
    assert removed == (len(a) if old else 0) - common and added == (len(b) if new else 0) - common
    assert applied(old, found) == new
    assert not found if old == new else found


def test_diffs_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    rows = diffs.line_diff(docs.join(other, "doc_id").limit(120), F.col("text"), F.col("next")).collect()
    for r in rows:
        a, b = (r["text"] or "").split("\n"), (r["next"] or "").split("\n")
        common = longest(a, b)
        assert (r["diff"]["removed"], r["diff"]["added"]) == (len(a) - common, len(b) - common) and applied(r["text"], r["diff"]["hunks"]) == r["next"]
    long = ["\n".join(str((i * k) % 1009) for i in range(6000)) for k in (7, 7)]
    long[1] = "start\n" + long[1].replace("\n500\n", "\n") + "\nend"
    assert diffs.hunks(*long)[:2] == (long[0].count("\n500\n"), 2)


def sampler(df):
    return df.select("id", "k", F.concat_ws("-", "prompt", F.lit("s"), F.col("k").cast("string")).alias("sample"))


def test_two_top_ups_agree_with_one(spark, tmp_path):
    ask = spark.createDataFrame([("a", "pa"), ("b", "pb"), ("b", "pb"), (None, "lost")], "id string, prompt string")
    more = spark.createDataFrame([("a", "pa"), ("b", "pb"), ("c", "pc")], "id string, prompt string")
    two, one = str(tmp_path / "two"), str(tmp_path / "one")
    first = {r["id"]: r["samples"] for r in samples.top_up(ask, two, 2, sampler).collect()}
    assert first == {"a": ["pa-s-0", "pa-s-1"], "b": ["pb-s-0", "pb-s-1"], None: []}
    for _ in range(2):
        samples.top_up(more, two, 5, sampler)
    samples.top_up(more, one, 5, sampler)
    rows = lambda f: sorted(map(tuple, samples.cached(spark, f).collect()))
    assert rows(two) == rows(one) and len(rows(one)) == 15
    assert {r["id"]: len(r["samples"]) for r in samples.top_up(more, two, 3, lambda df: 1 / 0).collect()} == {"a": 3, "b": 3, "c": 3}  # nothing to make


def test_a_run_that_dies_leaves_the_cache_as_it_was(spark, tmp_path):
    ask = spark.createDataFrame([(f"i{k}", "p") for k in range(30)], "id string, prompt string")
    folder = str(tmp_path / "cache")
    samples.top_up(ask, folder, 2, sampler)
    before = sorted(map(tuple, samples.cached(spark, folder).collect()))
    dies = lambda df: sampler(df).withColumn("sample", F.when(F.col("id") == "i7", F.raise_error(F.lit("down")).cast("string")).otherwise(F.col("sample")))
    with pytest.raises(Exception, match="down"):
        samples.top_up(ask, folder, 4, dies)
    assert sorted(map(tuple, samples.cached(spark, folder).collect())) == before
    partial = lambda df: sampler(df).where("id <> 'i3'")
    assert {len(r["samples"]) for r in samples.top_up(ask, folder, 4, partial).collect()} == {4, 2}
    assert {len(r["samples"]) for r in samples.top_up(ask, folder, 4, sampler).collect()} == {4}
    assert samples.cached(spark, folder).count() == 120
