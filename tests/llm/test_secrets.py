import hashlib
import math
import random
import re
from collections import Counter

import pytest

from veriframe.llm import secrets
from veriframe.llm.queries import op1_secret_scan

from .texts import ROWS, frame

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_base_spans_equal_brute_force(spark):
    got = secrets.scan(frame(spark)).select("doc_id", secrets.written(secrets.F.filter("spans", lambda x: x["rank"] < 3)).alias("s")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], joined(base(r[1]))) for r in ROWS), key=key)


def test_ownership_separates_copied_examples_from_owned_values(spark):
    rows = {r["doc_id"]: r["spans"] for r in secrets.scan(frame(spark), wide_share=0.2).collect()}
    assert [(x["rank"], x["owners"], x["copied"]) for x in rows[7]] == [(3, 1, False)]
    assert rows[8] == [] and rows[9] == []
    assert all(x["owners"] == 1 and x["repositories"] == 1 for x in rows[1])
    rows = {r["doc_id"]: r["spans"] for r in secrets.scan(frame(spark)).collect()}  # 2 of 6 owners are not many
    assert [(x["rank"], x["owners"], x["repositories"], x["copied"]) for x in rows[8]] == [(3, 2, 2, False)]


def test_repositories_count_too(spark):
    """A value of two in three owners is an example only if many repositories have it too."""
    value = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7"
    docs = [(i, f"x {value}" if i % 6 == 0 else "nothing", f"r{i}", f"o{i // 6}") for i in range(18) if i < 12 or i % 6]
    spans = lambda **how: [x for r in secrets.scan(frame(spark, docs), **how).collect() for x in r["spans"]]
    assert spans(wide_share=0.3, wide_most=1) == []
    assert [(x["owners"], x["repositories"], x["copied"]) for x in spans(wide_share=0.3)] == [(2, 2, False)] * 2
    assert spans(wide_share=0.3, repository=("doc_id",), wide_most=1) == []


def test_limits_follow_the_number_of_owners(spark):
    """400 owners: a key in 15 of them is theirs, one in 25 is an example; base spans stay either way."""
    leaked, example, base_hex = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7", "Zq7Tn2Wv9Xk4Lm8Pr3Bs6", "9f8e7d6c5b4a39281706f5e4d3"
    docs = [(i, f"doc {i} " + (leaked if i < 15 else example if i < 40 else base_hex if i < 70 else ""), "en", f"o{i}") for i in range(400)]
    rows = {r["doc_id"]: r["spans"] for r in secrets.scan(frame(spark, docs)).collect()}
    assert all([(x["rank"], x["owners"], x["copied"]) for x in rows[i]] == [(3, 15, False)] for i in range(15))
    assert all(rows[i] == [] for i in range(15, 40))
    assert all([(x["rank"], x["owners"], x["copied"]) for x in rows[i]] == [(2, 30, True)] for i in range(40, 70))
    out = {r["doc_id"]: r["text"] for r in secrets.redact(frame(spark, docs)).collect()}
    assert out[3] == "doc 3 <secret>" and out[20] == f"doc 20 {example}" and out[50] == f"doc 50 {base_hex}"
    assert [secrets.widely(n, 0.5) for n in (0, 1, 3, 10, 20, 60, 100, 400, 100_000)] == [1, 1, 1, 5, 10, 10, 10, 20, 316]


def slow_mask(text, spans):
    out, at = "", 0
    for s, e in spans:
        if s >= at:
            out += text[at:s] + secrets.MASK
        at = max(at, e)
    return out + text[at:]


def test_spans_that_overlap_and_masks_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["é token=abcdef12", "AKIA" + "Q7" * 9, "0a1b2c3d" * 4, "Zq7Tn2Wv9Xk4Lm8Pr3Bs6", "token=Zq7Tn2Wv9Xk4Lm8Pr3Bs6", " ", "plain 😀", "=secret:Zq7Tn2Wv9Xk4Lm8Pr3Bs6" + "0a1b2c3d" * 3]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts.append("".join(rng.choice(words) + " " for _ in range(4000)))
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    spans = {r["doc_id"]: [(x["start"], x["end"], x["rank"]) for x in r["spans"]] for r in secrets.scan(docs).collect()}
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    for i, t in enumerate(texts):
        fixed = base(t)
        runs = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t)]
        extra = [r for r in runs if not any(s < r[1] and r[0] < e for _, s, e in fixed) and re.search("[0-9]", t[slice(*r)]) and re.search("[A-Za-z]", t[slice(*r)]) and bits(t[slice(*r)]) >= 3.5]
        assert [(s, e) for s, e, rank in spans[i] if rank == 3] == extra
        assert [(s, e) for s, e, rank in spans[i] if rank < 3] == [(s, e) for _, s, e in fixed]
        assert out[i] == slow_mask(t, [(s, e) for s, e, _ in spans[i]])


def bits(value):
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def test_redaction_keeps_rows_and_takes_owned_values(spark):
    out = secrets.redact(frame(spark), wide_share=0.2)
    assert out.columns == frame(spark).columns
    rows = out.collect()
    assert len(rows) == len(ROWS)
    text = {r["doc_id"]: r["text"] for r in rows}
    assert text[7] == "<secret> is kept by one owner"
    assert text[8].startswith("Ab1Cd2")
    assert text[4] is None and text[5] == ""
    assert text[1] == '<secret>" and <secret>'


def test_empty_table(spark):
    assert secrets.scan(frame(spark, [])).count() == 0
    assert secrets.redact(frame(spark, [])).count() == 0


@pytest.mark.parametrize("copies", [3000])
def test_many_matches_in_one_text(spark, copies):
    text = "x token=abcdef1 é " * copies
    got = secrets.scan(frame(spark, [(1, text, "en", "a")])).collect()[0]["spans"]
    assert [(x["start"], x["end"]) for x in got] == [(s, e) for _, s, e in base(text)]


def test_query_over_the_whole_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_secret_scan(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = base(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[0] == k for x in spans) for k in ("assign", "access", "hex"))
        assert set(map(tuple, (x.split(":") for x in joined(spans).split(",") if x))) <= {tuple(x.split(":")) for x in r["spans"].split(",") if x}
