import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece

from veriframe.llm import secrets

from .test_quality import slow_kept
from .test_secrets import base
from .test_simhash import slow_components, slow_fingerprint
from .texts import ROWS


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_columns_and_order_of_stages(stages, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "secret scan", "mixing", "sentencepiece"]
    for rows in stages[1:-1]:
        assert rows[0].__fields__ == columns


def test_quality_stage(stages):
    want = [r for r, kept in zip(stages[0], slow_kept([r["text"] for r in stages[0]]), strict=True) if kept]
    assert Counter(want) == Counter(stages[1]) and len(want) < len(stages[0])


def test_dedup_stage(stages):
    rows = {r["doc_id"]: r for r in stages[1]}
    roots = slow_components({d: slow_fingerprint(r["text"]) for d, r in rows.items()})
    assert Counter(rows[d] for d in set(roots.values())) == Counter(stages[2])


def test_secret_stage(stages):
    before, after = {r["doc_id"]: r for r in stages[2]}, {r["doc_id"]: r for r in stages[3]}
    assert before.keys() == after.keys()
    owners = {}
    for r in stages[2]:
        for kind, s, e in base(r["text"]):
            owners.setdefault(value(kind, r["text"][s:e]), set()).add(r["source"])
    changed = 0
    for d, r in before.items():
        live = [x for x in base(r["text"]) if len(owners[value(x[0], r["text"][x[1] : x[2]])]) == 1]
        assert after[d]["n_chars"] == (len(after[d]["text"]) if after[d]["text"] != r["text"] else r["n_chars"])
        assert (after[d]["text"] == r["text"]) or secrets.MASK in after[d]["text"]
        for _, s, e in live:
            assert r["text"][s:e] not in after[d]["text"]
            changed += 1
    assert changed


def value(kind, match):
    from .test_secrets import ASSIGN

    return ASSIGN.match(match)[1] if kind == "assign" else match


def test_mix_stage(stages):
    before, after = Counter(stages[3]), Counter(stages[4])
    assert all(r in before and n <= 2 * before[r] for r, n in after.items())
    words = lambda c: sum(len((r["text"] or "").split()) * n for r, n in c.items())
    assert words(after) == pytest.approx(1.5 * words(before), rel=0.1)


def test_sentencepiece_stage(stages):
    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], len(own.encode(r["text"] or ""))) for r in stages[4])
    assert Counter((r["doc_id"], r["n_tokens"]) for r in stages[5]) == want


def test_run_gives_the_last_stage(spark, sf, stages):
    assert Counter(corpus_pipeline.run(spark, sf).collect()) == Counter(stages[-1])


def test_awkward_and_empty_tables(spark, tmp_path):
    from .texts import frame

    rng = random.Random(1)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(3000))
    rows = [*ROWS, (20, noise, "en", "a"), (20, noise, "en", "a"), (21, noise.upper(), "en", "b"), (None, f"{noise} secret=abcdef123", None, None)]
    seen = {}
    for name, some in (("rows", rows), ("empty", [])):
        docs, seen[name] = frame(spark, some), []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{k}")
            stage(spark, docs, "").write.parquet(path)
            docs = spark.read.parquet(path)
            seen[name].append(docs.collect())
    assert [len(x) for x in seen["empty"]] == [0] * 5
    quality_kept, dedup, secret, mix, coded = seen["rows"]
    key = lambda xs: sorted(((r["doc_id"] or -1, r["text"]) for r in xs))
    assert key(quality_kept) == sorted((r[0] or -1, r[1]) for r, kept in zip(rows, slow_kept([r[1] for r in rows]), strict=True) if kept)
    assert {r["doc_id"] for r in quality_kept} >= {20, 21, None}
    assert {r["doc_id"] for r in dedup} >= {20} and 21 not in {r["doc_id"] for r in dedup} and len(dedup) == len({r["doc_id"] for r in dedup})
    assert len(secret) == len(dedup) and not any("secret=abc" in r["text"] for r in secret)
    assert {r["doc_id"] for r in mix} <= {r["doc_id"] for r in secret} and len(coded) == len(mix) > 0
    assert all(r["parity"] and r["round_trip"] for r in coded)
