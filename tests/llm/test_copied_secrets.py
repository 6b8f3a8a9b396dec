"""Secrets that a few sources share are masked in the pipeline; widely copied examples stay."""

import corpus_pipeline

HEX, WIDE, ONE_PLACE, RUN = "2abc3ff2ca8fb1d04e6697a1", "9f8e7d6c5b4a39281706f5e4d3", "token=abcdef123456", "Zq7Tn2Wv9Xk4Lm8Pr3Bs6"


def test_few_sources_do_not_make_an_example(spark):
    rows = [(i, f"key {HEX} here {RUN}", "en", f"s{i}") for i in range(3)]
    rows += [(100 + i, f"example {WIDE} here", "en", f"s{i}") for i in range(12)]
    rows += [(200 + i, f"set {ONE_PLACE} here", "en", "s0") for i in range(30)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in corpus_pipeline.secret_scan(spark, docs, "").collect()}
    assert len(out) == len(rows)
    assert {out[i]["text"] for i in range(3)} == {"key <secret> here <secret>"}
    assert {out[100 + i]["text"] for i in range(12)} == {f"example {WIDE} here"}
    assert {out[200 + i]["text"] for i in range(30)} == {"set <secret> here"}
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
