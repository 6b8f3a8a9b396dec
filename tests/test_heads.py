import random

import pytest
from pyspark.sql import functions as F

from veriframe.functions import text as t
from veriframe.operators import grams, groups
from veriframe.plans import views

from .test_near_pairs import corpus, slow_pairs


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_sent_for_pairs_that_heads_leave_open_only(spark, monkeypatch):
    """However many blocks of texts there are."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(150)]
    texts = [(f"t{i:03}", " ".join(rng.choice(words) for _ in range(200))) for i in range(240)]
    texts += [("u", texts[0][1] + " end"), ("v", "begin " + texts[7][1])]
    chars = sum(len(x) for _, x in texts)
    monkeypatch.setattr(grams, "BLOCK_CHARS", chars // 30)
    df = spark.createDataFrame(texts, "id string, text string").localCheckpoint()
    before = shuffled(spark)
    assert {(r["a"], r["b"]) for r in groups.near_pairs(df).collect()} == {("t000", "u"), ("t007", "v")}
    assert shuffled(spark) - before < 4 * chars


@pytest.mark.parametrize("seed,threshold,head,common", [(5, 0.9, 400, 10**6), (6, 0.6, 150, 30), (7, 0.8, 10**6, 0)])
def test_blocks_of_heads_meet_once_and_lose_no_pair(spark, monkeypatch, seed, threshold, head, common):
    monkeypatch.setattr(grams, "HEAD_CHARS", head)
    monkeypatch.setattr(grams, "COMMON", common)
    texts = [*corpus(seed, 60), ("u0", "aaaaaaaaaaaaaaaaaa b"), ("u1", "aaaaaaaaaaaaaaaaaaa c"), ("u2", ""), ("u3", "zq")]
    found = groups.near_pairs(spark.createDataFrame(texts, "id string, text string"), threshold).collect()
    got = {(r["a"], r["b"]): r["similarity"] for r in found}
    assert got == pytest.approx(slow_pairs(texts, threshold)) and len(got) == len(found) > 5


def test_keys_of_cases_are_those_of_their_whole_texts(spark, tmp_path):
    texts = ["q\na", "Q!\nFirst one\na", "q\n\nsecond\na", "q\nx [CHUNK 7] y\nz\na", "q\nx [CHUNK 1] y\n[CHUNK 2]\nz\nlast", "q\n1\n2\n3\n4\n5\n", "one", "", "\n\n\n", "q\nonly\n", None, "?\n!\n;\n.\n,"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    whole = views.cases(spark, str(tmp_path)).select("id", F.nullif(t.query_key(F.col("question")), F.lit("")).alias("query"), t.first_chunk_key(F.col("context")).alias("chunk"), "faithfulness", "relevance")
    got, want = ({tuple(r) for r in df.collect()} for df in (views.case_keys(spark, str(tmp_path)), whole))
    assert got == want and len(want) == len(texts) and any(r[2] == "x" for r in want)
