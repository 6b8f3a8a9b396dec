import json
import random

import public_tokenizers
import pytest

from veriframe.llm import tokens
from veriframe.llm.queries import op5_token_counts

from .texts import ROWS, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return tokens.tokenizer(PATH)[0]


def whole(tok, text):
    return len(tok.encode(text, add_special_tokens=False).ids)


def spliced(tok, texts, chunk, overlap, reach=None):
    return list(tokens.counts(tok, reach or tokens.tokenizer(PATH)[1], texts, chunk, overlap, batch=7))


PARTS = [" ", "  ", "\n", "\n\n   ", "\t", "word", " word", "'re", "'", "re", "<|endoftext|>", "<|end", "oftext|>", "123", "!!", "é", "😀", "日本語", " ", "x" * 300, " " * 200]


@pytest.mark.parametrize("seed", range(12))
def test_spliced_counts_equal_whole_encoding(tok, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 1500))) for _ in range(5)]
    for chunk, overlap in ((300, 80), (1000, 90), (1300, 650), (64, 30)):
        found = spliced(tok, texts, chunk, overlap)
        assert [n for n, *_ in found] == [whole(tok, t) for t in texts]
        assert [c for _, c, _ in found] == [len(list(tokens.cuts(len(t), chunk, overlap))) for t in texts]


def test_special_strings_at_every_place_of_a_cut(tok):
    for shift in range(0, 60):
        text = "a" * shift + " bc" * 30 + "<|endoftext|>'re  <|endoftext|>|> x" * 4 + " de" * 40
        assert spliced(tok, [text], 100, 40)[0][0] == whole(tok, text)


def test_texts_of_one_unit_widen(tok):
    for text in ("a" * 5000, " " * 5000, "a" * 900 + " b" * 900 + "\n" * 3000 + "z" * 2000):
        n, _, widened = spliced(tok, [text], 400, 80)[0]
        assert n == whole(tok, text) and widened > 0


def test_widening_is_geometric(tok):
    n, chunks, widened = spliced(tok, ["=" * 300_000], 400, 80)[0]
    assert n == whole(tok, "=" * 300_000) and chunks > 900 and widened < 20


def test_unproven_tokenizers_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="normaliser"):
        tokens.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    with open(PATH, "rb") as f:
        said = json.load(f)
    assert tokens.unsuitable(said) is None
    for change in (
        {"pre_tokenizer": {**said["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": None}, {"post_processor": {"type": "TemplateProcessing"}},
        {"added_tokens": [{**said["added_tokens"][0], "lstrip": True}]}, {"added_tokens": [{**said["added_tokens"][0], "single_word": True}]}, {"model": {"type": "WordPiece"}},
    ):
        assert tokens.unsuitable({**said, **change})
    assert tokens.tokenizer(PATH)[1] == len("<|endoftext|>") + 1
    rows = tokens.count_tokens(frame(spark), public_tokenizers.path("word_bpe_49k.json"), chunk=None).select("doc.text", "n_tokens").collect()
    own = tokens.tokenizer(public_tokenizers.path("word_bpe_49k.json"), False)[0]
    assert all(r["n_tokens"] == whole(own, r["text"] or "") for r in rows)


def test_awkward_rows(spark, tok):
    rows = tokens.count_tokens(frame(spark), PATH, chunk=500, overlap=100).select("doc.text", "n_bytes", "n_tokens").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r["n_bytes"], r["n_tokens"]) == (len((r["text"] or "").encode()), whole(tok, r["text"] or ""))
    assert tokens.count_tokens(frame(spark, []), PATH).count() == 0


def test_query_over_the_whole_table(spark, tok):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_token_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = whole(tok, docs[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 512)
    assert sum(r["n_chunks"] > 1 for r in rows) > 100
