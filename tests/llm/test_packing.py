import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veriframe.llm import packing
from veriframe.llm.queries import op13_packing

from .texts import ROWS, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def whole(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


PARTS = [" ", "\n", "\t\x0b", "word", "Words", "'re", "'", "re", "<|endoftext|>", "<|end", "oftext|>", "123", "!!", "É", "é", "́", "\U0001f600", "日本", " ", " ", "Σ", "İ", "x" * 90, "\x1c", "\x85"]


@pytest.mark.parametrize("seed", range(6))
def test_words_apart_give_the_library_s_ids(tok, seed):
    rng, made = random.Random(seed), packing.Encoder(PATH)
    for _ in range(60):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 200)))
        assert np.frombuffer(made.ids(text), "<u4").tolist() == whole(tok, text)[:-1], repr(text)


def test_plain_words_by_units(tok):
    rng, made = random.Random(8), packing.Encoder(PATH)
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA0, 0x180), 0x301, 0x212A, 0x130)]
    for _ in range(300):
        text = " ".join("".join(rng.choice(letters[:94] if rng.random() < 0.5 else letters) for _ in range(rng.randint(1, 9))) + rng.choice(["", "'S", "'re", "'LL", "'", "<|startoftext|>"]) for _ in range(8))
        assert np.frombuffer(made.ids(text), "<u4").tolist() == whole(tok, text)[:-1], repr(text)
    assert len(made.units) > 100


def test_forgotten_words_are_encoded_again(tok, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    made = packing.Encoder(PATH)
    for i in range(40):
        text = f"one two{i % 7} three{i % 2} étude{i % 3} " + "long" * 30
        assert np.frombuffer(made.ids(text), "<u4").tolist() == whole(tok, text)[:-1]


def test_unsuitable_tokenizers_are_refused():
    with pytest.raises(ValueError, match="units|stands between"):
        packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    with open(PATH, "rb") as f:
        said = json.load(f)
    assert packing.unsuitable(said) is None
    cutter = said["pre_tokenizer"]["pretokenizers"]
    for change in (
        {"normalizer": {"type": "Prepend", "prepend": "_"}}, {"pre_tokenizer": {**said["pre_tokenizer"], "pretokenizers": [{**cutter[0], "behavior": "Isolated"}, cutter[1]]}},
        {"pre_tokenizer": {**said["pre_tokenizer"], "pretokenizers": [{**cutter[0], "pattern": {"Regex": ".+"}}, cutter[1]]}}, {"post_processor": {"type": "TemplateProcessing"}},
        {"pre_tokenizer": {**said["pre_tokenizer"], "pretokenizers": [cutter[0], {**cutter[1], "add_prefix_space": True}]}}, {"added_tokens": [{**said["added_tokens"][0], "single_word": True}]},
    ):
        assert packing.unsuitable({**said, **change})


def packed(windows):
    return [[(p.key, p.start, len(p.ids) // 4) for p in w] for w in windows]


def piece(key, n):
    return packing.Piece(key, 0, np.arange(n, dtype="<u4").tobytes(), n)


def test_best_fit_then_the_fullest():
    packer = packing.Packer(window=10, n_open=2)
    assert packed(packer.add(piece("a", 6))) == [] and packed(packer.add(piece("b", 7))) == []
    assert packed(packer.add(piece("c", 3))) == [[("b", 0, 7), ("c", 0, 3)]]  # leaves the least room
    assert packed(packer.add(piece("d", 8))) == []
    assert packed(packer.add(piece("e", 5))) == [[("d", 0, 8), ("e", 0, 2)]]  # none has room, the fullest goes; the rest fits
    assert packed(packer.add(piece("f", 25))) == [[("f", 0, 10)], [("f", 10, 10)]]
    assert packed(packer.close()) == [[("a", 0, 6), ("e", 2, 3), ("f", 20, 1)], [("f", 21, 4)]]


@pytest.mark.parametrize("seed", range(8))
def test_nothing_is_lost_and_only_the_last_is_short(seed):
    rng = random.Random(seed)
    packer, done, given = packing.Packer(window=64, n_open=rng.choice([1, 2, 5, 30])), [], []
    for i in range(200):
        n = rng.choice([0, 1, 3, 20, 63, 64, 65, 128, 300, rng.randint(1, 64)])
        given.append((i, n))
        done += packer.add(piece(i, n))
        assert len(packer.rooms) <= packer.n_open and len(packer.held) == len(packer.rooms)
    done += packer.close()
    sizes = [sum(len(p.ids) // 4 for p in w) for w in done]
    assert all(s == 64 for s in sizes[:-1]) and 0 < sizes[-1] <= 64
    parts = defaultdict(list)
    for w in done:
        for p in w:
            parts[p.key].append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    for i, n in given:
        assert [x for _, ids in sorted(parts.pop(i, [])) for x in ids] == list(range(n))
    assert not parts
    last = list(packing.powers(done[-1]))
    assert all((s := sum(len(p.ids) // 4 for p in w)) & (s - 1) == 0 for w in last)
    assert b"".join(p.ids for w in last for p in w) == b"".join(p.ids for p in done[-1])


def check(rows, docs, tok, window):
    """rows of one document each are told apart by their counts; docs: {key: [texts]}."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= window and (at == window or at & (at - 1) == 0)
        short += at < window
    assert short <= window.bit_length()
    assert set(pieces) == set(docs)
    for key, texts in docs.items():
        assert sum(r["length"] for r in pieces[key]) == sum(len(whole(tok, t)) for t in texts)
        if len(texts) == 1:
            ids, at = whole(tok, texts[0]), 0
            for r in sorted(pieces[key], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]])
                at += r["length"]
            assert at == len(ids)


@pytest.mark.parametrize("parts,window,n_open,merged", [(1, 64, 4, 2), (9, 64, 4, 2), (9, 4096, 32, 64), (5, 50, 1, 3)])
def test_awkward_rows(spark, tok, parts, window, n_open, merged):
    docs = defaultdict(list)
    for k, t, *_ in ROWS:
        docs[k].append(t)
    found = packing.pack(frame(spark).repartition(parts, "n_chars", "text"), PATH, window=window, n_open=n_open, merged=merged)
    rows = found.collect()
    if window == 50:
        assert sum(r["length"] for r in rows) == sum(len(whole(tok, t)) for ts in docs.values() for t in ts)
    else:
        check(rows, docs, tok, window)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)
    done = packing.sequences(found, window, pad=7).collect()
    for s in done:
        own = sorted((r["offset"], bytes(r["ids"])) for r in rows if r["sequence_id"] == s["sequence_id"])
        ids = np.frombuffer(b"".join(x for _, x in own), "<u4").tolist()
        assert s["n_tokens"] == len(ids) and s["input_ids"][: len(ids)] == ids and set(s["input_ids"][len(ids) :]) <= {7}
        assert len(s["input_ids"]) == (len(ids) if len(ids) & (len(ids) - 1) == 0 else window)
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_query_over_the_whole_table(spark, tok):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op13_packing(spark, sf).collect(), docs, tok, 4096)
