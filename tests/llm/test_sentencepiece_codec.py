import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from veriframe.llm import sentencepiece_codec as codec
from veriframe.llm.queries import op9_sentencepiece

from .texts import ROWS, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "Hello", " world", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "▁▁", "é", "😀", "日本", "\x00x", "123", "'s", "ﬁ", "\xa0", "x" * 50, " " * 20]


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts(n=1500, parts=PARTS):
    rng = random.Random(6)
    return ["", " ", "  ", "a ", " a", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]]


def test_whole_texts_have_parity(reference):
    texts = odd_texts()
    found = codec.backend(PATH).encode(texts)
    assert all(same for _, same in found)
    assert [i for i, _ in found] == reference.encode(texts)
    assert codec.backend(PATH).decode([i for i, _ in found]) == [reference.decode(i) for i, _ in found]


def test_units_put_together_equal_whole_texts(reference, monkeypatch):
    texts = odd_texts()
    for long, chunk, remembered in ((1 << 20, 1 << 14, 600_000), (5, 3, 600_000), (200, 3, 10)):
        monkeypatch.setattr(codec, "LONG", long)
        monkeypatch.setattr(codec, "CHUNK", chunk)
        monkeypatch.setattr(codec, "REMEMBERED", remembered)
        codec.backend(PATH).memory.clear()
        found = [r for some in codec.together(texts) for r in codec.backend(PATH).rows(some)]
        for t, (n, ids, back, trip, same) in zip(texts, found, strict=True):
            want = reference.encode(t)
            assert (n, ids, same) == (len(want), codec.digest(want), True)
            assert back == codec.sha(reference.decode(want)) and trip == (reference.decode(want) == t)
    assert len(codec.backend(PATH).memory) <= 10 + 200


def broken():
    """The backend with the merges of one piece taken out of the rebuilt model."""
    with open(PATH, "rb") as f:
        data = f.read()
    m = codec.parse(data)
    own, every = codec.backend(PATH), codec.merges(m)
    keep = codec.merges
    try:
        codec.merges = lambda _: [x for x in every if "".join(x) != "▁the"]
        return codec.Backend(codec.build(m), own.reference, own.by_units, own.threads)
    finally:
        codec.merges = keep


def test_ids_are_the_rebuilt_models_and_parity_tells_where_they_differ(reference):
    b = broken()
    for text, same in (("a cat sat", True), ("on the mat", False), ("a the", False), ("then", None)):
        ours = b.tok.encode(text, add_special_tokens=False).ids
        n, ids, back, trip, parity = next(iter(b.rows([text])))
        assert (n, ids) == (len(ours), codec.digest(ours)) and back == codec.sha(text) and trip
        assert parity == (ours == reference.encode(text)) and same in (None, parity)
    assert b.encode(["on the mat"])[0] != (reference.encode("on the mat"), True)


def test_protobuf_gives_what_the_library_says(reference):
    with open(PATH, "rb") as f:
        m = codec.parse(f.read())
    assert len(m.pieces) == reference.get_piece_size() and codec.apart(m) and m.byte_fallback
    for i in range(0, len(m.pieces), 97):
        assert m.pieces[i][0] == reference.id_to_piece(i) and m.pieces[i][1] == pytest.approx(reference.get_score(i))


def unigram_model():
    """A small model file of unigram kind, written field by field."""

    def message(*parts):
        out = b""
        for number, value in parts:
            if isinstance(value, bytes):
                out += bytes([number << 3 | 2]) + varint(len(value)) + value
            elif isinstance(value, float):
                import struct

                out += bytes([number << 3 | 5]) + struct.pack("<f", value)
            else:
                out += varint(number << 3) + varint(value)
        return out

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]]
    pieces += [(p, -s, 1) for p, s in (("▁", 3.0), ("▁the", 2.0), ("the", 4.0), ("re", 3.5), ("t", 6.0), ("h", 6.1), ("e", 6.2), ("r", 6.3), ("▁there", 3.1))]
    body = b"".join(message((1, message((1, p.encode()), (2, s), (3, kind)))) for p, s, kind in pieces)
    return body + message((2, message((3, 1), (35, 1)))) + message((3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


def test_unigram_models_too():
    data = unigram_model()
    m, own = codec.parse(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    tok = codec.build(m)
    rng = random.Random(8)
    texts = ["".join(rng.choice(["the", "re", " there", " ", "t", "é", "q"]) for _ in range(12)) for _ in range(300)]
    for t in texts:
        assert tok.encode(t, add_special_tokens=False).ids == own.encode(t)


def test_unigram_column_through_the_operator(spark, tmp_path):
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(unigram_model())
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the there", "", None, "there  re", "é the q", "t h e"]
    rows = codec.coded(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), path).select("doc.text", "ids_sha256", "decoded_sha256", "parity").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = own.encode(r["text"] or "")
        assert (r["ids_sha256"], r["decoded_sha256"], r["parity"]) == (codec.digest(want), codec.sha(own.decode(want)), True)


def test_awkward_rows(spark, reference):
    rows = codec.coded(frame(spark), PATH).select("doc.text", "n_tokens", "ids_sha256", "round_trip", "parity").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        want = reference.encode(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["round_trip"], r["parity"]) == (len(want), codec.digest(want), True, True)
    assert codec.coded(frame(spark, []), PATH).count() == 0
    ids = codec.encode_ids(frame(spark), PATH).select("doc.text", "ids")
    for r in codec.decode_ids(ids, PATH).select("row.text", "text").collect():
        assert (r[0] or "") == r[1]


def test_query_over_the_whole_table(spark, sf, reference):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_sentencepiece(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r["doc_id"]]
        want = reference.encode(t)
        assert (r["n_tokens"], r["ids_sha256"], r["parity"]) == (len(want), codec.digest(want), True)
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() and r["round_trip"]
