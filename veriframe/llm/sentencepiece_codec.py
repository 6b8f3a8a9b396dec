"""SentencePiece models encoded and decoded by the tokenizers library.

The model's protobuf is read here; its normaliser, marker of spaces, scores or merges, and byte
fallback are built anew, and the ids are held against the sentencepiece library's."""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the marker of spaces, kinds of pieces, and kinds of models.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; lengths give bytes, all else numbers."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        if n is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} is not expected")
            n = varint()
        yield tag >> 3, data[at : at + n]
        at += n


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True

    def unknown(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)


def parse(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            f = dict(fields(value))
            score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
            m.pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(fields(value))
            m.kind, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
        elif number == 3:
            f = dict(fields(value))
            m.charsmap, m.dummy_prefix = f.get(2, b""), bool(f.get(3, 1))
            m.remove_extra_spaces, m.escape_spaces = bool(f.get(4, 1)), bool(f.get(5, 1))
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs that make a piece, best piece first; a piece's own pairs by the numbers of their parts.

    Only pieces that text can become count: bytes and control pieces are never merged to. Runs of
    markers share one score in some models; there the leftmost run grows first, one marker at a
    time, which is what the longest left part first comes to."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for p, i in ids.items():
        for k in range(1, len(p)):
            if p[:k] in ids and p[k:] in ids:
                found.append((-m.pieces[i][1], -k * (p == MARK * len(p)), ids[p[:k]], ids[p[k:]], p[:k], p[k:]))
    return [(a, b) for *_, a, b in sorted(found)]


def marks_only_lead(m: Model) -> bool:
    """True if no piece has the marker behind another character, so words can be encoded apart."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))


def build(m: Model):
    """The tokenizer that works as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unknown(), m.byte_fallback)
    elif m.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        core = models.BPE(vocabulary, merges(m), unk_token=m.pieces[m.unknown()][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model kind {m.kind} has no counterpart")
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.remove_extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tok = Tokenizer(core)
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    if m.escape_spaces and marks_only_lead(m):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    decode = [decoders.Replace(MARK, " ")] + ([decoders.ByteFallback()] if m.byte_fallback else []) + [decoders.Fuse()]
    tok.decoder = decoders.Sequence(decode + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    return tok


def apart(m: Model) -> bool:
    """True if a text's units (markers and what follows up to the next marker) can be encoded one by
    one: nothing is normalised but single spaces to markers, a marker stands first, and no piece
    reaches from one unit into the next."""
    return not m.charsmap and not m.remove_extra_spaces and m.dummy_prefix and m.escape_spaces and marks_only_lead(m)


@dataclass
class Backend:
    """The built tokenizer, the sentencepiece library's own, and what is known of units so far.

    A unit is written here as its text without the leading marker, other markers as spaces."""

    tok: object
    reference: object
    by_units: bool
    threads: int
    #: Unit to its packed ids.
    memory: dict[str, bytes] = field(default_factory=dict)
    #: The few units that don't decode to themselves or lack parity: (decoded, parity).
    odd: dict[str, tuple[str, bool]] = field(default_factory=dict)

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """(ids, parity) of whole texts: the built tokenizer's ids, and whether the sentencepiece library
        gives the same. An empty text has no ids."""
        ours = [e.ids if t else [] for t, e in zip(texts, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
        theirs = self.reference.encode(texts, num_threads=self.threads)
        return [(a, a == b) for a, b in zip(ours, theirs, strict=True)]

    def decode(self, lists: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(lists, skip_special_tokens=False)

    def ready(self, units: set[str]) -> None:
        """Make sure that all units are known. What is remembered stays under REMEMBERED units and these."""
        missing = units - self.memory.keys()
        if missing and len(self.memory) + len(missing) > REMEMBERED:
            self.memory.clear()
            self.odd.clear()
            missing = units
        if missing:
            self.learn(list(missing))

    def learn(self, units: list[str]) -> None:
        """Encode, verify and decode units."""
        found = self.encode(units)
        for k, u in enumerate(units):
            if not u:  # a marker with nothing behind it, which encoding an empty text leaves out
                found[k] = [self.tok.token_to_id(MARK)], self.tok.token_to_id(MARK) == self.reference.piece_to_id(MARK)
        for u, (ids, same), back in zip(units, found, self.decode([i for i, _ in found]), strict=True):
            self.memory[u] = packed(ids)
            if not same or back != u:
                self.odd[u] = back, same

    def rows(self, texts: list[str]) -> Iterator[tuple[int, str, str, bool, bool]]:
        """(ids, their digest, digest of the decoded text, whether that is the text, parity) of each text."""
        if not self.by_units:
            coded = self.encode(texts)
            backs = self.decode([i for i, _ in coded])
            yield from [(len(i), digest(i), sha(b), b == t, same) for t, (i, same), b in zip(texts, coded, backs, strict=True)]
        elif len(texts) == 1 and len(texts[0]) > LONG:
            yield self.put_together(texts[0], units(texts[0]))
        else:
            apart = [units_of(t) for t in texts]
            self.ready(set().union(*apart))
            for t, u in zip(texts, apart, strict=True):
                yield self.put_together(t, [u])

    def put_together(self, text: str, chunks: Iterable[list[str]]) -> tuple[int, str, str, bool, bool]:
        """A text's row from its units, a list at a time. Its ids and its decoded text are the units'
        ids and the decoded units laid end to end, and both digests are of those."""
        n, same, equal, first, at = 0, True, True, True, 0
        ids, decoded = hashlib.sha256(), hashlib.sha256()
        for chunk in chunks:
            if not chunk:
                continue
            if len(text) > LONG:
                self.ready(set(chunk))
            codes = b"".join(map(self.memory.__getitem__, chunk))
            n += len(codes) // 4
            ids.update(codes)
            back = " ".join(chunk)
            if self.odd and not self.odd.keys().isdisjoint(chunk):
                same = same and all(self.odd[u][1] for u in chunk if u in self.odd)
                back = " ".join([self.odd[u][0] if u in self.odd else u for u in chunk])
            if not first:  # the first marker is no character
                back = " " + back
            equal, first = equal and text.startswith(back, at), False
            at += len(back)
            decoded.update(back.encode("utf-8", "surrogatepass"))
        return n, ids.hexdigest(), decoded.hexdigest(), equal and at == len(text), same


#: Units remembered by a task, characters of the texts that are taken at a time (a longer text goes alone,
#: by chunks of units), texts at a time, and threads of the libraries.
REMEMBERED, LONG, CHUNK, BATCH, THREADS = 600_000, 1 << 20, 1 << 14, 512, 2
UNIT = re.compile(f"{MARK}+[^{MARK}]*")


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def units_of(text: str) -> list[str]:
    """The units of a text. Where spaces are single and no marker is written out, they are what stands between spaces."""
    if not text:
        return []
    if "  " not in text and MARK not in text and text[0] != " ":
        return text.split(" ")
    return [u[1:].replace(MARK, " ") for u in UNIT.findall(marked(text))]


def together(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of at most BATCH and of at most LONG characters, a longer text on its own."""
    some: list[str] = []
    n = 0
    for t in texts:
        if some and (len(some) == BATCH or n + len(t) > LONG):
            yield some
            some, n = [], 0
        some.append(t)
        n += len(t)
    if some:
        yield some


def units(text: str) -> Iterator[list[str]]:
    """The units of a long text, some at a time."""
    found = (m[0][1:].replace(MARK, " ") for m in UNIT.finditer(marked(text)))
    while chunk := list(itertools.islice(found, CHUNK)):
        yield chunk


@lru_cache(maxsize=2)
def backend(path: str, threads: int = THREADS) -> Backend:
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    import sentencepiece

    with open(path, "rb") as f:
        data = f.read()
    model = parse(data)
    return Backend(build(model), sentencepiece.SentencePieceProcessor(model_proto=data), apart(model), threads)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}i", *ids)


def digest(ids: list[int]) -> str:
    return hashlib.sha256(packed(ids)).hexdigest()


COLUMNS = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean, parity boolean"


def coded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc, n_tokens, ids_sha256, decoded_sha256, round_trip, parity) for every row.

    doc holds the row as it came. ids_sha256 is of the built tokenizer's ids as little-endian 32-bit
    numbers, decoded_sha256 of what it decodes them to; round_trip tells whether that is the text, which
    a normaliser or a marker in the text may prevent; parity whether the sentencepiece library gives the
    same ids for all of the text. Where the model lets units be encoded one by one, each distinct unit
    of a batch is encoded, verified and decoded once, and a text is put together from its units; else
    whole texts are. A null text is an empty one: no ids, decoded empty. path is a model file that
    every executor has. Memory is LONG characters of texts or one text, their units, and the units
    remembered. Repeated rows stay; no rows give none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        codec = backend(path)
        for series in batches:
            yield pd.DataFrame([r for some in together(t or "" for t in series) for r in codec.rows(some)], columns=names)

    return docs.select(F.struct("*").alias("doc"), F.pandas_udf(run, COLUMNS, F.PandasUDFType.SCALAR_ITER)(F.col(text)).alias("s")).select("doc", "s.*")


def encode_ids(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc, ids, parity): the built tokenizer's ids themselves, and whether sentencepiece's are the same, by whole texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = backend(path)
        for series in batches:
            found = [x for some in together(t or "" for t in series) for x in codec.encode(some)]
            yield pd.DataFrame({"ids": [i for i, _ in found], "parity": [p for _, p in found]})

    udf = F.pandas_udf(run, "ids array<int>, parity boolean", F.PandasUDFType.SCALAR_ITER)
    return docs.select(F.struct("*").alias("doc"), udf(F.col(text)).alias("s")).select("doc", "s.*")


def decode_ids(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """(row, text): what the ids stand for; null ids give an empty text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = backend(path)
        for series in batches:
            yield pd.Series(codec.decode([[] if i is None else [int(x) for x in i] for i in series]), dtype=object)

    return df.select(F.struct("*").alias("row"), F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(ids)).alias("text"))
