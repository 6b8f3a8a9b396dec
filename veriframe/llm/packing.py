"""Packing of documents' tokens into windows, online and in bounded space.

Each task keeps a fixed number of open windows. A document goes whole into the open window where it
leaves the least room. When none has room for it, the fullest is topped up with the document's first
tokens and emitted, and the rest is placed in turn; so a window costs at most one cut, and no
padding. At the end of a partition its open windows are packed into one another the same way, until
one is left. Those leftovers, less than a window a partition, are merged in groups of partitions,
level by level, and what is left last is cut into powers of two, which need no padding.

Documents are encoded by the words between ASCII white space: the tokenizer's file must show that no
token, and nothing that its normaliser looks at, reaches over white space. A task encodes a word once as long as it remembers it; plain words are put together from
units, which words share."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

WINDOW = 4096
#: Open windows of a task.
OPEN = 32
#: Bytes of an id.
WIDE = 4
#: Words, and units of words, that a task remembers twice over, and bytes of the longest one.
REMEMBERED, LONGEST_WORD = 1 << 18, 64
#: Partitions whose leftovers one task merges.
MERGED = 64
#: Numbers of sequences: those of a task, and of a level of merging.
TASK, LEVEL = 1 << 32, 1 << 56
#: Pieces sent on at a time.
PIECES = 4096


def unsuitable(said: dict) -> str | None:
    """Why a tokenizer, given as its file says, can't be shown to encode words apart; None where it can."""
    normal = said["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
    for step in steps:
        space = step["type"] == "Replace" and step["pattern"].get("Regex") == r"\s+" and step["content"] == " "
        if not (space or step["type"] in ("NFC", "Lowercase")):
            return f"its normaliser has a step {step['type']}"
    cutter = said["pre_tokenizer"] or {}
    parts = cutter.get("pretokenizers", [cutter])
    first, last = parts[0], parts[-1]
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return "it keeps what stands between its units"
    if first["pattern"].get("Regex") != UNITS:
        return "its units aren't known to end at white space"
    if len(parts) > 2 or (len(parts) == 2 and (last.get("type") != "ByteLevel" or last.get("add_prefix_space") or last.get("use_regex", True))):
        return "its units are cut again"
    if said["post_processor"] is not None or said["model"].get("dropout"):
        return "it may add tokens, or encode a unit in several ways"
    if any(t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in said["added_tokens"]):
        return "its added tokens look at what stands beside them"
    return None


#: The pattern of units that never hold white space (fixed, as tokenizers' files have it).
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Words of visible ASCII and of Latin-1 letters: composed already, lower-cased letter by letter, and cut by the
#: same pattern with its classes spelt out.
PLAIN = r"[!-~À-ÖØ-öø-ÿ]+"
PLAIN_UNITS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The letters that byte-level models have for bytes: visible Latin-1 ones stand for themselves, the others, in
    order, have the letters from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {**{b: chr(b) for b in visible}, **{b: chr(0x100 + i) for i, b in enumerate(hidden)}}


class Memory(dict):
    """What make(key) gave for about 2 * most keys: those asked for since it was last full, and those before. Keys
    of over longest characters or bytes are made anew each time."""

    def __init__(self, make: Callable, most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > self.longest:
                return found
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    """Ids of texts, as packed unsigned 32-bit numbers. A plain word goes to the tokenizer's model by units, which
    many words share; any other goes through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the unit of work here
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            said = json.load(f)
        if reason := unsuitable(said):
            raise ValueError(f"{path}: {reason}; its words can't be encoded apart")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])]
        by_units = "Lowercase" in steps and len(said["pre_tokenizer"].get("pretokenizers", [])) == 2 and said["model"]["type"] == "BPE"
        special = "".join(f"(?!.*{re.escape(t['content'])})" for t in said["added_tokens"])
        self.plain = re.compile(special + PLAIN) if by_units else re.compile("(?!)")
        self.letters, self.model = byte_letters(), self.tok.model
        self.units, self.words = Memory(self.unit, REMEMBERED, LONGEST_WORD), Memory(self.word, REMEMBERED, LONGEST_WORD)

    def unit(self, unit: str) -> bytes:
        spelt = unit if unit.isascii() else "".join(map(self.letters.__getitem__, unit.encode()))
        found = [t.id for t in self.model.tokenize(spelt)]
        return struct.pack(f"<{len(found)}I", *found)

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.plain.fullmatch(text):
            return b"".join(map(self.units.__getitem__, PLAIN_UNITS.findall(text.lower())))
        found = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def ids(self, text: str | None) -> bytes:
        out = b"".join(map(self.words.__getitem__, (text or "").encode("utf-8", "replace").split()))  # of bytes: the six ASCII spaces only
        self.words.turn()
        self.units.turn()
        return out


class Piece(NamedTuple):
    """Tokens of a document: its key, what stands before, the ids, and the tokens of the whole document."""

    key: str | None
    start: int
    ids: bytes
    doc_tokens: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[: n * WIDE]), self._replace(start=self.start + n, ids=self.ids[n * WIDE :])


class Packer:
    """Open windows of one task. Yields whole windows as lists of pieces; a document of several windows
    fills them by itself first."""

    def __init__(self, window: int = WINDOW, n_open: int = OPEN):
        self.window, self.n_open = window, n_open
        self.rooms: list[tuple[int, int]] = []  # (room, number), in order
        self.held: dict[int, list[Piece]] = {}
        self.numbers = count()

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        size = len(piece.ids) // WIDE
        while size >= self.window:
            head, piece = piece.cut(self.window)
            size -= self.window
            yield [head]
        while size:
            at = bisect_left(self.rooms, (size, -1))
            if at < len(self.rooms):
                room, number = self.rooms.pop(at)
                self.held[number].append(piece)
                if room == size:
                    yield self.held.pop(number)
                else:
                    insort(self.rooms, (room - size, number))
                return
            if len(self.rooms) < self.n_open:
                number = next(self.numbers)
                self.held[number] = [piece]
                insort(self.rooms, (self.window - size, number))
                return
            room, number = self.rooms.pop(0)  # the fullest
            head, piece = piece.cut(room)
            yield [*self.held.pop(number), head]
            size -= room

    def close(self) -> Iterator[list[Piece]]:
        """Packs the open windows into one another; the last list is what is left, less than a window, if any."""
        while len(self.rooms) > 1:
            self.n_open = len(self.rooms) - 1
            _, number = self.rooms.pop()  # the emptiest
            for piece in self.held.pop(number):
                yield from self.add(piece)
        for _, number in self.rooms:
            yield self.held[number]


def powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces as sequences whose lengths are powers of two, longest first."""
    left = sum(len(p.ids) for p in pieces) // WIDE
    pieces = pieces[::-1]
    while left:
        size, out = 1 << left.bit_length() - 1, []
        left -= size
        while size:
            piece = pieces.pop()
            if len(piece.ids) // WIDE > size:
                piece, rest = piece.cut(size)
                pieces.append(rest)
            out.append(piece)
            size -= len(piece.ids) // WIDE
        yield out


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task long"


def rows(windows: Iterator[tuple[int | None, list[Piece]]], keep: bool, task: int) -> Iterator[pd.DataFrame]:
    """Frames of the windows' pieces; ids of leftovers (windows without a number) always stay."""
    out: list[tuple] = []
    for number, pieces in windows:
        at = 0
        for p in pieces:
            n = len(p.ids) // WIDE
            out.append((p.key, p.start, n, zlib.crc32(p.ids), p.doc_tokens, number, at, p.ids if keep or number is None else None, task))
            at += n
        if len(out) >= PIECES:
            yield out
            out = []
    if out:
        yield out


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = 2, window: int = WINDOW, n_open: int = OPEN, ids: bool = True, merged: int = MERGED) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row for each piece.

    A document is the ids of its text, as the tokenizers file at path (which every executor has) gives
    them without special tokens, and then end. start is what stands before a piece in its document,
    offset in its sequence; every id lies in one piece. All sequences have window ids but for the last
    few, whose lengths are powers of two; so there is no padding. ids_crc32 is unsigned, of
    little-endian unsigned 32-bit ids; ids holds those bytes, null where ids is false. A null text is
    an empty one; with end None it has no piece. The key is of a type that goes to a string and back. Null and repeated keys stay, each row
    is a document of its own; no rows give none. A tokenizer whose words can't be encoded apart is
    refused with a ValueError. The result is in the checkpoint folder."""
    if window < 1 or n_open < 1 or merged < 2:
        raise ValueError("a window has one id at least, a task one open window, and two partitions are merged at least")
    kind = docs.select(F.col(key).alias("key")).schema["key"].dataType
    schema = f"key string, {PIECE}"
    columns = ["key", *[c.split()[0] for c in PIECE.split(", ")]]
    tail = np.array([end], "<u4").tobytes() if end is not None else b""

    def framed(windows: Iterator[tuple[int | None, list[Piece]]], task: int) -> Iterator[pd.DataFrame]:
        for out in rows(windows, ids, task):
            yield pd.DataFrame(out, columns=columns).astype({"sequence_id": "Int64", "task": "Int64"})

    def numbered(windows: Iterator[list[Piece]], level: int, task: int) -> Iterator[tuple[int | None, list[Piece]]]:
        k = level * LEVEL + task * TASK
        for pieces in windows:
            full = sum(len(p.ids) for p in pieces) == window * WIDE
            yield (k if full else None), pieces
            k += full

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, packer, made = TaskContext.get().partitionId(), Packer(window, n_open), encoder(path)

        def windows() -> Iterator[list[Piece]]:
            for b in batches:
                for k, t in zip(b["key"], b["text"], strict=True):
                    found = made.ids(t) + tail
                    yield from packer.add(Piece(k, 0, found, len(found) // WIDE))
            yield from packer.close()

        yield from framed(numbered(windows(), 0, task), task)

    def joined(level: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            group, packer, done, source = None, None, [], iter(())

            def read() -> Iterator[tuple[int, Piece]]:
                for b in batches:
                    for g, k, start, found, n in zip(b["group"].tolist(), b["key"], b["start"].tolist(), b["ids"], b["doc_tokens"].tolist(), strict=True):
                        yield g, Piece(k, start, bytes(found), n)

            for g, piece in read():
                if g != group:
                    if packer:
                        done.extend(packer.close())
                    if group is not None:
                        yield from framed(numbered(iter(done), level, group), group)
                    group, packer, done = g, Packer(window, n_open), []
                done.extend(packer.add(piece))
            if group is not None:
                done.extend(packer.close())
                yield from framed(numbered(iter(done), level, group), group)

        return run

    def last(level: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pieces = [Piece(k, start, bytes(found), n) for b in batches for k, start, found, n in zip(b["key"], b["start"].tolist(), b["ids"], b["doc_tokens"].tolist(), strict=True)]
            yield from framed(((level * LEVEL + i, x) for i, x in enumerate(powers(pieces))), 0)

        return run

    current = materialise(docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(encoded, schema))
    done = [current.where("sequence_id is not null")]
    level = 0
    while True:
        left = current.where("sequence_id is null").select("task", "key", "start", "ids", "doc_tokens", "offset")
        tasks = left.agg(F.countDistinct("task")).first()[0]
        level += 1
        if tasks <= 1:
            break
        group = left.withColumn("group", F.floor(F.col("task") / merged))
        dealt = group.repartition(max(1, -(-tasks // merged)), "group").sortWithinPartitions("group", "task", "offset")
        current = materialise(dealt.select("group", "key", "start", "ids", "doc_tokens").mapInPandas(joined(level), schema))
        done.append(current.where("sequence_id is not null"))
    done.append(left.repartition(1).sortWithinPartitions("offset").select("key", "start", "ids", "doc_tokens").mapInPandas(last(level), schema))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.select(F.col("key").cast(kind).alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("ids") if ids else F.lit(None).cast("binary").alias("ids"))


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, input_ids, piece_lengths) of the pieces that pack gave with their ids.

    input_ids are padded to window with pad, except where a sequence's length is a power of two;
    piece_lengths say where documents meet, for masks that keep them apart."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([np.frombuffer(b"".join(bytes(p) for p in x), "<u4").astype(np.int32) for x in b])

    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("all"), F.sum("length").alias("n_tokens"))
    given = F.pandas_udf(run, "array<int>", F.PandasUDFType.SCALAR_ITER)(F.col("all.ids"))
    short = (F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) != 0) & (F.col("n_tokens") < window)
    return grouped.select("sequence_id", "n_tokens", F.col("all.length").alias("piece_lengths"), given.alias("ids")).select(
        "sequence_id", "n_tokens", F.when(short, F.concat("ids", F.array_repeat(F.lit(pad), (F.lit(window) - F.col("n_tokens")).cast("int")))).otherwise(F.col("ids")).alias("input_ids"), "piece_lengths"
    )
