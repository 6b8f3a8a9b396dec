"""Token counts of texts of any length, by overlapping chunks that are spliced where both must agree."""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and of the part that a chunk shares with the next one.
CHUNK, OVERLAP = 4096, 256
#: Chunks encoded at a time.
BATCH = 256
#: The longest contraction that the byte-level splitter looks ahead for.
CONTRACTION = 3
COLUMNS = "n_bytes long, n_tokens long, n_chunks long, n_widened long"


def unsuitable(said: dict) -> str | None:
    """Why the boundaries of a tokenizer, given as its file says, can't be proven; None where they can.

    The proof needs that a unit depends on nothing to its left and that what lies right of it decides
    it within a known reach."""
    cutter, after = said["pre_tokenizer"] or {}, said["post_processor"] or {}
    if said["normalizer"] is not None:
        return "its normaliser may change characters across a cut"
    if cutter.get("type") != "ByteLevel" or not cutter.get("use_regex", True):
        return "it is not cut into units by the byte-level pattern"
    if cutter.get("add_prefix_space"):
        return "it puts a space before every text, so before every chunk"
    if after.get("type", "ByteLevel") != "ByteLevel":
        return "its post-processor may add tokens"
    if said["model"]["type"] != "BPE" or said["model"].get("dropout"):
        return "its units aren't encoded alike every time"
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]):
        return "its added tokens look at what stands beside them"
    return None


@lru_cache(maxsize=4)
def tokenizer(path: str, proven: bool = True):
    """(tokenizer, reach): boundaries nearer than reach to a chunk's end may move once more text
    follows, as a special string or a contraction may be cut there."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the unit of work here
    from tokenizers import Tokenizer, processors

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    if not proven:
        return found, 0
    with open(path, "rb") as f:
        said = json.load(f)
    if reason := unsuitable(said):
        raise ValueError(f"{path}: {reason}; count its whole texts with chunk=None")
    found.post_processor = processors.ByteLevel(trim_offsets=False)  # changes offsets only: units then lie end to end
    return found, 1 + max([CONTRACTION, *[len(t["content"]) for t in said["added_tokens"]]])


def common_end(left, left_at: int, right, right_at: int, low: int, high: int) -> tuple[int, int, int] | None:
    """(place, tokens of left before it, tokens of right before it) of the first place after low and
    up to high where a unit ends in both encodings; they start at left_at and right_at in the text."""
    at = low
    while at < high:
        a, b = left.char_to_word(at - left_at), right.char_to_word(at - right_at)
        if a is None or b is None:  # a special string
            at += 1
            continue
        end_a, end_b = left.word_to_chars(a)[1] + left_at, right.word_to_chars(b)[1] + right_at
        if end_a == end_b <= high:
            return end_a, left.word_to_tokens(a)[1], right.word_to_tokens(b)[1]
        at = max(end_a, end_b) if end_a != end_b else high
    return None


class Splice:
    """The running count of one text, fed with its chunks from left to right.

    What is known at any time is a place, start, that is a true boundary, and an encoding of the text
    from somewhere up to there on, whose units after start are right but for those within reach of its
    end: units are found from left to right and what decides one lies before that. The next chunk
    starts at an arbitrary place in the overlap. At a place where a unit ends in both, and that is out
    of reach of the end, both go on alike, so the counts are spliced there and the next chunk takes
    over. Where there is no such place, the overlap is widened: the left part is encoded anew from
    start, twice as far each time, and chunks that it has passed are dropped."""

    def __init__(self, text: str, tok, reach: int, overlap: int):
        self.text, self.tok, self.reach, self.wider = text, tok, reach, overlap
        self.overlap, self.total, self.chunks, self.widened = overlap, 0, 0, 0
        self.encoding, self.at, self.end, self.before = None, 0, 0, 0

    def feed(self, begin: int, end: int, encoding) -> None:
        self.chunks += 1
        if self.encoding is None:
            self.encoding, self.at, self.end = encoding, begin, end
            return
        while self.end < end:
            # from the middle of the overlap first, where the new chunk has had time to fall into step
            for low in ((begin + self.end) // 2, begin + 1):
                found = common_end(self.encoding, self.at, encoding, begin, low, self.end - self.reach)
                if found:
                    _, left, right = found
                    self.total += left - self.before
                    self.encoding, self.at, self.end, self.before, self.wider = encoding, begin, end, right, self.overlap
                    return
            self.widen()

    def widen(self) -> None:
        self.widened += 1
        self.wider *= 2
        start = self.encoding.token_to_chars(self.before)[0] + self.at if self.before else self.at
        self.end = min(len(self.text), self.end + self.wider)
        self.encoding = self.tok.encode(self.text[start : self.end], add_special_tokens=False)
        self.at, self.before = start, 0

    def count(self) -> int:
        return self.total + len(self.encoding) - self.before


def cuts(n: int, chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the chunks of a text of n characters, at least one."""
    for begin in range(0, max(1, n - overlap), chunk - overlap):
        yield begin, min(n, begin + chunk)


def counts(tok, reach: int, texts: Iterable[str], chunk: int = CHUNK, overlap: int = OVERLAP, batch: int = BATCH) -> Iterator[tuple[int, int, int]]:
    """(tokens, chunks, times an overlap was widened) of each text, in order. Chunks of all texts are
    encoded together, so at most batch chunks are held as tokens."""
    if chunk < 2 * overlap:
        raise ValueError("a chunk must be twice its overlap at least")
    pieces = ((t, begin, end) for t in texts for begin, end in cuts(len(t), chunk, overlap))
    current: Splice | None = None
    while part := list(itertools.islice(pieces, batch)):
        for (text, begin, end), encoding in zip(part, tok.encode_batch([t[b:e] for t, b, e in part], add_special_tokens=False), strict=True):
            if begin == 0:
                if current:
                    yield current.count(), current.chunks, current.widened
                current = Splice(text, tok, reach, overlap)
            current.feed(begin, end, encoding)
    if current:
        yield current.count(), current.chunks, current.widened


def count_tokens(docs: DataFrame, path: str, text: str = "text", chunk: int | None = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc, n_bytes, n_tokens, n_chunks, n_widened) for every row; doc holds the row as it came.

    path is a tokenizers file that every executor has. A null text is an empty one: 0 tokens in one
    empty chunk. Every text goes by chunks, so what is held as tokens is bounded by chunks and by the
    longest run without a boundary. A tokenizer whose boundaries can't be proven is refused with a
    ValueError that says why; chunk=None encodes whole texts with any tokenizer. Repeated rows stay; no
    rows give none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tok, reach = tokenizer(path, chunk is not None)
        for texts in batches:
            texts = [t or "" for t in texts]
            if chunk is None:
                found = ((len(tok.encode(t, add_special_tokens=False)), 1, 0) for t in texts)
            else:
                found = counts(tok, reach, texts, chunk, overlap)
            yield pd.DataFrame([(len(t.encode("utf-8", "surrogatepass")), *x) for t, x in zip(texts, found, strict=True)], columns=["n_bytes", "n_tokens", "n_chunks", "n_widened"])

    return docs.select(F.struct("*").alias("doc"), F.pandas_udf(run, COLUMNS, F.PandasUDFType.SCALAR_ITER)(F.col(text)).alias("n")).select("doc", "n.*")
