"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, trained from document labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, materialise

SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"\w+")
#: Lengths of the beginnings of words that are features besides the words.
STEMS = (4, 5, 6)
#: Rows of each label that a fit reads, about; features kept at most; documents of the sample that must
#: have one; standard errors that its shares among toxic and clean documents must be apart.
PER_LABEL, FEATURES, SUPPORT, APART = 3000, 4096, 3, 4.0
#: Different sentences (as lists of features) of a document that a fit takes as they are; those beyond are
#: taken by their strongest feature alone, of which as many again may differ, and as sentences without one then.
#: So texts of any length take part, and what a fit gathers has a bound.
BAG = 256
#: Documents whose features are listed at a time.
LISTED = 64
#: Sentences that score this much are named as offending.
OFFENDING = 0.3
#: Words whose weights a task remembers.
REMEMBERED = 200_000


def features_of(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in STEMS if len(word) > n)]


def patterns(text: str, keep: dict[str, int]) -> Counter:
    """How often each list of kept feature numbers occurs as a sentence of the text."""
    out: Counter = Counter()
    for s in SENTENCE.finditer(text):
        out[tuple(sorted(keep[f] for w in TOKEN.findall(s[0].lower()) for f in features_of(w) if f in keep))] += 1
    return out


def bounded(found: Counter, most: int) -> Counter:
    """At most 2 * most + 1 lists of features that stand for all sentences of a document, none left out.

    Feature numbers run from the strongest on, so lists that come first in order stay as they are."""
    if len(found) <= most:
        return found
    ordered = sorted(found, key=lambda x: (not x, x))
    out, rest = Counter({x: found[x] for x in ordered[:most]}), Counter()
    for x in ordered[most:]:
        rest[x[:1]] += found[x]
    for i, x in enumerate(sorted(rest, key=lambda x: (not x, x))):
        out[x if i < most else ()] += rest[x]
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        memory: dict[str, float] = {}

        def weight(word: str) -> float:
            if word not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[word] = sum(self.weights.get(f, 0.0) for f in features_of(word))
            return memory[word]

        def score(text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
            spans, z = [], []
            for s in SENTENCE.finditer(text or ""):
                spans.append(s.span())
                z.append(self.bias + sum(map(weight, TOKEN.findall(s[0].lower()))))
            if not z:
                return 0.0, []
            stays = np.logaddexp(0, np.array(z))  # -log(1 - p) of each sentence
            p = -np.expm1(-stays)
            hot = np.nonzero(p >= OFFENDING)[0]
            return float(-np.expm1(-stays.sum())), [(*spans[i], float(p[i])) for i in hot]

        return score


def noisy_or_fit(docs: list[tuple[float, float, list[tuple[tuple[int, ...], int]]]], n_features: int, steps: int = 400, rate: float = 0.05, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, weight, [(features of a sentence, times)]) of documents.

    P(document) = 1 - prod (1 - p(sentence)); the weighted log loss with a square penalty is
    lowered by Adam over all documents at once, so the result depends on the data alone."""
    y, cw = np.array([d[0] for d in docs]), np.array([d[1] for d in docs])
    cw = cw / cw.sum()
    doc = np.array([i for i, d in enumerate(docs) for _ in d[2]])
    times = np.array([n for d in docs for _, n in d[2]], float)
    columns = np.array([f for d in docs for fs, _ in d[2] for f in fs], int)
    rows = np.repeat(np.arange(len(doc)), [len(fs) for d in docs for fs, _ in d[2]])
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = -6.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[columns], len(doc)) + w[-1]
        stays = np.bincount(doc, times * np.logaddexp(0, z), len(docs))
        p = -np.expm1(-stays)
        # d loss / d stays is 1 for a clean document and -(1 - P) / P for a toxic one
        pull = cw * np.where(y > 0.5, -(1 - p) / np.maximum(p, 1e-9), 1.0)
        slope = pull[doc] * times / (1 + np.exp(-z))
        g = np.append(np.bincount(columns, slope[rows], n_features), slope.sum()) + penalty * np.append(w[:-1], 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL, bag: int = BAG, seed: int = 11) -> Model:
    """Fit on about per_label documents of each label, of whatever length; ids that held_out() keeps back
    never take part.

    A document labelled more than once is toxic if one label says so; null labels and ids don't
    count. Sampled labels weigh as many rows as they stand for, so scores keep the true rate. The
    sample is 2 * per_label rows or so of two numbers and is sent to all tasks; the sampled texts are
    stored once, and what comes to the driver is FEATURES features and the sample's sentences as lists
    of their numbers, about 2 * bag a document at most. Without both labels every score is the share of toxic labels."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("key")).agg(F.max(F.col(label).cast("int")).alias("y"))
    sample = labelled_sample(known, "y", "key", per_label, seed)
    texts = materialise(docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key").select("y", "weight", "text"))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), LISTED):
                some = b.iloc[k : k + LISTED]
                found = [["", *{f for w in set(TOKEN.findall((t or "").lower())) for f in features_of(w)}] for t in some["text"]]
                yield pd.DataFrame({"y": np.repeat(some["y"].to_numpy(), [len(x) for x in found]), "f": pd.Series([f for x in found for f in x], dtype=object)})

    each = texts.mapInPandas(seen, "y int, f string").groupBy("f").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n"))
    rows = {r["f"]: (r["toxic"], r["n"]) for r in each.where("f = ''").collect()}
    n1, n = rows.get("", (0, 0))
    if n1 == 0 or n1 == n:
        rate = min(max(n1 / n if n else 0.0, 1e-6), 1 - 1e-6)
        return Model({}, float(np.log(rate / (1 - rate))))
    p1, p0 = F.col("toxic") / float(n1), (F.col("n") - F.col("toxic")) / float(n - n1)
    share = F.col("n") / float(n)
    z = (p1 - p0) / F.sqrt(share * (1 - share) * (1.0 / n1 + 1.0 / (n - n1)) + 1e-12)
    best = each.where((F.col("n") >= SUPPORT) & (F.abs(z) >= APART)).where("f <> ''").orderBy(F.abs(z).desc(), "f").limit(FEATURES)
    names = [r["f"] for r in best.select("f").collect()]
    keep = {f: i for i, f in enumerate(names)}

    def sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [bounded(patterns(t or "", keep), bag) for t in b["text"]]
            yield pd.DataFrame({"y": b["y"], "weight": b["weight"], "features": [[list(k) for k in c] for c in found], "times": [list(c.values()) for c in found]})

    bags = texts.mapInPandas(sentences, "y int, weight double, features array<array<int>>, times array<long>").collect()
    data = sorted((float(r["y"]), r["weight"], sorted((tuple(f), n) for f, n in zip(r["features"], r["times"], strict=True))) for r in bags)
    w, bias = noisy_or_fit(data, len(names))
    return Model({f: float(x) for f, x in zip(names, w, strict=True)}, bias)


SCORES = "score double, offending array<struct<start:long,end:long,score:double>>"


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc, score, offending) for every row; doc holds the row as it came, offending the sentences
    (code points, end exclusive) that score OFFENDING or more. A text without sentences, null
    included, scores 0. Repeated rows stay; no rows give none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scored = model.scorer()
        for texts in batches:
            found = [scored(t) for t in texts]
            hot = [[{"start": a, "end": b, "score": p} for a, b, p in spans] for _, spans in found]
            yield pd.DataFrame({"score": [x for x, _ in found], "offending": hot})

    return docs.select(F.struct("*").alias("doc"), F.pandas_udf(run, SCORES, F.PandasUDFType.SCALAR_ITER)(F.col(text)).alias("s")).select("doc", "s.*")
