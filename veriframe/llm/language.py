"""Language identification with blended-spectrum string kernels.

Two texts are as alike as the character n-grams (n = 1, 2, 3) they share: the number present in
both over the root of the product of their numbers. Nyström landmarks turn that into features, and
one-versus-rest kernel ridge regression scores them in batched matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, held_out, labelled_sample, materialise

#: Rows of each language that a fit reads, about; landmarks of each language; ridge.
PER_LABEL, LANDMARKS, RIDGE = 500, 24, 1e-3
#: Landmarks of all languages together at most; n-grams of one landmark at most; bytes of the matrix of landmarks
#: at most, which is what goes to all tasks.
ALL_LANDMARKS, LANDMARK_GRAMS, MODEL_BYTES = 1536, 16_384, 128 << 20
#: Code points whose n-grams are listed at a time, texts in a matrix product, and bytes of a batch's matrix.
BLOCK, BATCH, BATCH_BYTES = 1 << 20, 64, 32 << 20
UNKNOWN = "und"
#: How steeply a lead in the regression becomes a score.
SHARPNESS = 6.0


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of a text as numbers, three code points of 21 bits each, sorted.

    Case is folded to lower; runs of white space are one space, as are both ends."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found = np.empty(0, np.uint64)
    for i in range(0, len(points), BLOCK):
        p = points[i : i + BLOCK + 2]
        two = p[:-1] | p[1:] << np.uint64(21)
        three = two[:-1] | p[2:] << np.uint64(42)
        found = np.unique(np.concatenate([found, p, two, three]))
    return found


def sketch(found: np.ndarray, most: int) -> np.ndarray:
    """At most so many of a text's n-grams, those that a mixing of their bits puts first: an even sample of
    the whole text's, whatever its length, and all where there are no more. Sorted."""
    if len(found) <= most:
        return found
    mixed = found * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.sort(found[np.argsort(mixed ^ mixed >> np.uint64(32), kind="stable")[:most]])


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # n-grams of the landmarks, sorted
    landmarks: np.ndarray  # n-grams x landmarks: presence over the root of the landmark's number
    weights: np.ndarray  # landmarks x languages
    dropped: int = 0  # n-grams of landmarks that MODEL_BYTES left no room for

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Texts x landmarks, by matrix products of BATCH texts, or of as many as BATCH_BYTES hold."""
        out = np.empty((len(texts), self.landmarks.shape[1]), np.float32)
        batch = max(1, min(BATCH, BATCH_BYTES // (4 * max(1, len(self.vocabulary)))))
        for k in range(0, len(texts), batch):
            part = texts[k : k + batch]
            x = np.zeros((len(part), len(self.vocabulary)), np.float32)
            for i, t in enumerate(part):
                g = grams(t)
                at = np.searchsorted(self.vocabulary, g)
                at[at == len(self.vocabulary)] = 0
                x[i, at[self.vocabulary[at] == g]] = 1 / len(g) ** 0.5
            out[k : k + len(part)] = x @ self.landmarks
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not known or not self.languages:
            return out
        values = self.kernel([texts[i] for i in known]) @ self.weights
        e = np.exp(SHARPNESS * (values - values.max(axis=1, keepdims=True)))
        e /= e.sum(axis=1, keepdims=True)
        for i, best, p in zip(known, e.argmax(axis=1).tolist(), e.max(axis=1).tolist(), strict=True):
            out[i] = (self.languages[best], min(1.0, p))
        return out


def place_landmarks(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """N-grams of the landmarks, given as sorted lists of theirs, their matrix, and how many n-grams were left out:
    where the matrix would be over MODEL_BYTES, those that most landmarks have stay, of equals the smaller numbers."""
    vocabulary, seen = np.unique(np.concatenate(lists), return_counts=True) if lists else (np.empty(0, np.uint64), np.empty(0, int))
    every = len(vocabulary)
    most = max(1, MODEL_BYTES // (4 * max(1, len(lists))))
    if every > most:
        vocabulary = np.sort(vocabulary[np.argsort(-seen, kind="stable")[:most]])
    matrix = np.zeros((len(vocabulary), len(lists)), np.float32)
    for j, g in enumerate(lists):
        matrix[np.searchsorted(vocabulary, g[np.isin(g, vocabulary, assume_unique=True)]), j] = 1 / len(g) ** 0.5
    return vocabulary, matrix, every - len(vocabulary)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = PER_LABEL, landmarks: int = LANDMARKS, seed: int = 5) -> Model:
    """Fit on about per_label texts of each language, of whatever length, landmarks of them (fewer where
    ALL_LANDMARKS would be passed) to the driver.

    Rows with a null text or lang, without a letter, or held out never take part. Texts stay in the tasks: of a
    landmark its n-grams come to the driver, LANDMARK_GRAMS at most (a sketch of the whole text beyond
    that), and of the others of the sample their kernel rows: per_label numbers of languages times landmarks.
    Without any row to learn from, every text is UNKNOWN."""
    usable = docs.where(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull() & ~held_out(F.col(doc_id)))
    usable = usable.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sample = labelled_sample(usable, "lang", "key", per_label, seed)
    order = hash_fraction(F.col("key"), seed)
    sample = materialise(sample.withColumn("place", order * F.col("weight")))
    landmarks = max(1, min(landmarks, ALL_LANDMARKS // max(1, sample.select("lang").distinct().count())))

    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["grams"] = [sketch(grams(t), LANDMARK_GRAMS).astype(np.int64) for t in b["text"]]
            yield b.drop(columns="text")

    chosen = sample.where(F.col("place") < landmarks / per_label)
    if not chosen.limit(1).count():  # fewer rows than landmarks
        chosen = sample.orderBy("place", "key", "text").limit(landmarks)
    placed = chosen.select("lang", "place", "key", "text").mapInPandas(sketches, "lang string, place double, key string, grams array<long>").collect()
    placed = sorted(placed, key=lambda r: (r["lang"], r["place"], r["key"], r["grams"]))
    vocabulary, matrix, dropped = place_landmarks([np.array(r["grams"], np.int64).astype(np.uint64) for r in placed])
    half = Model([], vocabulary, matrix, np.empty((matrix.shape[1], 0)), dropped)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "k": list(half.kernel(list(b["text"])).astype(np.float64))})

    data = sorted((r["lang"], tuple(r["k"])) for r in sample.select("lang", "text").mapInPandas(rows, "lang string, k array<double>").collect())
    if not data:
        return half
    languages = sorted({d[0] for d in data})
    k = np.array([d[1] for d in data])
    y = np.array([[1.0 if d[0] == x else -1.0 for x in languages] for d in data])
    values, vectors = np.linalg.eigh(half.landmarks.T.astype(np.float64) @ half.landmarks)
    root = vectors / np.sqrt(np.maximum(values, 1e-8)) @ vectors.T
    phi = k @ root
    balance = np.array([len(data) / sum(d[0] == x for d in data) for x in languages])[np.argmax(y, axis=1)]
    ridge = np.linalg.solve(phi.T @ (phi * balance[:, None]) + RIDGE * len(data) * np.eye(phi.shape[1]), phi.T @ (y * balance[:, None]))
    return Model(languages, vocabulary, matrix, (root @ ridge).astype(np.float32), dropped)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc, lang_pred, score) for every row; doc holds the row as it came. UNKNOWN and 0 for a text
    that is null or has no letter. Repeated rows stay; no rows give none. The model has at most
    MODEL_BYTES and is sent to each task once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(shared.value.predict(list(texts)), columns=["lang_pred", "score"])

    udf = F.pandas_udf(run, "lang_pred string, score double", F.PandasUDFType.SCALAR_ITER)
    return docs.select(F.struct("*").alias("doc"), udf(F.col(text)).alias("p")).select("doc", "p.*")
