"""Clustering of integer vectors around centroids, by popcounts over bit planes.

Plane i of a vector of 64 components is one uint64: bit k is bit i of component k in two's
complement. The dot product of two vectors is the sum over planes i and j of the weights of i and j
(2^i, and -2^i for the sign's plane) times the number of bits set in both planes. So squared
distances are exact, whatever order they are added up in. Each round assigns every vector and adds up
its cluster's components; only a cluster's count and sums come to the driver."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

WIDTH = 64
#: Components of this size or more are taken by no plane: their squared distances would pass 64 bits.
LARGEST = 1 << 27
#: Planes of numbers below LARGEST, with the sign's.
MOST_PLANES = 28
#: Vectors that are compared at a time.
BLOCK = 8192


class Centroid(NamedTuple):
    components: tuple[int, ...]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.components)).encode()).hexdigest()


def weights(n_planes: int) -> list[int]:
    return [1 << i for i in range(n_planes - 1)] + [-(1 << n_planes - 1)]


def planes_of(values: np.ndarray) -> np.ndarray:
    """(n, MOST_PLANES) uint64 of (n, WIDTH) int64."""
    bits = [np.packbits(((values >> i) & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0] for i in range(MOST_PLANES)]
    return np.stack(bits, axis=1) if len(values) else np.zeros((0, MOST_PLANES), np.uint64)


def trimmed(planes: np.ndarray) -> np.ndarray:
    """Without the highest planes that only repeat the sign of all vectors."""
    n = planes.shape[1]
    while n > 1 and (planes[:, n - 1] == planes[:, n - 2]).all():
        n -= 1
    return planes[:, :n]


def components_of(planes: np.ndarray) -> np.ndarray:
    """(n, WIDTH) int64 of (n, planes) uint64."""
    total = np.zeros((len(planes), WIDTH), np.int64)
    for i, w in enumerate(weights(planes.shape[1])):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, i]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits * np.int64(w)
    return total


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of n vectors with one, or of n with n, given as planes."""
    total = np.zeros(len(a), np.int64)
    for i, wi in enumerate(weights(a.shape[1])):
        for j, wj in enumerate(weights(b.shape[1])):
            plane = b[:, j]
            if plane.any():
                total += wi * wj * np.bitwise_count(a[:, i] & plane).astype(np.int64)
    return total


def nearest(planes: np.ndarray, norms: np.ndarray, centroids: list[Centroid]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector; ties go to the smaller number."""
    a, rows = trimmed(planes), []
    for c in centroids:
        own = np.array(c.components, np.int64)
        rows.append(norms + int((own * own).sum()) - 2 * dots(a, trimmed(planes_of(own[None, :]))))
    found = np.stack(rows)
    at = found.argmin(axis=0)
    return at, found[at, np.arange(len(at))]


def stored(planes: pd.Series) -> np.ndarray:
    return np.stack(planes.to_numpy()).astype(np.int64, copy=False).view(np.uint64) if len(planes) else np.zeros((0, MOST_PLANES), np.uint64)


def bit_planes(vectors: DataFrame, embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(doc, planes, norm) of the rows that have WIDTH components, none null, NaN or infinite; doc holds the
    row as it came, without the embedding. A component x counts as floor(scale * x), x as double; rows with
    one of LARGEST or more in size, or of less than -LARGEST, go too. norm is the squared length, by popcounts as well."""
    x = F.col(embedding)
    whole = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    fit = lambda v: v.isNotNull() & ~F.isnan(v) & (F.lit(float(scale)) * v.cast("double") < LARGEST) & (F.lit(float(scale)) * v.cast("double") >= -LARGEST)
    others = [F.col(c) for c in vectors.columns if c != embedding]
    given = vectors.where((F.size(x) == WIDTH) & F.forall(x, fit)).select(F.struct(*others).alias("doc") if others else F.struct(F.lit(0).alias("_")).alias("doc"), whole.alias("whole"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [planes_of(np.stack(b.iloc[i : i + BLOCK].to_numpy()).astype(np.int64, copy=False)) for i in range(0, len(b), BLOCK)]
            planes = np.concatenate(parts) if parts else np.zeros((0, MOST_PLANES), np.uint64)
            short = trimmed(planes)
            yield pd.DataFrame({"planes": list(planes.view(np.int64)), "norm": dots(short, short)})

    made = F.pandas_udf(run, "planes array<long>, norm long", F.PandasUDFType.SCALAR_ITER)
    return given.select("doc", made("whole").alias("made")).select("doc", "made.*")


def first_centroids(vectors: DataFrame, order: Column, k: int) -> list[Centroid]:
    """The k vectors that come first in order; where they tie, the smallest planes do."""
    rows = vectors.select("planes", order.alias("_order")).orderBy("_order", "planes").limit(k).collect()
    return [Centroid(tuple(components_of(np.array([r["planes"]], np.int64).view(np.uint64))[0].tolist())) for r in rows]


def totals(vectors: DataFrame, centroids: list[Centroid]) -> dict[int, tuple[int, int, list[int]]]:
    """{cluster: (vectors, squared distances, sums of components)} of the clusters that have any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), BLOCK):
                planes, norms = stored(b["planes"].iloc[i : i + BLOCK]), b["norm"].to_numpy(np.int64)[i : i + BLOCK]
                cluster, distance = nearest(planes, norms, centroids)
                values, rows = components_of(trimmed(planes)), []
                for c in np.unique(cluster):
                    own = cluster == c
                    rows.append((int(c), int(own.sum()), Decimal(sum(distance[own].tolist())), values[own].sum(axis=0)))
                yield pd.DataFrame(rows, columns=["cluster", "n", "distance", "sums"])

    partial = vectors.select("planes", "norm").mapInPandas(run, "cluster int, n long, distance decimal(38,0), sums array<long>")
    found = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("distance").alias("distance"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(20,0)")) for i in range(WIDTH)]).alias("sums"))
    return {r["cluster"]: (r["n"], int(r["distance"]), [int(x) for x in r["sums"]]) for r in found.collect()}


def moved(centroids: list[Centroid], found: dict[int, tuple[int, int, list[int]]]) -> list[Centroid]:
    """Each centroid at the floor of its vectors' means; one without vectors stays."""
    return [Centroid(tuple(s // found[i][0] for s in found[i][2])) if i in found else c for i, c in enumerate(centroids)]


def assigned(vectors: DataFrame, centroids: list[Centroid]) -> DataFrame:
    """(doc, cluster, distance) of every vector."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for planes, norm in batches:
            parts = [nearest(stored(planes.iloc[i : i + BLOCK]), norm.to_numpy(np.int64)[i : i + BLOCK], centroids) for i in range(0, len(planes), BLOCK)]
            cluster, distance = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else ([], [])
            yield pd.DataFrame({"cluster": np.asarray(cluster, np.int32), "distance": np.asarray(distance, np.int64)})

    near = F.pandas_udf(run, "cluster int, distance long", F.PandasUDFType.SCALAR_ITER)
    return vectors.select("doc", near("planes", "norm").alias("near")).select("doc", "near.*")


def cluster(vectors: DataFrame, order: Column, k: int = 8, rounds: int = 10, embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(doc, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of every vector that bit_planes keeps.

    order, over column doc, says which k vectors the centroids start as; ties go by the vectors' planes. Each
    round assigns every vector to the nearest centroid (ties: the smaller number), then puts the
    centroid at the floor of the mean; one without vectors stays. distance is squared, inertia its sum.
    Fewer vectors than k give fewer centroids, none give no rows; repeated rows count each."""
    kept = materialise(bit_planes(vectors, embedding, scale))
    centroids = first_centroids(kept, order, k)
    if not centroids:
        near = kept.select("doc", F.lit(0).alias("cluster"), F.col("norm").alias("distance"))
        return near.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.array().cast("array<long>").alias("centroid"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(centroids, totals(kept, centroids))
    found = totals(kept, centroids)
    at = lambda values: F.array(*values)[F.col("cluster")]
    return assigned(kept, centroids).select(
        "doc", "cluster", "distance", at([F.lit(found[i][1] if i in found else 0).cast("long") for i in range(len(centroids))]).alias("cluster_inertia"),
        F.lit(sum(x[1] for x in found.values())).cast("long").alias("inertia"), at([F.array(*map(F.lit, c.components)).cast("array<long>") for c in centroids]).alias("centroid"),
        at([F.lit(c.sha256) for c in centroids]).alias("centroid_sha256"),
    )
