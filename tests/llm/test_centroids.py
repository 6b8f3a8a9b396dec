import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.llm import centroids


def order():
    return F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("doc.vec_id").cast("string"), F.lit(""))), 256)


def expected(vectors: list[tuple], k: int, rounds: int) -> list[tuple]:
    """Python integers throughout."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    own = [v for _, v in sorted(kept, key=lambda r: digest(r[0]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [min((far(v, c), j) for j, c in enumerate(own)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(own)):
            members = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]
            if members:
                own[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    at = assign()
    total = sum(d for d, _ in at)
    return [(i, c, d, sum(e for e, f in at if f == c), total, hashlib.sha256(",".join(map(str, own[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, at, strict=True)]


def got(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()]


def key(row):
    return (row[0] is None, *[x or 0 for x in row[:3]])


@pytest.mark.parametrize("scale,k,rounds", [(1.0, 8, 10), (1e-3, 3, 4), (100.0, 8, 2), (1e4, 5, 1)])
def test_equals_python_integers(spark, scale, k, rounds):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, scale, 64) + (i % 3) * scale]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(centroids.cluster(df, order(), k, rounds))
    assert sorted(found, key=key) == sorted(expected(rows, k, rounds), key=key)


def test_awkward_rows(spark):
    one = [float(np.float32(x)) for x in np.linspace(-1, 1, 64)]
    rows = [(1, one), (1, one), (None, [0.5] * 64), (2, None), (3, []), (4, one[:63]), (5, one + [0.0]), (6, [None, *one[1:]]), (7, [float("nan"), *one[1:]]), (8, [float("inf"), *one[1:]]), (9, [-0.0] * 64)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, doc string, planes int")
    assert sorted(got(centroids.cluster(df, order(), 8, 3)), key=key) == sorted(expected(rows, 8, 3), key=key)
    assert centroids.cluster(df.limit(0), order()).count() == 0
    assert centroids.cluster(df.where("vec_id = 3"), order()).collect() == []
    large = spark.createDataFrame([(1, [131071.9] * 64), (2, [-131072.0] * 64), (3, [131072.0] * 64), (4, [1e300] * 64), (5, [-1e300] * 64)], "vec_id long, embedding array<double>")
    found = got(centroids.cluster(large, order(), 2, 1))
    assert sorted(found, key=key) == sorted(expected([(1, [131071.9] * 64), (2, [-131072.0] * 64)], 2, 1), key=key)


def test_planes_go_there_and_back():
    rng = np.random.default_rng(0)
    for bits in (1, 5, 11, 27):
        values = rng.integers(-(1 << bits - 1), 1 << bits - 1, (50, 64)) if bits > 1 else -rng.integers(0, 2, (50, 64))
        planes = centroids.planes_of(values)
        assert (centroids.components_of(planes) == values).all()
        short = centroids.trimmed(planes)
        assert short.shape[1] <= bits and (centroids.components_of(short) == values).all()
        other = centroids.planes_of(values[::-1].copy())
        assert (centroids.dots(short, other) == (values * values[::-1]).sum(axis=1)).all()
        assert (centroids.dots(planes, other[:1]) == values @ values[-1]).all()
