"""Runs a query and its SQL on the same tables and compares all rows."""

import decimal
import math
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def family(kind: str) -> str:
    kind = kind.lower()
    for name, words in {"float": ("double", "float", "decimal"), "int": ("int", "long"), "bool": ("bool",), "text": ("string", "varchar"), "time": ("timestamp", "date")}.items():
        if any(kind.startswith(w) or kind.endswith(w) for w in words):
            return name
    return "other"


def compare(df: DataFrame, sql: str, sf_dir: str) -> None:
    con = connection(sf_dir)
    kinds = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    names = sorted(df.columns)
    assert names == sorted(kinds), (names, sorted(kinds))
    ours = {n: family(k) for n, k in df.dtypes}
    assert ours == {n: family(k) for n, k in kinds.items()}, (df.dtypes, kinds)
    assert "HUGEINT" not in kinds.values(), kinds
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    want = Counter(tuple(map(plain, r)) for r in con.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({sql}) q").fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3], sum(got.values()), sum(want.values()))
    assert sum(got.values()) > 0
