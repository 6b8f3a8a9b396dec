import zipfile

import pytest
from pyspark.sql import functions as F

from veriframe.sources import archives


def archive(path, **members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/", 1) if name.startswith("__") else f"{name}.csv", text)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_only_and_all_members(spark, tmp_path):
    archive(tmp_path / "a.zip", b='﻿a,"b c"\n1,"two\nlines"\n\n3\n', c="a\n9\n")
    with zipfile.ZipFile(tmp_path / "a.zip", "a") as z:
        z.writestr("__MACOSX/x.csv", "a\nno\n")
        z.writestr("readme.txt", "no")
    archive(tmp_path / "d.zip", e="other,a\nx,7\n")
    at = str(tmp_path / "a.zip")
    assert rows(archives.read(spark, at, ["b c", "a"], archives.FIRST)) == [("", "3"), ("two\nlines", "1")]
    with pytest.raises(Exception, match="expected one CSV"):
        archives.read(spark, at, ["a"], archives.ONLY).collect()
    assert rows(archives.read(spark, str(tmp_path / "d.zip"), ["a"], archives.ONLY)) == [("7",)]
    every = archives.read(spark, f"file://{tmp_path}", ["a"])
    assert rows(every) == [("1",), ("3",), ("7",), ("9",)] and every.rdd.getNumPartitions() == 3


def test_no_archives_no_rows_and_damage(spark, tmp_path):
    assert rows(archives.read(spark, str(tmp_path), ["a"])) == []
    archive(tmp_path / "h.zip", h="a,b\n", z="")
    assert rows(archives.read(spark, str(tmp_path), ["a"])) == []
    archive(tmp_path / "x.zip", x="a\n" + "line of some length\n" * 500)
    data = bytearray((tmp_path / "x.zip").read_bytes())
    data[60] ^= 255
    (tmp_path / "x.zip").write_bytes(data)
    with pytest.raises(Exception):  # noqa: B017
        archives.read(spark, str(tmp_path), ["a"]).collect()


def test_round_trip_in_small_members_and_batches(spark, tmp_path, monkeypatch):
    texts = ['quo"te, comma', "line\r\nend\n", "", None, "é" * 5000, " spaces ", "same", "same", "\x00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "id long, text string").repartition(3)
    folder = str(tmp_path / "out")
    archives.write(df, folder, 3000)
    archives.write(df.limit(0), folder)
    back = archives.read(spark, folder, ["id", "text"])
    assert back.rdd.getNumPartitions() > 3
    assert rows(back) == sorted((str(i), t or "") for i, t in enumerate(texts * 20))
    archives.write(df.limit(1).select("id", F.lit("more").alias("text")), folder)
    assert archives.read(spark, folder, ["text"]).where("text = 'more'").count() == 1


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(archives, "BATCH_ROWS", 3)
    monkeypatch.setattr(archives, "BATCH_CHARS", 10)
    lines = iter([["a"], ["xx"], ["yy"], ["zz"], ["12345678"], ["123456789012"], ["q"]])
    assert [b.num_rows for b in archives.batches(lines, ["a"])] == [3, 1, 1, 1]
