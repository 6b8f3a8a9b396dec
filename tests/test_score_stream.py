import json

import pandas as pd
import pytest

from veriframe.streaming import incremental

CASES, SCORES = "id string, answer string", "id string, score double"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def found(spark, sink):
    return sorted(tuple(r) for r in spark.read.schema(SCORES).json(str(sink)).collect())


def length(df):
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "score": b["answer"].str.len().fillna(0).astype(float)})

    return df.mapInPandas(run, SCORES)


def failing(df):
    def run(batches):
        for b in batches:
            raise RuntimeError("the scorer broke")
            yield b

    return df.mapInPandas(run, SCORES)


def test_each_id_once_over_batches_restarts_and_a_failure(spark, tmp_path):
    source, sink, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    go = lambda scorer: incremental.score_stream(spark, str(source), CASES, str(sink), str(check), scorer).awaitTermination()
    put(source, "a.json", [{"id": "1", "answer": "x"}, {"id": "2", "answer": "xx"}, {"id": "1", "answer": "x"}, {"id": None, "answer": "lost"}])
    go(length)
    assert found(spark, sink) == [("1", 1.0), ("2", 2.0)]
    put(source, "b.json", [{"id": "2", "answer": "again"}, {"id": "3", "answer": "xxx"}, {"id": "4", "answer": None}])
    with pytest.raises(Exception, match="the scorer broke|failed"):
        go(failing)
    assert found(spark, sink) == [("1", 1.0), ("2", 2.0)]
    go(length)
    assert found(spark, sink) == [("1", 1.0), ("2", 2.0), ("3", 3.0), ("4", 0.0)]
    go(length)  # nothing new
    put(source, "c.json", [{"id": str(i), "answer": "y" * i} for i in range(1, 7)])
    go(length)
    assert [i for i, _ in found(spark, sink)] == ["1", "2", "3", "4", "5", "6"]


def test_a_batch_reads_no_earlier_results(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    for k in range(3):
        put(source, f"{k}.json", [{"id": f"{k}-{i}", "answer": "z"} for i in range(20)])
        q = incremental.score_stream(spark, str(source), CASES, str(sink), str(tmp_path / "check"), length)
        q.awaitTermination()
        assert q.lastProgress["numInputRows"] == 20
        assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) == 20 * (k + 1)
    assert len(found(spark, sink)) == 60
