import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriframe.operators import report
from veriframe.sources import writers


def frames(spark, n=80):
    rng = np.random.default_rng(4)
    y, z = (rng.random((2, n)) < 0.5).astype(int)
    rows = [(f"c{i}", int(y[i] & z[i]), int(y[i]), int(z[i]), float(0.3 * y[i] + 0.7 * rng.random()), float(0.3 * z[i] + 0.7 * rng.random()), i % 10 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, both int, faith int, rel int, pf double, pr double, bad boolean").withColumn("s", F.col("pf") * F.col("pr"))
    folds = spark.createDataFrame([(f"c{i}", r, int(rng.integers(0, 3))) for i in range(n - 5) for r in range(2)], "id string, repeat int, fold int")
    return df, folds


AXES = {"reliable": ("both", "s"), "faithfulness": ("faith", "pf"), "relevance": ("rel", "pr")}


def test_every_metric_has_an_interval_and_a_place_in_the_noise(spark):
    df, folds = frames(spark)
    other = df.select("id", F.col("both").alias("y"), (F.col("s") > 0.4).cast("int").alias("pred")).where("id <> 'c3'")
    rows = report.assemble(df, folds, AXES, invalid=F.col("bad"), others={"plain": other}, b=300, trials=60)
    found = {(r["section"], r["name"]): r["value"] for r in rows.collect()}
    for section in ("primary", "axis.faithfulness", "axis.relevance"):
        assert found[section, "ci_lo"] <= found[section, "value"] <= found[section, "ci_hi"]
        assert 0 <= found[section, "null_percentile"] <= 100 and found[section, "above_noise"] == (found[section, "null_percentile"] > 95)
    assert found["coverage", "n"] == 75 and found["coverage", "excluded_n"] == 5 and found["comparison.plain", "n_common"] == 74
    assert found["diagnostics", "invalid_output_rate"] == pytest.approx(0.1)
    thresholds = [v for (s, _), v in found.items() if s == "thresholds"]
    assert len(thresholds) == 6 and found["diagnostics", "operating_threshold"] == pytest.approx(np.median(thresholds)) and found["diagnostics", "threshold_sd"] == pytest.approx(np.std(thresholds))
    repeats = [v for (s, _), v in found.items() if s == "repeats"]
    assert len(repeats) == 2 and found["diagnostics", "mean_per_repeat_f1"] == pytest.approx(np.mean(repeats))
    assert found["primary", "null_percentile"] > 50 and len(found) == rows.count()
    said = json.loads(writers.report_json(rows, method="m", variant="v", protocol={"b": 300}).first()["json"])
    assert said["schema_version"] == 1 and said["sections"]["primary"]["value"] == found["primary", "value"] and json.loads(said["protocol"]) == {"b": 300}


def test_a_report_without_interval_or_primary_is_refused(spark):
    whole = [("primary", n, 0.5) for n in ("value", "ci_lo", "ci_hi", "null_percentile")]
    frame = lambda rows: spark.createDataFrame(rows, "section string, name string, value double")
    assert json.loads(writers.report_json(frame(whole), method="m", variant="v").first()["json"])["sections"]["primary"]["ci_lo"] == 0.5
    for broken in (whole[:-1], [*whole[:2], ("primary", "ci_hi", None), whole[3]], [*whole, ("axis.x", "value", 1.0)], [("other", "n", 1.0)]):
        with pytest.raises(Exception, match="without interval|no primary"):
            writers.report_json(frame(broken), method="m", variant="v").collect()
    df, folds = frames(spark, 20)
    with pytest.raises(ValueError, match="none of the axes"):
        report.assemble(df, folds, AXES, primary="other")
