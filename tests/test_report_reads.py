from pyspark.sql import functions as F

from veriframe.operators import report

from .test_report import AXES, frames


def test_cases_and_folds_are_read_once(spark):
    df, folds = frames(spark, 40)
    seen, placed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(of):
        def one(batches):
            for b in batches:
                of.add(len(b))
                yield b

        return one

    cases, where = df.mapInPandas(counting(seen), df.schema), folds.mapInPandas(counting(placed), folds.schema)
    rows = report.assemble(cases, where, AXES, invalid=F.col("bad"), b=50, trials=20).collect()
    assert seen.value == df.count() and placed.value == folds.count() and rows
