"""Scoring that goes on where it stopped: only ids without a score are computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Scorer = Callable[[DataFrame], DataFrame]


def remaining(cases: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Cases that have no result yet."""
    return cases.join(done.select(key), key, "left_anti")


def score_new(cases: DataFrame, done: DataFrame, scorer: Scorer, key: str = "id") -> DataFrame:
    """Results of the remaining cases beside those there are; reruns change nothing."""
    return done.unionByName(scorer(remaining(cases, done, key)).select(*done.columns))


def in_order(results: DataFrame, cases: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """Results in the order of the cases."""
    return results.join(cases.select(key, order), key).orderBy(order).drop(order)


def score_stream(spark: SparkSession, source: str, case_schema: str, sink: str, checkpoint: str, scorer: Scorer, key: str = "id") -> StreamingQuery:
    """Scores cases as JSON files of them arrive, each id once, whichever batch or file it comes in again.

    Which ids were seen is keyed state in the checkpoint, dealt over the shuffle partitions, so a batch costs
    what its own rows cost however much was scored before. The sink is the stream's own folder: its
    log names the files of finished batches, so a batch that died halfway leaves nothing to see and runs
    again whole. scorer maps rows to rows (columns, mapInPandas); rows without an id are left out. For very
    many ids let the session keep its state in RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    stream = spark.readStream.schema(case_schema).json(source)
    fresh = stream.where(F.col(key).isNotNull()).dropDuplicates([key])
    return scorer(fresh).writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_epochs(log: DataFrame) -> DataFrame:
    """(repeat, fold, epoch, is_degenerate) of each fold's last epoch."""
    return log.groupBy("repeat", "fold").agg(F.max_by(F.struct("epoch", "is_degenerate"), "epoch").alias("l")).select("repeat", "fold", "l.*")


def kept_epochs(log: DataFrame, keep: int) -> DataFrame:
    """(repeat, fold, epoch) of the last keep different epochs of each fold: the checkpoints to hold on to."""
    place = F.row_number().over(Window.partitionBy("repeat", "fold").orderBy(F.col("epoch").desc()))
    return log.select("repeat", "fold", "epoch").distinct().withColumn("place", place).where(F.col("place") <= keep).drop("place")


def collapsed(log: DataFrame) -> DataFrame:
    """One row: whether every fold was degenerate at its last epoch."""
    return last_epochs(log).agg(F.coalesce(F.bool_and("is_degenerate"), F.lit(False)).alias("collapsed"), F.count(F.lit(1)).alias("n_folds"))
