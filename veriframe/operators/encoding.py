"""Inputs of encoders and fine-tuning, cut to a budget on lists of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

IGNORED = -100


def words(text: Column) -> Column:
    """Tokens by white space, a stand-in for a model's tokenizer (a column function from text to an array)."""
    return F.filter(F.split(text, t.SPACES), lambda w: w != "")


def budgeted(cases: DataFrame, budget: int, tokens=words) -> DataFrame:
    """(id, tokens, n_chunks_kept, n_chunks_total, truncated): the question, as many chunks as fit, the answer.

    The answer stays whole as long as it fits alone; then the question is cut at its end; chunks fill
    what is left from the first on, the last of them cut. Room is a running sum over a case's own chunks."""
    parts = cases.select("id", tokens(F.col("question")).alias("head"), F.transform(t.chunks(F.col("context")), tokens).alias("chunks"), tokens(F.col("answer")).alias("tail"))
    parts = parts.withColumn("alone", F.size("tail") >= budget).withColumn("tail", F.slice("tail", 1, budget))
    parts = parts.withColumn("kept_head", F.when(F.col("alone"), F.array().cast("array<string>")).otherwise(F.slice("head", F.lit(1), budget - F.size("tail"))))
    room = F.when(F.col("alone"), F.lit(0)).otherwise(budget - F.size("tail") - F.size("kept_head"))
    joined = parts.withColumn("room", room).withColumn("all", F.flatten("chunks"))
    begins = F.transform("chunks", lambda _, i: F.aggregate(F.slice("chunks", F.lit(1), i), F.lit(0), lambda n, c: n + F.size(c)))
    fits = F.size(F.filter(F.arrays_zip(begins.alias("at"), F.col("chunks").alias("c")), lambda x: x["at"] < F.col("room")))
    return joined.select(
        "id", F.concat("kept_head", F.slice("all", F.lit(1), F.col("room")), "tail").alias("tokens"), fits.alias("n_chunks_kept"), F.size("chunks").alias("n_chunks_total"),
        (F.col("alone") | (F.size("kept_head") < F.size("head")) | (F.size("all") > F.col("room"))).alias("truncated"),
    )


def masked(prompt: Column, completion: Column, most: int) -> Column:
    """struct<input, labels> of two token lists: the prompt loses its beginning so that the completion always fits
    (an error where it can't), and prompt places are IGNORED in the labels."""
    room = most - F.size(completion)
    kept = F.when(room < 1, F.raise_error(F.lit("no room for the completion")).cast("array<int>")).otherwise(F.slice(prompt, F.greatest(F.size(prompt) - room, F.lit(0)) + 1, F.greatest(room, F.lit(0))))
    return F.struct(F.concat(kept, completion).alias("input"), F.concat(F.transform(kept, lambda _: F.lit(IGNORED)), completion).alias("labels"))
