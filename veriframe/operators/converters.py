"""Raw organiser rows to cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import case_id
from ..functions.text import strip
from ..schemas import MARKERS

CHUNKS = tuple(f"chunk_{i}" for i in range(1, 9))
REQUIRED = ("full_dialog", "answer", *CHUNKS, "binary_relevancy", "binary_faithfulness", "markers")


def is_organiser(df: DataFrame) -> bool:
    return set(REQUIRED) <= set(df.columns)


def bool_label(value: Column) -> Column:
    """true/1 to 1, false/0 to 0 in any case; anything else is an error."""
    v = F.lower(strip(value))
    return F.when(v.isin("true", "1"), 1).when(v.isin("false", "0"), 0).otherwise(F.raise_error(F.concat(F.lit("not a label: "), F.coalesce(value, F.lit("null")))).cast("int"))


def binary(value: Column) -> Column:
    """As bool_label, null in place of the error."""
    v = F.lower(strip(value))
    return F.when(v.isin("true", "1"), 1).when(v.isin("false", "0"), 0)


def marker_list(value: Column) -> Column:
    """Quoted items of a written list."""
    return F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0)), lambda m: F.substr(m, F.lit(2), F.length(m) - 2))


def first_marker(markers: Column, reliable: Column) -> Column:
    """`none` for reliable rows, else the first item; `unknown` where there is none or it is no code."""
    first = F.try_element_at(markers, F.lit(1))
    return F.when(reliable == 1, "none").when(first.isin(*MARKERS), first).otherwise("unknown")


def resolved_marker(marker: Column, reliable: Column) -> Column:
    return F.coalesce(F.nullif(marker, F.lit("")), F.when(reliable == 1, "none").otherwise("unknown"))


def numbered_context(columns: Sequence[str] = CHUNKS) -> Column:
    """Chunks that hold text, each under its own number, a blank line between."""
    one = lambda c, i: F.when(strip(F.coalesce(c, F.lit(""))) == "", F.lit("")).otherwise(F.concat(F.lit("[CHUNK "), (i + 1).cast("string"), F.lit("]\n"), strip(c)))
    return F.array_join(F.filter(F.transform(F.array(*[F.col(c) for c in columns]), one), lambda x: x != ""), "\n\n")


def organiser_cases(raw: DataFrame) -> DataFrame:
    f, r = bool_label(F.col("binary_faithfulness")), bool_label(F.col("binary_relevancy"))
    both = raw.withColumn("faithfulness", f).withColumn("relevance", r).withColumn("_ok", (F.col("faithfulness") * F.col("relevance")))
    return both.select(
        case_id(F.col("full_dialog"), F.col("answer")).alias("id"), F.col("full_dialog").alias("question"), numbered_context().alias("context"), "answer",
        "faithfulness", "relevance", first_marker(marker_list(F.col("markers")), F.col("_ok")).alias("marker"),
    )


def marker_provenance(raw: DataFrame) -> DataFrame:
    """One row of counts before conversion: rows, annotated, with several markers, reliable, occurrences."""
    m = F.size(marker_list(F.col("markers")))
    ok = (binary(F.col("binary_faithfulness")) == 1) & (binary(F.col("binary_relevancy")) == 1)
    return raw.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(m > 0).alias("n_annotated"), F.count_if(m > 1).alias("n_multi"), F.count_if(ok).alias("n_reliable"),
        F.coalesce(F.sum(m), F.lit(0)).alias("n_occurrences"),
    )


def last_by_id(rows: DataFrame, key: str, order: str, labels: Sequence[str] = ()) -> DataFrame:
    """One row for each key: the values of its last row, at the place of its first; conflict tells whether labels differ.

    max_by keeps one row a key in the map tasks already, so a key on many rows costs no more."""
    rest = [c for c in rows.columns if c not in (key, order)]
    last = F.max_by(F.struct(*rest), order).alias("last") if rest else F.lit(None)
    clash = (F.count_distinct(*labels) > 1) if labels else F.lit(False)
    out = rows.groupBy(key).agg(F.min(order).alias(order), last, clash.alias("conflict"))
    return out.select(key, order, *[F.col(f"last.{c}").alias(c) for c in rest], "conflict")
