"""Ranks over whole tables without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.relational import pinned


def global_ranks(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """Add ``out``: each row's place, from 1 and without gaps, in the order of the whole table.

    Rows are sorted in ranges and numbered within their range; what the ranges before it hold is added from a table of
    one row per range. Rows that ``order`` does not tell apart get places next to each other in any order, so it should
    end with a key. The rows are written down before ranges are drawn, and numbered, so that both branches see one
    numbering.
    """
    df = pinned(df)  # ranges are drawn from a sample, which would compute all rows once more
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = pinned(ranged.withColumn("__at", F.monotonically_increasing_id()))  # range << 33 | place in it
    part = F.shiftright("__at", 33)
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(out, F.col("__before") + place).drop("__at", "__part", "__before")


def global_dense_ranks(df: DataFrame, column: str, out: str, descending: bool = True) -> DataFrame:
    """Add ``out``: dense ranks of a column's values, 1 for the first; nulls last and alike.

    Distinct values are ranked as a table of their own and joined back; equal values meet before they are sorted.
    """
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    ranked = global_ranks(df.select(column).distinct(), [order], out).withColumnRenamed(column, "__value")
    return df.join(ranked, F.col(column).eqNullSafe(F.col("__value")), "left").drop("__value")
