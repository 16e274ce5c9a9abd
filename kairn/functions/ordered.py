"""Order-dependent expressions over one long sequence, without putting it into one task.

A sequence is cut into spans of consecutive order values, as wide as SPAN rows are on average, so that
sparse values (times, for one) make no more spans than dense ones. Windows run inside spans, in
parallel; what has to cross a border (the last row before it, or a running total) comes from a table
with one row for each span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows in a span, about.
SPAN = 100_000


def span_width(df: DataFrame, order: str) -> int:
    """How many order values make a span."""
    low, high, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    return max(1, int((high - low + 1) // max(1, n // SPAN))) if n else 1


def lagged(df: DataFrame, columns: dict[str, str], order: str = "frame_id", by: list[str] | None = None, width: int | None = None) -> DataFrame:
    """df with the previous row's values: columns maps a column to the name of its lagged copy.

    by: keys of independent sequences. The first row of a sequence gets nulls. width: span_width, if known.
    """
    names = list(columns.values())
    if by:
        w = Window.partitionBy(*by).orderBy(order)
        return df.withColumns({new: F.lag(old).over(w) for old, new in columns.items()})
    spans = df.withColumn("_span", F.floor(F.col(order) / F.lit(width or span_width(df, order))))
    w = Window.partitionBy("_span").orderBy(order)
    inner = spans.withColumns({new: F.lag(old).over(w) for old, new in columns.items()} | {"_first": F.row_number().over(w) == 1})
    last = spans.groupBy("_span").agg(F.max_by(F.struct(*[F.col(old).alias(new) for old, new in columns.items()]), order).alias("_last"))
    before = last.select("_span", F.lag("_last").over(Window.orderBy("_span")).alias("_before"))
    joined = inner.join(before, "_span", "left")
    return joined.withColumns({n: F.when(F.col("_first"), F.col(f"_before.{n}")).otherwise(F.col(n)) for n in names}).drop("_span", "_first", "_before")


def running_sum(df: DataFrame, value: Column, name: str, order: str = "frame_id") -> DataFrame:
    """df with the sum of value over all rows up to each row in order."""
    spans = df.withColumn("_span", F.floor(F.col(order) / F.lit(span_width(df, order)))).withColumn("_value", value)
    up_to = Window.partitionBy("_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    total = spans.groupBy("_span").agg(F.sum("_value").alias("_total")).select("_span", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    return spans.join(total, "_span").withColumn(name, F.sum("_value").over(up_to) + F.col("_base")).drop("_span", "_value", "_base")
