"""Counts of measurements by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, by: Column, value: Column, bounds: tuple[float, ...]) -> DataFrame:
    """(by, le, n, total): of each group how many values are ``le`` or less, for each bound, and how many there are.

    One pass: a conditional sum for each bound, then a row for each.
    """
    (name,) = rows.select(by).columns
    sums = [F.sum((value <= b).cast("long")).alias(f"le{k}") for k, b in enumerate(bounds)]
    wide = rows.groupBy(by).agg(*sums, F.count("*").alias("total"))
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"le{k}").alias("n")) for k, b in enumerate(bounds))))
    return wide.select(name, each.alias("x"), "total").select(name, "x.le", "x.n", "total")
