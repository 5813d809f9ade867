"""Roll-ups of measured posts by several dimensions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolled_up(rows: DataFrame, dimensions: list[str], means: dict[str, str], sums: dict[str, str], present: str | None = None) -> DataFrame:
    """(dimension, key, n, the means and sums): each dimension's groups and, as dimension 'total' with a null key, all rows.

    means and sums map result columns to numeric ones; a mean is the sum over a group's rows, nulls as 0, by their number.  Rows whose column
    `present` is null were not measured and are skipped.  All dimensions are grouping sets of one aggregation: a row
    is expanded, added up where it lies and shuffled once, as sums.  Which set a group belongs to is read from grouping_id, so a
    null key of a dimension is a group of its own and not a total.
    """
    used = rows if present is None else rows.filter(F.col(present).isNotNull())
    cols = [F.col(d) for d in dimensions]
    add = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    aggregates = [F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_set"), *[add(c).alias(f"_m_{k}") for k, c in means.items()], *[add(c).alias(f"_s_{k}") for k, c in sums.items()]]
    sets = used.groupingSets([[c] for c in cols] + [[]], *cols).agg(*aggregates)
    # In grouping_id a dimension's bit is 0 where the set has it, the first dimension's bit being the highest.
    full = (1 << len(dimensions)) - 1
    bits = {d: full ^ (1 << (len(dimensions) - 1 - i)) for i, d in enumerate(dimensions)}
    name = reduce(lambda out, d: F.when(F.col("_set") == bits[d], F.lit(d)).otherwise(out), dimensions, F.lit("total"))
    key = reduce(lambda out, d: F.when(F.col("_set") == bits[d], F.col(d).cast("string")).otherwise(out), dimensions, F.lit(None).cast("string"))
    # Without rows there is no total either.
    return sets.filter("n > 0").select(name.alias("dimension"), key.alias("key"), "n", *[(F.col(f"_m_{k}") / F.col("n")).alias(k) for k in means], *[F.col(f"_s_{k}").alias(k) for k in sums])
