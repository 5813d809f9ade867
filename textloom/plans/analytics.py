"""Queries of roll-ups: events are posts with metrics, orders what they bring in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.regex import round_half_up
from textloom.operators import analytics as A
from textloom.plans import duck as D
from textloom.plans.registry import query
from textloom.sources.tables import table

_SUMS = f"count(*) AS n, {D.rnd('sum(coalesce(cents, 0))::DOUBLE / count(*)', 3)} AS cents_each, sum(coalesce(k, 0))::BIGINT AS inbound"
_ROWS = "(SELECT event_type AS pillar, CAST(user_id % 7 AS VARCHAR) AS archetype, CASE WHEN value > 100 THEN 'large' WHEN value > 10 THEN 'middle' END AS hook, CAST(floor(value * 100) AS BIGINT) AS cents, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events WHERE value IS NOT NULL)"


@query(" UNION ALL ".join([f"SELECT '{d}' AS dimension, {d} AS key, {_SUMS} FROM {_ROWS} GROUP BY {d}" for d in ("pillar", "archetype", "hook")] + [f"SELECT 'total', NULL, {_SUMS} FROM {_ROWS} HAVING count(*) > 0"]))
def performance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hook = F.when(F.col("value") > 100, "large").when(F.col("value") > 10, "middle")
    posts = table(spark, sf_dir, "events").select(F.col("event_type").alias("pillar"), (F.col("user_id") % 7).cast("string").alias("archetype"), hook.alias("hook"), F.floor(F.col("value") * 100).alias("cents"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))
    found = A.rolled_up(posts, ["pillar", "archetype", "hook"], {"cents_each": "cents"}, {"inbound": "k"}, present="cents")
    return found.withColumn("cents_each", round_half_up(F.col("cents_each"), 3))
