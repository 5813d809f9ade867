"""Tables by name; Spark reads only the columns and rows that a query asks for."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def literal(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table of nested rows as a literal of the plan; fields that a row leaves out are null."""
    schema = T.ArrayType(T.DataType.fromDDL(ddl))
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))
