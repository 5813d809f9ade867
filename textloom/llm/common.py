"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words once A-Z are lower-cased: every ASCII character but 0-9 and a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def fold(text: Column) -> Column:
    """Lower-case A-Z only; null is empty.  In a text of ASCII characters alone lower() does that, and faster."""
    t = text_or_empty(text)
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """array<string> of the words of a whole text; empty for null."""
    return F.array_remove(F.split(fold(text), NOT_WORD), "")


def word_hashes(text: Column) -> Column:
    """array<bigint>: one 64-bit hash for each word, computed in the JVM."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a session on one machine (master local) gets a temporary folder; a cluster has none that all
    its executors can read, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="textloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def intermediate_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark).rstrip('/')}/textloom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables.  Call it once results are written: frames that are still to be computed read them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(intermediate_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends at replicated files,
    so a lost executor costs a re-read and not a recomputation, and later passes skip the texts."""
    spark = df.sparkSession
    path = f"{intermediate_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from a literal of the plan: no Python worker makes it."""
    names = [f.split()[0] for f in schema.split(", ")]
    struct = ", ".join(f"{n}: {f.split()[1]}" for n, f in zip(names, schema.split(", ")))
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{struct}>>")))


def small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """Hint a broadcast of df only where its counted rows stay under the bound; else Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


#: Rows of a group from which on it is joined by broadcast.
HOT = 1000


def join_group(rows: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with groups, one row for each key, which holds the number n of the key's rows.

    Groups of more than HOT rows are broadcast, so their rows stay where they are; there are at most
    rows / HOT of them, counted first.  The others are joined by shuffle.  Both tables are written ones.
    """
    hot = groups.filter(F.col(n) > HOT)
    many = hot.count()
    if not many:
        return rows.join(groups, key)
    wide = rows.join(small(hot, many), key)
    return wide.unionByName(rows.join(small(hot.select(key), many), key, "left_anti").join(groups.filter(F.col(n) <= HOT), key))
