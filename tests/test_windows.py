"""Windows over an append-only history: any split into batches gives what one pass over all of it gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.streaming import windows

SCHEMA = "who string, seq long, mark boolean, note string"


def rows():
    r = random.Random(6)
    return [(r.choice(["a", "a", "a", "b", None, f"u{r.randint(0, 30)}"]), i, r.choice([True, False, None]), f"n{i}") for i in range(900)]


def batch(df, window):
    w = Window.partitionBy("who").orderBy("seq").rowsBetween(1 - window, 0)
    return sorted((tuple(x) for x in df.select("who", "seq", "note", F.count(F.lit(1)).over(w), F.count_if(F.col("mark")).over(w)).collect()), key=lambda x: x[1])


@pytest.mark.parametrize("splits,window", [(1, 30), (4, 30), (9, 3)])
def test_any_split_equals_one_pass(spark, tmp_path, splits, window):
    data = rows()
    r = random.Random(splits)
    cuts = [0, *sorted(r.sample(range(1, len(data)), splits - 1)), len(data)]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for a, b in zip(cuts, cuts[1:]):
        part = data[a:b]
        r.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        # Each batch is a run of its own, which goes on from the state of the one before.
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        windows.run(windows.last_posts(stream, "who", ["seq"], "mark", window), out, checkpoint).awaitTermination()
    found = spark.read.parquet(out).select("who", "seq", "note", "seen", "marked").collect()
    assert sorted(map(tuple, found), key=lambda x: x[1]) == batch(spark.createDataFrame(data, SCHEMA), window)
