"""Windows of the last posts of each group over an append-only history: a batch costs its own rows, not the history's."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom.operators.drift import WINDOW

#: The state store that stateful processors need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastPosts(StatefulProcessor):
    """For each new post of a group: its window's length and how many posts of the window are marked.

    The state of a group is one list, of the marks of its last `window` - 1 posts; it never grows beyond that.
    """

    def __init__(self, group: str, order: list[str], mark: str, window: int):
        self.group, self.order, self.mark, self.window = group, order, mark, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getListState("marks", T.StructType([T.StructField("mark", T.BooleanType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        last = deque((bool(x[0]) for x in self.marks.get()), maxlen=self.window - 1)
        seen, marked = [], []
        for mark in batch[self.mark]:
            seen.append(len(last) + 1)
            marked.append(sum(last) + bool(mark))
            last.append(bool(mark))
        self.marks.put([(x,) for x in last])
        batch = batch.drop(columns=[self.mark])
        batch["seen"], batch["marked"] = seen, marked
        yield batch

    def close(self) -> None:
        pass


def last_posts(stream: DataFrame, group: str, order: list[str], mark: str, window: int = WINDOW) -> DataFrame:
    """stream, without the column mark, with seen and marked: the length of each post's window and the marked posts in it, its own included.

    stream: group, the columns of order, a boolean mark and others that are kept.  Posts are added in the given order: a batch's posts come
    after those of the batches before it, and inside a batch they are sorted.  A null mark counts as false, and null groups are one
    group.  What one batch holds of a group is sorted in one task, so the trigger (files or bytes for each batch) bounds
    it; the state holds window - 1 marks for each group, whatever the history's length.
    """
    out = T.StructType([f for f in stream.schema.fields if f.name != mark] + [T.StructField("seen", T.LongType()), T.StructField("marked", T.LongType())])
    return stream.groupBy(group).transformWithStateInPandas(LastPosts(group, order, mark, window), outputStructType=out, outputMode="append", timeMode="none")


def run(rolled: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all rows that are there to a Parquet folder and end; a restart with the same checkpoint goes on behind them."""
    spark = rolled.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        return rolled.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
