"""Running caps over a stream: so many rows a key, so many in all, with the reason why each other row is skipped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructType

from ..storage import drop_stored, stored
from .batches import BatchTable

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyCaps(StatefulProcessor):
    """Per key, how many rows had each outcome so far; a row is over the cap once ``per_key`` rows of its key are kept."""

    def __init__(self, order: str, per_key: int):
        self.order, self.per_key = order, per_key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "reason string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        kept = self.counts.getValue(("kept",))[0] if self.counts.containsKey(("kept",)) else 0
        reason = frame["reason"].to_numpy(object)
        fit = (reason == "kept").astype(np.int64)
        before = kept + np.cumsum(fit) - fit
        over = (reason != "unusable") & (before >= self.per_key) & (self.per_key > 0)
        reason = np.where(over, "max_per_character", reason)
        for name, n in zip(*np.unique(reason.astype(str), return_counts=True), strict=True):
            held = self.counts.getValue((str(name),))[0] if self.counts.containsKey((str(name),)) else 0
            self.counts.updateValue((str(name),), (held + int(n),))
        yield frame.assign(reason=reason)

    def close(self) -> None:
        pass


def key_capped(rows: DataFrame, key: str, order: str, usable: Column, leaks: Column, has_reference: Column, per_key: int) -> DataFrame:
    """A stream's rows with ``reason``: ``kept``, or why a row is skipped, as ``operators.splits.ordered_reasons`` has it without a limit.

    What a row is like on its own is told by Spark; the state of a key holds a count for each outcome. Rows come in
    the order of their micro-batches and, within one, of ``order``. A key's rows of one micro-batch meet in memory,
    so the source's trigger bounds them.
    """
    fit = F.when(~F.coalesce(usable, F.lit(False)), "unusable").when(F.coalesce(leaks, F.lit(False)), "leakage").when(~F.coalesce(has_reference, F.lit(False)), "missing_reference").otherwise("kept")
    marked = rows.withColumn("reason", fit)
    out = StructType([f for f in marked.schema if f.name != "reason"]).add("reason", StringType())
    return marked.groupBy(key).transformWithStateInPandas(KeyCaps(order, per_key), out, "append", "None")


class CappedSink:
    """Takes micro-batches until ``limit`` rows are kept; rows after the one that fills it, and all later batches, are left out.

    How many rows each micro-batch kept is committed with it, so a replayed micro-batch changes nothing and a
    restarted stream goes on where it was.
    """

    def __init__(self, rows: DataFrame, path: str, order: str, limit: int, query: str = "capped"):
        self.schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self.table = BatchTable(rows.sparkSession, path, ("rows", "counts"))
        self.order, self.limit, self.query = order, limit, query

    def kept(self, before: int | None = None) -> int:
        """Rows kept by committed micro-batches, or by those before ``before``."""
        done = [x for x in self.table.committed() if x[0] == self.query and (before is None or x[1] < before)]
        return self.table.read("counts", "kept long", done).agg(F.coalesce(F.sum("kept"), F.lit(0))).first()[0]

    def append(self, batch: DataFrame, batch_id: int) -> None:
        if self.table.is_committed(self.query, batch_id):
            return
        left = self.limit - self.kept(batch_id) if self.limit > 0 else None
        batch = held = stored(batch, "micro-batch")  # read twice, and a stream wants all of it read
        if left is not None and left > 0:
            # The row that fills the limit is found by a bounded top-k; everything after it is cut off.
            last = batch.where("reason = 'kept'").select(self.order).orderBy(self.order).limit(left).agg(F.max(self.order).alias("__last"), F.count("*").alias("__n"))
            batch = batch.join(F.broadcast(last), (F.col("__n") < left) | (F.col(self.order) <= F.col("__last"))).drop("__last", "__n")
        elif left is not None:
            batch = batch.limit(0)
        self.table.write("rows", batch, self.query, batch_id)
        own = self.table.read("rows", self.schema, [(self.query, batch_id)])
        self.table.write("counts", own.agg(F.count_if(F.col("reason") == "kept").alias("kept")).coalesce(1), self.query, batch_id)
        drop_stored(held)

    def read(self) -> DataFrame:
        return self.table.read("rows", self.schema, [x for x in self.table.committed() if x[0] == self.query]).drop("query", "batch")


def start_capped(rows: DataFrame, sink: CappedSink, checkpoint: str) -> StreamingQuery:
    """Process what a stream of ``key_capped`` rows has; a restart goes on at ``checkpoint``. State is kept in RocksDB, as map state needs it."""
    spark = rows.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return rows.writeStream.foreachBatch(sink.append).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
