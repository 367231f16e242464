"""Queries with running state, and their DuckDB twins where SQL has one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..storage import new_path
from ..streaming.caps import CappedSink, key_capped, start_capped
from ..streaming.ema import normalize_batch, normalize_stream
from ..streaming.ledger import KeyLedger
from .set_queries import SQL as SET_SQL
from .views import table


def ema_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("key", F.concat("event_type", F.lit("-"), (F.col("user_id") % 5).cast("string")))
    return normalize_batch(events, "key", "event_id", "value").select("key", F.col("ord").alias("event_id"), F.round("normalized", 6).alias("normalized"))


def ema_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the table's files, gathered in a memory-free sink: a Parquet table."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet" if not sf_dir.endswith("events.parquet") else "*").parquet(sf_dir)
    out, state = new_path(spark, "ema"), new_path(spark, "ema-state")
    normal = normalize_stream(stream, "event_type", "event_id", "value")
    normal.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("key", F.col("ord").alias("event_id"), F.round("normalized", 6).alias("normalized"))


def resumed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that two overlapping runs append to: each key once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ledger = KeyLedger(orders, new_path(spark, "resumed"), "o_orderkey")
    ledger.append(orders.where("o_orderkey % 3 <> 0"), 0)
    ledger.append(orders.where("o_orderkey % 2 = 0"), 1)
    return ledger.rows()


def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of the first order of each customer, that a stream appends to; it is stopped and goes on when more orders have come."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    source, checkpoint = new_path(spark, "orders"), new_path(spark, "ledger-state")
    ledger = KeyLedger(orders, new_path(spark, "first-orders"), "o_custkey")
    half = orders.agg(F.avg("o_orderkey")).first()[0]
    for part in ("<", ">="):
        orders.where(f"o_orderkey {part} {half}").write.mode("append").parquet(source)
        ledger.append_stream(spark.readStream.schema(orders.schema).parquet(source), checkpoint, order="o_orderkey").awaitTermination()
    return ledger.rows()


def capped_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ordered_reason_caps`` over a stream of documents that comes in three parts; the stream is stopped and started again between them."""
    docs = table(spark, sf_dir, "documents").drop("text")
    source, sink_path, checkpoint = (new_path(spark, x) for x in ("documents", "capped", "capped-state"))
    cuts = docs.approxQuantile("doc_id", [0.2, 0.6], 0.01) or [0.0, 0.0]
    for low, high in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True):
        docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < high)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(docs.schema).parquet(source)
        rows = key_capped(stream, "source", "doc_id", F.col("n_chars") > 100, F.col("lang") == "es", F.col("doc_id") % 5 != 0, 8)
        sink = CappedSink(rows, sink_path, "doc_id", 120)
        start_capped(rows, sink, checkpoint).awaitTermination()
    return sink.read().select("doc_id", "reason")


def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as JSON lines and read back through the record reader."""
    path = new_path(spark, f"lines-{uuid.uuid4().hex[:6]}")
    files.write_lines(table(spark, sf_dir, "benchmark"), path)
    return files.read_lines(spark, path).select(F.try_variant_get("record", "$.item_id", "long").alias("item_id"), files.variant_text("record", "text").alias("text"))


QUERIES = {f.__name__: f for f in (ema_normalize, ema_stream, resumed_append, ledger_stream, capped_stream, lines_round_trip)}

SQL = {
    "ema_normalize": """
with recursive e as (select concat(event_type, '-', user_id % 5) as key, event_id, value::double as v, row_number() over (partition by concat(event_type, '-', user_id % 5) order by event_id) as k from events where value is not null),
r(key, event_id, k, m, s, out) as (
  select key, event_id, k, v, v * v, v from e where k = 1
  union all
  select e.key, e.event_id, e.k, 0.99::double * r.m + (1 - 0.99::double) * e.v, 0.99::double * r.s + (1 - 0.99::double) * e.v * e.v, case when e.k <= 8 then e.v else (e.v - r.m) / sqrt(greatest(0, r.s - r.m * r.m) + 1e-6::double) end
  from r join e on e.key = r.key and e.k = r.k + 1)
select key, event_id, round(out, 6) as normalized from r""",
    "resumed_append": "select o_orderkey, o_custkey from orders where o_orderkey % 3 <> 0 or o_orderkey % 2 = 0",
    "ledger_stream": "select min(o_orderkey) as o_orderkey, o_custkey from orders group by o_custkey",
    "capped_stream": SET_SQL["ordered_reason_caps"],
    "lines_round_trip": "select item_id, text from benchmark",
}
