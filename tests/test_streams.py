"""Streams with running caps and key ledgers: several micro-batches, restarts and replays."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomwright.operators.splits import ordered_reasons
from loomwright.streaming.caps import CappedSink, key_capped, start_capped
from loomwright.streaming.ledger import KeyLedger

ROWS = [(k, f"k{k * k % 5}" if k % 11 else None, "x" if k % 7 == 0 else "y", (k % 6) - (k % 13 == 0) * 6) for k in range(120)]


@pytest.mark.parametrize(("per_key", "limit"), [(6, 17), (0, 0)])
def test_caps_of_a_restarted_stream(spark, tmp_path, per_key, limit):
    rules = (F.col("size") > 0, F.col("lang") == "x", F.col("id") % 4 != 0)
    df = spark.createDataFrame(ROWS, "id long, key string, lang string, size int")
    for low, high in ((0, 30), (30, 31), (31, 90), (90, 120)):
        df.where(f"id >= {low} and id < {high}").write.mode("append").parquet(str(tmp_path / "in"))
        rows = key_capped(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", "id", *rules, per_key)
        sink = CappedSink(rows, str(tmp_path / "out"), "id", limit)
        start_capped(rows, sink, str(tmp_path / "state")).awaitTermination()
    want = ordered_reasons(df, "key", "id", *rules, per_key, limit or 1000)
    assert sorted(map(tuple, sink.read().select("id", "reason").collect())) == sorted(map(tuple, want.select("id", "reason").collect()))
    assert sink.kept() == want.where("reason = 'kept'").count()


def test_a_replayed_micro_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(k, "kept" if k % 2 else "leakage") for k in range(10)], "id long, reason string")
    sink = CappedSink(rows, str(tmp_path), "id", 4)
    sink.append(rows.where("id < 6"), 0)
    sink.append(rows.where("id < 6"), 0)
    assert sink.kept() == 3
    sink.append(rows.where("id >= 6"), 1)
    sink.append(rows.where("id >= 6").selectExpr("id + 10 as id", "reason"), 2)
    assert sorted(r.id for r in sink.read().collect()) == list(range(8))
    # a write that stopped before its counts is not there, and is made again
    sink.table.write("rows", rows, "capped", 3)
    assert sink.read().count() == 8
    sink.append(rows, 3)
    assert sink.read().count() == 8 and sink.table.is_committed("capped", 3)


def test_a_ledger_reads_only_what_may_hold_its_keys(spark, tmp_path):
    def rows(numbers):
        return spark.createDataFrame([(f"k{n}", n) for n in numbers], "key string, n long")

    ledger = KeyLedger(rows([]), str(tmp_path), "key", buckets=8)
    assert ledger.rows().count() == 0
    assert ledger.append(rows([]), 0).held == 0
    assert ledger.append(rows(range(1000)), 1).held == 0
    fresh = ledger.append(rows(range(5000, 5040)), 2)
    assert (fresh.held, fresh.read) == (8, fresh.read) and fresh.read <= 4  # 40 new keys, each taken for a held one about once in 300 times
    again = ledger.append(rows([3, 3, 7, 9000]), 3)
    assert again.held > again.read >= 1
    assert again.read <= 4  # the buckets of three keys, and perhaps one that was taken for another
    replay = ledger.append(rows([77777]), 3)
    assert replay.replayed and ledger.rows().count() == 1041
    assert sorted(r.n for r in ledger.rows().collect()) == [*range(1000), *range(5000, 5040), 9000]


def test_a_ledger_keeps_the_first_row_of_a_key_and_no_null(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 0), ("b", 2)], "key string, n long")
    ledger = KeyLedger(rows, str(tmp_path / "t"), "key")
    ledger.append(rows, 0, order="n")
    assert sorted(map(tuple, ledger.rows().collect())) == [("a", 1), ("b", 2)]
    ledger.table.write("rows", rows, "append", 1)  # was interrupted before its filters
    assert ledger.rows().count() == 2


def test_an_append_stream_goes_on_after_a_restart(spark, tmp_path):
    df = spark.range(20)
    ledger = KeyLedger(df, str(tmp_path / "t"), "id")
    ledger.append(df.where("id < 6"), 0)
    for low, high in ((0, 12), (4, 20)):
        df.where(f"id >= {low} and id < {high}").write.mode("append").parquet(str(tmp_path / "in"))
        ledger.append_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.id for r in ledger.rows().collect()) == list(range(20))


def test_a_key_is_held_in_few_bytes(monkeypatch):
    """Frames of a key are let go of as they come; what is held is its order and values, given back in chunks."""
    import numpy as np
    import pandas as pd

    from loomwright.streaming import ema

    monkeypatch.setattr(ema, "CHUNK", 4)
    frames = (pd.DataFrame({"key": ["k"] * 5, "ord": np.arange(5, dtype=np.int64)[::-1] + 5 * k, "value": np.full(5, float(k))}) for k in (1, 0))
    held = ema._Held(frames)
    assert [x for order, _ in held.chunks() for x in order] == list(range(10))
    assert max(len(order) for order, _ in held.chunks()) == 4
    assert held.order.nbytes + held.values.nbytes == 10 * 16
