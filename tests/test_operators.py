"""Operators over sets of records against plain versions."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import records as D
from loomwright.operators import similarity as S
from loomwright.operators import splits as P
from loomwright.sources import files
from loomwright.streaming.ema import normalize_batch, normalize_stream, step

NORMAL = lambda x: "".join(c for c in x.lower() if c.isalnum())


def plain_similarity(a, b):
    a, b = NORMAL(a), NORMAL(b)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if len(short) >= 24 and short in long:
        return len(short) / len(long)
    grams = lambda x: set(x) if len(x) <= 5 else {x[i : i + 5] for i in range(len(x) - 4)}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    base = ["".join(draw.choices("abcdefg ", k=160)) for _ in range(6)]
    rows = []
    for k in range(60):
        own = list(base[k % 6])
        for _ in range(draw.choice([0, 0, 1, 2, 3, 9])):
            own[draw.randrange(160)] = draw.choice("hijk")
        rows.append((k, "".join(own)[: draw.choice([160, 160, 150, 60])]))
    return [*rows, (100, ""), (101, "..."), (102, "ab"), (103, "ba"), (104, "aB!"), (105, "abab" * 20), (106, "abab" * 19), (107, "ababa" * 3)]


def test_near_duplicate_pairs_equal_brute_force(spark, texts):
    got = {(r.left_id, r.right_id): r.similarity for r in S.near_duplicate_pairs(spark.createDataFrame(texts, "id long, t string"), "id", "t").collect()}
    want = {(a, b): round(s, 6) for i, (a, x) in enumerate(texts) for b, y in texts[i + 1 :] if (s := plain_similarity(x, y)) >= 0.88}
    assert got == want and len(want) > 20


def test_links_and_membership_give_the_same_pairs(spark, texts):
    rows = [*texts, (900, texts[0][1].upper()), (901, texts[0][1]), (902, texts[3][1] + "!")]
    df = spark.createDataFrame(rows, "id long, t string")
    links, members = S.near_duplicate_links(df, "id", "t")
    own = dict(members.collect())
    linked = {(r.left_id, r.right_id): r.similarity for r in links.collect()}
    got = {}
    for a in own:
        for b in own:
            if a < b and (s := 1.0 if own[a] == own[b] else linked.get(tuple(sorted((own[a], own[b]))))):
                got[a, b] = s
    assert got == {(r.left_id, r.right_id): r.similarity for r in S.near_duplicate_pairs(df, "id", "t").collect()}
    assert S.near_duplicate_pairs(df.limit(0), "id", "t").count() == 0


def test_cross_pairs_are_those_between_the_two_splits(spark, texts):
    rows = [(k, t, ("reward", "eval_heldout", "sft")[k % 3]) for k, t in texts]
    df = spark.createDataFrame(rows, "id long, t string, split string")
    split = {k: s for k, _, s in rows}
    every = {(r.left_id, r.right_id) for r in S.near_duplicate_pairs(df, "id", "t").collect()}
    got = {(r.left_id, r.right_id) for r in S.near_duplicate_pairs(df, "id", "t", split="split", cross=("reward", "eval_heldout")).collect()}
    assert got == {(a, b) if split[a] == "reward" else (b, a) for a, b in every if {split[a], split[b]} == {"reward", "eval_heldout"}}


def test_normalisation_equals_its_exact_form(spark):
    """Over all of the plane's characters, alone and between letters."""
    from loomwright.functions.text import normalize_text, normalize_text_exact

    texts = [f"Ab{chr(k)}c" for k in range(0x1, 0x10000) if not 0xD800 <= k <= 0xDFFF]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    assert df.select(normalize_text(F.col("t")).alias("a"), normalize_text_exact("t").alias("b")).where("not (a <=> b)").count() == 0


def test_greedy_dedup_keeps_first(spark, texts):
    got = dict(S.greedy_dedup(spark.createDataFrame(texts, "id long, t string"), "id", "t").select("id", "kept_id").collect())
    kept, want = [], {}
    for i, x in texts:
        for j, y in kept:
            if plain_similarity(y, x) >= 0.88:
                want[i] = j
                break
        else:
            kept.append((i, x))
    assert got == want


def test_hash_fraction(spark):
    keys = ["作品A::甲", "作品B::乙", "作品C::丙"]
    got = dict(P.hash_fraction(spark.createDataFrame([(k,) for k in keys * 2], "k string"), F.col("k"), 0.34).collect())
    assert got == {"作品A::甲": False, "作品B::乙": False, "作品C::丙": True}


def test_work_disjoint_split_does_not_depend_on_order(spark):
    rows = [(f"c{k}", f"作品{'ABCDEFGHIJ'[k % 10]}") for k in range(30)]
    ratios = {"sft": 0.7, "reward": 0.2, "eval_heldout": 0.1}
    split = lambda r: dict(P.work_disjoint_split(spark.createDataFrame(r, "character string, source_work string"), ratios).collect())
    got = split(rows)
    assert got == split(rows[::-1])
    order = sorted(got, key=lambda w: hashlib.blake2b(w.encode(), digest_size=8).hexdigest())
    assert [got[w] for w in order] == ["sft"] * 7 + ["reward"] * 2 + ["eval_heldout"]


def test_ordered_reasons(spark):
    draw = random.Random(1)
    rows = [(k, draw.choice("abc"), draw.random() < 0.9, draw.random() < 0.2, draw.random() < 0.8) for k in range(200)]
    want, counts, kept = {}, {}, 0
    for k, key, usable, leaks, reference in rows:
        if not usable:
            want[k] = "unusable"
        elif counts.get(key, 0) >= 12:
            want[k] = "max_per_character"
        elif leaks:
            want[k] = "leakage"
        elif not reference:
            want[k] = "missing_reference"
        else:
            want[k] = "kept"
            counts[key] = counts.get(key, 0) + 1
            kept += 1
            if kept >= 20:
                break
    df = spark.createDataFrame(rows, "ord int, key string, usable boolean, leaks boolean, ref boolean")
    assert dict(P.ordered_reasons(df, "key", "ord", F.col("usable"), F.col("leaks"), F.col("ref"), 12, 20).select("ord", "reason").collect()) == want


def test_roles_and_budget(spark):
    turns = [("user", "u" * 30), ("Alice", "a" * 20), ("narrator", "n"), ("player", " "), ("SYSTEM", "s")]
    df = spark.createDataFrame([(turns,)], f"turns {D.TURN}")
    messages = df.select(D.chat_messages(F.lit("alice"), F.lit("w"), F.lit("card"), F.col("turns")).alias("m")).first().m
    assert [m.role for m in messages] == ["system", "user", "assistant", "assistant", "system"]
    fitted = df.select(D.fit_turns(F.col("turns"), F.lit(25), system=False).alias("t")).first().t
    assert [t.role for t in fitted] == ["Alice", "narrator", "player", "SYSTEM"]


def test_ema_batch_and_stream_agree(spark, tmp_path):
    draw = random.Random(2)
    rows = [(k, draw.choice("xy"), draw.gauss(5, 2)) for k in range(60)]
    want, states = {}, {}
    for k, key, v in rows:
        want[k], states[key] = step(*states.get(key, (0, 0.0, 0.0)), v)
    df = spark.createDataFrame(rows, "ord long, key string, value double")
    assert {r.ord: pytest.approx(r.normalized) for r in normalize_batch(df, "key", "ord", "value").collect()} == want
    for part in range(3):
        df.where((F.col("ord") >= part * 20) & (F.col("ord") < part * 20 + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = normalize_stream(stream, "key", "ord", "value").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"a": {"b": 1}, "a.b": "dotted"}\n\n{"x": "y"}\n', encoding="utf-8")
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n[1]\n')
    (tmp_path / "doc.json").write_text(json.dumps({"note": 1, "items": [{"k": 1}, {"k": 2}]}))
    (tmp_path / "one.json").write_text('{"k": 9}')
    lines = files.read_lines(spark, str(tmp_path / "a.jsonl"))
    assert [r.line for r in lines.collect()] == [1, 3]
    assert lines.orderBy("line").select(files.variant_text("record", "a.b").alias("v")).first().v == "dotted"
    with pytest.raises(Exception, match="line 2"):
        files.read_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    assert files.read_lines(spark, str(tmp_path / "bad.jsonl"), strict=False).where("record is null").count() == 1
    assert files.read_document(spark, str(tmp_path / "doc.json")).count() == 2
    assert files.read_document(spark, str(tmp_path / "one.json")).count() == 1
    ledger = files.ledger(spark, str(tmp_path / "one.json"))
    assert ledger.first().sha256 == hashlib.sha256(b'{"k": 9}').hexdigest()
    assert tuple(files.ledger_totals(ledger).first()) == (1, 8)
    files.write_lines(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":null,"b":1}'
    with pytest.raises(Exception, match="invalid record"):
        files.write_valid(spark.createDataFrame([(1, ["x"])], "b int, issues array<string>"), "issues", str(tmp_path / "v"))


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
