"""JSON of any shape, walked level by level as a table of nodes: records at any depth of documents, texts at any depth of records.

A level's nodes are rows, written to the shared folder and dealt anew, so the children of one large document are the
work of many tasks from its second level on; there are as many rounds as levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import drop_stored, stored

#: Names of fields by which a JSON object is known as a record.
QUESTION_KEYS = ["question", "prompt", "query", "instruction", "input", "answer", "label", "target"]
ROLE_KEYS = ["character", "role", "name", "profile", "persona", "conversations", "dialogue", "history"]
CARD_KEYS = ["character_name", "character_profile", "dialogue"]
CHOICE_KEYS = ["A", "B", "C", "D", "choices", "options", "candidates"]
_FAIL = {"mode": "FAILFAST"}


def record_like(keys: Column) -> Column:
    """Whether an object with these keys looks like a record: a question with choices, a role with a question, or a character card with its dialogue."""
    has = lambda names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    card = F.size(F.array_except(F.array(*map(F.lit, CARD_KEYS)), keys)) == 0
    return F.coalesce((has(QUESTION_KEYS) & has(CHOICE_KEYS)) | (has(ROLE_KEYS) & has(QUESTION_KEYS)) | card, F.lit(False))


def _kind(value: Column) -> Column:
    """{ or [ for a variant that holds others, else nothing."""
    shape = F.schema_of_variant(value)
    return F.when(F.startswith(shape, F.lit("OBJECT")), "{").when(F.startswith(shape, F.lit("ARRAY")), "[")


def _children(boxes: DataFrame) -> DataFrame:
    """(path, at, text, kind) of what the boxes hold: objects and lists alone, in their order.

    Each child is read twice, as the text it is written in, which keeps the order of its keys, and as a VARIANT,
    which tells a text that looks like an object from an object. Of equal keys the last one counts.
    """
    both = lambda kind: F.arrays_zip(*(F.from_json("text", f"{kind}{x}>", _FAIL) for x in ("string", "variant")))
    listed = boxes.where("kind = '['").select("path", "at", F.posexplode(both("array<").cast("array<struct<text:string,value:variant>>")).alias("i", "x"))
    maps = [F.from_json("text", f"map<string,{x}>", _FAIL) for x in ("string", "variant")]
    entries = F.arrays_zip(F.map_keys(maps[0]), F.map_values(maps[0]), F.map_values(maps[1])).cast("array<struct<key:string,text:string,value:variant>>")
    named = boxes.where("kind = '{'").select("path", "at", F.posexplode(F.filter(entries, lambda e: e["text"].isNotNull())).alias("i", "x"))
    both_kinds = listed.select("path", "at", "i", "x.text", "x.value").unionByName(named.select("path", "at", "i", "x.text", "x.value"))
    return both_kinds.select("path", F.array_append("at", F.col("i")).alias("at"), "text", _kind(F.col("value")).alias("kind")).where("kind is not null")


def discover_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, index, record): every object of JSON documents that looks like a record, outermost first, at any depth, numbered in the order of its document.

    Nothing inside a record is one. A document that is no JSON ends the query. A document is read whole by one task
    once, so it must fit a row (2 GB); what it holds is dealt out from then on.
    """
    text = F.regexp_replace("value", "^﻿?[ \\t\\r\\n]*", "")
    docs = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.array().cast("array<int>").alias("at"), text.alias("text"))
    head = F.substring("text", 1, 1)
    now = docs.withColumn("kind", F.when(head.isin("{", "["), head).otherwise(_kind(F.parse_json("text")))).where("kind is not null")
    found = []
    while True:
        judged = stored(now.withColumn("is_record", F.coalesce((F.col("kind") == "{") & record_like(F.json_object_keys("text")), F.lit(False))), "json-level")
        found.append(judged.where("is_record").select("path", "at", "text"))
        boxes = judged.where("not is_record")
        if boxes.isEmpty():
            break
        now = _children(boxes).repartition(F.col("path"), F.xxhash64("at"))
    rows = found[0]
    for level in found[1:]:
        rows = rows.unionByName(level)
    return _numbered(rows).select("path", "index", F.parse_json("text").alias("record"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``index``, the number of a row among those of its path in the order of ``at``: counted in ranges of the order, then within one."""
    part = stored(rows.repartitionByRange("path", "at").withColumn("part", F.spark_partition_id()), "json-order")
    counts = part.groupBy("path", "part").agg(F.count("*").alias("n"))
    before = counts.select("path", "part", (F.sum("n").over(Window.partitionBy("path").orderBy("part")) - F.col("n")).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("path", "part").orderBy("at")) - 1
    return part.join(before, ["path", "part"]).withColumn("index", number)


def texts_within(rows: DataFrame, key: str, record: str) -> DataFrame:
    """(key, field, value) of every text in a VARIANT column, however deep; fields are named ``a.b[0].c``, a text that is all there is ``<record>``."""
    spark = rows.sparkSession
    now = rows.select(F.col(key).alias("key"), F.lit("").alias("field"), F.col(record).alias("value"))
    texts, levels = [], []
    while True:
        texts.append(now.where(F.schema_of_variant("value") == "STRING").select("key", F.when(F.col("field") == "", "<record>").otherwise(F.col("field")).alias("field"), F.try_variant_get("value", "$", "string").alias("value")))
        boxes = now.where(_kind(F.col("value")).isNotNull()).withColumnRenamed("value", "box").withColumnRenamed("field", "above")
        if boxes.isEmpty():
            break
        held = boxes.lateralJoin(spark.tvf.variant_explode(F.col("box").outer()))
        step = F.when(F.schema_of_variant("box").startswith("ARRAY"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("above") == "", F.col("key_in")).otherwise(F.concat(F.lit("."), F.col("key_in")))
        named = held.toDF("key", "above", "box", "pos", "key_in", "value")
        level = stored(named.select("key", F.concat("above", step).alias("field"), F.to_json("value").alias("json")), "json-texts")
        levels.append(level)
        now = level.select("key", "field", F.parse_json("json").alias("value"))
    out = texts[0]
    for level in texts[1:]:
        out = out.unionByName(level)
    out = stored(out.withColumnRenamed("key", key), "texts")
    for level in levels:
        drop_stored(level)
    return out


def placeholders_within(rows: DataFrame, key: str, record: str, markers: list[str]) -> DataFrame:
    """(key, field) of every text in a VARIANT column that holds one of ``markers`` in any case."""
    found = F.exists(F.array(*(F.lit(m.upper()) for m in markers)), lambda m: F.contains(F.upper("value"), m))
    return texts_within(rows, key, record).where(found).select(key, "field")
