"""Readers and writers of record files: JSON lines, JSON documents, CSV, Parquet, and a ledger of what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import stored

#: Keys under which a JSON document may hold its records.
RECORD_KEYS = ["data", "items", "examples", "records"]
METRIC_KEYS = ["rows", "records", "examples", "data", "results"]
#: Kinds of inputs that folders are searched for.
SUFFIXES = {"data": ["json", "jsonl", "parquet"], "eval": ["json", "jsonl", "parquet", "csv", "tsv"], "train": ["json", "jsonl", "parquet"], "ledger": None}


#: Splits of files up to which their table is broadcast; beyond, Spark joins it by shuffle.
SENT_SPLITS = 100_000


def numbered_lines(spark: SparkSession, paths: str | list[str], through: bool = False) -> DataFrame:
    """(path, line, value) of text files, lines numbered from 1 within their file; with ``through`` from one file on to the next, in the order of their paths.

    A large file is read by many tasks: each split's lines are counted, and a running sum over a file's splits gives
    where its numbers begin. That table, a row for each split, is sent to the tasks while it is small.
    """
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    sums = raw.groupBy("path", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = Window.orderBy("path", "split") if through else Window.partitionBy("path").orderBy("split")  # a row for each split
    before = stored(sums.select("path", "split", "first", (F.sum("n").over(ahead) - F.col("n")).alias("before")), "splits")
    before = F.broadcast(before) if before.count() <= SENT_SPLITS else before
    line = (F.col("before") + F.col("at") - F.col("first") + 1).alias("line")
    return raw.join(before, ["path", "split"]).select("path", line, F.when((F.col("split") == 0) & (F.col("at") == F.col("first")), F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")).alias("value"))


def read_lines(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """(path, line, record): the JSON object of each line that isn't blank, as VARIANT.

    ``strict`` raises for a line that is no object, naming it; otherwise its record is null.
    """
    some = numbered_lines(spark, paths).where(F.trim("value") != "")
    parsed = some.withColumn("record", F.try_parse_json("value"))
    good = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    wrong = F.raise_error(F.concat("path", F.lit(": line "), F.col("line").cast("string"), F.lit(": not a JSON object"))).cast("variant") if strict else F.lit(None).cast("variant")
    return parsed.select("path", "line", F.when(good, F.col("record")).otherwise(wrong).alias("record"))


def read_tolerant(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line, record) up to the first line of each file that is no JSON object; what stands after it is left out. ``unreadable`` lists those lines."""
    rows = read_lines(spark, paths, strict=False)
    bad = rows.where("record is null").groupBy("path").agg(F.min("line").alias("bad"))
    return rows.join(bad, "path", "left").where(F.col("bad").isNull() | (F.col("line") < F.col("bad"))).drop("bad")


def unreadable(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line): the first line of each file that is no JSON object."""
    return read_lines(spark, paths, strict=False).where("record is null").groupBy("path").agg(F.min("line").alias("line"))


def read_document(spark: SparkSession, paths: str | list[str], keys: list[str] = RECORD_KEYS) -> DataFrame:
    """(path, index, record): the items of a JSON list, or of the first list among ``keys`` of an object, or the object itself."""
    docs = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("doc"))
    is_list = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    held = [F.try_variant_get("doc", f"$.{k}", "variant") for k in keys]
    found = F.coalesce(F.when(is_list(F.col("doc")), F.col("doc")), *(F.when(is_list(h), h) for h in held))
    items = F.when(found.isNotNull(), found.cast("array<variant>")).otherwise(F.array("doc"))
    return docs.select("path", F.posexplode(items).alias("index", "record"))


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV or TSV file with a header; a byte order mark before it is no part of the first name."""
    rows = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    return rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns))


def with_origin(rows: DataFrame, order: Column) -> DataFrame:
    """Adds the file and the row's number in it, from 0, where the table doesn't name them itself."""
    path = rows.withColumn("raw_path", F.col("_metadata.file_path"))
    return path.withColumn("raw_index", F.row_number().over(Window.partitionBy("raw_path").orderBy(order)) - 1)


def variant_text(record: Column | str, *path: str) -> Column:
    """The text at the first path that holds one; a key with dots in its name comes before a nested path."""
    tries = [F.try_variant_get(record, f"$['{p}']", "string") if literal else F.try_variant_get(record, f"$.{p}", "string") for p in path for literal in (True, False)]
    return F.coalesce(*tries)


def union_in_order(tables: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Tables one after another, with the number of their table and row; the first ``limit`` rows, one at least."""
    parts = [t.withColumn("table_number", F.lit(k)) for k, t in enumerate(tables)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out if limit is None else out.orderBy("table_number", *[c for c in ("line", "index") if c in out.columns]).limit(max(1, limit))


def sorted_keys(value: Column, kind: T.DataType) -> Column:
    """``value`` with the fields of its structs and the keys of its maps in order, at every level; a VARIANT has them in order already."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*(sorted_keys(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)))
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: sorted_keys(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], sorted_keys(e["value"], kind.valueType))))
    return value


def sorted_json(rows: DataFrame) -> Column:
    """A row as JSON, with its keys sorted at every level and nulls written."""
    return F.to_json(F.struct(*(sorted_keys(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(rows.schema, key=lambda f: f.name))), {"ignoreNullFields": "false"})


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines with keys sorted at every level."""
    rows.select(sorted_json(rows).alias("value")).write.text(path)


def write_valid(rows: DataFrame, issues: str, path: str) -> None:
    """JSON lines, but nothing if any row has an issue: the write fails at the first one."""
    guard = F.when(F.size(issues) > 0, F.raise_error(F.concat(F.lit("invalid record: "), F.to_json(issues))).cast("string"))
    rows.select(F.coalesce(guard, sorted_json(rows.drop(issues))).alias("value")).write.text(path)


def ledger(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, bytes, sha256) of every file under ``paths``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def ledger_totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))


def license_named(license: Column) -> Column:
    """Whether a license is named at all."""
    return ~F.lower(F.trim(F.coalesce(license, F.lit("")))).isin("", "unknown", "none", "todo")
