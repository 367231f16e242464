"""JSON lines as a data source, ``spark.read.format("record_lines")``: byte ranges of files by many tasks, bad lines beside good ones, and a writer that leaves all of its files or none."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

from ..operators.validate import schema_errors
from ..storage import stored
from .files import SENT_SPLITS

RANGE_BYTES = 64 << 20
_CHUNK, _ROWS = 1 << 20, 8192
_SCHEMA = "path string, range long, start long, number long, offset long, json string, error string"
_ARROW = pa.schema([("path", pa.string()), ("range", pa.int64()), ("start", pa.int64()), ("number", pa.int64()), ("offset", pa.int64()), ("json", pa.string()), ("error", pa.string())])


def _store(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path)


#: Ranges smaller than this are read several by a task, so that tasks grow with the bytes of the files and not with the number of ranges.
TASK_BYTES = 8 << 20


@dataclass
class LineRange(InputPartition):
    path: str
    number: int
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Consecutive ranges that one task reads."""

    ranges: list[LineRange]


def _lines(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in the range; the last one is read to its end."""
    at = start
    if start:
        stream.seek(start - 1)
        at = start - 1
    rest, skip = b"", start > 0
    while True:
        data = stream.read(_CHUNK)
        if not data:
            break
        parts = (rest + data).split(b"\n")
        rest = parts.pop()
        for line in parts:
            if skip:
                skip = False
            elif at >= end:
                return
            else:
                yield at, line
            at += len(line) + 1
        if at >= end and not skip:
            return
    if rest and not skip and at < end:
        yield at, rest


def _judged(line: bytes) -> tuple[str | None, str | None]:
    """(JSON text, what is wrong with it)."""
    try:
        text = line.decode()
        value = json.loads(text)
    except UnicodeDecodeError:
        return None, "invalid UTF-8"
    except json.JSONDecodeError as wrong:
        return None, f"invalid JSON: {wrong.msg}"
    return (text, None) if isinstance(value, dict) else (None, "record must be a JSON object")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = options["path"]
        self.paths = json.loads(given) if given.startswith("[") else [given]
        self.size, self.counts = int(options.get("rangeBytes", RANGE_BYTES)), options.get("counts", "false").lower() == "true"
        self.first, self.last = int(options.get("from", 0)), int(options.get("to", -1))

    def ranges(self) -> list[LineRange]:
        out = []
        for path in self.paths:
            store, inner = _store(path)
            info = store.get_file_info(inner)
            if info.type == stores.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [info] if info.type == stores.FileType.File else store.get_file_info(stores.FileSelector(inner, recursive=True))
            head = path[: len(path.rstrip("/")) - len(inner.rstrip("/"))]
            for file in sorted((x for x in found if x.type == stores.FileType.File and x.base_name[0] not in "._"), key=lambda x: x.path):
                out += [(head + file.path, i, min(i + self.size, file.size)) for i in range(0, file.size, self.size)]
        return [LineRange(path, k, i, j) for k, (path, i, j) in enumerate(out)]

    def partitions(self) -> list[Ranges]:
        some, out, held = self.ranges(), [], 0
        for one in some[self.first : self.last if self.last >= 0 else len(some)]:
            size = one.end - one.start
            if not out or held + size > TASK_BYTES:
                out.append(Ranges([]))
                held = 0
            out[-1].ranges.append(one)
            held += size
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self._read(one)

    def _read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        rows, number = [], 0
        store, inner = _store(partition.path)
        with store.open_input_file(inner) as stream:
            for offset, line in _lines(stream, partition.start, partition.end):
                number += 1
                if offset == 0:
                    line = line.removeprefix(b"\xef\xbb\xbf")
                if not self.counts and line.strip():
                    rows.append((partition.path, partition.number, partition.start, number, offset, *_judged(line.strip())))
                if len(rows) >= _ROWS:
                    yield self._batch(rows)
                    rows = []
        rows.append((partition.path, partition.number, partition.start, number, None, None, None))
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


@dataclass
class _Part(WriterCommitMessage):
    path: str
    rows: int


def _plain(value: Any) -> Any:
    """A value as JSON has it; variants and nested rows too."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return _plain(value.toPython()) if isinstance(value, T.VariantVal) else value


class _Writer(DataSourceWriter):
    """Tasks write hidden files; the driver gives them their names once all are whole, and removes them if one failed."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.issues, self.overwrite, self.run = options["path"].rstrip("/"), options.get("issues"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> _Part:
        store, inner = _store(self.path)
        store.create_dir(inner, recursive=True)
        context = TaskContext.get()
        path, n = f"{inner}/.{self.run}-{context.partitionId():05d}-{context.taskAttemptId()}", 0
        with store.open_output_stream(path) as out:
            for row in iterator:
                value = _plain(row)
                if self.issues and value.pop(self.issues, None):
                    raise ValueError(f"invalid record: {json.dumps(_plain(row)[self.issues], ensure_ascii=False, default=str)}")
                out.write(json.dumps(value, ensure_ascii=False, sort_keys=True, default=str).encode() + b"\n")
                n += 1
        return _Part(path, n)

    def commit(self, messages: list[_Part | None]) -> None:
        store, inner = _store(self.path)
        kept = {m.path for m in messages if m}
        present = [x.path for x in store.get_file_info(stores.FileSelector(inner)) if x.path not in kept]
        number = 0
        for m in messages:
            if m and m.rows:
                store.move(m.path, f"{inner}/part-{number:05d}-{self.run}.jsonl")
                number += 1
            elif m:
                store.delete_file(m.path)
        # Files of tries that were given up, and when the table is overwritten, those that were there before.
        for path in present:
            if self.overwrite or self.run in path:
                store.delete_file(path)
        store.open_output_stream(f"{inner}/_SUCCESS").close()

    def abort(self, messages: list[_Part | None]) -> None:
        store, inner = _store(self.path)
        for x in store.get_file_info(stores.FileSelector(inner, allow_not_found=True)):
            if self.run in x.path:
                store.delete_file(x.path)


class RecordLines(DataSource):
    """Options: ``path`` (one, or a JSON list of them), ``rangeBytes``, ``from`` and ``to`` (ranges of the listing), ``counts`` (nothing parsed); for writing ``path`` and ``issues``, a column that must be empty.

    A line belongs to the range that its first byte is in. ``number`` counts from 1 within the range; a range's last row
    has no offset and, as number, how many lines it has. ``record_lines`` turns numbers into lines of the file. Lines end at line feeds; a byte order mark before the first is no part of it.
    """

    @classmethod
    def name(cls) -> str:
        return "record_lines"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def record_lines(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, line, record, error): each line that isn't blank, as VARIANT, or what is wrong with it.

    Ranges are counted first, without parsing; a running sum over a file's ranges says where the numbers of each begin.
    """
    spark.dataSource.register(RecordLines)
    reader = spark.read.format("record_lines").option("path", json.dumps([paths] if isinstance(paths, str) else paths)).option("rangeBytes", range_bytes)
    counts = stored(reader.option("counts", "true").load().select("path", "start", "number"), "line-counts")
    before = counts.select("path", "start", (F.sum("number").over(Window.partitionBy("path").orderBy("start")) - F.col("number")).alias("before"))
    before = F.broadcast(before) if counts.count() <= SENT_SPLITS else before
    rows = reader.option("counts", "false").load().where("offset is not null").join(before, ["path", "start"])
    return rows.select("path", (F.col("before") + F.col("number")).alias("line"), F.try_parse_json("json").alias("record"), "error")


def first_records(spark: SparkSession, paths: str | list[str], limit: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, line, record, error) of the first ``limit`` lines that aren't blank, one at least, of files one after another, each path's in the order of their names.

    Ranges are read in the order of the files, each time as many as before, until they hold enough: twice what is
    needed at most, whatever else there is. Each range says how many lines it has, so nothing is read to number them.
    """
    spark.dataSource.register(RecordLines)
    options = {"path": json.dumps([paths] if isinstance(paths, str) else paths), "rangeBytes": str(range_bytes)}
    total, parts, at, held, limit = len(_Reader(options).ranges()), [], 0, 0, max(1, limit)
    while held < limit and at < max(total, 1):
        to = max(1, 2 * at)
        part = stored(spark.read.format("record_lines").options(**options).option("from", at).option("to", min(to, max(total, 1))).load(), "first-ranges")
        parts.append(part)
        held, at = held + part.where("offset is not null").count(), to
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    counts = rows.where("offset is null").select("range", (F.sum("number").over(Window.partitionBy("path").orderBy("range")) - F.col("number")).alias("before"))
    some = rows.where("offset is not null").orderBy("range", "number").limit(limit).join(counts, "range")
    return some.select("path", (F.col("before") + F.col("number")).alias("line"), F.try_parse_json("json").alias("record"), "error")


def write_records(rows: DataFrame, path: str, issues: str | None = None, mode: str = "append") -> None:
    """JSON lines with keys sorted at every level. With ``issues``, nothing is left if a row has any."""
    rows.sparkSession.dataSource.register(RecordLines)
    writer = rows.write.format("record_lines").mode(mode).option("path", path)
    (writer.option("issues", issues) if issues else writer).save()


def variant_str(value: Column) -> Column:
    """A variant as text, as Python writes it; null for a missing or null one."""
    shown = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(shown)).when(~F.is_variant_null(value), shown)


def variant_items(value: Column) -> Column:
    """The items of a variant list; none of anything else."""
    return F.coalesce(F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.try_variant_get(value, "$", "array<variant>")), F.array().cast("array<variant>"))


def typed_record(record: Column) -> list[Column]:
    """The fields of a reward record, coerced from whatever types its JSON has: texts as written, a cluster that is no number as -2, lists that are none as empty, a missing review as false."""
    field = lambda name, of=record: F.try_variant_get(of, f"$.{name}", "variant")
    text = lambda name, of=record: F.coalesce(variant_str(field(name, of)), F.lit(""))
    meta = field("synth_meta")
    reviewed = field("human_reviewed", meta)
    own = F.struct(
        text("generator", meta).alias("generator"), text("prompt_id", meta).alias("prompt_id"), F.transform(variant_items(field("lore_sources", meta)), variant_str).alias("lore_sources"), variant_str(field("rejected_strategy", meta)).alias("rejected_strategy"),
        F.when(reviewed.isNull(), False).when(F.schema_of_variant(reviewed) == "BOOLEAN", F.try_variant_get(reviewed, "$", "boolean")).alias("human_reviewed"),
    )
    turns = F.transform(variant_items(field("conversations")), lambda t: F.struct(F.coalesce(variant_str(F.try_variant_get(t, "$.role", "variant")), F.lit("")).alias("role"), F.coalesce(variant_str(F.try_variant_get(t, "$.content", "variant")), F.lit("")).alias("content")))
    out = {name: text(name) for name in ("id", "character", "source_work", "profile", "gold_focus_attr", "reference_answer", "source", "split")}
    cluster = F.coalesce(F.try_variant_get(field("character_cluster"), "$", "long"), F.try_variant_get(field("character_cluster"), "$", "double").cast("long"), F.lit(-2).cast("long"))
    out |= {"character_cluster": cluster, "conversations": turns, "gold_focus": F.transform(variant_items(field("gold_focus")), variant_str), "rejected_answer": variant_str(field("rejected_answer")), "synth_meta": F.when(F.startswith(F.schema_of_variant(meta), F.lit("OBJECT")), own)}
    return [c.alias(name) for name, c in out.items()]


def load_records(spark: SparkSession, paths: str | list[str], validate: bool = True, strict: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, line, record, errors, and the fields of ``typed_record``) of every line that isn't blank.

    ``errors`` has ``line N: ...`` for broken JSON, for what is no object and, with ``validate``, for each rule of the
    schema that the record breaks. ``strict`` fails at a line that has any instead.
    """
    rows = record_lines(spark, paths, range_bytes).select("path", "line", "record", "error", *typed_record(F.col("record")))
    found = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(schema_errors() if validate else F.array().cast("array<string>"))
    errors = F.transform(found, lambda x: F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), x))
    if strict:
        errors = F.when(F.size(errors) > 0, F.raise_error(F.concat("path", F.lit(": "), F.array_join(errors, "; "))).cast("array<string>")).otherwise(errors)
    return rows.withColumn("errors", errors).drop("error")
