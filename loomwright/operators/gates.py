"""Checks over whole sets of records, split tables and ledgers: issues as rows, gates that fail a run."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank, record_text
from ..sources.files import license_named
from ..storage import drop_stored, stored
from . import similarity
from .validate import LOCAL_ONLY, SOURCES, SPLITS, duplicate_ids, record_issues, split_overlaps

#: Sources of local-only records, and the marks by which such records are known.
LOCAL_SOURCES = ["HSR-canon", "HSR-synth"]
LOCAL_ID, LOCAL_WORK, LOCAL_TITLE, LOCAL_MARKS = "hsr_", "hsr", "星穹铁道", ["local-only", "local_only"]
#: What shows that a gold record is still a template.
MARKERS = ["PLACEHOLDER", "DO_NOT_USE", "TEMPLATE", "TODO", "FILL_ME", "NOT_A_GOLD_RECORD", "占位", "待填写"]
NEAR = 0.88
_ISSUE = "record_id string, code string, field string"


def _pairs(table: DataFrame, key: str, code: str) -> DataFrame:
    """(code, field, detail) for each two splits that share values of ``key``."""
    rank = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    own = table.where(F.col(key).isNotNull() & F.col("split").isin(SPLITS)).select(F.col(key).alias("k"), "split", rank.alias("r")).distinct()
    left, right = own.select("k", F.col("split").alias("a"), F.col("r").alias("ra")), own.select(F.col("k").alias("k2"), F.col("split").alias("b"), F.col("r").alias("rb"))
    both = left.join(right, (F.col("k") == F.col("k2")) & (F.col("ra") < F.col("rb")))
    return both.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("k")), ", ").alias("detail")).select(F.lit(code).alias("code"), F.concat("a", F.lit("/"), "b").alias("field"), "detail")


def split_table_issues(config: DataFrame, works: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """(code, field, detail) of a split table (split, character): doubled entries, characters or works in two splits, local-only characters outside the held-out one.

    ``works`` (character, source_work) are the table's own; with ``records`` (character, source_work, order), theirs take
    precedence and the works are checked again, so an overlap that both show is listed twice.
    """
    doubled = config.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("character").alias("k")).where("n <> k").select(F.lit("split.duplicate_character").alias("code"), F.col("split").alias("field"), F.lit(None).cast("string").alias("detail"))
    local = config.where(F.col("character").isin(LOCAL_ONLY) & F.col("split").isin("sft", "reward")).distinct().select(F.lit("leakage.hsr_not_eval_only").alias("code"), F.col("split").alias("field"), F.col("character").alias("detail"))
    out = doubled.unionByName(_pairs(config, "character", "leakage.character_split_overlap")).unionByName(local)
    named = None if works is None else works.select("character", "source_work")
    if named is not None:
        out = out.unionByName(_pairs(config.join(named, "character"), "source_work", "leakage.source_work_split_overlap"))
    if records is not None:
        own = records.where(~blank(F.col("character")) & ~blank(F.col("source_work"))).groupBy("character").agg(F.max_by("source_work", "order").alias("source_work"))
        merged = own if named is None else named.join(own, "character", "left_anti").unionByName(own)
        out = out.unionByName(_pairs(config.join(merged, "character"), "source_work", "leakage.source_work_split_overlap"))
    return out


def record_split_issues(records: DataFrame) -> DataFrame:
    """(record_id, code, field): local-only records outside the held-out split, and characters and works that occur in more than one."""
    local = records.where(F.col("character").isin(LOCAL_ONLY) & F.col("split").isin(SPLITS) & (F.col("split") != "eval_heldout")).select(F.col("id").alias("record_id"), F.lit("leakage.hsr_not_eval_only").alias("code"), F.lit("split").alias("field"))
    known = records.where(F.col("split").isin(SPLITS)).withColumns({c: F.when(~blank(F.col(c)), F.col(c)) for c in ("character", "source_work")})
    over = split_overlaps(known, {"character": "leakage.character_record_split_overlap", "source_work": "leakage.source_work_record_split_overlap"})
    return local.unionByName(over.select(F.col("key").alias("record_id"), "code", F.when(F.col("code").contains("source_work"), "source_work").otherwise("character").alias("field")))


def _compared(records: DataFrame) -> DataFrame:
    text = record_text([F.col("profile"), F.col("gold_focus_attr"), F.col("reference_answer")], F.col("conversations"))
    return records.select("id", "split", text.alias("text"))


def near_duplicate_records(records: DataFrame, within: bool = False, threshold: float = NEAR) -> DataFrame:
    """(left_id, right_id, similarity, reason) of records by their text; between reward and eval_heldout, or with ``within`` among all."""
    own = _compared(records)
    return similarity.near_duplicate_pairs(own, "id", "text", threshold) if within else similarity.near_duplicate_pairs(own, "id", "text", threshold, split="split", cross=("reward", "eval_heldout"))


def _named(records: DataFrame, order: str) -> DataFrame:
    """``records`` with row_ and its number for a missing id."""
    return records.withColumn("id", F.when(blank(F.col("id")), F.concat(F.lit("row_"), F.col(order).cast("string"))).otherwise(F.col("id")))


def _joint_issues(records: DataFrame, order: str) -> DataFrame:
    """(record_id, code, field): repeated ids and split overlaps."""
    doubled = duplicate_ids(_named(records, order), "id", order).select(F.col("id").alias("record_id"), F.lit("schema.duplicate_id").alias("code"), F.lit("id").alias("field"))
    return doubled.unionByName(record_split_issues(records))


def batch_issues(records: DataFrame, order: str, check_cjk: bool = True, check_near: bool = True, threshold: float = NEAR) -> DataFrame:
    """(record_id, code, field): the issues of each record, repeated ids (a missing one is row_ and its number), split overlaps, and near duplicates between reward and held-out records."""
    own = record_issues(records, check_cjk).select(F.col("id").alias("record_id"), F.inline("issues"))
    out = own.unionByName(_joint_issues(records, order))
    if not check_near:
        return out
    near = near_duplicate_records(records, threshold=threshold)
    return out.unionByName(near.select(F.col("left_id").alias("record_id"), F.lit("leakage.cross_split_near_duplicate").alias("code"), F.lit("conversations/reference_answer").alias("field")))


def batch_report(records: DataFrame, order: str, check_cjk: bool = True, threshold: float = NEAR) -> DataFrame:
    """(ok, code, n): how many issues of each code a whole batch has, near duplicates across splits among them, and whether it has none; one row without a code for a batch without any. Near duplicates are counted by classes of equal texts."""
    found = batch_issues(records, order, check_cjk, False).groupBy("code").agg(F.count("*").alias("n"))
    near = similarity.cross_pair_count(_compared(records), "id", "text", threshold, "split", ("reward", "eval_heldout"))
    counted = stored(found.unionByName(near.where("n > 0").select(F.lit("leakage.cross_split_near_duplicate").alias("code"), "n")), "batch-issues")
    clean = counted.agg(F.count("*").alias("k")).where("k = 0").select(F.lit(True).alias("ok"), F.lit(None).cast("string").alias("code"), F.lit(0).cast("long").alias("n"))
    return counted.select(F.lit(False).alias("ok"), "code", "n").unionByName(clean)


def string_fields(schema: T.StructType) -> Column:
    """An array of (path, value) of every text in a row, however deep: a.b[0].c."""

    def walk(kind: T.DataType, value: Column, path: Column) -> Column:
        none = F.array().cast("array<struct<path:string,value:string>>")
        if isinstance(kind, T.StringType):
            return F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), value.alias("value")))).otherwise(none)
        if isinstance(kind, T.StructType):
            return F.concat(none, *(walk(f.dataType, value.getField(f.name), F.concat(path, F.lit(f".{f.name}"))) for f in kind))
        if isinstance(kind, T.ArrayType):
            each = F.transform(value, lambda x, i: walk(kind.elementType, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            return F.coalesce(F.flatten(each), none)
        if isinstance(kind, T.MapType):
            each = F.transform(F.map_entries(value), lambda e: walk(kind.valueType, e["value"], F.concat(path, F.lit("."), e["key"])))
            return F.coalesce(F.flatten(each), none)
        return none

    return F.concat(*(walk(f.dataType, F.col(f.name), F.lit(f.name)) for f in schema))


def placeholders(rows: DataFrame, key: str, markers: list[str] = MARKERS) -> DataFrame:
    """(key, field) for every text of a row, nested ones too, that holds a placeholder marker in any case."""
    found = rows.select(key, F.explode(string_fields(rows.drop(key).schema)).alias("x")).select(key, F.col("x.path").alias("field"), F.upper("x.value").alias("value"))
    return found.where(F.exists(F.array(*(F.lit(m.upper()) for m in markers)), lambda m: F.contains("value", m))).select(key, "field")


def local_only(character: Column, source: Column, record_id: Column, work: Column) -> Column:
    """Whether a record belongs to the local-only set: by character, source, id or work."""
    text = lambda x: F.coalesce(x, F.lit(""))
    return text(character).isin(LOCAL_ONLY) | text(source).isin(LOCAL_SOURCES) | F.startswith(text(record_id), F.lit(LOCAL_ID)) | F.contains(F.lower(text(work)), F.lit(LOCAL_WORK)) | F.contains(text(work), F.lit(LOCAL_TITLE))


def human_reviewed(rows: DataFrame) -> Column:
    """True only for a boolean true in the provenance or the record itself."""
    marks = []
    if "synth_meta" in rows.columns and "human_reviewed" in rows.schema["synth_meta"].dataType.names:
        marks.append(F.col("synth_meta").getField("human_reviewed"))
    if "human_reviewed" in rows.columns and isinstance(rows.schema["human_reviewed"].dataType, T.BooleanType):
        marks.append(F.col("human_reviewed"))
    out = F.lit(False)
    for mark in marks:
        out = out | F.coalesce(mark, F.lit(False))
    return out


def gold_gate(records: DataFrame, path: str = "path", least: int = 20, local_folder: str = "work/data/hsr") -> DataFrame:
    """(record_id, code, field) of everything that keeps a file of gold records from passing; records carry the ``path`` of their file.

    Besides the rules of records: too few of them, template files, rows no one has reviewed, placeholder texts, unknown
    sources and splits, and local-only records with another source, split, id, work or folder.
    """
    c = F.col
    named = F.coalesce(c("id"), F.lit("<missing-id>"))
    local = local_only(c("character"), c("source"), c("id"), c("source_work"))
    marked = F.exists(F.array(*map(F.lit, LOCAL_MARKS)), lambda m: F.contains(F.lower(F.coalesce("source_work", F.lit(""))), m))
    rules = [
        (~human_reviewed(records), "gate.human_reviewed_false", "synth_meta.human_reviewed"),
        (~F.coalesce(c("source").isin(SOURCES), F.lit(False)), "gate.source_invalid", "source"),
        (~F.coalesce(c("split").isin(SPLITS), F.lit(False)), "gate.split_invalid", "split"),
        (local & ~F.coalesce(c("source").isin(LOCAL_SOURCES), F.lit(False)), "local_only.hsr_source", "source"),
        (local & (F.coalesce("split", F.lit("")) != "eval_heldout"), "local_only.hsr_split", "split"),
        (local & ~F.startswith(F.coalesce("id", F.lit("")), F.lit(LOCAL_ID)), "local_only.hsr_id_prefix", "id"),
        (local & ~marked, "local_only.source_work_marker", "source_work"),
        (local & ~F.contains(c(path), F.lit(f"/{local_folder}/")), "local_only.path", None),
    ]
    found = F.array_compact(F.array(*(F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"))) for rule, code, field in rules)))
    rows = records.select(named.alias("record_id"), F.explode(found).alias("i")).select("record_id", "i.code", "i.field")
    texts = placeholders(records.drop(path).withColumn("record_id", named), "record_id").select("record_id", F.lit("gate.placeholder_marker").alias("code"), "field")
    files = records.select(path).distinct().where(F.contains(F.lower(F.element_at(F.split(path, "/"), -1)), F.lit("template"))).select(F.lit(None).cast("string").alias("record_id"), F.lit("gate.template_input").alias("code"), F.lit(None).cast("string").alias("field"))
    n = records.agg(F.count("*").alias("n"))
    few = n.where(F.col("n") < least).select(F.lit(None).cast("string").alias("record_id"), F.when(F.col("n") == 0, "gate.no_records").otherwise("gate.too_few_records").alias("code"), F.lit(None).cast("string").alias("field"))
    return rows.unionByName(texts).unionByName(files).unionByName(few)


def gold_report(records: DataFrame, order: str, path: str = "path", least: int = 20, local_folder: str = "work/data/hsr", threshold: float = NEAR) -> DataFrame:
    """(n, bad, unreviewed, codes) of a whole gold batch in one row: records, those with issues of their own, those no one has reviewed, and how many issues of each code there are; a batch without any passes.

    All that the gate asks for: the rules of records, repeated ids, split overlaps, near duplicates between reward and
    held-out records, each pair once and counted by classes of equal texts, and ``gold_gate``.
    """
    checked = stored(record_issues(records), "gold-records")
    rows = checked.drop("issues")
    own = checked.select(F.explode("issues.code").alias("code"))
    found = own.unionByName(_joint_issues(rows, order).select("code")).unionByName(gold_gate(rows, path, least, local_folder).select("code")).groupBy("code").agg(F.count("*").alias("n"))
    near = similarity.cross_pair_count(_compared(_named(rows, order)), "id", "text", threshold, "split", ("reward", "eval_heldout"))
    counted = found.unionByName(near.where("n > 0").select(F.lit("leakage.cross_split_near_duplicate").alias("code"), "n"))
    codes = counted.agg(F.array_join(F.array_sort(F.collect_list(F.concat("code", F.lit(":"), F.col("n").cast("string")))), ",").alias("codes"))
    sums = checked.agg(F.count("*").alias("n"), F.count_if(F.size("issues") > 0).alias("bad"), F.count_if(~human_reviewed(rows)).alias("unreviewed"))
    out = stored(sums.crossJoin(codes), "gold-report")
    drop_stored(checked)
    return out


def require(ok: Column, message: Column | str) -> Column:
    """True, or an error that ends the query."""
    return F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(message if isinstance(message, Column) else F.lit(message)).cast("boolean"))


def ledger_entry(entries: DataFrame, source_id: str, order: str) -> DataFrame:
    """The first entry (source_id, license, file_count) of a source; the query fails for one without a named license or files, and for none."""
    first = entries.where(F.col("source_id") == source_id).agg(F.min_by(F.struct(*entries.columns), order).alias("e"))
    found = require(F.col("e").isNotNull(), f"no ledger entry for source_id={source_id}")
    named = require(license_named(F.col("e.license")), f"entry {source_id} has unknown license")
    filled = require(F.coalesce("e.file_count", F.lit(0)) > 0, f"entry {source_id} has no files")
    return first.where(F.when(found, F.when(named, filled))).select("e.*")


def all_scored(scored: DataFrame) -> DataFrame:
    """(rows, unscored, passed) of scored rows with ``status`` and ``score``: a run that asks for gold passes only if every row is ok and has a score."""
    bad = F.count_if((F.col("status") != "ok") | F.col("score").isNull())
    return scored.agg(F.count("*").alias("rows"), bad.alias("unscored"), (bad == 0).alias("passed"))


def trainer_errors(config: dict, generations: str = "num_generations") -> list[str]:
    """What is wrong with a trainer's settings: a beta that isn't positive, or a batch that the generations don't divide."""
    out = []
    beta = config.get("beta")
    if beta is not None and float(beta) <= 0:
        out.append("beta must be positive")
    each = int(config.get(generations) or 0)
    batch = int(config.get("per_device_train_batch_size") or 1) * int(config.get("gradient_accumulation_steps") or 1)
    if each and batch % each:
        out.append(f"batch of {batch} isn't divided by {each} generations")
    return out


def model_scores(rows: DataFrame, scorer: Callable[[list[str]], list[float | None]] | None, template: Callable[[Column, Column, Column], Column], batch: int = 16) -> DataFrame:
    """Adds ``scoring`` (score, status, error) to rows with profile, dialogue and response: by ``scorer`` in batches, or dry_run without one.

    A batch whose scorer fails gives its rows the status error with what it said.
    """
    texts = rows.withColumn("scored_text", template(F.col("profile"), F.col("dialogue"), F.col("response")))
    kind = "struct<score:double,status:string,error:string>"
    if scorer is None:
        dry = F.struct(F.lit(None).cast("double").alias("score"), F.lit("dry_run").alias("status"), F.lit(None).cast("string").alias("error"))
        return texts.withColumn("scoring", dry.cast(kind)).drop("scored_text")

    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.DataFrame:
        out = []
        for i in range(0, len(x), batch):
            some = x.iloc[i : i + batch].tolist()
            try:
                out += [(s, "ok", None) for s in scorer(some)]
            except Exception as e:  # noqa: BLE001  what a model raises is its own
                out += [(None, "error", f"{type(e).__name__}: {e}")] * len(some)
        return pd.DataFrame(out, columns=["score", "status", "error"])

    return texts.withColumn("scoring", run("scored_text")).drop("scored_text")
