"""Validation rules as issue columns, and checks over whole sets of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grammar import FOCUS_LABELS, label_array, parse_strict, perfect_completion
from ..functions.text import blank, has_cjk, normalize_text, py_strip

#: The closed sets of the record schema.
SPLITS = ["sft", "reward", "eval_heldout"]
SOURCES = ["CharacterBench", "RoleBench", "DeepSeek-synth", "HSR-canon", "HSR-synth"]
SYNTHETIC = ["DeepSeek-synth", "HSR-synth"]
ROLES = ["user", "assistant"]
LOCAL_ONLY = ["三月七", "March 7th"]
TEXT_FIELDS = ["id", "character", "source_work", "profile", "gold_focus_attr", "reference_answer", "source", "split"]
PLACEHOLDERS = ["TODO", "TBD", "FIXME", "PLACEHOLDER", "FILL_ME", "待填", "占位", "示例文本"]
MAX_REFERENCE = 1000


def schema_errors(record_id: Column | None = None) -> Column:
    """What is wrong with a typed record, as sentences in the order of the rules; ``record_id`` stands in for its id.

    Columns: id, character, source_work, character_cluster, profile, conversations, gold_focus, gold_focus_attr, reference_answer,
    rejected_answer, source, split, synth_meta (generator, prompt_id, rejected_strategy, human_reviewed).
    """
    c, text = F.col, lambda x: F.coalesce(x, F.lit(""))
    listed = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
    say = lambda rule, words: F.when(F.coalesce(rule, F.lit(False)), words if isinstance(words, Column) else F.lit(words))
    named = {"id": record_id if record_id is not None else c("id").cast("string")} | {f: c(f) for f in ("character", "source_work", "profile", "gold_focus_attr", "reference_answer")}
    turns, focus, meta, rejected = c("conversations"), F.coalesce(c("gold_focus"), F.array().cast("array<string>")), c("synth_meta"), c("rejected_answer")
    at = lambda i, rest: F.concat(F.lit("conversations["), i.cast("string"), F.lit(rest))
    said = F.flatten(F.transform(turns, lambda t, i: F.array(F.when(~text(t["role"]).isin(ROLES), at(i, f"].role must be one of {listed(ROLES)}")), F.when(blank(t["content"]), at(i, "].content must be non-empty")))))
    illegal = F.filter(focus, lambda x: ~F.array_contains(label_array(), x))
    first = [say(blank(x), f"{name} must be a non-empty string") for name, x in named.items()]
    first += [say(F.coalesce(c("character_cluster"), F.lit(-2)) < -1, "character_cluster must be -1 or a non-negative integer"), say(F.coalesce(F.size(turns), F.lit(0)) < 1, "conversations must contain at least one turn")]
    late = [
        say(F.size(focus) == 0, "gold_focus must contain at least one label"),
        say(F.size(illegal) > 0, F.concat(F.lit("gold_focus contains illegal labels: ['"), F.array_join(illegal, "', '"), F.lit("']"))),
        say(F.size(F.array_distinct(focus)) != F.size(focus), "gold_focus must not contain duplicate labels"),
        say(~text(c("source")).isin(SOURCES), f"source must be one of {listed(SOURCES)}"),
        say(~text(c("split")).isin(SPLITS), f"split must be one of {listed(SPLITS)}"),
        say(c("source").isin(SYNTHETIC) & meta.isNull(), "synth_meta is required for synthetic sources"),
        *(say(meta.isNotNull() & blank(meta.getField(f)), f"synth_meta.{f} must be a non-empty string") for f in ("generator", "prompt_id")),
        say(meta.isNotNull() & meta.getField("human_reviewed").isNull(), "synth_meta.human_reviewed must be a boolean"),
        say(rejected.isNotNull() & blank(rejected), "rejected_answer must be non-empty when present"),
        say(rejected == text(c("reference_answer")), "rejected_answer must differ from reference_answer"),
        say(rejected.isNotNull() & meta.isNull(), "synth_meta is required when rejected_answer is present"),
        say(rejected.isNotNull() & meta.isNotNull() & (text(meta.getField("rejected_strategy")) == ""), "synth_meta.rejected_strategy is required when rejected_answer is present"),
    ]
    return F.concat(F.array_compact(F.array(*first)), F.coalesce(F.array_compact(said), F.array().cast("array<string>")), F.array_compact(F.array(*late)))


def _issue(rule: Column, code: str, field: Column | str) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.when(rule, F.struct(F.lit(code).alias("code"), name.alias("field")))


def _each(items: Column, rule, code: str, name: str, suffix: str = "") -> Column:
    """An issue for each item that ``rule`` (item, index) finds wrong."""
    hits = F.transform(items, lambda x, i: _issue(F.coalesce(rule(x, i), F.lit(False)), code, F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"]{suffix}"))))
    return F.coalesce(F.array_compact(hits), F.array().cast("array<struct<code:string,field:string>>"))


def record_issues(records: DataFrame, check_cjk: bool = True) -> DataFrame:
    """Adds ``issues``: an array of (code, field) in the order of the rules. No shuffle.

    Records have id, character, source_work, profile, conversations, gold_focus, gold_focus_attr, reference_answer,
    rejected_answer, source, split and a nullable synth_meta struct.
    """
    c = F.col
    reference, rejected = normalize_text(c("reference_answer")), normalize_text(c("rejected_answer"))
    has_rejected, meta = c("rejected_answer").isNotNull(), c("synth_meta")
    needs_cjk = has_cjk(F.concat_ws(" ", "character", "source_work", "profile", "gold_focus_attr", F.array_join(F.transform("conversations", lambda t: F.coalesce(t["content"], F.lit(""))), " ")))
    labels_ok = (F.size("gold_focus") > 0) & (F.size(F.array_except("gold_focus", label_array())) == 0)
    p = parse_strict(perfect_completion(c("gold_focus"), c("gold_focus_attr"), c("reference_answer")))
    formed = p.getField("well_formed")
    same = (F.size(F.array_except(p.getField("focus_labels"), c("gold_focus"))) == 0) & (F.size(F.array_except(c("gold_focus"), p.getField("focus_labels"))) == 0)
    trip = labels_ok & c("gold_focus_attr").isNotNull() & c("reference_answer").isNotNull()
    single = [
        *(_issue(blank(c(f)), "schema.non_empty_string", f) for f in TEXT_FIELDS),
        _issue(~c("source").isin(SOURCES), "provenance.source_unknown", "source"),
        _issue(~c("split").isin(SPLITS), "split.unknown", "split"),
        _issue(F.coalesce(F.size("conversations"), F.lit(0)) < 1, "schema.conversations", "conversations"),
        _issue(F.coalesce(F.size("gold_focus"), F.lit(0)) < 1, "label.gold_focus", "gold_focus"),
    ]
    late = [
        _issue(c("reference_answer").isNotNull() & blank(c("reference_answer")), "reference.empty", "reference_answer"),
        _issue(F.length("reference_answer") > MAX_REFERENCE, "reference.too_long", "reference_answer"),
        _issue(reference == normalize_text(c("gold_focus_attr")), "reference.equals_gold_attr", "reference_answer"),
        _issue(reference.isin([x.lower().replace("_", "") for x in FOCUS_LABELS]), "reference.equals_focus_label", "reference_answer"),
        *([_issue(needs_cjk & c("reference_answer").isNotNull() & ~has_cjk(c("reference_answer")), "reference.not_cjk", "reference_answer")] if check_cjk else []),
        _issue(has_rejected & blank(c("rejected_answer")), "dpo.rejected_empty", "rejected_answer"),
        _issue(has_rejected & (reference == rejected), "dpo.chosen_equals_rejected", "rejected_answer"),
        *([_issue(needs_cjk & has_rejected & ~has_cjk(c("rejected_answer")), "dpo.rejected_not_cjk", "rejected_answer")] if check_cjk else []),
        _issue(c("source").isin(SYNTHETIC) & meta.isNull(), "provenance.synth_meta_missing", "synth_meta"),
        _issue(meta.isNotNull() & blank(meta.getField("generator")), "provenance.synth_meta_field_missing", "synth_meta.generator"),
        _issue(meta.isNotNull() & blank(meta.getField("prompt_id")), "provenance.synth_meta_field_missing", "synth_meta.prompt_id"),
        _issue(~blank(c("rejected_answer")) & blank(meta.getField("rejected_strategy")), "provenance.rejected_strategy_missing", "synth_meta.rejected_strategy"),
        _issue((F.coalesce("rejected_answer", F.lit("")) == "") & ~blank(meta.getField("rejected_strategy")), "provenance.rejected_strategy_without_rejected", "synth_meta.rejected_strategy"),
        _issue(c("character").isin(LOCAL_ONLY) & (c("split") != "eval_heldout"), "leakage.hsr_not_eval_only", "split"),
        _issue(trip & ~formed, "parseability.round_trip_format", "<completion>"),
        _issue(trip & formed & ~same, "parseability.round_trip_focus", "gold_focus"),
        _issue(trip & formed & (p.getField("focus_attr") != py_strip(c("gold_focus_attr"))), "parseability.round_trip_attr", "gold_focus_attr"),
        _issue(trip & formed & (p.getField("boxed_answer") != py_strip(c("reference_answer"))), "parseability.round_trip_reference", "reference_answer"),
    ]
    indexed = [
        _each(c("conversations"), lambda t, i: ~F.coalesce(t["role"].isin(ROLES), F.lit(False)), "schema.conversation_role", "conversations", ".role"),
        _each(c("conversations"), lambda t, i: blank(t["content"]), "schema.conversation_content", "conversations", ".content"),
        _each(c("gold_focus"), lambda x, i: ~F.array_contains(label_array(), x), "label.illegal", "gold_focus"),
        _each(c("gold_focus"), lambda x, i: F.array_contains(F.slice(c("gold_focus"), 1, i), x), "label.duplicate", "gold_focus"),
    ]
    return records.withColumn("issues", F.concat(F.array_compact(F.array(*single)), *indexed, F.array_compact(F.array(*late))))


def duplicate_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, first) for every occurrence of a key after its first."""
    first = F.min(order).over(Window.partitionBy(key))
    return rows.select(key, order).withColumn("first", first).where(F.col(order) > F.col("first"))


def split_overlaps(rows: DataFrame, keys: dict[str, str], split: str = "split") -> DataFrame:
    """(code, key, splits) for keys that occur in more than one split; ``keys`` maps columns to issue codes."""
    sets = rows.select(split, F.explode(F.array(*(F.struct(F.lit(code).alias("code"), F.col(k).alias("key")) for k, code in keys.items()))).alias("k")).select(split, "k.*").where("key is not null")
    return sets.groupBy("code", "key").agg(F.array_join(F.array_sort(F.collect_set(split)), "/").alias("splits")).where(F.instr("splits", "/") > 0)


def expected_splits(records: DataFrame, config: DataFrame) -> DataFrame:
    """(id, code) for records that a split table (character, split) doesn't have, or has in another split; a character's last split in the order of the splits counts."""
    rank = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    last = config.groupBy(F.col("character").alias("known")).agg(F.max_by("split", rank).alias("expected"), F.count_distinct("split").alias("n"))
    joined = records.join(last, records["character"] == last["known"], "left")
    codes = F.array_compact(F.array(F.when(F.col("n") > 1, "leakage.character_split_overlap"), F.when(F.col("expected").isNull(), "split.character_missing"), F.when(F.col("expected") != F.col("split"), "split.mismatch")))
    return joined.select("id", F.explode(codes).alias("code"))


def placeholder_fields(rows: DataFrame, key: str, fields: list[str], markers: list[str] = PLACEHOLDERS) -> DataFrame:
    """(key, field) for each text field that holds a placeholder marker in any case."""
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    hit = F.exists(F.array(*(F.lit(m.upper()) for m in markers)), lambda m: F.contains(F.upper("value"), m))
    return rows.select(key, values.alias("x")).select(key, "x.*").where(hit).select(key, "field")
