"""The rules of records over JSON of any shape: what is missing or has the wrong type, and then what typed records are judged by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.record_lines import variant_items
from .validate import TEXT_FIELDS, record_issues

#: The fields that every record has.
REQUIRED = ["id", "character", "source_work", "character_cluster", "profile", "conversations", "gold_focus", "gold_focus_attr", "reference_answer", "rejected_answer", "source", "split", "synth_meta"]
_ISSUES = "array<struct<code:string,field:string>>"


def _is(value: Column, *kinds: str) -> Column:
    """Whether a variant is of one of these kinds; false for a missing one."""
    shape = F.schema_of_variant(value)
    found = F.lit(False)
    for kind in kinds:
        found = found | F.startswith(shape, F.lit(kind))
    return F.coalesce(value.isNotNull() & found, F.lit(False))


def _text(value: Column) -> Column:
    """A variant that is a text; null for any other."""
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def raw_record_issues(rows: DataFrame, key: str, record: str, check_cjk: bool = True) -> DataFrame:
    """(key, issues) of VARIANT records: an array of (code, field), first what is missing or of the wrong type, then the rules of ``record_issues``.

    A record that is no object, or null, has that one issue. A field that is missing isn't empty too, a turn that is
    no object has no role or content to judge, and a label that is no text is neither illegal nor a duplicate.
    """
    r = F.col(record)
    get = lambda name, of=r: F.try_variant_get(of, f"$.{name}", "variant")
    meta = get("synth_meta")
    own = F.struct(*(_text(get(f, meta)).alias(f) for f in ("generator", "prompt_id", "rejected_strategy")))
    turns = F.transform(variant_items(get("conversations")), lambda t: F.struct(_text(F.try_variant_get(t, "$.role", "variant")).alias("role"), _text(F.try_variant_get(t, "$.content", "variant")).alias("content")))
    typed = {name: _text(get(name)) for name in (*TEXT_FIELDS, "rejected_answer")}
    typed |= {"conversations": turns, "gold_focus": F.transform(variant_items(get("gold_focus")), _text), "synth_meta": F.when(_is(meta, "OBJECT"), own)}

    issue = lambda rule, code, field: F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    wrong = lambda value, *kinds: value.isNotNull() & ~_is(value, "VOID", *kinds)
    at = lambda name, i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
    each = lambda name, kind, code: F.array_compact(F.transform(variant_items(get(name)), lambda x, i: F.when(~_is(x, kind), F.struct(F.lit(code).alias("code"), at(name, i).alias("field")))))
    missing = F.array_compact(F.array(*(F.when(get(name).isNull(), F.lit(name)) for name in REQUIRED)))
    cluster, lore = get("character_cluster"), get("lore_sources", meta)
    types = F.array_compact(
        F.array(
            issue(cluster.isNotNull() & ~_is(cluster, "BIGINT", "BOOLEAN"), "schema.character_cluster", "character_cluster"),
            issue(wrong(get("rejected_answer"), "STRING"), "schema.rejected_answer", "rejected_answer"),
            issue(wrong(meta, "OBJECT"), "schema.synth_meta", "synth_meta"),
            issue(_is(meta, "OBJECT") & lore.isNotNull() & ~_is(lore, "ARRAY"), "provenance.lore_sources", "synth_meta.lore_sources"),
        )
    )
    turn_issues, label_issues = each("conversations", "OBJECT", "schema.conversation_turn"), each("gold_focus", "STRING", "label.type")
    first = F.concat(F.transform(missing, lambda m: F.struct(F.lit("schema.missing").alias("code"), m.alias("field"))), types, turn_issues, label_issues)

    own_columns = F.struct(F.col(key).alias("__key"), _is(r, "OBJECT").alias("is_object"), missing.alias("missing"), first.alias("first"), *(c.alias(name) for name, c in typed.items()))
    # One row for each: a generator keeps the optimizer from writing these expressions out wherever a rule names a column.
    typed_rows = rows.select(F.inline_outer(F.array(own_columns)))
    judged = record_issues(typed_rows, check_cjk)
    bad_turns = F.transform(F.filter("first", lambda x: x["code"] == "schema.conversation_turn"), lambda x: x["field"])
    judged = judged.select(F.inline_outer(F.array(F.struct("__key", "is_object", "missing", "first", "issues", bad_turns.alias("bad_turns")))))
    kept = F.filter("issues", lambda x: ~((x["code"] == "schema.non_empty_string") & F.array_contains("missing", x["field"])) & ~(x["code"].isin("schema.conversation_role", "schema.conversation_content") & F.array_contains("bad_turns", F.substring_index(x["field"], ".", 1))))
    lone = F.array(F.struct(F.lit("schema.record_type").alias("code"), F.lit("<record>").alias("field")))
    return judged.select(F.col("__key").alias(key), F.when(F.col("is_object"), F.concat(F.col("first").cast(_ISSUES), kept.cast(_ISSUES))).otherwise(lone).alias("issues"))
