"""Queries over builders, typed values and gates, and their DuckDB twins.

Twins of value functions list what each kind of input must give; those of builders compute it from the fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions import reward as W
from ..functions.mcq import typed_choice
from ..functions.text import normalize_text, record_text
from ..operators import builders as B
from ..operators import gates as K
from ..operators import records as R
from ..operators import splits as P
from ..operators import validate as V
from ..operators.raw_validate import raw_record_issues
from ..sources.walk import record_like
from ..storage import stored
from .reward_queries import strip
from .set_queries import near_ctes
from .views import ctes, view

SOURCE = "RoleBench"
_RAW = """
select rid, case when rid % 11 = 0 then '  ' when rid % 2 = 0 then concat(' ', persona) end as role, case when rid % 11 = 0 then null else persona end as name, case when rid % 4 = 0 then source_work end as work,
  case when rid % 3 = 0 then profile end as persona, case when rid % 13 = 0 then ' ' else question end as question, case when rid % 7 = 0 then null else reference_answer end as answer, case when rid % 14 = 0 then 'second' end as output,
  rejected_answer, case when rid % 6 = 0 then '' else id end as id, cluster as character_cluster, case when rid % 5 = 0 then ' ' else gold_focus_attr end as gold_focus_attr, case when rid % 9 = 0 then 'Bogus' else f1 end as f1, f2, reference_answer as said
from records
"""


def _lit(value: object) -> Column:
    return F.lit(value)


def _pick(values: list) -> Column:
    """The value of a row by its number."""
    return F.element_at(F.array(*map(_lit, values)), (F.col("rid") % len(values) + 1).cast("int"))


def _case(values: list, kind: str = "varchar") -> str:
    """The same in SQL."""
    say = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "concat('" + "', chr(10), '".join(v.replace("'", "''").split("\n")) + "')"
    return f"cast(case rid % {len(values)} " + " ".join(f"when {k} then {say(v)}" for k, v in enumerate(values)) + f" end as {kind})"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "records")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"with raw as ({_RAW.replace('from records', 'from {r}')}) select * from raw", r=_records(spark, sf_dir))
    turn = F.struct(F.when(F.col("rid") % 17 == 0, "narrator").otherwise("user").alias("speaker"), F.col("question").alias("text"))
    dialogue = F.when(F.col("rid") % 3 == 1, F.array(turn, F.struct(F.lit(None).cast("string").alias("speaker"), F.lit("  ").alias("text"))))
    return rows.withColumns({"dialogue": dialogue, "gold_focus": F.when(F.col("rid") % 8 > 0, F.array("f1", "f2")), "generated": F.array(F.lit("  "), F.concat(F.lit("gen "), "said"), F.lit("later"))}).drop("said", "f1", "f2")


def _flat(rows: DataFrame) -> DataFrame:
    turns = F.array_join(F.transform("conversations", lambda t: F.concat(t["role"], F.lit("="), F.length(t["content"]).cast("string"))), ";")
    out = rows.withColumns({"conversations": turns, "gold_focus": F.array_join("gold_focus", ",")}).withColumnRenamed("order", "rid")
    if "synth_meta" in rows.columns:
        out = out.withColumn("synth_meta", F.concat_ws("/", "synth_meta.generator", "synth_meta.prompt_id", F.array_join("synth_meta.lore_sources", "+"), "synth_meta.rejected_strategy"))
    return out.drop("skip_reason", "reportability_reasons")


def bootstrap_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = B.bootstrap_records(_raw(spark, sf_dir).drop("generated"), SOURCE, "rid")
    return _flat(B.kept_records(judged, "official")).drop("claim_boundary", "label_source", "split", "source")


def bootstrap_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.skip_counts(B.bootstrap_records(_raw(spark, sf_dir).drop("generated"), SOURCE, "rid"))


def bootstrap_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what is skipped before a capped selection is full."""
    judged = B.bootstrap_records(_raw(spark, sf_dir).drop("generated"), SOURCE, "rid")
    return B.skip_counts(judged, B.kept_records(judged, "official", 100))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.published_records(_raw(spark, sf_dir).drop("rejected_answer"), SOURCE, "rid")


def published_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(B.kept_records(_published(spark, sf_dir), "formal")).drop("claim_boundary", "label_source", "reference_answer_source", "split", "source", "rejected_answer", "synth_meta")


def heldout_rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = B.kept_records(_published(spark, sf_dir), "formal")
    return B.heldout_rows(kept.where("order % 2 = 0"), "order").select(F.col("order").alias("rid"), "id", "axis", "split", "character", "reference_answer", "reportability_status")


def heldout_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).withColumns({"raw_path": _pick(["a/CharacterBench/x.json", "b/RoleBench.json", "c/CharacterEval/RoleBench.json", "d.json", None]), "source": F.when(F.col("rid") % 3 == 0, "own").when(F.col("rid") % 3 == 1, "")})
    raw = raw.drop("generated", "answer", "output").withColumn("reference", F.when(F.col("rid") % 7 > 0, F.col("rejected_answer"))).drop("rejected_answer")
    return _flat(B.heldout_candidates(raw, "rid").withColumn("reason", F.col("skip_reason"))).drop("split", "axis", "profile")


def normalized_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.normalize_seeds(_raw(spark, sf_dir), SOURCE, "reward", "rid")
    return _flat(out.withColumn("id", R.numbered_id(F.col("id"), "seed", F.col("order")))).select("rid", "id", "character", "source_work", "character_cluster", "conversations", "gold_focus", "rejected_answer", "reference_answer")


def assistant_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    return raw.select("rid", B.assistant_answer(raw).alias("answer"))


def sft_chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.sft_rows(_raw(spark, sf_dir), "rid", chat=True, require_gold=True)
    kept = R.number_kept(rows.where("skip_reason is null").drop("skip_reason"), F.col("order"), "sft_chat")
    n = lambda c, k: F.length(F.col(c)[k]["content"]).cast("long")
    return kept.select(F.col("order").alias("rid"), "id", "character", "source_work", F.size("prompt").cast("long").alias("turns"), F.element_at("prompt", -1)["role"].alias("last_role"), n("completion", 0).alias("completion_length"))


def sft_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.skip_counts(B.sft_rows(_raw(spark, sf_dir), "rid", require_gold=True))


def grpo_chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy rows of records that pass the schema, the others left out beforehand."""
    rows = B.grpo_rows(_typed(spark, sf_dir).where(F.size(V.schema_errors()) == 0), "rid", chat=True)
    return rows.select(F.col("order").alias("rid"), "id", "character", F.array_join("gold_focus", ",").alias("gold_focus"), F.size("prompt").cast("long").alias("turns"), "skip_reason")


def rollout_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).drop("gold_focus", "generated").withColumn("policy_prompt", F.when(F.col("rid") % 4 == 0, "own prompt"))
    out = B.rollout_seeds(raw.withColumn("number", F.col("rid")), "SFT", "heldout")
    return out.select("id", "character", "source_work", "answer", "gold_focus_attr", F.when(F.col("policy_prompt").isNotNull(), F.col("prompt")).alias("prompt"), F.coalesce(F.size("messages"), F.lit(0)).cast("long").alias("messages"))


def merged_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _records(spark, sf_dir).select("rid", "persona", "reference_answer")
    made = seeds.where("rid % 3 = 0").select("rid", F.concat(F.lit("new "), "persona").alias("reference_answer"), F.lit("swap").alias("rejected_strategy"))
    return B.merged(seeds, made, "rid").select("rid", "persona", "reference_answer", "rejected_strategy")


_META = "struct<generator:string,prompt_id:string,lore_sources:array<string>,rejected_strategy:string,human_reviewed:boolean>"
_TYPED = """
select rid, case when rid % 19 = 0 then ' ' else id end as id, case when rid % 23 = 0 then null else persona end as character, source_work, cluster - (case when rid % 16 = 0 then 1 else 0 end) as character_cluster, profile,
  question, case when rid % 12 = 0 then 'narrator' else 'user' end as who, case when rid % 8 = 0 then 'Bogus' else f1 end as f1, f2, case when rid % 9 = 0 then null else gold_focus_attr end as gold_focus_attr, reference_answer,
  rejected_answer, case when rid % 10 = 0 then 'Elsewhere' else source end as source, case when rid % 10 = 5 then 'test' else split end as split, rid % 4 as meta
from records
"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_TYPED.replace("from records", "from {r}"), r=_records(spark, sf_dir))
    meta = F.when(F.col("meta") > 0, F.struct(F.lit("g").alias("generator"), F.when(F.col("meta") == 1, "").otherwise("p").alias("prompt_id"), F.array("source_work").alias("lore_sources"), F.when(F.col("meta") == 2, "swap").alias("rejected_strategy"), F.when(F.col("meta") != 3, F.lit(True)).alias("human_reviewed"))).cast(_META)
    turns = F.array(F.struct(F.col("who").alias("role"), F.when(F.col("rid") % 20 == 0, " ").otherwise(F.col("question")).alias("content")))
    return rows.withColumns({"synth_meta": meta, "conversations": F.when(F.col("rid") % 21 > 0, turns).otherwise(F.array().cast(R.TURN)), "gold_focus": F.when(F.col("rid") % 22 > 0, F.array("f1", "f2"))}).drop("meta", "who", "f1", "f2", "question")


def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("rid", F.posexplode(V.schema_errors()).alias("at", "error")).select("rid", F.col("at").cast("long").alias("at"), "error")


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir)
    return rows.select("rid", F.sha2(record_text([F.col("profile"), F.col("gold_focus_attr"), F.col("reference_answer")], F.col("conversations")), 256).alias("digest"))


def typed_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("rid", typed_choice(F.parse_json(_pick([a for a, _ in CHOICE_CASES]))).alias("choice"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("rid", normalize_text(_pick([a for a, _ in NORMAL_CASES])).alias("normal"))


def shown_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _pick([a for a, _, _ in REPLY_CASES])
    return _records(spark, sf_dir).select("rid", G.shown_reply(said).alias("reply"), G.shown_reply(said, True).alias("with_focus"))


def fenced_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _pick([a for a, _, _ in FENCE_CASES])
    return _records(spark, sf_dir).select("rid", F.to_json(G.fenced_json(said)).alias("object"), F.to_json(G.fenced_json(said, "array")).alias("items"))


def completion_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.parse_json(_pick([a for a, _, _ in SHAPE_CASES]))
    return _records(spark, sf_dir).select("rid", G.completion_text(value).alias("text"), F.size(G.completion_batch(value)).cast("long").alias("completions"))


def derived_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = G.parse_completion(_pick([a for a, _ in MARK_CASES]))
    return _records(spark, sf_dir).select("rid", parsed.alias("p")).select("rid", G.derived_marks(F.col("p")).alias("m")).select("rid", F.concat(*(F.col(f"m.{k}").cast("int").cast("string") for k in ("has_think", "has_focus", "has_focus_attr", "has_boxed", "has_illegal_focus", "is_well_formed"))).alias("marks"))


def legal_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = F.when(F.col("rid") % 6 == 0, F.array(F.lit("Bogus"))).otherwise(F.array("f1", F.lit("Style")))
    gold = F.when(F.col("rid") % 12 == 0, F.array().cast("array<string>")).otherwise(F.array("f2", F.lit("Memory"), F.lit("Bogus")))
    return _records(spark, sf_dir).select("rid", F.round(W.legal_overlap(mine, gold), 9).alias("overlap"))


def batch_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = F.when(F.col("rid") % 3 == 0, F.array(F.array("f1"))).when(F.col("rid") % 3 == 1, F.array(F.array("f1"), F.array("f2"))).otherwise(F.array().cast("array<array<string>>"))
    return _records(spark, sf_dir).select("rid", F.array_join(W.gold_labels_at(lists, F.lit(1), F.lit(2)), ",").alias("gold"))


def record_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("rid", record_like(F.split(_pick([a for a, _ in KEY_CASES]), ",")).alias("record"))


def local_only_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [c for *c, _ in LOCAL_CASES]
    return _records(spark, sf_dir).select("rid", K.local_only(*(_pick([c[k] for c in cases]) for k in range(4))).alias("local"))


def split_table_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    config = records.where("turn < 4").select("split", F.when(F.col("rid") % 97 == 0, "三月七").otherwise(F.col("persona")).alias("character"))
    works = records.groupBy(F.col("persona").alias("character")).agg(F.min("source_work").alias("source_work"))
    own = records.select(F.col("persona").alias("character"), "source_work", F.col("rid").alias("order"))
    return K.split_table_issues(config, works, own)


def gold_gate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _typed(spark, sf_dir).drop("rid").withColumns({"path": F.lit("/x/work/data/hsr/gold_template.jsonl"), "profile": F.when(F.col("source_work") == "w3", "todo: card").otherwise(F.col("profile"))})
    return K.gold_gate(rows).groupBy("code", "field").agg(F.count("*").alias("n"))


def batch_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a whole batch but for those of single records and of near duplicates, which have queries of their own."""
    rows = _typed(spark, sf_dir).withColumn("id", F.when(F.col("rid") % 50 == 1, "twice").otherwise(F.col("id")))
    found = stored(K.batch_issues(rows, "rid", check_near=False), "issues").where(F.col("code").isin("schema.duplicate_id", "leakage.character_record_split_overlap", "leakage.source_work_record_split_overlap"))
    return found.groupBy("code", "field").agg(F.count("*").alias("n"))


def batch_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a whole batch, near duplicates between reward and held-out records included; codes of single records have queries of their own."""
    rows = _typed(spark, sf_dir).withColumn("id", F.when(F.col("rid") % 50 == 1, "twice").otherwise(F.col("id")))
    report = K.batch_report(rows, "rid")
    return report.where(F.col("code").isin("schema.duplicate_id", "leakage.character_record_split_overlap", "leakage.source_work_record_split_overlap", "leakage.cross_split_near_duplicate"))


_RAW_CASES = [
    (0, None, None, ["schema.record_type|<record>"]), (1, "profile", None, ["schema.missing|profile"]), (2, "character_cluster", '"x"', ["schema.character_cluster|character_cluster"]), (3, "rejected_answer", "5", ["schema.rejected_answer|rejected_answer"]),
    (4, "synth_meta", '"s"', ["schema.synth_meta|synth_meta"]), (5, "conversations", '[1, {"role": "user", "content": "x"}]', ["schema.conversation_turn|conversations[0]"]), (6, "gold_focus", '["Style", 3, "Style"]', ["label.type|gold_focus[1]", "label.duplicate|gold_focus[2]"]),
    (7, "synth_meta", '{"generator": "g", "prompt_id": "p", "lore_sources": "x"}', ["provenance.lore_sources|synth_meta.lore_sources"]), (8, "id", "7", ["schema.non_empty_string|id"]), (9, "conversations", "{}", ["schema.conversations|conversations"]),
    (10, "gold_focus", None, ["schema.missing|gold_focus", "label.gold_focus|gold_focus"]), (11, "character_cluster", "true", []), (12, "synth_meta", '{"generator": 1, "prompt_id": "p"}', ["provenance.synth_meta_field_missing|synth_meta.generator"]), (13, "conversations", '[{"role": 1, "content": null}]', ["schema.conversation_role|conversations[0].role", "schema.conversation_content|conversations[0].content"]),
]
_RAW_CODES = ["schema.record_type", "schema.missing", "schema.character_cluster", "schema.rejected_answer", "schema.synth_meta", "schema.conversation_turn", "schema.conversation_role", "schema.conversation_content", "schema.conversations", "label.type", "label.duplicate", "label.gold_focus", "provenance.lore_sources", "provenance.synth_meta_field_missing", "schema.non_empty_string"]


def raw_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of JSON records whose fields are missing or of other types, each in one way by its number."""
    records = _records(spark, sf_dir).where("trim(id) <> '' and trim(reference_answer) <> '' and trim(question) <> ''")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    parts = {"id": quoted("id"), "character": quoted("persona"), "source_work": quoted("source_work"), "character_cluster": F.lit("1"), "profile": quoted("profile"), "conversations": F.concat(F.lit('[{"role": "user", "content": '), quoted("question"), F.lit("}]")), "gold_focus": F.lit('["Style"]'), "gold_focus_attr": quoted("gold_focus_attr"), "reference_answer": quoted("reference_answer"), "rejected_answer": F.lit("null"), "source": F.lit('"RoleBench"'), "split": F.lit('"sft"'), "synth_meta": F.lit("null")}
    kind = F.col("rid") % len(_RAW_CASES)
    for k, field, value, _ in _RAW_CASES:
        if field:
            parts[field] = F.when(kind == k, F.lit(value).cast("string")).otherwise(parts[field])
    written = [F.when(v.isNotNull(), F.concat(F.lit(f'"{name}": '), v)) for name, v in parts.items()]
    body = F.when(kind == 0, F.lit("[1]")).otherwise(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*written)), ", "), F.lit("}")))
    found = raw_record_issues(records.select("rid", F.parse_json(body).alias("record")), "rid", "record").select("rid", F.inline_outer("issues"))
    return found.where(F.col("code").isin(_RAW_CODES))


def ledger_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _records(spark, sf_dir).select("rid", F.col("persona").alias("source_id"), F.lit("MIT").alias("license"), F.lit(2).alias("file_count"))
    return K.ledger_entry(entries, "c5", "rid")


def gold_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.all_scored(_records(spark, sf_dir).select(F.when(F.col("rid") % 7 == 0, "missing_gold").otherwise("ok").alias("status"), F.when(F.col("rid") % 7 > 0, F.lit(1.0)).alias("score")))


def dry_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select("rid", "profile", F.col("question").alias("dialogue"), F.col("reference_answer").alias("response"))
    return K.model_scores(rows, None, lambda p, d, r: F.concat(p, F.lit("\n"), d, F.lit("\n"), r)).select("rid", "scoring.score", "scoring.status")


def character_split_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir).withColumn("character", F.when(F.col("rid") % 97 == 0, "三月七").otherwise(F.col("persona")))
    table, _ = P.character_split(records, {s: 1.0 for s in V.SPLITS}, "rid", V.SPLITS, V.LOCAL_ONLY)
    return table


def character_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir).withColumn("character", F.col("persona"))
    return P.character_split(records, {s: 1.0 for s in V.SPLITS}, "rid", V.SPLITS, V.LOCAL_ONLY)[1]


def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    old, new = records.groupBy("persona").agg(F.min("source_work").alias("work")), records.where("turn = 1").groupBy("persona").agg(F.max("source_work").alias("work"))
    return P.merged_map(old, new, "persona")


def key_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return P.only_keys(records.select("rid", "persona"), records.where("turn = 3").select("persona").distinct(), "persona")


def doubled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.doubled_entries(_records(spark, sf_dir).where("conv_id < 60"), "split", "persona")


_MCQ_RAW = {"rid": "rid", "question": "question", "A": "a_text", "b": "b_text", "option_c": "c_text", "choice_d": "d_text", "label": "target"}


def _mcq_rows(rows: DataFrame) -> DataFrame:
    choices = F.array_join(F.transform(F.array_sort(F.map_entries("choices")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select(F.col("order").alias("rid"), "id", "axis", "split", "question", choices.alias("choices"), F.when(F.col("skip_reason").isNull(), F.col("answer")).alias("answer"), F.when(F.col("skip_reason").isNull(), F.col("raw_answer")).alias("raw_answer"), "skip_reason")


def mcq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "mcq")
    raw = rows.select(*(F.col(c).alias(n) for n, c in _MCQ_RAW.items()), F.when(F.col("rid") % 4 == 0, "q1").alias("qid"))
    return _mcq_rows(B.mcq_records(raw, "ceval", "w4_ceval", "rid"))


def mcq_records_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices as a list, with digits from 0; the others as a map."""
    rows = view(spark, sf_dir, "mcq")
    raw = rows.select("rid", "question", F.when(F.col("rid") % 2 == 0, F.array("a_text", "b_text", F.lit(" "), "c_text")).alias("options"), F.when(F.col("rid") % 2 == 1, F.create_map(F.lit("A"), "a_text", F.lit("b"), "b_text", F.lit("x"), "c_text")).alias("choices"), (F.col("rid") % 5).cast("string").alias("answer"))
    return _mcq_rows(B.mcq_records(raw, "social", "w4_social", "rid"))


QUERIES = {
    f.__name__: f
    for f in (
        bootstrap_records, bootstrap_skips, bootstrap_capped, published_records, heldout_rekeyed, heldout_candidates, normalized_seeds, assistant_answers, sft_chat_rows, sft_skips, grpo_chat_rows, rollout_seeds, merged_synthesis,
        schema_errors, record_texts, typed_choices, normal_forms, shown_replies, fenced_objects, completion_shapes, derived_marks, legal_overlap, batch_gold, record_shapes, local_only_records, split_table_issues, gold_gate_issues,
        batch_issue_counts, batch_verdict, raw_issues, ledger_lookup, gold_required, dry_model_scores, character_split_existing, character_works, map_merge, key_semi_join, doubled_entries, mcq_records, mcq_records_listed,
    )
}

CHOICE_CASES = [("2", "B"), ("true", None), ("2.0", "B"), ("2.5", None), ('"b"', "B"), ('["x", "C"]', "C"), ('{"answer": 3}', "C"), ("null", None), ("0", None), ('{"label": "D", "other": 1}', "D"), ('"答案是C"', "C"), ("[true, 4]", "D"), ('"Ｂ"', "B"), ("[]", None), ('"none"', None)]
NORMAL_CASES = [("ＡＢＣ１", "abc1"), ("①②", "12"), ("ﬁne ﬂow", "fineflow"), ("Straße, GROẞ", "strassegross"), ("İx", "i̇x"), ("K Å Ω", "kåω"), ("a b c", "abc"), ("½ cup", "12cup"), ("、。「你好」！", "你好"), ("É é É", "ééé"), ("ｶﾞ", "ガ"), ("x²", "x2"), ("", ""), ("...", ""), ("ſo", "so")]
REPLY_CASES = [("a \\boxed{ b } c", "b", "b"), ("  plain ", "plain", "plain"), ("<focus> Style </focus> \\boxed{x{y}z}", "x{y", "x{y\n\n_（关注点 focus: Style）_"), ("", "", ""), ("<FOCUS>a\nb</FOCUS> t", "<FOCUS>a\nb</FOCUS> t", "<FOCUS>a\nb</FOCUS> t\n\n_（关注点 focus: a\nb）_")]
FENCE_CASES = [('```json\n{"a":1}\n```', '{"a":1}', None), ('say {"a":{"b":2}} so', '{"a":{"b":2}}', None), ("no json", None, None), ("[1,2]", None, "[1,2]"), ('```\n[{"a":1}]\n```', None, '[{"a":1}]'), ("{broken", None, None), ("", None, None)]
SHAPE_CASES = [('"plain"', "plain", 1), ('{"content":"c"}', "c", 1), ('{"text":"t","generated_text":"g"}', "t", 1), ('["a","","b"]', "a\nb", 3), ('[{"role":"assistant","content":"x"},{"role":"assistant","content":"y"}]', "x\ny", 1), ("null", "", 1), ("12", "12", 1), ("[]", "", 0)]
MARK_CASES = [("<think>a<focus>Style</focus><focus_attr>b</focus_attr></think>\\boxed{c}", "111101"), ("<think>a<focus>Bogus</focus><focus_attr>b</focus_attr></think>\\boxed{c}", "101110"), ("plain", "000000"), ("<think><focus>Style</focus></think>", "110000"), ("\\boxed{c}", "000100"), ("<think><focus>Style, Bogus</focus><focus_attr>x</focus_attr></think>\\boxed{c}", "111110")]
KEY_CASES = [("question,A", True), ("question", False), ("role,input", True), ("name,label,x", True), ("character_name,character_profile,dialogue", True), ("character_name,dialogue", False), ("choices,target", True), ("choices,role", False), ("x", False)]
LOCAL_CASES = [("三月七", "RoleBench", "a", "w", True), ("c", "HSR-synth", "a", "w", True), ("c", "RoleBench", "hsr_1", "w", True), ("c", "RoleBench", "a", "My HSR book", True), ("c", None, "a", "崩坏：星穹铁道", True), ("c", "RoleBench", "a", "w", False), (None, None, None, None, False)]

_NAMED = f"""raw as ({_RAW}), b0 as (select *, coalesce(nullif({strip('role')}, ''), nullif({strip('name')}, '')) as character, nullif({strip('question')}, '') as q, case when rid % 3 = 1 and rid % 17 = 0 then 'narrator' else 'user' end as speaker from raw),
b1 as (select *, coalesce(nullif({strip('work')}, ''), concat('{SOURCE}/', character)) as w from b0),
b as (select *, case when q is null then '' else concat(speaker, '=', length(q)) end as turns, coalesce(nullif({strip('persona')}, ''), concat(character, '角色卡：来自', w, '{R.PROFILE_TAIL}')) as card, case when cluster_ = 0 then -1 else cluster_ end as cl,
  case when rid % 8 > 0 then concat(f1, ',', f2) else 'Style,Engagement' end as focus, coalesce(nullif({strip('gold_focus_attr')}, ''), concat('保持', character, '的身份、语气和互动推进感。')) as attr, nullif({strip("coalesce(rejected_answer, '')")}, '') as rejected from (select *, character_cluster as cluster_ from b1))"""
_BAD = "((rid % 3 = 1 and rid % 17 = 0) or (rid % 8 > 0 and (f1 = 'Bogus' or f1 = f2)) or cl < -1 or coalesce(rejected = ref, false))"
_BOOT = f"""with {ctes('records')}, {_NAMED}, r as (select *, coalesce(nullif({strip('answer')}, ''), nullif({strip('output')}, '')) as ref from b), j as (select *, case when character is null or q is null or ref is null then 'unusable_row' when {_BAD} then 'schema_error' end as reason from r)"""
_PUB = f"""with {ctes('records')}, {_NAMED}, r as (select * replace (null::varchar as rejected), coalesce(nullif({strip('answer')}, ''), nullif({strip('output')}, ''), {strip("concat('gen ', said)")}) as ref from b), j as (select *, case when character is null or q is null or ref is null then 'unusable_row' when {_BAD} then 'schema_error' end as reason from r),
k as (select *, row_number() over (order by rid) - 1 as number from j where reason is null)"""
_ID = lambda prefix, n="number": f"coalesce(nullif(id, ''), format('{prefix}_{{:06d}}', {n}))"
_FIELDS = "character, w as source_work, cl as character_cluster, card as profile, turns as conversations, focus as gold_focus, attr as gold_focus_attr, ref as reference_answer"
_PATHS = _case(["CharacterBench", "RoleBench", "CharacterEval", "heldout_roleplay", "heldout_roleplay"])
_WHOLE_PATHS = _case(["a/CharacterBench/x.json", "b/RoleBench.json", "c/CharacterEval/RoleBench.json", "d.json", ""])
_GOOD_TYPED = f"with {ctes('records')}, t as ({_TYPED})"
_SAY = [
    (f"{strip('id')} = ''", "'id must be a non-empty string'"), ("character is null", "'character must be a non-empty string'"), ("gold_focus_attr is null", "'gold_focus_attr must be a non-empty string'"), (f"{strip('reference_answer')} = ''", "'reference_answer must be a non-empty string'"),
    ("character_cluster < -1", "'character_cluster must be -1 or a non-negative integer'"), ("rid % 21 = 0", "'conversations must contain at least one turn'"), ("rid % 21 > 0 and rid % 12 = 0", "'conversations[0].role must be one of (''user'', ''assistant'')'"), (f"rid % 21 > 0 and (rid % 20 = 0 or {strip('question')} = '')", "'conversations[0].content must be non-empty'"),
    ("rid % 22 = 0", "'gold_focus must contain at least one label'"), ("rid % 22 > 0 and f1 = 'Bogus'", "'gold_focus contains illegal labels: [''Bogus'']'"), ("rid % 22 > 0 and f1 = f2", "'gold_focus must not contain duplicate labels'"),
    ("rid % 10 = 0", "'source must be one of (''CharacterBench'', ''RoleBench'', ''DeepSeek-synth'', ''HSR-canon'', ''HSR-synth'')'"), ("split = 'test'", "'split must be one of (''sft'', ''reward'', ''eval_heldout'')'"), ("source in ('DeepSeek-synth', 'HSR-synth') and meta = 0", "'synth_meta is required for synthetic sources'"),
    ("meta = 1", "'synth_meta.prompt_id must be a non-empty string'"), ("meta = 3", "'synth_meta.human_reviewed must be a boolean'"), (f"{strip('rejected_answer')} = ''", "'rejected_answer must be non-empty when present'"), ("rejected_answer = reference_answer", "'rejected_answer must differ from reference_answer'"),
    ("rejected_answer is not null and meta = 0", "'synth_meta is required when rejected_answer is present'"), ("rejected_answer is not null and meta in (1, 3)", "'synth_meta.rejected_strategy is required when rejected_answer is present'"),
]
_ERRORS = "list_filter([" + ", ".join(f"case when {rule} then {words} end" for rule, words in _SAY) + "], lambda x: x is not null)"
_POS = "list_position(['sft', 'reward', 'eval_heldout'], {s})"


def _shared(table: str, key: str, code: str) -> str:
    return f"select '{code}' as code, concat(a.split, '/', b.split) as field, string_agg(distinct a.{key}, ', ' order by a.{key}) as detail from {table} a join {table} b on a.{key} = b.{key} and {_POS.format(s='a.split')} < {_POS.format(s='b.split')} group by a.split, b.split"


_ANSWERED = "case when token in ('A', 'B', 'C', 'D') then token when token in ('1', '2', '3', '4') then chr(64 + token::int) else coalesce(by_text, '') end"
_CHOSEN = ["a_text", "b_text", "c_text", "d_text"]

SQL = {
    "bootstrap_records": f"{_BOOT} select rid, number, {_ID('official')} as id, {_FIELDS}, rejected as rejected_answer, case when rejected is null then '' else concat('source_reset_builder/official_reset_deterministic_bootstrap_v1/', w, '/provided_degraded_answer') end as synth_meta from (select *, row_number() over (order by rid) - 1 as number from j where reason is null)",
    "bootstrap_skips": f"{_BOOT} select reason as skip_reason, count(*) as n from j where reason is not null group by 1",
    "bootstrap_capped": f"{_BOOT} select reason as skip_reason, count(*) as n from (select *, count(*) filter (reason is null) over (order by rid) as kept from j) where reason is not null and kept < 100 group by 1",
    "published_records": f"{_PUB} select rid, number, {_ID('formal')} as id, {_FIELDS} from k",
    "heldout_rekeyed": f"{_PUB} select rid, format('formal_rolebench_heldout_{{:06d}}', row_number() over (order by rid) - 1) as id, 'heldout' as axis, 'eval_heldout' as split, character, ref as reference_answer, 'reportable' as reportability_status from k where rid % 2 = 0",
    "heldout_candidates": f"""with {ctes('records')}, {_NAMED}, r as (select *, case when rid % 7 > 0 then nullif({strip("coalesce(rejected_answer, '')")}, '') end as ref, {_PATHS} as label from b)
select rid, format('w4_heldout_{{:06d}}', rid) as id, case when rid % 3 = 0 then 'own' else label end as source, character, coalesce(nullif({strip('work')}, ''), label || '/' || character) as source_work, id as raw_id, {_WHOLE_PATHS} as raw_path, turns as conversations, ref as reference_answer,
  case when ref is not null then focus end as gold_focus, case when ref is not null then coalesce(nullif(gold_focus_attr, ''), concat('保持', character, '的身份、语气和互动推进感。')) end as gold_focus_attr, case when character is null or q is null then 'unusable_heldout' end as reason from r""",
    "normalized_seeds": f"""with {ctes('records')}, {_NAMED} select rid, {_ID('seed', 'rid')} as id, coalesce(character, 'unknown') as character, coalesce(nullif({strip('work')}, ''), concat('{SOURCE}/', coalesce(character, 'unknown'))) as source_work, cl as character_cluster, turns as conversations, case when rid % 8 > 0 then focus end as gold_focus, rejected_answer,
  coalesce(nullif({strip('answer')}, ''), concat({strip("concat('gen ', said)")}, chr(10), 'later')) as reference_answer from b""",
    "assistant_answers": f"with {ctes('records')}, raw as ({_RAW}) select rid, coalesce(nullif({strip('answer')}, ''), {strip("concat('gen ', said)")}) as answer from raw",
    "sft_chat_rows": f"""with {ctes('records')}, {_NAMED}, g as (select *, coalesce(nullif({strip('answer')}, ''), {strip("concat('gen ', said)")}) as ans, case when f1 = 'Bogus' then f2 when f1 = f2 then f1 else concat(f1, ', ', f2) end as labels from b where rid % 8 > 0 and {strip('gold_focus_attr')} <> ''),
k as (select *, row_number() over (order by rid) - 1 as number from g)
select rid, {_ID('sft_chat')} as id, coalesce(character, 'unknown') as character, coalesce(nullif({strip('work')}, ''), concat('RoleBench/', coalesce(character, 'unknown'))) as source_work, 2 as turns, case when q is null then 'user' when speaker = 'narrator' then 'assistant' else 'user' end as last_role,
  length(concat('{R.THINK_LEAD}<focus>', labels, '</focus><focus_attr>', {strip('gold_focus_attr')}, '</focus_attr></think>', chr(10), chr(92), 'boxed{{', ans, '}}')) as completion_length from k""",
    "sft_skips": f"with {ctes('records')}, raw as ({_RAW}) select 'no_gold' as skip_reason, count(*) as n from raw where rid % 8 = 0 or {strip('gold_focus_attr')} = ''",
    "grpo_chat_rows": f"{_GOOD_TYPED} select rid, id, character, concat(f1, ',', f2) as gold_focus, 2 as turns, null::varchar as skip_reason from t where len({_ERRORS}) = 0",
    "rollout_seeds": f"""with {ctes('records')}, raw as ({_RAW}) select coalesce(nullif(id, ''), 'heldout_SFT_unknown') as id, coalesce(nullif(role, ''), 'unknown') as character, coalesce(nullif(work, ''), 'unknown') as source_work, answer, gold_focus_attr, case when rid % 4 = 0 then 'own prompt' end as prompt, case when rid % 3 = 1 then 2 else 0 end as messages from raw""",
    "merged_synthesis": f"with {ctes('records')} select rid, persona, case when rid % 3 = 0 then concat('new ', persona) else reference_answer end as reference_answer, case when rid % 3 = 0 then 'swap' end as rejected_strategy from records",
    "schema_errors": f"{_GOOD_TYPED}, e as (select rid, {_ERRORS} as errors from t) select rid, unnest(range(len(errors))) as at, unnest(errors) as error from e",
    "record_texts": f"{_GOOD_TYPED} select rid, sha256(concat_ws(chr(10), profile, gold_focus_attr, reference_answer, case when rid % 21 > 0 then who end, case when rid % 21 > 0 then case when rid % 20 = 0 then ' ' else question end end)) as digest from t",
    "typed_choices": f"with {ctes('records')} select rid, {_case([b for _, b in CHOICE_CASES])} as choice from records",
    "normal_forms": f"with {ctes('records')} select rid, {_case([b for _, b in NORMAL_CASES])} as normal from records",
    "shown_replies": f"with {ctes('records')} select rid, {_case([b for _, b, _ in REPLY_CASES])} as reply, {_case([c for _, _, c in REPLY_CASES])} as with_focus from records",
    "fenced_objects": f"with {ctes('records')} select rid, {_case([b for _, b, _ in FENCE_CASES])} as object, {_case([c for _, _, c in FENCE_CASES])} as items from records",
    "completion_shapes": f"with {ctes('records')} select rid, {_case([b for _, b, _ in SHAPE_CASES])} as text, {_case([c for _, _, c in SHAPE_CASES], 'bigint')} as completions from records",
    "derived_marks": f"with {ctes('records')} select rid, {_case([b for _, b in MARK_CASES])} as marks from records",
    "legal_overlap": f"""with {ctes('records')}, s as (select rid, case when rid % 6 = 0 then [] else list_distinct([f1, 'Style']) end as mine, case when rid % 12 = 0 then [] else list_distinct([f2, 'Memory']) end as gold from records)
select rid, round(case when len(mine) + len(gold) = 0 then 1 else len(list_intersect(mine, gold))::double / len(list_distinct(list_concat(mine, gold))) end, 9) as overlap from s""",
    "batch_gold": f"with {ctes('records')} select rid, case rid % 3 when 0 then f1 when 1 then f2 else '' end as gold from records",
    "record_shapes": f"with {ctes('records')} select rid, {_case([b for _, b in KEY_CASES], 'boolean')} as record from records",
    "local_only_records": f"with {ctes('records')} select rid, {_case([c[-1] for c in LOCAL_CASES], 'boolean')} as local from records",
    "split_table_issues": f"""with {ctes('records')}, config as (select split, case when rid % 97 = 0 then '三月七' else persona end as character from records where turn < 4), cfg as (select distinct * from config), works as (select persona as character, min(source_work) as source_work from records group by 1),
own as (select persona as character, max_by(source_work, rid) as source_work from records group by 1), c1 as (select distinct split, source_work from cfg join works using (character)), c2 as (select distinct split, source_work from cfg join own using (character))
select 'split.duplicate_character' as code, split as field, null::varchar as detail from config group by split having count(*) <> count(distinct character)
union all {_shared('cfg', 'character', 'leakage.character_split_overlap')}
union all select 'leakage.hsr_not_eval_only', split, character from cfg where character = '三月七' and split in ('sft', 'reward')
union all {_shared('c1', 'source_work', 'leakage.source_work_split_overlap')}
union all {_shared('c2', 'source_work', 'leakage.source_work_split_overlap')}""",
    "gold_gate_issues": f"""{_GOOD_TYPED}, l as (select *, coalesce(source, '') in ('HSR-canon', 'HSR-synth') as local from t),
i as (select unnest([case when meta not in (1, 2) then 'gate.human_reviewed_false|synth_meta.human_reviewed' end, case when rid % 10 = 0 then 'gate.source_invalid|source' end, case when split = 'test' then 'gate.split_invalid|split' end, case when local and split <> 'eval_heldout' then 'local_only.hsr_split|split' end,
  case when local then 'local_only.hsr_id_prefix|id' end, case when local then 'local_only.source_work_marker|source_work' end, case when source_work = 'w3' then 'gate.placeholder_marker|profile' end]) as x from l union all select 'gate.template_input|' union all select case when (select count(*) from t) < 20 then 'gate.too_few_records|' end)
select split_part(x, '|', 1) as code, nullif(split_part(x, '|', 2), '') as field, count(*) as n from i where x is not null group by 1, 2""",
    "batch_issue_counts": f"""{_GOOD_TYPED}, n as (select *, case when rid % 50 = 1 then 'twice' when {strip('id')} = '' then concat('row_', rid) else id end as key from t), s as (select * from n where split in ('sft', 'reward', 'eval_heldout'))
select * from (select 'schema.duplicate_id' as code, 'id' as field, (select count(*) from n) - (select count(distinct key) from n) as n
union all select 'leakage.character_record_split_overlap', 'character', count(*) from (select character from s where character is not null group by 1 having count(distinct split) > 1)
union all select 'leakage.source_work_record_split_overlap', 'source_work', count(*) from (select source_work from s group by 1 having count(distinct split) > 1)) where n > 0""",
    "batch_verdict": f"""{_GOOD_TYPED}, near as ({near_ctes("select rid as doc_id, split, concat_ws(chr(10), profile, gold_focus_attr, reference_answer, case when rid % 21 > 0 then who end, case when rid % 21 > 0 then case when rid % 20 = 0 then ' ' else question end end) as text from t where split in ('reward', 'eval_heldout')")}
  select count(*) as n from f join t a on a.rid = f.a_id join t b on b.rid = f.b_id where score >= 0.88 and a.split <> b.split and case when a.rid % 50 = 1 then 'twice' else a.id end <> case when b.rid % 50 = 1 then 'twice' else b.id end),
m as (select *, case when rid % 50 = 1 then 'twice' when {strip('id')} = '' then concat('row_', rid) else id end as key from t), s as (select * from m where split in ('sft', 'reward', 'eval_heldout'))
select false as ok, * from (select 'schema.duplicate_id' as code, (select count(*) from m) - (select count(distinct key) from m) as n
union all select 'leakage.character_record_split_overlap', count(*) from (select character from s where character is not null group by 1 having count(distinct split) > 1)
union all select 'leakage.source_work_record_split_overlap', count(*) from (select source_work from s group by 1 having count(distinct split) > 1)
union all select 'leakage.cross_split_near_duplicate', n from near) where n > 0""",
    "raw_issues": f"""with {ctes('records')}, r as (select rid from records where trim(id) <> '' and trim(reference_answer) <> '' and trim(question) <> ''),
x as (select rid, unnest(case rid % {len(_RAW_CASES)} {' '.join(f"when {k} then {issues or '[]::varchar[]'}" for k, _, _, issues in _RAW_CASES)} end) as x from r) select rid, split_part(x, '|', 1) as code, split_part(x, '|', 2) as field from x""",
    "ledger_lookup": f"with {ctes('records')} select min(rid) as rid, 'c5' as source_id, 'MIT' as license, 2 as file_count from records where persona = 'c5'",
    "gold_required": f"with {ctes('records')} select count(*) as rows, count(*) filter (rid % 7 = 0) as unscored, count(*) filter (rid % 7 = 0) = 0 as passed from records",
    "dry_model_scores": f"with {ctes('records')} select rid, null::double as score, 'dry_run' as status from records",
    "character_split_existing": f"with {ctes('records')} select distinct case when rid % 97 = 0 then 'eval_heldout' else split end as split, case when rid % 97 = 0 then '三月七' else persona end as character from records",
    "character_works": f"with {ctes('records')} select persona as character, max_by(source_work, rid) as source_work from records group by 1",
    "map_merge": f"with {ctes('records')}, o as (select persona, min(source_work) as work from records group by 1), n as (select persona, max(source_work) as work from records where turn = 1 group by 1) select coalesce(n.persona, o.persona) as persona, coalesce(n.work, o.work) as work from o full join n on o.persona = n.persona",
    "key_semi_join": f"with {ctes('records')} select rid, persona from records where persona in (select persona from records where turn = 3)",
    "doubled_entries": f"with {ctes('records')} select split from records where conv_id < 60 group by 1 having count(*) <> count(distinct persona)",
    "mcq_records": f"""with {ctes('mcq')}, c as (select *, {strip("coalesce(target, '')")} as t, list_filter([{', '.join(f"case when {strip(x)} <> '' then concat('{'ABCD'[k]}=', {strip(x)}) end" for k, x in enumerate(_CHOSEN))}], lambda x: x is not null) as chosen from mcq),
k as (select *, upper(regexp_replace(t, '^[()]+|[()]+$', '', 'g')) as token, list_filter(chosen, lambda x: lower(regexp_replace(x[3:], '\\s+', '', 'g')) = lower(regexp_replace(t, '\\s+', '', 'g')))[1][1] as by_text from c),
r as (select *, case when t = '' then '' else {_ANSWERED} end as answer from k)
select rid, case when rid % 4 = 0 then 'q1' else format('w4_ceval_{{:06d}}', rid) end as id, 'ceval' as axis, 'eval' as split, nullif({strip('question')}, '') as question, array_to_string(chosen, ';') as choices, case when answer <> '' and {strip('question')} <> '' then answer end as answer,
  case when answer <> '' and {strip('question')} <> '' and t <> answer then t end as raw_answer, case when answer = '' or {strip('question')} = '' then 'unusable_mcq' end as skip_reason from r""",
    "mcq_records_listed": f"""with {ctes('mcq')}, c as (select *, rid % 5 as d, case when rid % 2 = 0 then concat('A=', {strip('a_text')}, ';B=', {strip('b_text')}, ';D=', {strip('c_text')}) else concat('A=', {strip('a_text')}, ';B=', {strip('b_text')}) end as choices from mcq),
r as (select *, case when rid % 2 = 0 then (case when d < 4 then chr(65 + d::int) else 'D' end) when d between 1 and 4 then chr(64 + d::int) end as answer from c)
select rid, format('w4_social_{{:06d}}', rid) as id, 'social' as axis, 'eval' as split, nullif({strip('question')}, '') as question, choices, case when {strip('question')} <> '' then answer end as answer, case when {strip('question')} <> '' and answer is not null then d::varchar end as raw_answer, case when answer is null or {strip('question')} = '' then 'unusable_mcq' end as skip_reason from r""",
}
