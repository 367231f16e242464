"""Queries over sets of records: validation, similarity, splits and statistics, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, normalize_text, with_normal_text
from ..operators import aggregate as A
from ..operators import gates as K
from ..operators import similarity as S
from ..operators import splits as P
from ..operators import validate as V
from .reward_queries import _LEGAL, strip
from .views import ctes, table, view, view_of

_META = "struct<generator:string,prompt_id:string,rejected_strategy:string>"
_BROKEN = """
select rid, case when rid % 11 = 0 then ' ' else id end as id, case when rid % 17 = 0 then '三月七' else persona end as character, source_work, profile, question, f1, case when rid % 8 = 0 then 'Bogus' else f2 end as f2,
  case when rid % 13 = 0 then 'Style' when rid % 13 = 1 then repeat('long ', 201) when rid % 13 = 2 then gold_focus_attr else reference_answer end as reference_answer,
  case when rid % 9 = 0 then null else gold_focus_attr end as gold_focus_attr, rejected_answer, case when rid % 10 = 0 then 'Elsewhere' else source end as source, case when rid % 10 = 5 then 'test' else split end as split
from records
"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view_of(spark, sf_dir, _BROKEN)
    turns = F.array(F.struct(F.when(F.col("rid") % 12 == 0, "narrator").otherwise("user").alias("role"), F.when(F.col("rid") % 12 == 1, " ").otherwise(F.col("question")).alias("content")))
    meta = F.when(F.col("rid") % 4 > 0, F.struct(F.lit("g").alias("generator"), F.when(F.col("rid") % 4 == 1, "").otherwise("p").alias("prompt_id"), F.when(F.col("rid") % 4 == 2, "swap").alias("rejected_strategy"))).cast(_META)
    return rows.withColumns({"gold_focus": F.array("f1", "f2"), "conversations": turns, "synth_meta": meta})


def record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.record_issues(_broken(spark, sf_dir)).select("rid", F.explode("issues").alias("x")).select("rid", "x.code", "x.field")


def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_issues(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "records").select(F.concat("persona", F.lit("-"), (F.col("rid") % 7).cast("string")).alias("key"), "rid")
    return V.duplicate_ids(rows, "key", "rid")


def split_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.split_overlaps(view(spark, sf_dir, "records"), {"persona": "leakage.character_record_split_overlap", "source_work": "leakage.source_work_record_split_overlap"})


def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = view(spark, sf_dir, "records").withColumnRenamed("persona", "character")
    config = records.where("rid % 3 = 0 and turn < 4").select("character", "split").distinct()
    return V.expected_splits(records.select("id", "character", "split"), config)


def placeholder_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "records").withColumn("profile", F.when(F.col("rid") % 7 == 0, "todo: card").otherwise(F.col("profile")))
    return V.placeholder_fields(rows, "rid", ["profile", "source_work", "gold_focus_attr"])


def gold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole gate over a batch with faults of every kind, in files of which one is a template."""
    rid, meta = F.col("rid"), F.col("synth_meta")
    rows = _broken(spark, sf_dir).withColumns(
        {
            "id": F.when((rid % 50 == 1) & (rid % 11 > 0), "twice").otherwise(F.col("id")),
            "profile": F.when(F.col("source_work") == "w3", "todo: card").otherwise(F.col("profile")),
            "synth_meta": F.when(meta.isNotNull(), meta.withField("human_reviewed", F.when(rid % 4 != 3, True))),
            "path": F.when(rid % 5 == 0, "/x/work/data/hsr/gold.jsonl").otherwise("/x/data/gold_template.jsonl"),
        }
    )
    return K.gold_report(rows.drop("question", "f1", "f2"), "rid")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("split", F.element_at(F.array(*map(F.lit, V.SPLITS)), (F.col("doc_id") % 3 + 1).cast("int")))


def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_normal_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "norm").select("doc_id", F.sha2("norm", 256).alias("digest"))


def ngram_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", normalize_text(F.col("text")).alias("norm"))
    return rows.select("item_id", F.size(char_ngrams(F.col("norm"))).cast("long").alias("n_grams"))


def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.near_duplicate_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def cross_split_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.near_duplicate_pairs(_docs(spark, sf_dir), "doc_id", "text", split="split", cross=("reward", "eval_heldout"))


def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.greedy_dedup(table(spark, sf_dir, "documents"), "doc_id", "text")


def leakage_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    seen = docs.where("doc_id % 100 = 7").select("source", "lang").where("lang <> 'en'")
    return P.not_seen(docs, seen, ["source"]).select("doc_id")


def hash_fraction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.hash_fraction(table(spark, sf_dir, "documents"), F.concat("lang", F.lit("::"), "source"), 0.34)


def capped_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.capped(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")), "l_suppkey", "ord", 3, 100).select("ord", "l_suppkey")


def ordered_reason_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return P.ordered_reasons(docs, "source", "doc_id", F.col("n_chars") > 100, F.col("lang") == "es", F.col("doc_id") % 5 != 0, 8, 120).select("doc_id", "reason")


def skip_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_reason_caps(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


def hamilton_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_distinct("source").alias("n"))
    return counts.select("lang", F.explode(P.hamilton(F.col("n"), {"sft": 0.7, "reward": 0.2, "eval_heldout": 0.1})).alias("q")).select("lang", "q.split", "q.quota")


def work_disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = view(spark, sf_dir, "records").withColumnRenamed("persona", "character")
    return P.work_disjoint_split(records, {"sft": 0.6, "reward": 0.2, "eval_heldout": 0.2}, F.col("source_work") == "w3")


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return P.remaining(orders, table(spark, sf_dir, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("v"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("v")).where("v >= 12")
    return P.upsert(old, new, "c_custkey")


_ARM = "element_at(array('Base', 'SFT', 'DPO', 'GRPO'), cast(user_id % 4 + 1 as int))"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumns({"arm": F.expr(_ARM), "axis": F.col("event_type")})
    return events.withColumn("score", F.when(F.col("event_id") % 9 == 0, None).otherwise(A.first_number(F.col("props"), ["score", "k"])))


def arm_axis_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.bucket_stats(_events(spark, sf_dir), ["Base", "SFT", "DPO", "GRPO", "Other"], ["click", "view", "none"])
    return stats.withColumn("mean", F.round("mean", 9))


def arm_axis_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.with_deltas(A.bucket_stats(_events(spark, sf_dir), ["Base", "SFT", "DPO", "GRPO"], ["click", "view"]), ["Base", "SFT"])
    return stats.select("arm", "axis", *(F.round(c, 9).alias(c.lower()) for c in ("delta_vs_Base", "delta_vs_SFT")))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return A.status_counts(events, F.coalesce(A.path_text(events["props"], "status"), F.when(F.col("score").isNotNull(), "ok").otherwise("missing_status")))


def metric_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = A.metric_slots(_events(spark, sf_dir), {"fluency": F.col("value"), "empathy": F.when(F.col("event_id") % 2 == 0, F.col("score")), "mbti": F.lit(None)})
    return slots.withColumn("mean", F.round("mean", 6))


def verdict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.verdicts(_events(spark, sf_dir), F.col("score") > 40, 32, 0.55, ["SFT", "DPO", "GRPO"]).withColumn("rate", F.round("rate", 9))


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "records").groupBy("split").agg(F.count_distinct("persona").alias("characters"), F.count_distinct("source_work").alias("works"))


def work_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = view(spark, sf_dir, "records").groupBy("source_work").agg(F.collect_set("persona").alias("c"), F.collect_set("source").alias("s"))
    return sets.select("source_work", F.array_join(F.array_sort("c"), ",").alias("characters"), F.array_join(F.array_sort("s"), ",").alias("sources"))


QUERIES = {
    f.__name__: f
    for f in (
        record_issues, issue_counts, duplicate_ids, split_invariants, split_membership, placeholder_fields, gold_gate, normalized_texts, ngram_profile, exact_dups, near_dup_pairs, cross_split_near_dups, greedy_dedup, leakage_anti_join,
        hash_fraction_split, capped_per_key, ordered_reason_caps, skip_reason_counts, hamilton_quotas, work_disjoint_split, resume_anti_join, ledger_upsert, arm_axis_stats, arm_axis_deltas, status_counts, metric_slots, verdict_gate, distinct_counts, work_groups,
    )
}

_NORM = lambda x: f"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}]', '', 'g')"
_BLANK = lambda x: f"coalesce({strip(x)}, '') = ''"
_CASES = [
    *((f"{_BLANK(f)}", "schema.non_empty_string", f"'{f}'") for f in V.TEXT_FIELDS),
    ("source not in ('CharacterBench', 'RoleBench', 'DeepSeek-synth', 'HSR-canon', 'HSR-synth')", "provenance.source_unknown", "'source'"),
    ("split not in ('sft', 'reward', 'eval_heldout')", "split.unknown", "'split'"),
    ("rid % 12 = 0", "schema.conversation_role", "'conversations[0].role'"),
    (f"rid % 12 = 1 or {_BLANK('question')}", "schema.conversation_content", "'conversations[0].content'"),
    (f"not list_contains({_LEGAL}, f1)", "label.illegal", "'gold_focus[0]'"),
    (f"not list_contains({_LEGAL}, f2)", "label.illegal", "'gold_focus[1]'"),
    ("f1 = f2", "label.duplicate", "'gold_focus[1]'"),
    (f"{_BLANK('reference_answer')}", "reference.empty", "'reference_answer'"),
    ("length(reference_answer) > 1000", "reference.too_long", "'reference_answer'"),
    (f"{_NORM('reference_answer')} = {_NORM('gold_focus_attr')}", "reference.equals_gold_attr", "'reference_answer'"),
    (f"list_contains(list_transform({_LEGAL}, lambda x: {_NORM('x')}), {_NORM('reference_answer')})", "reference.equals_focus_label", "'reference_answer'"),
    ("rid % 17 = 0", "reference.not_cjk", "'reference_answer'"),
    (f"rejected_answer is not null and {_BLANK('rejected_answer')}", "dpo.rejected_empty", "'rejected_answer'"),
    (f"{_NORM('reference_answer')} = {_NORM('rejected_answer')}", "dpo.chosen_equals_rejected", "'rejected_answer'"),
    ("rid % 17 = 0 and rejected_answer is not null", "dpo.rejected_not_cjk", "'rejected_answer'"),
    ("source in ('DeepSeek-synth', 'HSR-synth') and rid % 4 = 0", "provenance.synth_meta_missing", "'synth_meta'"),
    ("rid % 4 = 1", "provenance.synth_meta_field_missing", "'synth_meta.prompt_id'"),
    (f"not {_BLANK('rejected_answer')} and rid % 4 <> 2", "provenance.rejected_strategy_missing", "'synth_meta.rejected_strategy'"),
    ("coalesce(rejected_answer, '') = '' and rid % 4 = 2", "provenance.rejected_strategy_without_rejected", "'synth_meta.rejected_strategy'"),
    ("rid % 17 = 0 and split <> 'eval_heldout'", "leakage.hsr_not_eval_only", "'split'"),
    (f"list_contains({_LEGAL}, f1) and list_contains({_LEGAL}, f2) and gold_focus_attr is not null and {_BLANK('reference_answer')}", "parseability.round_trip_format", "'<completion>'"),
]
_ISSUE_LIST = ", ".join(f"case when {rule} then {{'code': '{code}', 'field': {field}}} end" for rule, code, field in _CASES)
_ISSUES = f"with {ctes('records')}, broken as ({_BROKEN}), i as (select rid, unnest(list_filter([{_ISSUE_LIST}], lambda x: x is not null)) as x from broken), issues as (select rid, x.code as code, x.field as field from i)"
_SPLIT = "split_part('sft,reward,eval_heldout', ',', (doc_id % 3)::int + 1)"

def near_ctes(source: str) -> str:
    """CTEs that end in f, the pairs of ``source``, a query of (doc_id, split, text), with their similarity as score."""
    return f"""
with n as materialized (select doc_id, split, {_NORM('text')} as norm from ({source})),
ch as (select doc_id, unnest(string_split(norm, '')) as c, unnest(range(length(norm))) as pos, length(norm) as len from n where norm <> ''),
gr as (select doc_id, pos, len, case when len <= 5 then c else concat(c, lead(c, 1) over w, lead(c, 2) over w, lead(c, 3) over w, lead(c, 4) over w) end as g from ch window w as (partition by doc_id order by pos)),
gl as materialized (select doc_id, list(distinct g) as grams from gr where len <= 5 or pos <= len - 5 group by doc_id),
s as materialized (select n.*, length(norm) as len, grams from n join gl on n.doc_id = gl.doc_id),
i as materialized (select doc_id, len, len(grams) as size, norm, list_sort(grams)[1:(len(grams) - ceil(0.88 * len(grams) - 1e-9) + 1)::bigint] as pre from s),
q as (select a.doc_id as a_id, b.doc_id as b_id from i a join i b on a.doc_id < b.doc_id and (a.norm = b.norm or (least(a.size, b.size) >= 0.88 * greatest(a.size, b.size) and list_has_any(a.pre, b.pre))
  or (least(a.len, b.len) >= 0.88 * greatest(a.len, b.len) and (case when a.len <= b.len then contains(b.norm, a.norm) else contains(a.norm, b.norm) end)))),
p as (select q.a_id, q.b_id, a.split as a_split, b.split as b_split, a.norm as an, b.norm as bn, a.len as al, b.len as bl, a.grams as ag, b.grams as bg from q join s a on q.a_id = a.doc_id join s b on q.b_id = b.doc_id),
c as (select *, case when an = bn then 'normalized_exact' when least(al, bl) >= 24 and (case when al <= bl then contains(bn, an) else contains(an, bn) end) then 'normalized_containment' else 'char_5gram_jaccard' end as reason from p),
k as (select *, case when reason = 'char_5gram_jaccard' then len(list_intersect(ag, bg)) else 0 end as common from c),
f as (select *, case reason when 'normalized_exact' then 1.0 when 'normalized_containment' then least(al, bl) / greatest(al, bl) else common / (len(ag) + len(bg) - common) end::double as score from k)
"""


_NEAR = near_ctes(f"select doc_id, {_SPLIT} as split, text from documents")
_FIT = "(n_chars > 100 and lang <> 'es' and doc_id % 5 <> 0)"
_REASONS = f"""with m as (select *, coalesce(sum({_FIT}::int) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as prior from documents),
r as (select doc_id, case when not n_chars > 100 then 'unusable' when prior >= 8 then 'max_per_character' when lang = 'es' then 'leakage' when doc_id % 5 = 0 then 'missing_reference' else 'kept' end as reason from m),
q as (select *, sum((reason = 'kept')::int) over (order by doc_id rows between unbounded preceding and 1 preceding) as done from r), z as (select doc_id, reason from q where coalesce(done, 0) < 120)"""
_EVENTS = "with e as (select *, split_part('Base,SFT,DPO,GRPO', ',', (user_id % 4)::int + 1) as arm, event_type as axis, case when event_id % 9 = 0 then null else try_cast(json_extract_string(props, '$.k') as double) end as score from events)"
_GRID = "g as (select * from (select unnest({arms}) as arm) cross join (select unnest({axes}) as axis)), st as (select g.arm, g.axis, count(e.event_id) as n, count(score) as scored, avg(score) as mean, min(score) as lowest, max(score) as highest from g left join e on g.arm = e.arm and g.axis = e.axis group by all)"

SQL = {
    "record_issues": f"{_ISSUES} select * from issues",
    "issue_counts": f"{_ISSUES} select code, count(*) as n from issues group by code",
    "duplicate_ids": f"with {ctes('records')}, k as (select concat(persona, '-', rid % 7) as key, rid from records), f as (select *, min(rid) over (partition by key) as first from k) select * from f where rid > first",
    "split_invariants": f"with {ctes('records')}, k as (select 'leakage.character_record_split_overlap' as code, persona as key, split from records union all select 'leakage.source_work_record_split_overlap', source_work, split from records) select code, key, string_agg(distinct split, '/' order by split) as splits from k group by code, key having count(distinct split) > 1",
    "split_membership": f"""with {ctes('records')}, c as (select distinct persona, split, list_position(['sft', 'reward', 'eval_heldout'], split) as k from records where rid % 3 = 0 and turn < 4), l as (select persona, max_by(split, k) as expected, count(distinct split) as n from c group by persona), j as (select r.id, r.split, l.expected, l.n from records r left join l on r.persona = l.persona)
select id, 'leakage.character_split_overlap' as code from j where n > 1 union all select id, 'split.character_missing' from j where expected is null union all select id, 'split.mismatch' from j where expected <> split""",
    "placeholder_fields": f"with {ctes('records')} select rid, 'profile' as field from records where rid % 7 = 0",
    "gold_gate": f"""{_ISSUES}, gold as (select * replace (case when rid % 50 = 1 and rid % 11 > 0 then 'twice' else id end as id, case when source_work = 'w3' then 'todo: card' else profile end as profile),
  case when rid % 12 = 0 then 'narrator' else 'user' end as who, case when rid % 12 = 1 then ' ' else question end as said, rid % 5 = 0 as local_path, rid % 17 = 0 or source in ('HSR-canon', 'HSR-synth') as local from broken),
named as (select *, case when {_BLANK('id')} then concat('row_', rid) else id end as key from gold), valid as (select * from gold where split in ('sft', 'reward', 'eval_heldout')),
own as (select unnest([case when rid % 4 in (0, 3) then 'gate.human_reviewed_false' end, case when rid % 10 = 0 then 'gate.source_invalid' end, case when split = 'test' then 'gate.split_invalid' end, case when local and source not in ('HSR-canon', 'HSR-synth') then 'local_only.hsr_source' end,
  case when local and split <> 'eval_heldout' then 'local_only.hsr_split' end, case when local then 'local_only.hsr_id_prefix' end, case when local then 'local_only.source_work_marker' end, case when local and not local_path then 'local_only.path' end]) as code from gold),
marked as (select unnest([id, character, source_work, profile, who, said, f1, f2, gold_focus_attr, reference_answer, rejected_answer, source, split]) as x from gold),
near as ({near_ctes("select rid as doc_id, split, concat_ws(chr(10), profile, gold_focus_attr, reference_answer, who, said) as text from gold where split in ('reward', 'eval_heldout')")}
  select f.* from f join named a on a.rid = f.a_id join named b on b.rid = f.b_id where score >= 0.88 and a.split <> b.split and a.key <> b.key),
every as (select code from issues union all select code from own union all select 'gate.placeholder_marker' from marked where regexp_matches(upper(x), '{'|'.join(K.MARKERS)}') union all select 'leakage.cross_split_near_duplicate' from near
  union all select 'leakage.hsr_not_eval_only' from valid where rid % 17 = 0 and split <> 'eval_heldout' union all select 'schema.duplicate_id' from (select row_number() over (partition by key order by rid) as k from named) where k > 1
  union all select 'leakage.character_record_split_overlap' from valid where not {_BLANK('character')} group by character having count(distinct split) > 1 union all select 'leakage.source_work_record_split_overlap' from valid where not {_BLANK('source_work')} group by source_work having count(distinct split) > 1
  union all select 'gate.template_input' from (select distinct local_path from gold where not local_path) union all select case when count(*) = 0 then 'gate.no_records' else 'gate.too_few_records' end from gold having count(*) < 20),
counted as (select code, count(*) as k from every where code is not null group by code)
select count(*) as n, (select count(distinct rid) from issues) as bad, count_if(rid % 4 in (0, 3))::bigint as unreviewed, (select coalesce(string_agg(concat(code, ':', k), ',' order by concat(code, ':', k)), '') from counted) as codes from gold""",
    "normalized_texts": f"select doc_id, sha256({_NORM('text')}) as digest from documents",
    "ngram_profile": f"with n as (select item_id, {_NORM('text')} as t from benchmark) select item_id, case when length(t) <= 5 then len(list_distinct(string_split(t, ''))) else len(list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5)))) end::bigint as n_grams from n",
    "exact_dups": f"with n as (select doc_id as id, {_NORM('text')} as t from documents), f as (select *, min(id) over (partition by t) as first_id from n) select first_id, id from f where t <> '' and id > first_id",
    "greedy_dedup": f"""with recursive {_NEAR.strip()[5:]},
e as (select distinct a_id as u, b_id as v from f where score >= 0.88), m as materialized (select v, row_number() over (order by v) as k, list(u) as near from e group by v),
r(k, dropped) as (select 0::bigint, []::bigint[] union all select r.k + 1, case when len(list_filter(m.near, lambda x: not list_contains(r.dropped, x))) > 0 then list_append(r.dropped, m.v) else r.dropped end from r join m on m.k = r.k + 1),
d as (select dropped from r order by k desc limit 1)
select v as id, list_min(list_filter(near, lambda x: not list_contains(dropped, x))) as kept_id from m, d where list_contains(dropped, v)""",
    "near_dup_pairs": f"{_NEAR} select a_id as left_id, b_id as right_id, round(score, 6) as similarity, reason from f where score >= 0.88",
    "cross_split_near_dups": f"{_NEAR} select case when a_split = 'reward' then a_id else b_id end as left_id, case when a_split = 'reward' then b_id else a_id end as right_id, round(score, 6) as similarity, reason from f where score >= 0.88 and ((a_split = 'reward' and b_split = 'eval_heldout') or (a_split = 'eval_heldout' and b_split = 'reward'))",
    "leakage_anti_join": "select doc_id from documents where source not in (select source from documents where doc_id % 100 = 7 and lang <> 'en')",
    "hash_fraction_split": "with k as (select distinct concat(lang, '::', source) as key from documents), r as (select key, row_number() over (order by sha256(key), key) as k, count(*) over () as n from k) select key, k <= least(greatest(1, round_even(n * 0.34::double, 0)), n - 1) as heldout from r",
    "capped_per_key": "with l as (select l_orderkey * 10 + l_linenumber as ord, l_suppkey from lineitem), r as (select *, row_number() over (partition by l_suppkey order by ord) as k from l) select ord, l_suppkey from r where k <= 3 order by ord limit 100",
    "ordered_reason_caps": f"{_REASONS} select * from z",
    "skip_reason_counts": f"{_REASONS} select reason, count(*) as n from z group by reason",
    "hamilton_quotas": """with c as (select lang, count(distinct source) as n from documents group by lang), s as (select lang, n, unnest(['sft', 'reward', 'eval_heldout']) as split, unnest([0.7::double, 0.2::double, 0.1::double]) as ratio from c),
r as (select *, floor(n * ratio)::bigint as base, n * ratio - floor(n * ratio) as rest from s), k as (select *, row_number() over (partition by lang order by rest desc, ratio desc, split desc) as k, n - sum(base) over (partition by lang) as left_over from r) select lang, split, base + (k <= left_over)::int as quota from k""",
    "resume_anti_join": "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 20)",
    "ledger_upsert": "with new as (select o_custkey as c_custkey, count(*) as v from orders group by 1 having count(*) >= 12) select c_custkey, c_nationkey::bigint as v from customer where c_custkey not in (select c_custkey from new) union all select * from new",
    "arm_axis_stats": f"{_EVENTS}, {_GRID.format(arms=['Base', 'SFT', 'DPO', 'GRPO', 'Other'], axes=['click', 'view', 'none'])} select arm, axis, n, scored, round(mean, 9) as mean, lowest, highest from st",
    "arm_axis_deltas": f"{_EVENTS}, {_GRID.format(arms=['Base', 'SFT', 'DPO', 'GRPO'], axes=['click', 'view'])} select arm, axis, round(mean - max(case when arm = 'Base' then mean end) over (partition by axis), 9) as delta_vs_base, round(mean - max(case when arm = 'SFT' then mean end) over (partition by axis), 9) as delta_vs_sft from st",
    "status_counts": f"{_EVENTS} select arm, axis, case when score is null then 'missing_status' else 'ok' end as status, count(*) as n from e group by all",
    "metric_slots": f"{_EVENTS}, m as (select arm, axis, unnest(['fluency', 'empathy', 'mbti']) as metric, unnest([value::double, case when event_id % 2 = 0 then score end, null]) as v from e) select arm, axis, metric, count(v) as with_values, round(avg(v), 6) as mean, min(v) as lowest, max(v) as highest from m group by all",
    "verdict_gate": f"{_EVENTS}, s as (select arm, count(*) as n, avg((score > 40)::int::double) as rate from e group by arm) select arm, n, round(rate, 9) as rate, case when n >= 32 and (arm = 'Base' or rate >= 0.55) then 'PASS' else 'FAIL' end as verdict from s",
    "distinct_counts": f"with {ctes('records')} select split, count(distinct persona) as characters, count(distinct source_work) as works from records group by split",
    "work_groups": f"with {ctes('records')} select source_work, string_agg(distinct persona, ',' order by persona) as characters, string_agg(distinct source, ',' order by source) as sources from records group by source_work",
}
