"""Queries over records: projections and derived training rows, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank
from ..operators import records as R
from .reward_queries import strip
from .views import ctes, table, view, view_of

_RAW = """
select rid, case when rid % 3 = 0 then '  ' when rid % 3 = 1 then persona end as character, case when rid % 2 = 0 then concat(' ', persona, ' ') end as role, case when rid % 7 = 0 then null else 'fallback' end as name,
  case when rid % 4 = 0 then source_work end as work, case when rid % 5 = 0 then profile else '' end as persona_text, question, reference_answer, case when rid % 6 = 0 then '' else id end as id, cluster
from records
"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_of(spark, sf_dir, _RAW).withColumnRenamed("persona_text", "description")


def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    character = R.resolve(raw, R.ALIASES["character"])
    return raw.select("rid", character.alias("character"), R.resolve(raw, R.ALIASES["source_work"], F.concat(F.lit("src/"), character)).alias("source_work"), R.resolve(raw, R.EVAL_CHARACTER).alias("eval_character"))


def normalize_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    raw = raw.withColumn("c", R.resolve(raw, R.ALIASES["character"], "unknown"))
    raw = raw.withColumn("w", R.resolve(raw, R.ALIASES["source_work"], F.concat(F.lit("src/"), "c")))
    return raw.select("rid", R.numbered_id(F.col("id"), "seed", F.col("rid")).alias("id"), F.col("c").alias("character"), F.col("w").alias("source_work"), R.cluster_or_none(F.col("cluster")).alias("cluster"), R.resolve(raw, R.ALIASES["profile"], R.default_profile(F.col("c"), F.col("w"))).alias("profile"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation with its turns in order; grouped by conversation, whose turns are few."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.when(F.col("turn") % 5 == 4, "  ").otherwise(F.col("text")).alias("content")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))


def _lines(turns: str) -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("="), F.length(t["content"]).cast("string"))), ";")


def normalize_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).withColumn("turns", R.normalize_turns(F.col("turns"), F.lit(None).cast("string"))).select("conv_id", _lines("turns").alias("turns"))


def trim_trailing_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).withColumn("turns", R.user_last(F.col("turns"))).where("turns is not null").select("conv_id", _lines("turns").alias("turns"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _turns(spark, sf_dir).withColumn("character", F.concat(F.lit("c"), (F.col("conv_id") % 23).cast("string")))
    messages = R.chat_messages(F.col("character"), F.lit("w"), F.lit("card"), F.transform("turns", lambda t: F.struct(F.when(t["role"] == "assistant", F.col("character")).otherwise(t["role"]).alias("role"), t["content"].alias("content"))))
    return named.withColumn("turns", messages).select("conv_id", _lines("turns").alias("messages"))


def policy_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "records")
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))
    return rows.select("rid", R.policy_prompt(F.col("persona"), F.col("source_work"), F.col("profile"), turns).alias("prompt"))


def sft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "records").where(~blank(F.col("reference_answer")))
    focus = F.when(F.col("rid") % 4 == 0, F.array(F.lit("Bogus"))).otherwise(F.array("f1", "f2"))
    attr = F.when(F.col("rid") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("gold_focus_attr"))
    return rows.select("id", R.sft_content(focus, attr, F.col("persona"), F.col("reference_answer")).alias("completion"))


def grpo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with all gold fields, numbered among those kept where they have no id."""
    rows = view(spark, sf_dir, "records").withColumn("id", F.when(F.col("rid") % 6 == 0, F.lit("")).otherwise(F.col("id"))).where((F.col("rid") % 5 != 1) & ~blank(F.col("reference_answer")) & ~blank(F.col("gold_focus_attr")))
    return R.number_kept(rows.select("id", "rid", "gold_focus_attr"), F.col("rid"), "grpo").select("rid", "id", "gold_focus_attr")


def dpo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "records").withColumnRenamed("persona", "character").withColumn("rejected_strategy", F.when(F.col("rid") % 2 == 0, "persona_swap"))
    return R.dpo_pairs(rows)


def strategy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dpo_pairs(spark, sf_dir).groupBy("rejected_strategy").agg(F.count("*").alias("n"))


def dpo_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "records").select("id", F.col("reference_answer").alias("chosen"), F.col("rejected_answer").alias("rejected"))
    return R.strict_pairs(rows).select("id", "error")


def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("chosen")
    return dpo_pairs(spark, sf_dir).groupBy("rejected_strategy").agg(F.coalesce(F.min(n), F.lit(0)).cast("long").alias("shortest"), F.coalesce(F.max(n), F.lit(0)).cast("long").alias("longest"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 9).alias("mean"))


def prompt_budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _turns(spark, sf_dir).select("conv_id", R.fit_turns(F.col("turns"), F.lit(900), system=False).alias("turns"))
    return fitted.select("conv_id", F.coalesce(F.size("turns"), F.lit(0)).cast("long").alias("kept"), _lines("turns").alias("turns"))


def truncated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "records").select("rid", R.truncate(F.col("reference_answer"), 200).alias("answer"))


QUERIES = {f.__name__: f for f in (alias_resolution, normalize_seed, normalize_conversations, trim_trailing_assistant, chat_messages, policy_prompt, sft_rows, grpo_rows, dpo_pairs, strategy_counts, dpo_errors, length_summary, prompt_budget_fit, truncated_answers)}


def _first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({strip(n)}, '')" for n in names) + ")"


_RAW_CTE = f"with {ctes('records')}, raw as ({_RAW})"
_CHARACTER, _TURNS = _first("character", "role", "name"), """t as (select conv_id, turn, role, case when turn % 5 = 4 then '  ' else text end as content from conversations)"""
_LINE = "string_agg(concat({role}, '=', length({content})), ';' order by turn)"
_STRIPPED = strip("content")
_PROMPT_HEAD = "你正在扮演一个中文角色。请只根据可见角色卡和对话上下文作答。"
_ESCAPED = lambda s: "concat('" + s.replace("'", "''").replace("\n", "', chr(10), '") + "')"
_PAIRS = f"""pairs as (select concat('dpo_', id) as id, id as source_record_id, persona as character, source_work, {strip('reference_answer')} as chosen,
  coalesce(nullif({strip("coalesce(rejected_answer, '')")}, ''), concat('我现在只是一个普通助手，不能以', persona, '的身份回答。这个问题我没有特别的看法。')) as r0,
  case when nullif({strip("coalesce(rejected_answer, '')")}, '') is null then 'style_flattening_fallback' when rid % 2 = 0 then 'persona_swap' else 'provided_degraded_answer' end as rejected_strategy from records where {strip('reference_answer')} <> '')"""

SQL = {
    "alias_resolution": f"{_RAW_CTE} select rid, {_CHARACTER} as character, coalesce({_first('work')}, concat('src/', {_CHARACTER})) as source_work, {_CHARACTER} as eval_character from raw".replace("concat('src/', coalesce", "('src/' || coalesce"),
    "normalize_seed": f"""{_RAW_CTE}, r as (select *, coalesce({_CHARACTER}, 'unknown') as c from raw), w as (select *, coalesce({_first('work')}, concat('src/', c)) as w from r)
select rid, coalesce(nullif(id, ''), format('seed_{{:06d}}', rid)) as id, c as character, w as source_work, case when cluster = 0 then -1 else cluster end as cluster, coalesce({_first('persona_text')}, concat(c, '角色卡：来自', w, '{R.PROFILE_TAIL}')) as profile from w""",
    "normalize_conversations": f"with {_TURNS} select conv_id, coalesce({_LINE.format(role='role', content=_STRIPPED)} filter ({_STRIPPED} <> ''), '') as turns from t group by conv_id",
    "trim_trailing_assistant": f"with {_TURNS}, k as (select *, max(case when role = 'user' then turn end) over (partition by conv_id) as last_user from t where {_STRIPPED} <> '' and role in ('user', 'assistant')) select conv_id, {_LINE.format(role='role', content=_STRIPPED)} as turns from k where turn <= last_user group by conv_id",
    "chat_messages": f"""with {_TURNS}, h as (select conv_id, concat('system=', length(concat('角色: ', 'c', conv_id % 23, chr(10), '来源作品: w', chr(10), '角色卡:', chr(10), 'card', chr(10), chr(10))) + {len(R.CONTRACT)}) as head from conversations group by conv_id)
select h.conv_id, concat(head, ';', coalesce({_LINE.format(role="t.role", content=_STRIPPED)} filter ({_STRIPPED} <> ''), 'user={len(R.FILLER_TURN)}')) as messages from h join t on h.conv_id = t.conv_id group by h.conv_id, head""",
    "policy_prompt": f"with {ctes('records')} select rid, concat('{_PROMPT_HEAD}', chr(10), chr(10), '角色: ', persona, chr(10), '来源作品: ', source_work, chr(10), '角色卡:', chr(10), profile, chr(10), chr(10), '对话上下文:', chr(10), 'user: ', {strip('question')}, chr(10), chr(10), {_ESCAPED(R.FORMAT_INSTRUCTION)}, chr(10)) as prompt from records",
    "sft_rows": f"""with {ctes('records')} select id, concat('{R.THINK_LEAD}<focus>', case when rid % 4 = 0 then 'Style, Engagement' when f1 = f2 then f1 else concat(f1, ', ', f2) end, '</focus><focus_attr>', case when rid % 3 = 0 then concat('保持', persona, '的身份、语气和互动推进感。') else {strip('gold_focus_attr')} end,
'</focus_attr></think>', chr(10), chr(92), 'boxed{{', {strip('reference_answer')}, '}}') as completion from records where {strip('reference_answer')} <> ''""",
    "grpo_rows": f"with {ctes('records')} select rid, case when rid % 6 = 0 then format('grpo_{{:06d}}', row_number() over (order by rid) - 1) else id end as id, gold_focus_attr from records where rid % 5 <> 1 and {strip('reference_answer')} <> ''",
    "dpo_pairs": f"with {ctes('records')}, {_PAIRS} select id, source_record_id, character, source_work, chosen, case when r0 = chosen then concat(r0, '（偏离角色语气的降质版本）') else r0 end as rejected, rejected_strategy from pairs",
    "strategy_counts": f"with {ctes('records')}, {_PAIRS} select rejected_strategy, count(*) as n from pairs group by 1",
    "dpo_errors": f"with {ctes('records')} select id, case when trim(reference_answer) = '' then 'empty_chosen' when coalesce(trim(rejected_answer), '') = '' then 'empty_rejected' when regexp_replace(reference_answer, '\\s+', '', 'g') = regexp_replace(rejected_answer, '\\s+', '', 'g') then 'same_texts' end as error from records",
    "length_summary": f"with {ctes('records')}, {_PAIRS} select rejected_strategy, min(length(chosen)) as shortest, max(length(chosen)) as longest, round(avg(length(chosen)), 9) as mean from pairs group by 1",
    "prompt_budget_fit": f"""with {_TURNS}, s as (select *, sum(length(content)) over (partition by conv_id order by turn desc) as total from t), k as (select * from s where total <= 900)
select c.conv_id, count(k.turn) as kept, string_agg(concat(k.role, '=', length(k.content)), ';' order by k.turn) filter (k.turn is not null) as turns from (select distinct conv_id from t) c left join k on c.conv_id = k.conv_id group by c.conv_id""",
    "truncated_answers": f"with {ctes('records')} select rid, case when length(reference_answer) <= 200 then reference_answer else concat(regexp_replace(substr(reference_answer, 1, 180), '\\s+$', ''), chr(10), '...[truncated]') end as answer from records",
}
