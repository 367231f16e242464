"""Queries over multiple-choice questions and replies, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mcq as M
from ..functions.text import PY_WS_RE2 as W
from .reward_queries import squash, strip
from .views import ctes, view


def _choices(df: DataFrame) -> DataFrame:
    own = M.choice_map({x: [F.col(f"{x.lower()}_text")] for x in M.LETTERS}, None)
    listed = M.choice_map({x: [F.lit(None).cast("string")] for x in M.LETTERS}, F.array("a_text", "b_text", "c_text", "d_text"))
    return df.withColumn("from_list", F.col("rid") % 2 == 0).withColumn("choices", F.when(F.col("from_list"), listed).otherwise(own))


def mcq_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(view(spark, sf_dir, "mcq")).select("rid", F.explode("choices").alias("letter", "choice"))


def mcq_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(view(spark, sf_dir, "mcq")).select("rid", M.mcq_prompt(F.col("question"), F.col("choices")).alias("prompt"))


def mcq_answer_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(view(spark, sf_dir, "mcq")).select("rid", M.answer_label(F.col("target"), F.col("choices"), F.col("from_list")).alias("label"))


def mcq_extract_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "mcq").select("rid", M.general_choice(F.col("reply")).alias("choice"))


def mcq_extract_social(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "mcq").select("rid", M.social_choice(F.col("reply")).alias("choice"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "mcq")
    reply = F.when(~F.coalesce(F.trim("reply") == "", F.lit(True)), F.col("reply"))
    target = F.when(~F.coalesce(F.trim("target") == "", F.lit(True)), F.col("target"))
    rows = rows.withColumns({"reply": reply, "target": target})
    general = M.mcq_status(F.col("reply"), M.general_choice(F.col("reply")), F.col("target"), M.general_choice(F.col("target")))
    social = M.mcq_status(F.col("reply"), M.social_choice(F.col("reply")), F.col("target"), M.social_choice(F.col("target")))
    return rows.select("rid", F.explode(F.array(F.struct(F.lit("general").alias("axis"), general.alias("s")), F.struct(F.lit("social").alias("axis"), social.alias("s")))).alias("x")).select("rid", "x.axis", "x.s.*")


def mcq_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("rid", "axis", "prediction", "target", F.col("correct").cast("int").alias("correct"), "accuracy", "status")


def mcq_accuracy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _scored(spark, sf_dir).groupBy("axis").agg(F.count("*").alias("n_rows"), F.count("accuracy").alias("scored"), F.count_if("correct").alias("correct"))
    return sums.withColumn("accuracy", F.round(F.col("correct") / F.nullif(F.col("scored"), F.lit(0)), 9))


def mcq_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("axis", "status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (mcq_choices, mcq_prompt, mcq_answer_label, mcq_extract_general, mcq_extract_social, mcq_scored, mcq_accuracy_summary, mcq_status_counts)}

_LETTERS = "['A', 'B', 'C', 'D']"
_LONG = f"with {ctes('mcq')}, l as (select *, unnest({_LETTERS}) as letter, unnest([a_text, b_text, c_text, d_text]) as raw from mcq), ch as (select rid, letter, {strip('raw')} as choice from l where {strip('raw')} <> '')"
_EDGE = r"""[''"`“”‘’()\[\]{}（）【】.。,:：;；!！?？]+"""
_GENERAL_EDGE = r"""[ \t\r\n.。,:：;；!！?？()\[\]{}<>"''`“”‘’【】]+"""


def _digit(x: str) -> str:
    return f"case when {x} in ('A', 'B', 'C', 'D') then {x} when {x} in ('1', '2', '3', '4') then substr('ABCD', {x}::int, 1) end"


def _last(text: str, pattern: str) -> str:
    return f"list_last(regexp_extract_all({text}, '{pattern}', 1))"


def _alone(text: str, pattern: str, outside: str) -> str:
    """The last match of a single character without ``outside`` on either side; RE2 can't look around, so each separator is doubled."""
    spread = f"concat(' ', regexp_replace({text}, '([^{outside}])', '\\1\\1', 'g'), ' ')"
    return f"list_last(regexp_extract_all({spread}, '[^{outside}]({pattern})[^{outside}]', 1))"


def _general(column: str) -> str:
    clean = strip(f"nfc_normalize({column})")
    token = lambda x: _digit(f"regexp_replace(upper({strip(x)}), '^{_GENERAL_EDGE}|{_GENERAL_EDGE}$', '', 'g')")
    boxed, tag, cue, _ = (p.replace("(?iu)", "(?i)") for p in M.general_patterns(W))
    found = f"coalesce({_last(clean, boxed)}, {_last(clean, tag)}, {_last(clean, cue)}, {_alone(clean, '[A-Da-d1-4]', 'A-Za-z0-9')})"
    return f"case when {clean} = '' then null else coalesce({token(clean)}, {token(found)}) end"


def _social(column: str) -> str:
    clean = strip(column)
    cue, line, _ = (p.replace("(?iu)", "(?i)") for p in M.social_patterns(W))
    line = line.replace(f"(?=[{W}]|$)", f"(?:[{W}]|$)")

    def token(x: str) -> str:
        start = f"regexp_replace({strip(x)}, '^[{W}''\"`“”‘’(\\[{{（【]+', '')"
        bare = f"upper(regexp_replace({start}, '[{W}''\"`“”‘’)\\]}}）】.。,:：;；!！?？]+$', ''))"
        return f"case when instr('ABCD', {bare}) > 0 or {bare} = '' then {bare} else {_digit(bare)} end"

    return f"case when coalesce({column}, '') = '' then null else coalesce({token(clean)}, {token(_last(clean, cue))}, {token(_last(clean, line))}, {token(_alone(clean, '[A-D]', 'A-Za-z0-9'))}) end"


_STATUS = """
n as (select rid, nullif(trim(reply), '') as reply, case when trim(target) <> '' then target end as target from mcq),
e as (select rid, 'general' as axis, reply, target as raw, {gr} as prediction, {gt} as target from n union all select rid, 'social', reply, target, {sr}, {st} from n),
s as (select *, case when target is null then case when raw is null then 'missing_target' else 'unparseable_target' end when reply is null then 'missing_prediction' when prediction is null then 'unparseable_prediction' else 'ok' end as status from e),
f as (select *, case when target is not null then coalesce(status = 'ok' and prediction = target, false) end as correct from s)
""".format(gr=_general("reply"), gt=_general("target"), sr=_social("reply"), st=_social("target"))

SQL = {
    "mcq_choices": f"{_LONG} select rid, letter, choice from ch",
    "mcq_prompt": f"""{_LONG} select mcq.rid, concat('请回答以下单项选择题。只输出一个大写字母 A/B/C/D，不要解释。', chr(10), chr(10), '题目: ', question, chr(10), string_agg(concat(letter, '. ', choice, chr(10)), '' order by letter), '答案:') as prompt from mcq join ch on mcq.rid = ch.rid group by mcq.rid, question""",
    "mcq_answer_label": f"""{_LONG}, k as (select rid, {strip("coalesce(target, '')")} as t, upper(regexp_replace({strip("coalesce(target, '')")}, '^{_EDGE}|{_EDGE}$', '', 'g')) as token from mcq),
m as (select k.rid, min(letter) as letter from k join ch on k.rid = ch.rid and lower({squash('t')}) = lower({squash('choice')}) group by k.rid)
select k.rid, case when t = '' then '' when token in ('A', 'B', 'C', 'D') then token when k.rid % 2 = 0 and token in ('0', '1', '2', '3') then substr('ABCD', token::int + 1, 1) when token in ('1', '2', '3', '4') then substr('ABCD', token::int, 1) else coalesce(m.letter, '') end as label from k left join m on k.rid = m.rid""",
    "mcq_extract_general": f"with {ctes('mcq')} select rid, {_general('reply')} as choice from mcq",
    "mcq_extract_social": f"with {ctes('mcq')} select rid, {_social('reply')} as choice from mcq",
    "mcq_scored": f"with {ctes('mcq')}, {_STATUS} select rid, axis, prediction, target, correct::int as correct, correct::int::double as accuracy, status from f",
    "mcq_accuracy_summary": f"with {ctes('mcq')}, {_STATUS} select axis, count(*) as n_rows, count(correct) as scored, count_if(correct)::bigint as correct, round(count_if(correct) / nullif(count(correct), 0), 9) as accuracy from f group by axis",
    "mcq_status_counts": f"with {ctes('mcq')}, {_STATUS} select axis, status, count(*) as n from f group by axis, status",
}
