"""Derived tables over the driver's tables, in SQL that Spark and DuckDB both read; the queries' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LABELS = "Knowledge,Style,Worldview,Emotion,Empathetic,Engagement,Human_Like,Extension,Memory,Safety"

#: One record for each assistant turn, with the turn before it as the question.
RECORDS = f"""
select r.*, concat('keeps ', substr(r.reference_answer, 1, 24)) as gold_focus_attr,
  case r.rid % 5 when 0 then null when 1 then '' when 2 then r.reference_answer else concat('bad ', reverse(substr(r.reference_answer, 1, 40))) end as rejected_answer
from (
  select a.conv_id * 100 + a.turn as rid, concat('r', a.conv_id * 100 + a.turn) as id, a.conv_id as conv_id, a.turn as turn,
    concat('c', a.conv_id % 23) as persona, concat('w', a.conv_id % 7) as source_work, cast(a.conv_id % 4 as int) - 2 as cluster,
    concat('Profile of c', a.conv_id % 23) as profile, u.text as question, a.text as reference_answer,
    split_part('{LABELS}', ',', cast((a.conv_id + a.turn) % 10 as int) + 1) as f1, split_part('{LABELS}', ',', cast((a.conv_id * 3 + 1) % 10 as int) + 1) as f2,
    split_part('CharacterBench,RoleBench,DeepSeek-synth,HSR-canon,HSR-synth', ',', cast(a.conv_id % 5 as int) + 1) as source,
    split_part('sft,reward,eval_heldout', ',', cast(a.conv_id % 3 as int) + 1) as split
  from conversations a join conversations u on u.conv_id = a.conv_id and u.turn = a.turn - 1
  where a.role = 'assistant'
) r
"""

_BOX = "concat(chr(92), 'boxed{', x.reference_answer, '}')"
_HEAD = "'<think>first the voice.<focus>', x.f1, ',', x.f2, '</focus><focus_attr>', x.gold_focus_attr, '</focus_attr></think>', chr(10)"

#: Completions of every kind the grammar tells apart, by the record's number.
ROLLOUTS = f"""
select x.rid, x.conv_id, x.persona, x.f1, x.f2, x.gold_focus_attr, x.reference_answer,
  split_part('Base,SFT,DPO,GRPO', ',', cast(x.rid % 4 as int) + 1) as arm, split_part('charactereval,heldout,socialbench', ',', cast(x.conv_id % 3 as int) + 1) as axis,
  case x.rid % 19
    when 3 then concat('<think>part<focus>', x.f1, '</focus><focus_attr>', substr(x.gold_focus_attr, 1, 15), '</focus_attr></think>', chr(10), {_BOX})
    when 4 then concat('<think>x<focus>', x.f1, '；Bogus</focus><focus_attr>a</focus_attr></think>', {_BOX})
    when 5 then concat({_HEAD}, x.reference_answer)
    when 6 then concat({_HEAD}, {_BOX}, {_BOX})
    when 7 then concat({_HEAD}, {_BOX}, ' and more')
    when 8 then concat({_HEAD}, {_BOX}, '<|im_end|> <pad>')
    when 9 then concat({_HEAD}, chr(92), 'boxed{{a {{b}} ', substr(x.reference_answer, 1, 30), '}}')
    when 10 then concat('Human: hi ', {_HEAD}, {_BOX})
    when 11 then substr(concat({_HEAD}, {_BOX}), 1, 90)
    when 12 then '  '
    when 13 then concat('<think>a</think>', {_HEAD}, {_BOX})
    when 14 then concat('< think lang="x"> b <focus>[', x.f2, '] | "', x.f1, '", ', x.f2, '</focus>< focus_attr >', x.gold_focus_attr, '</focus_attr></think >', {_BOX})
    when 15 then concat('<think><focus>', x.f1, '</focus><focus>', x.f2, '</focus><focus_attr>a</focus_attr><focus_attr>b</focus_attr></think>', {_BOX})
    when 16 then concat({_HEAD}, chr(92), 'boxed {{ }}')
    else concat({_HEAD}, chr(92), 'boxed{{', substr(x.reference_answer, 1, 20 + cast(x.rid % 40 as int)), '}}')
  end as completion
from records x
"""

#: Free-text replies to multiple-choice questions, and targets.
MCQ = """
select rid, f1, f2, question, concat('opt ', f1) as a_text, concat('opt ', f2) as b_text, 'none of these' as c_text, case when rid % 3 = 0 then '' else 'all of these' end as d_text,
  case rid % 14 when 0 then '答案是B' when 1 then '(C)' when 2 then concat(chr(92), 'boxed{D}') when 3 then '3' when 4 then '。。。' when 5 then 'AB' when 6 then 'I think so' when 7 then ''
    when 8 then 'First A, but the answer: D.' when 9 then '<answer> b </answer>' when 10 then concat('so', chr(10), 'C. because') when 11 then 'it is A or B' when 12 then 'Final answer = 2' else null end as reply,
  case rid % 9 when 0 then 'A' when 1 then '2' when 2 then 'c' when 3 then '(D)' when 4 then 'x' when 5 then '' when 6 then null when 7 then '0' else concat('OPT  ', f2) end as target
from records
"""

VIEWS = {"records": RECORDS, "rollouts": ROLLOUTS, "mcq": MCQ}


def ctes(*names: str) -> str:
    """The views as common table expressions, each after those it reads."""
    order = ["records", *(n for n in names if n != "records")]
    return ",\n".join(f"{n} as ({VIEWS[n]})" for n in order)


def _over(spark: SparkSession, sf_dir: str, names: tuple[str, ...], body: str) -> DataFrame:
    """SQL over derived tables, which stand over the conversations of ``sf_dir``; the session's own views are left alone."""
    text = f"with {ctes(*names)} {body}".replace("{", "{{").replace("}", "}}")
    text = text.replace("from conversations a join conversations u", "from {conversations} a join {conversations} u")
    return spark.sql(text, conversations=table(spark, sf_dir, "conversations"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the Parquet files of ``sf_dir``."""
    return _over(spark, sf_dir, (name,), f"select * from {name}")


def view_of(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """What a select over the derived table ``records`` gives."""
    return _over(spark, sf_dir, ("records",), f", made as ({text}) select * from made")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
