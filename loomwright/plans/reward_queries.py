"""Queries over parsed completions: grammar, contract, rewards, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import reward as R
from ..functions.grammar import LEAK_MARKERS, balanced, parse_completion, parse_strict, perfect_completion
from ..functions.text import PY_WS_RE2 as W
from .views import LABELS, ctes, view


def _rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "rollouts").withColumn("gold_focus", F.array_distinct(F.array("f1", "f2")))


def parse_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "rollouts").select("rid", parse_completion(F.col("completion")).alias("p"))
    return p.select(
        "rid", "p.think", F.array_join("p.focus_labels", ",").alias("focus_labels"), F.array_join("p.illegal_focus_labels", ",").alias("illegal_labels"), "p.focus_attr", "p.boxed_answer", F.col("p.boxed_closed").cast("int").alias("boxed_closed"),
        F.col("p.clean_tail").cast("int").alias("clean_tail"), *(F.col(f"p.{c}").cast("long").alias(c) for c in ("think_count", "focus_count", "focus_attr_count", "boxed_count")),
    )


def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_contract(_rollouts(spark, sf_dir)).select("rid", F.array_join("issues", ",").alias("issues"), F.col("valid").cast("int").alias("valid"))


def contract_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_contract(_rollouts(spark, sf_dir)).select(F.explode("issues").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def focus_overlap_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.with_contract(_rollouts(spark, sf_dir))
    return scored.select("rid", F.round(R.focus_overlap(F.col("parsed"), F.col("valid"), F.col("gold_focus")), 9).alias("f1"))


def focus_overlap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.with_contract(_rollouts(spark, sf_dir))
    return scored.select("rid", F.round(R.focus_overlap(F.col("parsed"), F.col("valid"), F.col("gold_focus"), "jaccard"), 9).alias("jaccard"))


def focus_strict_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.with_contract(_rollouts(spark, sf_dir))
    return scored.select("rid", R.strict_match(F.col("parsed"), F.col("valid"), F.col("gold_focus")).alias("strict_em"))


def chrf_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrF of each reference against the question before it: texts that differ."""
    return view(spark, sf_dir, "records").select("rid", F.round(R.chrf(F.col("question"), F.col("reference_answer")), 9).alias("chrf"))


def chrf_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "records").select("rid", F.round(R.chrf(F.col("gold_focus_attr"), F.col("reference_answer")), 9).alias("chrf"))


def format_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_contract(_rollouts(spark, sf_dir)).groupBy("arm").agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("double")).alias("passed"))


def reward_score_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.score_completions(_rollouts(spark, sf_dir))
    return scored.select("rid", *(F.round(c, 9).alias(c) for c in [*R.WEIGHTS, "score"]))


def heldout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollouts = _rollouts(spark, sf_dir).withColumn("gold_focus_attr", F.when(F.col("rid") % 6 == 0, F.lit(None)).otherwise(F.col("gold_focus_attr")))
    scored = R.score_heldout(rollouts, ["completion"], dry_run=F.col("rid") % 10 == 1)
    return scored.groupBy("arm", "status").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.round(F.avg("score"), 9).alias("mean_score"), F.sum("length_chars").cast("long").alias("chars"), F.count_if(F.col("report.status") == "pass").alias("contract_pass"))


def strict_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = view(spark, sf_dir, "records").withColumn("gold_focus", F.array("f1", "f2"))
    p = records.withColumn("p", parse_strict(perfect_completion(F.col("gold_focus"), F.col("gold_focus_attr"), F.col("reference_answer"))))
    flag = lambda c: c.cast("int")
    return p.select("rid", flag(F.col("p.well_formed")).alias("well_formed"), F.array_join("p.focus_labels", ",").alias("labels"), flag(F.col("p.focus_attr") == F.trim("gold_focus_attr")).alias("attr_same"), flag(F.col("p.boxed_answer") == F.trim("reference_answer")).alias("answer_same"))


QUERIES = {f.__name__: f for f in (parse_completions, contract_issues, contract_issue_counts, focus_overlap_f1, focus_overlap_jaccard, focus_strict_em, chrf_reference, chrf_attribute, format_reward, reward_score_rollouts, heldout_summary, strict_parse_roundtrip)}


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{W}]+|[{W}]+$', '', 'g')"


def squash(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[{W}]+', '', 'g')"


def _tag(name: str) -> str:
    return rf"(?is)<[{W}]*{name}\b[^>]*>(.*?)</[{W}]*{name}[{W}]*>"


_EDGE = r"""[ \t\r\n''"`\[\](){}<>:：.!！?？]+"""
_LEGAL = "[" + ", ".join(f"'{x}'" for x in LABELS.split(",")) + "]"
_PARSED = f"""
p0 as (select *, coalesce(completion, '') as raw from rollouts),
p1 as (select *, nullif({strip(f"regexp_extract(raw, '{_tag('think')}', 1)")}, '') as think from p0),
p2 as (select *, coalesce(think, raw) as area, regexp_extract(raw, '(?s)\\\\boxed[{W}]*\\{{(.*)$', 1) as rest, regexp_matches(raw, '\\\\boxed[{W}]*\\{{') as opened from p1),
p3 as (select *, regexp_extract_all(area, '{_tag('focus')}', 1) as bodies, opened and regexp_matches(rest, '(?s)^({balanced(3, '')})\\}}(.*)$') as closed from p2),
p4 as (select *, list_filter(list_transform(string_split_regex(array_to_string(bodies, ','), '[,，;；、/|]+|[{W}]+'), lambda t: regexp_replace(t, '^{_EDGE}|{_EDGE}$', '', 'g')), lambda t: t <> '') as tokens,
  case when closed then regexp_extract(rest, '(?s)^({balanced(3, '')})\\}}(.*)$', 1) end as content, case when closed then regexp_extract(rest, '(?s)^({balanced(3, '')})\\}}(.*)$', 2) end as tail from p3),
p5 as (select *, list_filter(tokens, lambda t, i: list_position(tokens, t) = i) as labels from p4),
p as (select *, list_filter(labels, lambda t: list_contains({_LEGAL}, t)) as legal, list_filter(labels, lambda t: not list_contains({_LEGAL}, t)) as illegal,
  nullif({strip(f"regexp_extract(area, '{_tag('focus_attr')}', 1)")}, '') as attr, nullif({strip('content')}, '') as boxed,
  coalesce(regexp_matches(tail, '^([{W}]|<\\|im_end\\|>|<pad>)*$'), false) as clean,
  len(regexp_extract_all(raw, '{_tag('think')}', 1)) as think_count, len(bodies) as focus_count, len(regexp_extract_all(area, '{_tag('focus_attr')}', 1)) as focus_attr_count,
  len(regexp_extract_all(raw, '\\\\boxed[{W}]*\\{{')) as boxed_count from p5)
"""
_LEAK = " or ".join(f"contains(raw, '{m}')" for m in LEAK_MARKERS)
_RULES = {
    "empty_completion": f"{strip('raw')} = ''", "prefix_before_think": f"{strip('raw')} <> '' and not starts_with(lower({strip('raw')}), '<think')", "missing_think": "think is null", "multi_think": "think_count > 1", "missing_focus": "len(legal) = 0",
    "multi_focus": "focus_count > 1", "illegal_focus": "len(illegal) > 0", "missing_focus_attr": "attr is null", "multi_focus_attr": "focus_attr_count > 1", "missing_boxed": "boxed is null", "multi_boxed": "boxed_count > 1",
    "malformed_boxed": "boxed_count > 0 and not closed", "text_after_first_boxed": "closed and not clean", "prompt_leakage": f"({_LEAK})",
}
_ISSUES = "list_filter([" + ", ".join(f"case when {rule} then '{code}' end" for code, rule in _RULES.items()) + "], lambda c: c is not null)"
_WITH = f"with {ctes('rollouts')}, {_PARSED}, j as (select *, {_ISSUES} as issues, case when f1 = f2 then [f1] else [f1, f2] end as gold from p), v as (select *, len(issues) = 0 as valid, len(list_intersect(legal, gold)) as shared from j)"


def _chrf(source: str) -> str:
    """CTEs that end in c(k, chrf) for ``source``, a query of (k, a, b)."""
    return f"""
t as (select k, {squash('a')} as a, {squash('b')} as b from ({source})),
o as (select k, a, b, unnest(range(1, greatest(1, least(6, greatest(length(a), length(b)))) + 1)) as n from t where a <> '' and b <> '' and a <> b),
ga as (select k, n, substr(a, i, n) as g, count(*) as m from (select *, unnest(range(1, length(a) - n + 2)) as i from o where length(a) >= n) group by all),
gb as (select k, n, substr(b, i, n) as g, count(*) as m from (select *, unnest(range(1, length(b) - n + 2)) as i from o where length(b) >= n) group by all),
s as (select ga.k, ga.n, sum(least(ga.m, gb.m)) as m from ga join gb on ga.k = gb.k and ga.n = gb.n and ga.g = gb.g group by all),
pr as (select o.k, avg(case when length(a) >= o.n and length(b) >= o.n then coalesce(m, 0) / (length(a) - o.n + 1) else 0.0 end) as p, avg(case when length(a) >= o.n and length(b) >= o.n then coalesce(m, 0) / (length(b) - o.n + 1) else 0.0 end) as r from o left join s on o.k = s.k and o.n = s.n group by o.k),
c as (select t.k, case when a = '' or b = '' then 0.0 when a = b then 1.0 when p > 0 and r > 0 then 5 * p * r / (4 * p + r) else 0.0 end::double as chrf from t left join pr on t.k = pr.k)
"""


_F1 = "case when valid and len(legal) > 0 then 2 * shared / (len(legal) + len(illegal) + len(gold)) else 0.0 end"
_SCORED = f"""
{_WITH}, x1 as (with {_chrf("select rid as k, attr as a, gold_focus_attr as b from v")} select * from c), x2 as (with {_chrf("select rid as k, boxed as a, reference_answer as b from v")} select * from c),
sc as (select v.*, {_F1} as focus, case when valid then x1.chrf else 0.0 end as attribute, case when valid then x2.chrf else 0.0 end as reference, valid::int::double as format from v join x1 on v.rid = x1.k join x2 on v.rid = x2.k)
"""
_TOTAL = "0.4::double * focus + 0.2::double * attribute + 0.2::double * reference + 0.2::double * format"
_RAW_STRICT = "concat('<think><focus>', f1, ', ', f2, '</focus><focus_attr>', gold_focus_attr, '</focus_attr></think>', chr(10), chr(92), 'boxed{', reference_answer, '}')"

SQL = {
    "parse_completions": f"{_WITH} select rid, think, array_to_string(legal, ',') as focus_labels, array_to_string(illegal, ',') as illegal_labels, attr as focus_attr, boxed as boxed_answer, closed::int as boxed_closed, clean::int as clean_tail, think_count, focus_count, focus_attr_count, boxed_count from v",
    "contract_issues": f"{_WITH} select rid, array_to_string(issues, ',') as issues, valid::int as valid from v",
    "contract_issue_counts": f"{_WITH} select code, count(*) as n from (select unnest(issues) as code from v) group by code",
    "focus_overlap_f1": f"{_WITH} select rid, round(({_F1})::double, 9) as f1 from v",
    "focus_overlap_jaccard": f"{_WITH} select rid, round((case when valid and len(legal) > 0 then shared / (len(legal) + len(gold) - shared + len(illegal)) else 0.0 end)::double, 9) as jaccard from v",
    "focus_strict_em": f"{_WITH} select rid, (valid and shared = len(legal) and shared = len(gold) and len(illegal) = 0)::int::double as strict_em from v",
    "chrf_reference": f"with {ctes('records')}, {_chrf('select rid as k, question as a, reference_answer as b from records')} select k as rid, round(chrf, 9) as chrf from c",
    "chrf_attribute": f"with {ctes('records')}, {_chrf('select rid as k, gold_focus_attr as a, reference_answer as b from records')} select k as rid, round(chrf, 9) as chrf from c",
    "format_reward": f"{_WITH} select arm, count(*) as n, sum(valid::int::double) as passed from v group by arm",
    "reward_score_rollouts": f"{_SCORED} select rid, round(focus::double, 9) as focus, round(attribute, 9) as attribute, round(reference, 9) as reference, format, round({_TOTAL}, 9) as score from sc",
    "heldout_summary": f"""{_SCORED}, h as (select *, case when {strip('raw')} = '' then 'missing_response' when rid % 10 = 1 then 'dry_run' when rid % 6 = 0 then 'missing_gold' else 'ok' end as status, {_TOTAL} as total from sc)
select arm, status, count(*) as n, count(case when status = 'ok' then total end) as scored, round(avg(case when status = 'ok' then total end), 9) as mean_score, sum(case when status <> 'missing_response' then length(raw) end)::bigint as chars, count_if(status <> 'missing_response' and valid)::bigint as contract_pass from h group by all""",
    "strict_parse_roundtrip": f"""with {ctes('records')}, q as (select *, {_RAW_STRICT} as raw from records), r as (select *, {strip(r"regexp_extract(raw, '(?s)\\boxed\{(.*?)\}', 1)")} as answer, {strip("regexp_extract(raw, '(?is)<focus_attr>(.*?)</focus_attr>', 1)")} as attr from q)
select rid, (answer <> '' and attr <> '')::int as well_formed, case when f1 = f2 then f1 else concat(f1, ',', f2) end as labels, (attr = trim(gold_focus_attr))::int as attr_same, (answer = trim(reference_answer))::int as answer_same from r""",
}
