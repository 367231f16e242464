"""Records: resolving aliases, normalising conversations, and deriving training and evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grammar import label_array
from ..functions.text import blank, first_nonempty, py_strip, squash
from ..storage import stored

#: The names under which a field may come, in order of preference.
ALIASES = {
    "character": ["character", "role", "name", "character_name"],
    "source_work": ["source_work", "work", "book", "movie"],
    "profile": ["profile", "persona", "description", "character_profile", "system_prompt"],
    "question": ["question", "instruction", "prompt", "query", "input"],
    "answer": ["reference_answer", "answer", "response", "generated", "output"],
}
EVAL_CHARACTER = ["character", "role", "character_name", "name"]
#: Texts of prompts and completions.
PROFILE_TAIL = "。请保持该角色身份、称谓、语气和价值观，用中文回应，不要以普通助手口吻回答。"
FORMAT_INSTRUCTION = (
    "请严格按以下格式回答。不要省略任何标签。只输出一次这个结构，\\boxed{} 后立刻结束，不要继续续写第二个 <think> 或第二个 \\boxed{}。"
    "不要输出 <|endoftext|>、Human:、user:、角色:、来源作品: 或任何新题目：\n<think>用简短中文说明角色回复时需要关注什么。"
    "<focus>从 Knowledge, Style, Worldview, Emotion, Empathetic, Engagement, Human_Like, Extension, Memory, Safety 中选择一个或多个英文标签，用逗号分隔</focus>"
    "<focus_attr>用中文写出本次回复需要体现的角色属性</focus_attr></think>\n\\boxed{最终给用户的中文角色回复}"
)
CONTRACT = (
    "请用中文扮演指定角色，保持角色身份、语气、价值观和对话上下文。输出必须是一个 assistant 回复，结构为：<think>简短说明本次角色回复关注点。"
    "<focus>从 Knowledge, Style, Worldview, Emotion, Empathetic, Engagement, Human_Like, Extension, Memory, Safety 中选择一个或多个英文标签，用逗号分隔</focus>"
    "<focus_attr>用中文写出本次回复体现的角色属性</focus_attr></think>\\boxed{最终给用户的中文角色回复}"
)
FALLBACK_HEAD, FALLBACK_NAME, FALLBACK_TAIL = "我现在只是一个普通助手，不能以", "这个角色", "的身份回答。这个问题我没有特别的看法。"
STRATEGIES, SAME_SUFFIX = ("style_flattening_fallback", "provided_degraded_answer"), "（偏离角色语气的降质版本）"
POLICY_HEAD, CARD_HEAD, WORK_HEAD, PROFILE_HEAD, DIALOGUE_HEAD = "你正在扮演一个中文角色。请只根据可见角色卡和对话上下文作答。", "角色: ", "来源作品: ", "角色卡:", "对话上下文:"
THINK_LEAD = "<think>本次回复需要先保持角色身份，再根据用户问题推进对话。"
FILLER_TURN = "请根据角色卡进行回应。"
ASSISTANT_ROLES = ["assistant", "model", "bot", "ai", "角色", "模型"]
USER_ROLES = ["user", "human", "person", "player", "用户", "玩家"]
TURN = "array<struct<role:string,content:string>>"


def resolve(df: DataFrame, names: list[str], default: Column | str | None = None) -> Column:
    """The first of the columns ``names`` that the table has and that is not blank."""
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    found = first_nonempty(*have) if have else F.lit(None).cast("string")
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def default_profile(character: Column, work: Column) -> Column:
    return F.concat(character, F.lit("角色卡：来自"), work, F.lit(PROFILE_TAIL))


def numbered_id(df_id: Column, prefix: str, number: Column) -> Column:
    return F.coalesce(F.nullif(df_id, F.lit("")), F.format_string(f"{prefix}_%06d", number))


def cluster_or_none(value: Column) -> Column:
    """Whole numbers as they are, but 0 and null become -1."""
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit(-1)).otherwise(value.cast("int"))


def normalize_turns(turns: Column, question: Column) -> Column:
    """Turns with text, roles defaulting to user; without any, the question as one turn; else empty."""
    clean = F.filter(F.transform(turns, lambda t: F.struct(F.coalesce(F.nullif(py_strip(t["role"]), F.lit("")), F.lit("user")).alias("role"), py_strip(t["content"]).alias("content"))), lambda t: F.coalesce(t["content"] != "", F.lit(False)))
    asked = F.when(~blank(question), F.array(F.struct(F.lit("user").alias("role"), py_strip(question).alias("content")))).otherwise(F.array().cast(TURN))
    return F.when(F.size(F.coalesce(clean, F.array().cast(TURN))) > 0, clean).otherwise(asked)


def user_last(turns: Column) -> Column:
    """User and assistant turns with text, up to the last user turn; null if there is none."""
    clean = F.filter(F.transform(turns, lambda t: F.struct(F.lower(py_strip(t["role"])).alias("role"), py_strip(t["content"]).alias("content"))), lambda t: t["role"].isin("user", "assistant") & (t["content"] != ""))
    last = F.array_max(F.transform(clean, lambda t, i: F.when(t["role"] == "user", i + 1)))
    return F.when(last.isNotNull(), F.slice(clean, 1, last))


def chat_role(role: Column, character: Column) -> Column:
    """Standard roles by synonym; any other speaker is the assistant."""
    r = F.lower(py_strip(F.coalesce(role, F.lit("user"))))
    own = F.lower(py_strip(F.coalesce(character, F.lit(""))))
    return F.when(r.isin(*ASSISTANT_ROLES) | ((own != "") & (r == own)), "assistant").when(r == "system", "system").when(r.isin(*USER_ROLES) | (r == ""), "user").otherwise("assistant")


def chat_messages(character: Column, work: Column, profile: Column, turns: Column) -> Column:
    """System message with card and contract, then the dialogue; a filler turn where there is none."""
    head = F.concat(F.lit(CARD_HEAD), character, F.lit(f"\n{WORK_HEAD}"), work, F.lit(f"\n{PROFILE_HEAD}\n"), profile, F.lit(f"\n\n{CONTRACT}"))
    system = F.array(F.struct(F.lit("system").alias("role"), head.alias("content")))
    said = F.filter(F.transform(turns, lambda t: F.struct(chat_role(t["role"], character).alias("role"), py_strip(t["content"]).alias("content"))), lambda t: t["content"] != "")
    filler = F.array(F.struct(F.lit("user").alias("role"), F.lit(FILLER_TURN).alias("content")))
    return F.concat(system, F.when(F.size(said) > 0, said).otherwise(filler))


def render_dialogue(turns: Column) -> Column:
    said = F.filter(turns, lambda t: ~blank(t["content"]))
    return F.array_join(F.transform(said, lambda t: F.concat(F.coalesce(F.nullif(py_strip(t["role"]), F.lit("")), F.lit("user")), F.lit(": "), py_strip(t["content"]))), "\n")


def policy_prompt(character: Column, work: Column, profile: Column, turns: Column) -> Column:
    return F.concat(F.lit(f"{POLICY_HEAD}\n\n{CARD_HEAD}"), character, F.lit(f"\n{WORK_HEAD}"), work, F.lit(f"\n{PROFILE_HEAD}\n"), profile, F.lit(f"\n\n{DIALOGUE_HEAD}\n"), render_dialogue(turns), F.lit(f"\n\n{FORMAT_INSTRUCTION}\n"))


def sft_content(focus: Column, attr: Column, character: Column, answer: Column) -> Column:
    legal = F.array_intersect(F.coalesce(focus, F.array().cast("array<string>")), label_array())
    named = F.when(F.size(legal) > 0, legal).otherwise(F.array(F.lit("Style"), F.lit("Engagement")))
    own = F.coalesce(F.nullif(py_strip(attr), F.lit("")), F.concat(F.lit("保持"), character, F.lit("的身份、语气和互动推进感。")))
    return F.concat(F.lit(f"{THINK_LEAD}<focus>"), F.array_join(named, ", "), F.lit("</focus><focus_attr>"), own, F.lit("</focus_attr></think>\n\\boxed{"), py_strip(answer), F.lit("}"))


def strip_end_tokens(text: Column) -> Column:
    once = F.regexp_replace(py_strip(text), r"\s*<\|im_end\|>$", "")
    return F.regexp_replace(once, r"\s*<\|endoftext\|>$", "")


def formatted(answer: Column, focus: Column, attr: Column, character: Column) -> Column:
    """The answer in the contract's form; left as it is, without end tokens, where it has that form."""
    done = F.contains(answer, F.lit("<think>")) & F.contains(answer, F.lit("\\boxed{"))
    return F.when(done, strip_end_tokens(answer)).otherwise(sft_content(focus, attr, character, answer))


def dpo_pairs(records: DataFrame) -> DataFrame:
    """(id, chosen, rejected, rejected_strategy) for records with a reference; a missing rejection is replaced by an off-character one."""
    chosen, given = py_strip(F.col("reference_answer")), F.nullif(py_strip(F.coalesce("rejected_answer", F.lit(""))), F.lit(""))
    fallback = F.concat(F.lit(FALLBACK_HEAD), F.coalesce(F.nullif(F.col("character"), F.lit("")), F.lit(FALLBACK_NAME)), F.lit(FALLBACK_TAIL))
    strategy = F.when(given.isNull(), STRATEGIES[0]).otherwise(F.coalesce(F.nullif(py_strip(F.col("rejected_strategy")), F.lit("")), F.lit(STRATEGIES[1])))
    paired = records.where(~blank(F.col("reference_answer"))).select(F.concat(F.lit("dpo_"), "id").alias("id"), F.col("id").alias("source_record_id"), "character", "source_work", chosen.alias("chosen"), F.coalesce(given, fallback).alias("rejected"), strategy.alias("rejected_strategy"))
    return paired.withColumn("rejected", F.when(F.col("rejected") == F.col("chosen"), F.concat("rejected", F.lit(SAME_SUFFIX))).otherwise(F.col("rejected")))


def strict_pairs(pairs: DataFrame) -> DataFrame:
    """Adds ``error``: what is wrong with a pair, or null."""
    error = F.when(blank(F.col("chosen")), "empty_chosen").when(blank(F.col("rejected")), "empty_rejected").when(squash(F.col("chosen")) == squash(F.col("rejected")), "same_texts")
    return pairs.withColumn("error", error)


def number_kept(rows: DataFrame, order: Column, prefix: str) -> DataFrame:
    """Dense numbers from 0 in the order of ``order``, and ids from them where a row has none.

    Rows are numbered in ranges of the order, which are stored, so that counting and numbering see the same ones: a
    count per range, then within it.
    """
    ranged = rows.withColumn("__key", order)
    part = stored(ranged.repartitionByRange(F.col("__key")).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = part.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    placed = part.join(F.broadcast(before), F.col("__part") == F.col("__p"))
    number = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy("__key")) - 1
    out = placed.withColumn("number", number)
    return out.withColumn("id", numbered_id(F.col("id"), prefix, F.col("number"))).drop("__key", "__part", "__p", "__n", "__before")


def fit_turns(turns: Column, budget: Column, system: bool = True) -> Column:
    """The system turn and the longest run of last turns whose characters fit the budget; null if not even the last turn does. Sums run once from the last turn back; a turn without content fits no budget."""
    lead = F.slice(turns, 1, 1) if system else F.array().cast(TURN)
    dialogue = F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0))) if system else turns
    width = lambda t: F.coalesce(F.length(t["content"]).cast("long"), F.lit(1 << 40))
    start = F.aggregate(lead, F.lit(0).cast("long"), lambda n, t: n + width(t))
    zero = F.struct(start.alias("total"), F.lit(0).alias("kept"))
    step = lambda n, t: F.struct((n["total"] + width(t)).alias("total"), (n["kept"] + F.when(n["total"] + width(t) <= budget, 1).otherwise(0)).alias("kept"))
    keep = F.aggregate(F.reverse(dialogue), zero, step, lambda n: n["kept"])
    return F.when(keep > 0, F.concat(lead, F.slice(dialogue, -F.greatest(keep, F.lit(1)), keep)))


def truncate(text: Column, limit: int = 1200) -> Column:
    cut = F.concat(F.regexp_replace(F.substring(text, 1, limit - 20), r"[\s 　]+$", ""), F.lit("\n...[truncated]"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)
