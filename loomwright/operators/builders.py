"""Building records, evaluation rows and training rows from raw tables whose fields come under many names.

A raw table has any of the alias columns; texts may be strings or lists of strings, turns lists of structs. Rows are
judged in place (``skip_reason``), counted by one aggregation, and numbered by ranges of an order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mcq import LETTERS, answer_label, choice_map, mcq_prompt
from ..functions.text import blank, py_strip
from . import records as R
from .validate import schema_errors

#: Names of fields, labels and texts of built rows.
DEFAULT_FOCUS = ["Style", "Engagement"]
TURN_LISTS = ["conversations", "dialogue", "history"]
TURN_TEXTS = ["content", "text", "utterance"]
ANSWERS = {
    "bootstrap": ["reference_answer", "answer", "response", "generated", "output"],
    "published": ["reference_answer", "answer", "response", "output"],
    "heldout": ["reference_answer", "reference_response", "generated", "reference"],
    "seed": ["answer", "response", "generated", "reference"],
    "assistant": ["reference_answer", "answer", "response", "generated", "output", "completion"],
}
MCQ_QUESTION = ["question", "prompt", "query", "instruction", "input", "text", "sentence", "context"]
MCQ_ANSWER = ["answer", "label", "gold", "target", "correct_answer", "answerKey"]
MCQ_CHOICES = ["choices", "options", "candidates"]
ROLLOUT_TARGETS = ["policy_prompt", "question", "choices", "gold_focus", "gold_focus_attr", "reference_answer", "answer", "label", "gold", "target", "correct_answer", "split", "source"]
SEED_FIELDS = ["gold_focus", "gold_focus_attr", "reference_answer", "rejected_answer", "synth_meta"]
ATTR_HEAD, ATTR_TAIL = "保持", "的身份、语气和互动推进感。"
LABEL_SOURCE = "deterministic_bootstrap_not_human_gold"
BOOTSTRAP_META = {"generator": "source_reset_builder", "prompt_id": "official_reset_deterministic_bootstrap_v1", "rejected_strategy": "provided_degraded_answer"}
BOOTSTRAP_CLAIM = "Heuristic bootstrap labels for official trainer-path smoke. Do not report as human-gold Character-R1 quality data."
PUBLISHED_CLAIM = "Deterministic RoleBench formal-v1 labels for official reproduction. Not human-gold Character-R1 quality data."
PUBLISHED_ANSWER = "public_rolebench_field_or_first_generated"
SOURCE_BY_PATH = ["CharacterBench", "CharacterEval", "RoleBench"]
MCQ_CHARACTER, MCQ_PROFILE = "通用答题者", "通用中文答题者。请按照题目要求回答，不要扮演角色。"

_NONE = "string"
_META = "struct<generator:string,prompt_id:string,lore_sources:array<string>,rejected_strategy:string,human_reviewed:boolean>"


def _null(kind: str = _NONE) -> Column:
    return F.lit(None).cast(kind)


def text_of(raw: DataFrame, name: str) -> Column:
    """A field as stripped text: the non-empty texts of a list, a line each; null where the table has no such field."""
    if name not in raw.columns:
        return _null()
    kind = raw.schema[name].dataType
    if isinstance(kind, T.ArrayType):
        parts = F.filter(F.transform(F.col(name), lambda x: py_strip(F.coalesce(x.cast("string"), F.lit("")))), lambda x: x != "")
        return F.array_join(parts, "\n")
    return py_strip(F.col(name).cast("string"))


def first_text(raw: DataFrame, names: list[str], default: Column | None = None) -> Column:
    found = F.coalesce(*(F.nullif(text_of(raw, n), F.lit("")) for n in names))
    return found if default is None else F.coalesce(found, default)


def first_of_list(raw: DataFrame, name: str) -> Column:
    """The first item with text of a list, or the text itself."""
    if name in raw.columns and isinstance(raw.schema[name].dataType, T.ArrayType):
        return F.get(F.filter(F.transform(F.col(name), lambda x: py_strip(F.coalesce(x.cast("string"), F.lit("")))), lambda x: x != ""), F.lit(0))
    return F.nullif(text_of(raw, name), F.lit(""))


def assistant_answer(raw: DataFrame) -> Column:
    """The first answer field with text, of a list its first item with text."""
    return F.coalesce(*(first_of_list(raw, n) for n in ANSWERS["assistant"]))


def _turn(fields: list[str]):
    """A function from a turn with any of the usual fields to role and content."""

    def one(t: Column) -> Column:
        role = F.coalesce(*(F.nullif(t[f], F.lit("")) for f in ("role", "speaker") if f in fields), F.lit("user"))
        content = F.coalesce(*(F.nullif(t[f], F.lit("")) for f in TURN_TEXTS if f in fields), F.lit(""))
        return F.struct(F.coalesce(F.nullif(py_strip(role), F.lit("")), F.lit("user")).alias("role"), py_strip(content).alias("content"))

    return one


def turns_of(raw: DataFrame, question: list[str] | None = None) -> Column:
    """Turns with text of the first list of turns that isn't empty; where it leaves none, the question as a user's turn; else an empty list."""
    lists = [F.when(F.size(n) > 0, F.transform(F.col(n), _turn(raw.schema[n].dataType.elementType.names))) for n in TURN_LISTS if n in raw.columns]
    said = F.filter(F.coalesce(*lists), lambda t: t["content"] != "") if lists else _null(R.TURN)
    asked = first_text(raw, question or R.ALIASES["question"])
    alone = F.when(asked.isNotNull(), F.array(F.struct(F.lit("user").alias("role"), asked.alias("content")))).otherwise(F.array().cast(R.TURN))
    return F.when(F.coalesce(F.size(said), F.lit(0)) > 0, said).otherwise(alone)


def _focus(raw: DataFrame) -> Column:
    default = F.array(*map(F.lit, DEFAULT_FOCUS))
    return F.when(F.size("gold_focus") > 0, F.col("gold_focus")).otherwise(default) if "gold_focus" in raw.columns else default


def _attr(raw: DataFrame, character: Column) -> Column:
    return F.coalesce(F.nullif(text_of(raw, "gold_focus_attr"), F.lit("")), F.concat(F.lit(ATTR_HEAD), character, F.lit(ATTR_TAIL)))


def _cluster(raw: DataFrame) -> Column:
    return R.cluster_or_none(F.col("character_cluster")) if "character_cluster" in raw.columns else F.lit(-1)


def _base(raw: DataFrame, source: Column, order: str, aliases: list[str]) -> DataFrame:
    """Character, work, turns and profile under names of their own, beside the raw columns."""
    own = raw.withColumn("b_order", F.col(order)).withColumn("b_character", first_text(raw, aliases))
    own = own.withColumn("b_work", first_text(raw, R.ALIASES["source_work"], F.concat(source, F.lit("/"), F.col("b_character"))))
    return own.withColumns({"b_turns": turns_of(raw), "b_profile": first_text(raw, R.ALIASES["profile"], R.default_profile(F.col("b_character"), F.col("b_work"))), "b_id": text_of(raw, "id")})


def _judged(built: DataFrame, usable: Column) -> DataFrame:
    reason = F.when(~F.coalesce(usable, F.lit(False)), "unusable_row").when(F.size(schema_errors(F.when(F.col("id") == "", "-").otherwise(F.col("id")))) > 0, "schema_error")
    return built.withColumn("skip_reason", reason)


def bootstrap_records(raw: DataFrame, source: str, order: str) -> DataFrame:
    """Reward records of a raw table, with ``skip_reason`` and ``order``: unusable_row without character, turns or answer, schema_error, or null.

    Missing labels get defaults, a rejected answer brings its provenance. Ids that are missing are empty; ``kept_records`` numbers them.
    """
    own = _base(raw, F.lit(source), order, R.ALIASES["character"])
    rejected = F.nullif(text_of(raw, "rejected_answer"), F.lit(""))
    meta = F.struct(F.lit(BOOTSTRAP_META["generator"]).alias("generator"), F.lit(BOOTSTRAP_META["prompt_id"]).alias("prompt_id"), F.array("b_work").alias("lore_sources"), F.lit(BOOTSTRAP_META["rejected_strategy"]).alias("rejected_strategy"), F.lit(False).alias("human_reviewed"))
    answer = first_text(raw, ANSWERS["bootstrap"])
    built = _labelled(own, raw, answer, rejected, F.when(rejected.isNotNull(), meta).cast(_META), source, {"label_source": F.lit(LABEL_SOURCE), "claim_boundary": F.lit(BOOTSTRAP_CLAIM)})
    return _judged(built, F.col("character").isNotNull() & (F.size("conversations") > 0) & F.col("reference_answer").isNotNull())


def published_records(raw: DataFrame, source: str, order: str) -> DataFrame:
    """Like ``bootstrap_records``, of tables whose ``generated`` lists answers: its first one with text counts, after the named answers; nothing is rejected."""
    own = _base(raw, F.lit(source), order, R.ALIASES["character"])
    answer = F.coalesce(first_text(raw, ANSWERS["published"]), first_of_list(raw, "generated"))
    built = _labelled(own, raw, answer, _null(), _null(_META), source, {"label_source": F.lit(LABEL_SOURCE), "reference_answer_source": F.lit(PUBLISHED_ANSWER), "claim_boundary": F.lit(PUBLISHED_CLAIM)})
    return _judged(built, F.col("character").isNotNull() & (F.size("conversations") > 0) & F.col("reference_answer").isNotNull())


def _labelled(own: DataFrame, raw: DataFrame, answer: Column, rejected: Column, meta: Column, source: str, more: dict[str, Column]) -> DataFrame:
    columns = {
        "order": F.col("b_order"), "id": F.coalesce("b_id", F.lit("")), "character": F.col("b_character"), "source_work": F.col("b_work"), "character_cluster": _cluster(raw), "profile": F.col("b_profile"), "conversations": F.col("b_turns"), "gold_focus": _focus(raw), "gold_focus_attr": _attr(raw, F.col("b_character")),
        "reference_answer": answer, "rejected_answer": rejected, "source": F.lit(source), "split": F.lit("reward"), "synth_meta": meta,
    }
    return own.select(*(c.alias(n) for n, c in (columns | more).items()))


def kept_records(judged: DataFrame, prefix: str, max_records: int | None = None) -> DataFrame:
    """The rows without ``skip_reason``, with ids where they have none from their number among those kept; the first ``max_records``, one at least."""
    kept = R.number_kept(judged.where("skip_reason is null").drop("skip_reason"), F.col("order"), prefix)
    return kept if max_records is None else kept.where(F.col("number") < max(1, max_records))


def skip_counts(judged: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(skip_reason, n); with ``kept``, a capped selection, only of rows before the last one kept."""
    rows = judged.where("skip_reason is not null")
    if kept is not None:
        last = kept.agg(F.max("order").alias("last"))
        rows = rows.join(F.broadcast(last), F.col("order") < F.col("last"), "left_semi")
    return rows.groupBy("skip_reason").agg(F.count("*").alias("n"))


def normalize_seeds(raw: DataFrame, source: str, split: str, order: str) -> DataFrame:
    """Seeds: every row, a missing character being unknown; gold fields pass through, and a missing reference comes from the answer fields."""
    own = raw.withColumn("b_order", F.col(order)).withColumn("b_character", first_text(raw, R.ALIASES["character"], F.lit("unknown")))
    own = own.withColumn("b_work", first_text(raw, R.ALIASES["source_work"], F.concat(F.lit(f"{source}/"), "b_character")))
    out = own.select(
        F.col("b_order").alias("order"), F.coalesce(text_of(raw, "id"), F.lit("")).alias("id"), F.col("b_character").alias("character"), F.col("b_work").alias("source_work"), _cluster(raw).alias("character_cluster"),
        first_text(raw, R.ALIASES["profile"], R.default_profile(F.col("b_character"), F.col("b_work"))).alias("profile"), turns_of(raw).alias("conversations"), F.lit(source).alias("source"), F.lit(split).alias("split"),
        *(F.col(c) for c in SEED_FIELDS if c in raw.columns),
        *([] if "reference_answer" in raw.columns else [first_text(raw, ANSWERS["seed"]).alias("reference_answer")]),
    )
    return out


def heldout_rows(rows: DataFrame, order: str) -> DataFrame:
    """Records as evaluation rows, numbered anew."""
    own = rows.select(F.col(order).alias("order"), F.lit("").alias("id"), F.lit("heldout").alias("axis"), "source", F.lit("eval_heldout").alias("split"), "character", "source_work", "profile", "conversations", "gold_focus", "gold_focus_attr", "reference_answer", "label_source", "reference_answer_source", F.lit("reportable").alias("reportability_status"), F.array().cast("array<string>").alias("reportability_reasons"))
    return R.number_kept(own, F.col("order"), "formal_rolebench_heldout").drop("number")


def source_of_path(path: Column) -> Column:
    named = F.lit("heldout_roleplay")
    for source in reversed(SOURCE_BY_PATH):
        named = F.when(F.contains(F.coalesce(path, F.lit("")), F.lit(source)), source).otherwise(named)
    return named


def heldout_candidates(raw: DataFrame, index: str, path: str = "raw_path") -> DataFrame:
    """Evaluation rows of raw tables, with ``skip_reason`` unusable_heldout where character or turns are missing; labels only where there is a reference."""
    at = F.col(path) if path in raw.columns else F.lit("")
    own = _base(raw.withColumn("b_label", source_of_path(at)), F.col("b_label"), index, R.EVAL_CHARACTER)
    reference, character = first_text(raw, ANSWERS["heldout"]), F.col("b_character")
    given = F.nullif(F.col("gold_focus_attr"), F.lit("")) if "gold_focus_attr" in raw.columns else _null()
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.col("b_label")) if "source" in raw.columns else F.col("b_label")
    out = own.select(
        F.col("b_order").alias("order"), F.format_string("w4_heldout_%06d", F.col("b_order").cast("long")).alias("id"), F.lit("heldout").alias("axis"), source.alias("source"), F.lit("eval_heldout").alias("split"), character.alias("character"), F.col("b_work").alias("source_work"),
        F.coalesce("b_id", F.lit("")).alias("raw_id"), F.coalesce(at, F.lit("")).alias("raw_path"), F.col("b_profile").alias("profile"), F.col("b_turns").alias("conversations"), reference.alias("reference_answer"),
        F.when(reference.isNotNull(), _focus(raw)).alias("gold_focus"), F.when(reference.isNotNull(), F.coalesce(given, F.concat(F.lit(ATTR_HEAD), character, F.lit(ATTR_TAIL)))).alias("gold_focus_attr"),
    )
    return out.withColumn("skip_reason", F.when(F.col("character").isNull() | (F.size("conversations") == 0), "unusable_heldout"))


def mcq_choices(raw: DataFrame) -> Column:
    """Choices by letter: of columns of their own (five spellings each), else of the first map or list among the choice columns that has any."""
    spelled = {x: [text_of(raw, n) for n in (x, x.lower(), f"option_{x.lower()}", f"option{x}", f"choice_{x.lower()}") if n in raw.columns] for x in LETTERS}
    spelled = {x: own or [_null()] for x, own in spelled.items()}
    tries = [choice_map(spelled)]
    for name in MCQ_CHOICES:
        kind = raw.schema[name].dataType if name in raw.columns else None
        if isinstance(kind, T.MapType):
            tries.append(choice_map({x: [F.coalesce(F.nullif(F.try_element_at(name, F.lit(x)), F.lit("")), F.try_element_at(name, F.lit(x.lower())))] for x in LETTERS}))
        elif isinstance(kind, T.ArrayType):
            tries.append(choice_map({x: [_null()] for x in LETTERS}, F.col(name)))
    return F.coalesce(*(F.when(F.size(t) > 0, t) for t in tries), F.create_map().cast("map<string,string>"))


def has_sequence_choices(raw: DataFrame) -> Column:
    lists = [F.col(n).isNotNull() for n in MCQ_CHOICES if n in raw.columns and isinstance(raw.schema[n].dataType, T.ArrayType)]
    out = F.lit(False)
    for own in lists:
        out = out | own
    return out


def mcq_records(raw: DataFrame, axis: str, prefix: str, index: str) -> DataFrame:
    """Multiple-choice rows of raw tables, with ``skip_reason`` unusable_mcq where question, two choices or a known answer are missing."""
    given = F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in MCQ_ANSWER if n in raw.columns), _null())
    own = raw.withColumns({"b_order": F.col(index), "b_question": first_text(raw, MCQ_QUESTION), "b_choices": mcq_choices(raw), "b_given": given, "b_listed": has_sequence_choices(raw)})
    own = own.withColumn("b_answer", answer_label(F.col("b_given"), F.col("b_choices"), F.col("b_listed"))).withColumn("b_prompt", mcq_prompt(F.col("b_question"), F.col("b_choices")))
    field = lambda n: F.nullif(F.col(n).cast("string"), F.lit("")) if n in raw.columns else _null()
    said = py_strip(F.col("b_given"))
    out = own.select(
        F.col("b_order").alias("order"), F.coalesce(field("id"), field("qid"), field("question_id"), F.format_string(f"{prefix}_%06d", F.col("b_order").cast("long"))).alias("id"), F.lit(axis).alias("axis"), F.coalesce(field("source"), F.lit(axis)).alias("source"), F.coalesce(field("split"), F.lit("eval")).alias("split"),
        F.lit(MCQ_CHARACTER).alias("character"), F.lit(axis).alias("source_work"), F.lit(MCQ_PROFILE).alias("profile"), F.array(F.struct(F.lit("user").alias("role"), F.col("b_prompt").alias("content"))).alias("conversations"), F.col("b_prompt").alias("policy_prompt"), F.col("b_question").alias("question"), F.col("b_choices").alias("choices"),
        F.col("b_answer").alias("answer"), F.col("b_answer").alias("label"), F.when((said != "") & (said != F.col("b_answer")), said).alias("raw_answer"), F.lit("reportable").alias("reportability_status"),
    )
    return out.withColumn("skip_reason", F.when(F.col("question").isNull() | (F.size("choices") < 2) | (F.col("answer") == ""), "unusable_mcq"))


def _prompt_fields(raw: DataFrame) -> dict[str, Column]:
    character = first_text(raw, R.ALIASES["character"], F.lit("unknown"))
    work = first_text(raw, R.ALIASES["source_work"], F.concat(F.lit("RoleBench/"), character))
    return {"character": character, "source_work": work, "b_profile": first_text(raw, R.ALIASES["profile"], R.default_profile(character, work)), "b_turns": turns_of(raw)}


def _with_prompts(raw: DataFrame, chat: bool) -> DataFrame:
    own = raw.select("*", *(c.alias(f"p_{n}") for n, c in _prompt_fields(raw).items()))
    make = R.chat_messages if chat else R.policy_prompt
    return own.withColumn("prompt", make(F.col("p_character"), F.col("p_source_work"), F.col("p_b_profile"), F.col("p_b_turns")))


def sft_rows(raw: DataFrame, order: str, chat: bool = False, require_gold: bool = False) -> DataFrame:
    """(order, prompt, completion, id, character, source_work, skip_reason): training rows; as role messages with ``chat``. Rows without an answer, or without gold labels where they are required, are skipped."""
    own = _with_prompts(raw.withColumn("b_answer", assistant_answer(raw)), chat)
    focus = F.col("gold_focus") if "gold_focus" in raw.columns else _null("array<string>")
    attr = text_of(raw, "gold_focus_attr")
    content = R.sft_content(focus, attr, F.col("p_character"), F.col("b_answer"))
    completion = F.array(F.struct(F.lit("assistant").alias("role"), content.alias("content"))) if chat else content
    gold = F.coalesce((F.size(focus) > 0) & (attr != ""), F.lit(False))
    reason = F.when(F.col("b_answer").isNull(), "no_answer")
    if require_gold:
        reason = F.coalesce(reason, F.when(~gold, "no_gold"))
    return own.select(F.col(order).alias("order"), "prompt", completion.alias("completion"), F.coalesce(text_of(raw, "id"), F.lit("")).alias("id"), F.col("p_character").alias("character"), F.col("p_source_work").alias("source_work"), reason.alias("skip_reason"))


def grpo_rows(records: DataFrame, order: str, chat: bool = False, validate: bool = True) -> DataFrame:
    """Policy rows with gold columns kept out of the prompt. ``validate`` fails on the first record with schema errors; rows without a gold field are skipped."""
    own = _with_prompts(records, chat)
    missing = (F.coalesce(F.size("gold_focus"), F.lit(0)) < 1) | (F.coalesce("gold_focus_attr", F.lit("")) == "") | (F.coalesce("reference_answer", F.lit("")) == "")
    named = F.coalesce(F.col("id").cast("string"), F.lit("<missing-id>"))
    reason = F.when(missing, "no_gold")
    if validate:
        errors = schema_errors()
        reason = F.when(F.size(errors) > 0, F.raise_error(F.concat(F.lit("record "), named, F.lit(" failed schema validation: "), F.array_join(errors, "; "))).cast("string")).otherwise(reason)
    field = lambda n: F.coalesce(F.nullif(F.col(n), F.lit("")), F.lit("unknown"))
    return own.select(F.col(order).alias("order"), "prompt", "gold_focus", "gold_focus_attr", "reference_answer", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), field("character").alias("character"), field("source_work").alias("source_work"), reason.alias("skip_reason"))


def rollout_seeds(raw: DataFrame, arm: str, axis: str) -> DataFrame:
    """Seeds of rollouts: prompt and messages, and the target fields passed through for the scorers."""
    plain = lambda names, default: F.coalesce(*(F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in raw.columns), F.lit(default))
    lists = [F.when(F.size(n) > 0, F.col(n)) for n in TURN_LISTS if n in raw.columns]
    own = _with_prompts(raw, False)
    messages = R.chat_messages(F.col("p_character"), F.col("p_source_work"), F.col("p_b_profile"), F.col("p_b_turns"))
    given = F.nullif(F.col("policy_prompt"), F.lit("")) if "policy_prompt" in raw.columns else _null()
    has_turns = F.coalesce(*lists).isNotNull() if lists else F.lit(False)
    return own.select(
        plain(["id"], f"{axis}_{arm}_unknown").alias("id"), F.lit(arm).alias("arm"), F.lit(axis).alias("axis"), plain(["character", "role"], "unknown").alias("character"), plain(["source_work", "work"], "unknown").alias("source_work"), plain(["profile", "persona", "character_profile"], "").alias("profile"),
        *([F.coalesce(*lists).alias("conversations")] if lists else []), F.coalesce(given, F.col("prompt")).alias("prompt"), F.when(has_turns, messages).alias("messages"), *(F.col(c) for c in ROLLOUT_TARGETS if c in raw.columns),
    )


def legacy_messages(messages: Column) -> Column:
    """Messages as plain lines, for runs without a chat template."""
    return F.concat(R.render_dialogue(messages), F.lit("\n"))


def completion_summary(messages: Column) -> Column:
    """The contents of role messages, a line each."""
    return F.array_join(F.filter(F.transform(messages, lambda t: F.coalesce(t["content"], F.lit(""))), lambda x: ~blank(x)), "\n")


def merged(seeds: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """Seeds with the fields of their synthesis over them, where it has any."""
    own = made.select(F.col(key).alias("m_key"), *(F.col(c).alias(f"m_{c}") for c in made.columns if c != key))
    joined = seeds.join(own, seeds[key] == F.col("m_key"), "left")
    fields = [c for c in made.columns if c != key]
    kept = [c for c in seeds.columns if c not in fields]
    over = [F.when(F.col("m_key").isNotNull(), F.col(f"m_{c}")).otherwise(seeds[c] if c in seeds.columns else _null(made.schema[c].dataType.simpleString())).alias(c) for c in fields]
    return joined.select(*(seeds[c] for c in kept), *over)
