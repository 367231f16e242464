"""Multiple-choice questions: choices, answer labels, and choices found in free text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PY_WS, py_strip, squash

LETTERS = ("A", "B", "C", "D")
_W = f"[{PY_WS}]"
#: Cue words, and the characters that may wrap a choice.
_CUES = "正确答案|最终答案|答案|答|选择|选项|我选|应选|FINAL{w}+ANSWER|ANSWER|OPTION|CHOICE"
_SOCIAL_CUES = "final{w}+answer|correct{w}+answer|answer|option|choice|label|最终答案|正确答案|答案|选项|选择|我选|应选|选|答"
_WRAP = r""" \t\r\n.。,:：;；!！?？()\[\]{}<>"'`“”‘’【】"""


#: The patterns of a choice in free text, from the surest to the weakest.
def general_patterns(ws: str = PY_WS) -> list[str]:
    """In order of trust: boxed, tagged, after a cue, on its own."""
    w = f"[{ws}]"
    cue = rf"(?iu)(?:{_CUES.format(w=w)}){w}*(?:是|为|应为|:|：|-|=)?{w}*[\(\[{{【]?{w}*([A-D1-4])"
    return [rf"(?iu)\\boxed{w}*\{{{w}*([A-D1-4]){w}*\}}", rf"(?iu)<answer>{w}*([A-D1-4]){w}*</answer>", cue, r"(?iu)(?<![A-Z0-9])([A-D1-4])(?![A-Z0-9])"]


#: The patterns of a choice in social questions, from the surest to the weakest.
def social_patterns(ws: str = PY_WS) -> list[str]:
    w = f"[{ws}]"
    cue = rf"(?iu)(?:{_SOCIAL_CUES.format(w=w)}){w}*(?:is|as|=|:|：|-|为|是|应该是|应为)?{w}*(?:option|choice|选项)?{w}*[\(\[（【]?{w}*([A-D1-4]){w}*[\)\]）】]?"
    line = rf"(?:^|\n){w}*[\(\[（【]?{w}*([A-D1-4]){w}*[\)\]）】\.、:：]?(?={w}|$)"
    return [cue, line, r"(?<![A-Za-z0-9])([A-D])(?![A-Za-z0-9])"]


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _letter(token: Column) -> Column:
    return F.when(token.isin(*LETTERS), token).when(token.isin("1", "2", "3", "4"), F.element_at(F.array(*map(F.lit, LETTERS)), token.cast("int")))


def general_token(text: Column) -> Column:
    return _letter(F.regexp_replace(F.upper(py_strip(text)), f"^[{_WRAP}]+|[{_WRAP}]+$", ""))


def _last(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def general_choice(text: Column, normalized: bool = False) -> Column:
    """The choice a free text makes: the text itself, or the last match of the first pattern that matches at all."""
    clean = py_strip(text if normalized else nfkc(text))
    found = F.coalesce(*(_last(clean, p) for p in general_patterns()))
    return F.when(clean == "", None).otherwise(F.coalesce(general_token(clean), general_token(found)))


#: Fields of an object that may hold the target.
TARGET_FIELDS = ["answer", "label", "gold", "target", "correct_answer"]


def typed_choice(target: Column) -> Column:
    """The choice that a VARIANT target makes: a whole number from 1 to 4, a text, the first of a list that makes one, or what an object holds; none for booleans.

    Lists and objects hold texts and numbers.
    """
    kind = F.schema_of_variant(target)
    first = F.get(F.filter(F.transform(F.try_variant_get(target, "$", "array<variant>"), typed_choice_of_scalar), lambda x: x.isNotNull()), F.lit(0))
    held = F.coalesce(*(F.when(~_blank_text(F.try_variant_get(target, f"$.{f}", "string")), F.try_variant_get(target, f"$.{f}", "variant")) for f in TARGET_FIELDS))
    alone = F.when(kind == "STRING", general_choice(F.try_variant_get(target, "$", "string"))).otherwise(typed_choice_of_scalar(target))
    return F.when(F.startswith(kind, F.lit("ARRAY")), first).when(F.startswith(kind, F.lit("OBJECT")), typed_choice_of_scalar(held)).otherwise(alone)


def _blank_text(text: Column) -> Column:
    return F.coalesce(py_strip(text), F.lit("")) == ""


def typed_choice_of_scalar(value: Column) -> Column:
    """The choice of a text or number in a VARIANT; texts are taken as they are, without compatibility forms."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    whole = F.when((number == F.floor(number)) & number.between(1, 4), _letter(number.cast("int").cast("string")))
    return F.when(kind == "STRING", general_choice(F.try_variant_get(value, "$", "string"), normalized=True)).when(kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), whole)


#: What may stand around a choice.
def unwrapped(text: Column) -> Column:
    ws = PY_WS
    start = F.regexp_replace(py_strip(text), rf"""^[{ws}'"`“”‘’(\[{{（【]+""", "")
    return py_strip(F.regexp_replace(start, rf"""[{ws}'"`“”‘’)\]}}）】.。,:：;；!！?？]+$""", ""))


def social_token(text: Column) -> Column:
    """Any text that occurs in "ABCD" is a choice, the empty one too; digits are 1-based."""
    token = F.upper(unwrapped(text))
    return F.when(F.instr(F.lit("ABCD"), token) > 0, token).when(token.isin("1", "2", "3", "4"), _letter(token))


def social_choice(text: Column, normalized: bool = False) -> Column:
    clean = py_strip(text if normalized else nfkc(text))
    cue, line, letter = (_last(clean, p) for p in social_patterns())
    return F.when(F.coalesce(text, F.lit("")) == "", None).otherwise(F.coalesce(social_token(clean), social_token(cue), social_token(line), social_token(letter)))


def choice_map(letters: dict[str, list[Column]], listed: Column | None = None) -> Column:
    """Choices by letter: from columns of their own, the first that is not blank, or else from a list."""
    own = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, letters)), F.array(*(F.coalesce(*(F.nullif(py_strip(c), F.lit("")) for c in cs)) for cs in letters.values()))), lambda k, v: v.isNotNull())
    if listed is None:
        return own
    pairs = F.filter(F.transform(F.slice(F.coalesce(listed, F.array().cast("array<string>")), 1, len(LETTERS)), lambda x, i: F.struct(F.element_at(F.array(*map(F.lit, LETTERS)), i + 1), py_strip(x))), lambda p: F.coalesce(p["col2"] != "", F.lit(False)))
    return F.when(F.size(own) > 0, own).otherwise(F.map_from_entries(pairs))


def canonical(text: Column) -> Column:
    return F.lower(squash(text))


#: What may stand around a label.
def answer_label(value: Column, choices: Column, from_list: Column) -> Column:
    """A letter for a letter, a digit (0-based only for listed choices), or the text of a choice; else empty."""
    text = py_strip(F.coalesce(value, F.lit("")))
    token = F.upper(F.regexp_replace(py_strip(text), r"""^['"`“”‘’()\[\]{}（）【】.。,:：;；!！?？]+|['"`“”‘’()\[\]{}（）【】.。,:：;；!！?？]+$""", ""))
    letters = F.array(*map(F.lit, LETTERS))
    same = F.filter(F.map_entries(choices), lambda e: canonical(e["value"]) == canonical(text))
    by_text = F.when(F.size(same) > 0, F.get(same, F.lit(0))["key"])
    zero = F.when(from_list & token.isin("0", "1", "2", "3"), F.element_at(letters, F.try_add(token.try_cast("int"), F.lit(1))))
    label = F.coalesce(F.when(token.isin(*LETTERS), token), zero, _letter(token), by_text, F.lit(""))
    return F.when(text == "", F.lit("")).otherwise(label)


#: The head of a prompt.
def mcq_prompt(question: Column, choices: Column) -> Column:
    lines = [F.when(F.map_contains_key(choices, x), F.concat(F.lit(f"{x}. "), choices[x])) for x in LETTERS]
    head = F.concat(F.lit("请回答以下单项选择题。只输出一个大写字母 A/B/C/D，不要解释。\n\n题目: "), question)
    return F.array_join(F.array_compact(F.array(head, *lines, F.lit("答案:"))), "\n")


def mcq_status(response: Column, prediction: Column, target_raw: Column, target: Column) -> Column:
    """(prediction, target, correct, accuracy, status) of a scored answer."""
    status = (
        F.when(target.isNull(), F.when(target_raw.isNull(), "missing_target").otherwise("unparseable_target"))
        .when(response.isNull(), "missing_prediction")
        .when(prediction.isNull(), "unparseable_prediction")
        .otherwise("ok")
    )
    correct = F.when(target.isNotNull(), F.coalesce((status == "ok") & (prediction == target), F.lit(False)))
    return F.struct(prediction.alias("prediction"), target.alias("target"), correct.alias("correct"), correct.cast("double").alias("accuracy"), status.alias("status"))
