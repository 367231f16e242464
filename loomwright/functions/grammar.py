"""Parsing structured completions: a private reasoning block with focus labels, and a boxed answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_WS, blank, py_strip

#: The closed set of labels, and texts that show a leaked prompt.
FOCUS_LABELS = ["Knowledge", "Style", "Worldview", "Emotion", "Empathetic", "Engagement", "Human_Like", "Extension", "Memory", "Safety"]
LEAK_MARKERS = ["Human:", "User:", "Assistant:", "System:", "human:", "user:", "assistant:", "system:", "角色:", "来源作品:", "角色卡:", "对话上下文:", "请严格", "不要输出", "新题目", "<|endoftext|>"]
_STRIP = r"""\ \t\r\n'"`\[\](){}<>:：.!！?？"""
#: Nesting of braces that the pattern for boxed answers follows; deeper ones are scanned character by character.
BRACE_DEPTH = 6
_BOX = r"(?s)\\boxed\{(.*?)\}"


def tag_pattern(name: str, ws: str = PY_WS) -> str:
    return rf"(?is)<[{ws}]*{name}\b[^>]*>(.*?)</[{ws}]*{name}[{ws}]*>"


def balanced(depth: int = BRACE_DEPTH, possessive: str = "+") -> str:
    """Text up to the brace that closes it, with nested braces; a backslash takes the next character with it."""
    plain = r"[^{}\\]*" + possessive
    inner = r"\\."
    for _ in range(depth):
        inner = rf"\\.|\{{{plain}(?:(?:{inner}){plain})*{possessive}\}}"
    return rf"{plain}(?:(?:{inner}){plain})*{possessive}"


def _strip_or_null(text: Column) -> Column:
    return F.nullif(py_strip(text), F.lit(""))


def _scan(rest: Column) -> Column:
    """Characters before the closing brace of ``rest``, or null; a fold over its characters for any depth."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("skip"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, c: Column) -> Column:
        live = s["end"].isNull() & ~s["skip"]
        depth = s["depth"] + F.when(live & (c == "{"), 1).when(live & (c == "}"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), (live & (c == "\\")).alias("skip"), F.coalesce(s["end"], F.when(live & (depth == 0), s["at"])).alias("end"))

    return F.aggregate(F.split(rest, ""), start, step)["end"]


def boxed_parts(raw: Column) -> tuple[Column, Column]:
    """(content, tail) of the first boxed answer: both null if there is none or its brace stays open."""
    rest = F.regexp_extract(raw, rf"(?s)\\boxed[{PY_WS}]*\{{(.*)$", 1)
    opened = F.rlike(raw, F.lit(rf"\\boxed[{PY_WS}]*\{{"))
    pattern = rf"(?s)^({balanced()})\}}(.*)$"
    flat = F.rlike(rest, F.lit(pattern))
    end = _scan(rest)
    # the pattern gives up only on braces that stay open or that nest deeper than it follows
    deep = ~flat & F.rlike(rest, F.lit(r"\}"))
    content = F.when(opened & flat, F.regexp_extract(rest, pattern, 1)).when(opened & deep, F.substring(rest, F.lit(1), end))
    tail = F.when(opened & flat, F.regexp_extract(rest, pattern, 2)).when(opened & deep, F.substring(rest, end + 2, F.length(rest)))
    return content, tail


def split_labels(text: Column) -> Column:
    """Distinct label tokens in order of appearance."""
    parts = F.split(text, rf"[,，;；、/|]+|[{PY_WS}]+")
    clean = F.transform(parts, lambda x: F.regexp_replace(x, rf"^[{_STRIP}]+|[{_STRIP}]+$", ""))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def label_array() -> Column:
    return F.array(*map(F.lit, FOCUS_LABELS))


def parse_completion(completion: Column) -> Column:
    """A struct of all that the contract looks at; a null completion is empty.

    raw, think, focus_labels, illegal_focus_labels, focus_attr, boxed_answer, boxed_closed, clean_tail, think_count,
    focus_count, focus_attr_count, boxed_count. Focus tags are looked for in the first reasoning block, or in the
    whole text where that is missing or blank.
    """
    raw = F.coalesce(completion, F.lit(""))
    think = _strip_or_null(F.regexp_extract(raw, tag_pattern("think"), 1))
    area = F.coalesce(think, raw)
    bodies = F.regexp_extract_all(area, F.lit(tag_pattern("focus")), F.lit(1))
    labels = split_labels(F.array_join(bodies, ","))
    content, tail = boxed_parts(raw)
    return F.struct(
        raw.alias("raw"),
        think.alias("think"),
        F.array_intersect(labels, label_array()).alias("focus_labels"),
        F.array_except(labels, label_array()).alias("illegal_focus_labels"),
        _strip_or_null(F.regexp_extract(area, tag_pattern("focus_attr"), 1)).alias("focus_attr"),
        _strip_or_null(content).alias("boxed_answer"),
        content.isNotNull().alias("boxed_closed"),
        F.coalesce(F.rlike(tail, F.lit(rf"^(?:[{PY_WS}]|<\|im_end\|>|<pad>)*+$")), F.lit(False)).alias("clean_tail"),
        F.regexp_count(raw, F.lit(tag_pattern("think"))).alias("think_count"),
        F.size(bodies).alias("focus_count"),
        F.regexp_count(area, F.lit(tag_pattern("focus_attr"))).alias("focus_attr_count"),
        F.regexp_count(raw, F.lit(rf"\\boxed[{PY_WS}]*\{{")).alias("boxed_count"),
    )


def leak_markers(raw: Column) -> Column:
    return F.filter(F.array(*map(F.lit, LEAK_MARKERS)), lambda m: F.contains(raw, m))


def contract_issues(parsed: Column) -> Column:
    """The codes of all broken rules of a parsed completion, in the order of the rules."""
    p = parsed.getField
    stripped = py_strip(p("raw"))
    rules = [
        (stripped == "", "empty_completion"),
        ((stripped != "") & ~F.startswith(F.lower(stripped), F.lit("<think")), "prefix_before_think"),
        (blank(p("think")), "missing_think"),
        (p("think_count") > 1, "multi_think"),
        (F.size(p("focus_labels")) == 0, "missing_focus"),
        (p("focus_count") > 1, "multi_focus"),
        (F.size(p("illegal_focus_labels")) > 0, "illegal_focus"),
        (blank(p("focus_attr")), "missing_focus_attr"),
        (p("focus_attr_count") > 1, "multi_focus_attr"),
        (blank(p("boxed_answer")), "missing_boxed"),
        (p("boxed_count") > 1, "multi_boxed"),
        ((p("boxed_count") > 0) & ~p("boxed_closed"), "malformed_boxed"),
        (p("boxed_closed") & ~p("clean_tail"), "text_after_first_boxed"),
        (F.size(leak_markers(p("raw"))) > 0, "prompt_leakage"),
    ]
    return F.array_compact(F.array(*(F.when(rule, F.lit(code)) for rule, code in rules)))


def contract_report(parsed: Column, issues: Column) -> Column:
    p, markers = parsed.getField, leak_markers(parsed.getField("raw"))
    ok = F.size(issues) == 0
    return F.struct(
        F.when(ok, "pass").otherwise("fail").alias("status"),
        ok.cast("double").alias("score"),
        issues.alias("issues"),
        *(p(k).alias(k) for k in ("think_count", "focus_count", "focus_attr_count", "boxed_count")),
        p("clean_tail").alias("has_clean_tail"),
        F.struct(F.when(F.size(markers) > 0, "fail").otherwise("pass").alias("status"), markers.alias("markers")).alias("prompt_leakage"),
    )


def parse_strict(completion: Column) -> Column:
    """The validators' grammar: tags without attributes, and the box up to its first closing brace.

    focus_labels, illegal_focus_labels (repeats kept), focus_attr, boxed_answer, well_formed.
    """
    raw = F.coalesce(completion, F.lit(""))
    ws = f"[{PY_WS}]"
    one = lambda name: rf"(?is)<{name}>{ws}*(.*?){ws}*</{name}>"
    bodies = F.array_join(F.regexp_extract_all(raw, F.lit(one("focus")), F.lit(1)), ",")
    tokens = F.filter(F.split(bodies, r"[,，、;/；" + PY_WS + "]+"), lambda x: x != "")
    attr = F.when(F.rlike(raw, F.lit(one("focus_attr"))), py_strip(F.regexp_extract(raw, one("focus_attr"), 1)))
    answer = F.when(F.rlike(raw, F.lit(_BOX)), py_strip(F.regexp_extract(raw, _BOX, 1)))
    legal = F.array_distinct(F.filter(tokens, lambda x: F.array_contains(label_array(), x)))
    illegal = F.filter(tokens, lambda x: ~F.array_contains(label_array(), x))
    think = F.rlike(raw, F.lit(r"(?is)<think\b[^>]*>.*?</think>"))
    full = think & (F.size(legal) > 0) & (F.size(illegal) == 0) & (F.coalesce(attr, F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != "")
    return F.struct(legal.alias("focus_labels"), illegal.alias("illegal_focus_labels"), attr.alias("focus_attr"), answer.alias("boxed_answer"), full.alias("well_formed"))


def perfect_completion(focus: Column, attr: Column, answer: Column) -> Column:
    return F.concat(F.lit("<think><focus>"), F.array_join(focus, ", "), F.lit("</focus><focus_attr>"), attr, F.lit("</focus_attr></think>\n\\boxed{"), answer, F.lit("}"))


def derived_marks(parsed: Column) -> Column:
    """What a parsed completion has: has_think, has_focus, has_focus_attr, has_boxed, has_illegal_focus and is_well_formed."""
    p = parsed.getField
    text = lambda x: F.coalesce(x, F.lit("")) != ""
    marks = {"has_think": p("think_count") > 0, "has_focus": F.size(p("focus_labels")) > 0, "has_focus_attr": text(p("focus_attr")), "has_boxed": text(p("boxed_answer")), "has_illegal_focus": F.size(p("illegal_focus_labels")) > 0}
    formed = marks["has_think"] & marks["has_focus"] & marks["has_focus_attr"] & marks["has_boxed"] & ~marks["has_illegal_focus"]
    return F.struct(*(c.alias(n) for n, c in marks.items()), formed.alias("is_well_formed"))


def shown_reply(completion: Column, with_focus: bool = False) -> Column:
    """What a reader is shown: the box up to its first closing brace, or the whole text; with the focus after it, if that is asked for."""
    raw = F.coalesce(completion, F.lit(""))
    ws = f"[{PY_WS}]"
    reply = F.when(F.rlike(raw, F.lit(_BOX)), py_strip(F.regexp_extract(raw, _BOX, 1))).otherwise(py_strip(raw))
    if not with_focus:
        return reply
    focus = rf"(?is)<focus>{ws}*(.*?){ws}*</focus>"
    return F.when(F.rlike(raw, F.lit(focus)), F.concat(reply, F.lit("\n\n_（关注点 focus: "), py_strip(F.regexp_extract(raw, focus, 1)), F.lit("）_"))).otherwise(reply)


def fenced_json(text: Column, kind: str = "object") -> Column:
    """The JSON object (or array) of a reply, as VARIANT: without its code fence, or else from its first opening brace to its last closing one; null if neither parses to the kind."""
    body = F.regexp_replace(F.regexp_replace(py_strip(text), rf"^```(?:json)?[{PY_WS}]*", ""), rf"[{PY_WS}]*```$", "")
    pattern = r"(?s)(\{.*\})" if kind == "object" else r"(?s)(\[.*\])"
    whole, part = F.try_parse_json(body), F.try_parse_json(F.nullif(F.regexp_extract(body, pattern, 1), F.lit("")))
    found = F.coalesce(whole, part)
    return F.when(F.startswith(F.schema_of_variant(found), F.lit("OBJECT" if kind == "object" else "ARRAY")), found)


def completion_text(completion: Column) -> Column:
    """A completion in any shape, as VARIANT, as text: a text, the first text among content, text and generated_text of a message, or the messages of a list, a line each."""
    said = lambda v: F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string")) for k in ("content", "text", "generated_text")))
    kind = F.schema_of_variant(completion)
    one = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.coalesce(said(v), F.to_json(v))).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))
    parts = F.filter(F.transform(F.try_variant_get(completion, "$", "array<variant>"), one), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.coalesce(F.when(F.startswith(kind, F.lit("ARRAY")), F.array_join(parts, "\n")).otherwise(one(completion)), F.lit(""))


def completion_batch(completions: Column) -> Column:
    """A batch of completions as a list of VARIANTs: a list of messages is one completion, any other list one each, anything else one."""
    items = F.try_variant_get(completions, "$", "array<variant>")
    message = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & (F.try_variant_get(v, "$.role", "string").isNotNull() | F.try_variant_get(v, "$.content", "string").isNotNull())
    chat = (F.size(items) > 0) & F.forall(items, lambda v: F.coalesce(message(v), F.lit(False)))
    return F.when(F.startswith(F.schema_of_variant(completions), F.lit("ARRAY")) & ~F.coalesce(chat, F.lit(False)), items).otherwise(F.array(completions))
