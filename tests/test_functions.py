"""Golden values and traps of the text, grammar, reward and multiple-choice functions."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from loomwright.functions import mcq as M
from loomwright.functions import reward as R
from loomwright.functions.grammar import boxed_parts, contract_issues, parse_completion, parse_strict, perfect_completion, split_labels
from loomwright.functions.text import char_ngrams, normalize_text, normalize_text_exact, py_strip


def column(spark, values, expression):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", expression(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.k)]


def test_strip_takes_all_unicode_white_space(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert column(spark, [f"{s}a b{s}" for s in spaces] + ["​x"], py_strip) == ["a b"] * len(spaces) + ["​x"]


def test_normalized_text(spark):
    texts = ["  你好，World！ ", "Straße", "A-B_C d", "", "🙂é", "Ａ①"]
    exact = column(spark, texts, normalize_text_exact)
    want = ["".join(c for c in unicodedata.normalize("NFKC", x).casefold() if unicodedata.category(c)[0] not in "PSZC") for x in texts]
    assert exact == want and exact[0] == "你好world"
    assert column(spark, texts[:5], normalize_text) == want[:5]


def test_char_ngrams_of_short_texts_are_characters(spark):
    assert [sorted(x) for x in column(spark, ["", "aab", "abcde", "abcdef"], char_ngrams)] == [[], ["a", "b"], list("abcde"), ["abcde", "bcdef"]]


def test_labels(spark):
    got = column(spark, ["Knowledge,Style", "[Style]；'Bogus' | Style", " ,, ", "Memory　Safety"], split_labels)
    assert got == [["Knowledge", "Style"], ["Style", "Bogus"], [], ["Memory", "Safety"]]


@pytest.mark.parametrize(
    ("text", "content", "tail"),
    [
        (r"\boxed{a}", "a", ""), (r"x \boxed {a{b}c} t", "a{b}c", " t"), (r"\boxed{a\}b} t", r"a\}b", " t"), (r"\boxed{a", None, None), ("none", None, None), (r"\boxed{a} \boxed{b}", "a", r" \boxed{b}"), (r"\boxed{a \boxed{b}", None, None),
        ("\\boxed{" + "{" * 12 + "x" + "}" * 12 + "} t", "{" * 12 + "x" + "}" * 12, " t"), ("\\boxed{" + "y{z}" * 3000 + "}", "y{z}" * 3000, ""), ("\\boxed{a\\", None, None),
    ],
)
def test_boxed_answers(spark, text, content, tail):
    a, b = boxed_parts(F.col("v"))
    got = spark.createDataFrame([(text,)], "v string").select(a.alias("a"), b.alias("b")).first()
    assert (got.a, got.b) == (content, tail)


GOOD = "<think>x<focus>Knowledge, Style</focus><focus_attr>calm voice</focus_attr></think>\n\\boxed{the answer}"


def issues(spark, texts):
    return column(spark, texts, lambda v: contract_issues(parse_completion(v)))


def test_contract(spark):
    texts = [GOOD, GOOD + "<|im_end|> <pad>", GOOD + "<|endoftext|>", GOOD + " more", "Human: " + GOOD, "", GOOD.replace("the answer", "user: hi"), GOOD.replace("Style", "Bogus"), GOOD.replace("</focus>", "</focus><focus>Style</focus>"), GOOD[:-1], GOOD.replace("<think>", "<think>a</think><think>")]
    assert issues(spark, texts) == [
        [], [], ["text_after_first_boxed", "prompt_leakage"], ["text_after_first_boxed"], ["prefix_before_think", "prompt_leakage"], ["empty_completion", "missing_think", "missing_focus", "missing_focus_attr", "missing_boxed"], ["prompt_leakage"], ["illegal_focus"], ["multi_focus"],
        ["missing_boxed", "malformed_boxed"], ["multi_think", "missing_focus", "missing_focus_attr"],
    ]


def test_chrf_golden_values():
    pairs = [("豪放洒脱，爱饮酒，擅长七言", "豪放洒脱，好酒，长于七言", 0.331481), ("冷静克制，机械回答，避免闲谈", "豪放洒脱，好酒，长于七言", 0.026882), ("哈哈，且来共饮一杯吧！", "哈哈，且来共饮一杯！", 0.852232), ("好", "哈哈，且来共饮一杯！", 0.0), ("哈", "哈哈，且来共饮一杯！", 0.020325), ("a", "a", 1.0), ("", "a", 0.0)]
    assert [round(R.chrf_of(a, b), 6) for a, b, _ in pairs] == [x for *_, x in pairs]


def test_scores(spark):
    rows = [(GOOD, ["Knowledge", "Style"], "calm voice", "the answer"), (GOOD, ["Knowledge", "Emotion"], "calm voice", "the answer"), (GOOD + " x", ["Knowledge", "Style"], "calm voice", "the answer")]
    got = R.score_completions(spark.createDataFrame(rows, "completion string, gold_focus array<string>, gold_focus_attr string, reference_answer string")).select("focus", "attribute", "reference", "format", F.round("score", 6)).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 1.0, 1.0, 1.0), (0.5, 1.0, 1.0, 1.0, 0.8), (0.0, 0.0, 0.0, 0.0, 0.0)]


def test_two_grammars_differ_on_nested_braces(spark):
    text = GOOD.replace("the answer", "a {b} c")
    assert column(spark, [text], lambda v: parse_completion(v).getField("boxed_answer")) == ["a {b} c"]
    assert column(spark, [text], lambda v: parse_strict(v).getField("boxed_answer")) == ["a {b"]
    assert column(spark, ["x"], lambda v: perfect_completion(F.array(F.lit("Style")), F.lit("y"), v)) == ["<think><focus>Style</focus><focus_attr>y</focus_attr></think>\n\\boxed{x}"]


def test_multiple_choice(spark):
    replies = ["答案是B", "(C)", "\\boxed{D}", "3", "。。。", "AB", "I think so", "first A but the answer: D.", "ＢＢ", "Ｂ", "", None, "A1 b"]
    assert column(spark, replies, M.general_choice) == ["B", "C", "D", "C", None, None, None, "D", None, "B", None, None, "B"]
    assert column(spark, replies, M.social_choice) == ["B", "C", "D", "C", "", "AB", None, "D", None, "B", None, None, None]


def test_answer_labels(spark):
    rows = [("1", True, "B"), ("1", False, "A"), ("4", True, "D"), ("0", False, ""), ("c.", False, "C"), ("Opt  TWO", False, "B"), (None, True, "")]
    choices = F.create_map(*(F.lit(x) for x in ("A", "opt one", "B", "opt two", "C", "x", "D", "y")))
    got = spark.createDataFrame(rows, "v string, listed boolean, want string").select(M.answer_label(F.col("v"), choices, F.col("listed")).alias("r"), "want").collect()
    assert [r.r for r in got] == [r.want for r in got]


def test_normalised_columns_share_one_python_node(spark):
    """Iterators of batches would have a node, and so a Python worker a task, each."""
    rows = spark.createDataFrame([("Ａ b!", "ẞ－x", None)], "a string, b string, c string")
    out = rows.select(*(normalize_text(F.col(x)).alias(x) for x in "abc"))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert tuple(out.first()) == ("ab", "ssx", None)


def test_text_with_many_dropped_characters(spark):
    marks = "".join(chr(c) for c in range(0x2190, 0x2400))
    assert column(spark, [f"{marks}É{marks}b c"], normalize_text) == ["ébc"]
