"""Rule-based rewards of parsed completions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grammar import contract_issues, contract_report, label_array, parse_completion
from .text import blank, jaccard, squash

#: The weights of focus, attribute, reference and format.
WEIGHTS = {"focus": 0.4, "attribute": 0.2, "reference": 0.2, "format": 0.2}
CHRF_ORDER, CHRF_BETA = 6, 2.0


def _f_beta(precision: float, recall: float, beta: float) -> float:
    square = beta * beta
    return (1 + square) * precision * recall / (square * precision + recall) if precision > 0 and recall > 0 else 0.0


def chrf_of(a: str, b: str, order: int = CHRF_ORDER, beta: float = CHRF_BETA) -> float:
    """chrF of two texts without white space: mean clipped n-gram precision and recall over the orders either reaches."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    orders = range(1, max(1, min(order, max(len(a), len(b)))) + 1)
    precision = recall = 0.0
    for n in orders:
        mine, other = max(0, len(a) - n + 1), max(0, len(b) - n + 1)
        if mine and other:
            shared = (Counter(map(a.__getitem__, (slice(i, i + n) for i in range(mine)))) & Counter(map(b.__getitem__, (slice(i, i + n) for i in range(other))))).total()
            precision += shared / mine
            recall += shared / other
    return _f_beta(precision / len(orders), recall / len(orders), beta)


@F.pandas_udf(T.DoubleType())
def _chrf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([chrf_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def chrf(prediction: Column, reference: Column) -> Column:
    """chrF over characters, white space dropped; a null counts as empty. In Arrow batches: clipped counts have no JVM form within a row."""
    return _chrf(squash(F.coalesce(prediction, F.lit(""))), squash(F.coalesce(reference, F.lit(""))))


def focus_overlap(parsed: Column, valid: Column, gold: Column, metric: str = "f1") -> Column:
    """Overlap of predicted and gold labels, illegal labels counting against; 0 for an invalid completion."""
    mine, illegal, gold = parsed.getField("focus_labels"), F.size(parsed.getField("illegal_focus_labels")), F.array_distinct(gold)
    shared = F.size(F.array_intersect(mine, gold))
    if metric == "f1":
        score = 2 * shared / (F.size(mine) + illegal + F.size(gold))
    elif metric == "jaccard":
        score = shared / (F.size(F.array_union(mine, gold)) + illegal)
    else:
        raise ValueError(f"no such metric: {metric}")
    return F.when(valid & (F.size(mine) > 0) & (F.size(gold) > 0), score).otherwise(0.0)


def strict_match(parsed: Column, valid: Column, gold: Column) -> Column:
    mine, gold = parsed.getField("focus_labels"), F.array_distinct(gold)
    same = (F.size(F.array_except(mine, gold)) == 0) & (F.size(F.array_except(gold, mine)) == 0)
    return (valid & (F.size(gold) > 0) & same & (F.size(parsed.getField("illegal_focus_labels")) == 0)).cast("double")


def legal_overlap(mine: Column, gold: Column) -> Column:
    """The validators' overlap: Jaccard of the legal labels of both; 1 where neither has any."""
    legal = lambda x: F.array_intersect(F.coalesce(x, F.array().cast("array<string>")), label_array())
    return jaccard(legal(mine), legal(gold))


def gold_labels_at(gold: Column, index: Column, size: Column) -> Column:
    """The gold labels of row ``index`` of a batch, from a list of label lists; a flat list of labels (one list in ``gold``) is every row's."""
    return F.when((F.size(gold) == size) & (F.size(gold) > 1), F.get(gold, index)).when(F.size(gold) == 1, F.get(gold, F.lit(0))).otherwise(F.array().cast("array<string>"))


def with_contract(df: DataFrame, completion: str = "completion") -> DataFrame:
    """Adds ``parsed``, ``issues`` and ``valid``; the completion is parsed once."""
    return df.withColumn("parsed", parse_completion(F.col(completion))).withColumn("issues", contract_issues(F.col("parsed"))).withColumn("valid", F.size("issues") == 0)


#: Components by name: functions of (parsed, valid, gold_focus, gold_focus_attr, reference_answer). More can be registered.
COMPONENTS: dict[str, Callable[..., Column]] = {
    "focus": lambda parsed, valid, gold, attr, reference: focus_overlap(parsed, valid, gold),
    "attribute": lambda parsed, valid, gold, attr, reference: F.when(valid & ~blank(parsed.getField("focus_attr")), chrf(parsed.getField("focus_attr"), attr)).otherwise(0.0),
    "reference": lambda parsed, valid, gold, attr, reference: F.when(valid & ~blank(parsed.getField("boxed_answer")), chrf(parsed.getField("boxed_answer"), reference)).otherwise(0.0),
    "format": lambda parsed, valid, gold, attr, reference: valid.cast("double"),
}


def score_completions(df: DataFrame, completion: str = "completion", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds a column per component and ``score``, their weighted sum. Rows need gold_focus, gold_focus_attr and reference_answer. No shuffle."""
    scored = with_contract(df, completion)
    inputs = [F.col(c) for c in ("parsed", "valid", "gold_focus", "gold_focus_attr", "reference_answer")]
    scored = scored.withColumns({name: COMPONENTS[name](*inputs) for name in weights})
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.col(name)
    return scored.withColumn("score", total)


def score_heldout(df: DataFrame, responses: list[str], dry_run: Column | None = None) -> DataFrame:
    """Adds ``response``, ``status`` (missing_response, dry_run, missing_gold or ok), ``format_score``, ``length_chars``, ``report`` and, where gold is complete, the components and score."""
    response = F.coalesce(*(F.when(~blank(F.col(c)), F.col(c)) for c in responses))
    df = df.withColumn("response_text", response)
    gold_missing = (F.size(F.coalesce("gold_focus", F.array().cast("array<string>"))) == 0) | blank(F.col("gold_focus_attr")) | blank(F.col("reference_answer"))
    status = F.when(F.col("response_text").isNull(), "missing_response").when(dry_run if dry_run is not None else F.lit(False), "dry_run").when(gold_missing, "missing_gold").otherwise("ok")
    scored = score_completions(df.withColumn("status", status), "response_text")
    answered = ~F.col("status").isin("missing_response")
    ok = F.col("status") == "ok"
    scored = scored.withColumns({name: F.when(ok, F.col(name)) for name in [*WEIGHTS, "score"]})
    scored = scored.withColumn("report", F.when(answered, contract_report(F.col("parsed"), F.col("issues"))))
    return scored.withColumns({"format_score": F.when(answered, F.col("valid").cast("double")), "length_chars": F.length("response_text")})
