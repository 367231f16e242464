"""Quality rules with thresholds from mergeable quantile summaries per language and source, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Rates whose adaptive thresholds decide, with the least spread that counts for each (so that a group whose
#: documents are all alike does not reject one that differs a little).
RATES = {"symbol_rate": 0.05, "dup_line_rate": 0.10, "repeat_rate": 0.10, "word_length": 1.0}
#: A rate is an outlier beyond the third quartile by so many spreads between the quartiles.
FENCE = 3.0
ACCURACY = 1000


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _windows(words: DataFrame) -> DataFrame:
    """Adds ``windows``: a hash for each three consecutive ``hashes``."""
    h = F.col("hashes")
    pairs = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    threes = F.zip_with(pairs, F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return words.withColumn("windows", F.slice(threes, 1, F.greatest(F.size(h) - 2, F.lit(0))))


def text_features(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words to ``docs``; drops text. A null text has no words.

    Repeated three-word windows are found within the row: window hashes of 64 bits, each with its place, are
    sorted, neighbours that share a hash mark repeated places, and the sorted places give the covered words as the
    sum of the gaps between them, three at most each. Nothing is exploded or shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = docs.withColumns(
        {
            "words": F.filter(F.split(text, _SPACE, -1), lambda w: w != ""),
            "n_symbols": _without(text, _SYMBOLS).cast("long"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "lines": lines,
        }
    ).drop("text")
    own = own.withColumns({"hashes": F.transform("words", lambda w: F.xxhash64(w)), "n_words": F.size("words").cast("long"), "n_lines": F.size("lines").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")}).drop("words", "lines")
    own = _windows(own).drop("hashes")
    none = F.array().cast("array<bigint>")
    own = own.withColumn("windows", F.when(F.size(F.array_distinct("windows")) == F.size("windows"), none).otherwise(F.col("windows")))
    placed = F.transform("windows", lambda x, i: F.struct(x.alias("hash"), i.cast("long").alias("at")))
    own = own.withColumn("sorted", F.sort_array(placed)).drop("windows")
    alike = F.zip_with("sorted", F.slice("sorted", 2, F.greatest(F.size("sorted"), F.lit(1))), lambda a, b: F.coalesce(a["hash"] == b["hash"], F.lit(False)))
    own = own.withColumn("alike", alike)
    marked = F.zip_with("alike", F.concat(F.array(F.lit(False)), F.col("alike")), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    places = F.filter(F.zip_with("sorted", marked, lambda v, m: F.when(v.isNotNull() & m, v["at"])), lambda p: p.isNotNull())
    own = own.withColumn("places", F.sort_array(places)).drop("sorted", "alike")
    gaps = F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(F.lit(3).cast("long"), F.coalesce(b - a, F.lit(3).cast("long"))))
    return own.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda n, g: n + g)).drop("places")


def quality_verdicts(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, fence: float = FENCE, rates: dict[str, float] = RATES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reasons) for each row of ``docs`` (doc_id, text, lang, source; other columns are ignored).

    Documents that fail the base (too few words, or mostly repeated windows) go. Of the others, each rate's
    quartiles are summarised per language and source (a null is a group of its own) with a mergeable quantile
    summary over all rows: partial summaries per task, merged by group, so a group with a third of all rows
    costs no more in one task than any other. A document goes if a rate lies above the third quartile by more
    than ``fence`` spreads, a spread being the distance between the quartiles or the rate's least spread. The
    thresholds, rounded to hundredths so that reruns agree, are joined back by group.

    Null and empty texts have zero words and fail. Repeated rows each get the same verdict.
    """
    slim = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    features = stored(text_features(slim).withColumn("base_failed", failed), "features")

    def rated(df: DataFrame) -> DataFrame:
        over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
        return df.withColumns({"symbol_rate": over("n_symbols", "word_chars"), "dup_line_rate": over("n_dup_lines", "n_lines"), "repeat_rate": over("n_repeat_words", "n_words"), "word_length": over("word_chars", "n_words")})

    quartiles = {x: F.percentile_approx(x, [0.25, 0.75], ACCURACY) for x in rates}
    found = rated(features.where("not base_failed")).groupBy("lang", "source").agg(*(q.alias(f"q_{x}") for x, q in quartiles.items()))
    limit = {x: F.round(F.col(f"q_{x}")[1] + fence * F.greatest(F.col(f"q_{x}")[1] - F.col(f"q_{x}")[0], F.lit(least)), 2) for x, least in rates.items()}
    thresholds = found.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *(v.alias(f"max_{x}") for x, v in limit.items()))
    joined = rated(features).join(thresholds, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    reasons = F.array_compact(F.array(*(F.when(F.col(x) > F.col(f"max_{x}"), F.lit(x)) for x in rates)))
    judged = joined.withColumn("reasons", reasons)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons")
