"""Text functions with Python's ideas of white space and case, as Columns."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 29 code points that Python's str.strip() and \s take as white space, as a regex class body.
PY_WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same in RE2's syntax, for DuckDB.
PY_WS_RE2 = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CJK = r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"


def py_strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{PY_WS}]+|[{PY_WS}]+$", "")


def squash(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, f"[{PY_WS}]+", "")


def blank(text: Column) -> Column:
    """True for null and for nothing but white space."""
    return F.coalesce(py_strip(text) == "", F.lit(True))


def first_nonempty(*texts: Column, default: str | None = None) -> Column:
    """The first text that is not blank, stripped."""
    return F.coalesce(*(F.nullif(py_strip(t), F.lit("")) for t in texts), F.lit(default))


def has_cjk(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(_CJK)), F.lit(False))


#: Texts are freed of so many different characters by one pass each; one with more goes character by character.
_PASSES = 64
_ASCII_DROPPED = bytes(c for c in range(128) if unicodedata.category(chr(c))[0] in "PSZC")


class _Dropped(dict):
    """For ``str.translate``: None for the code points that are dropped, learned as they are met."""

    def __missing__(self, point: int) -> int | None:
        return self.setdefault(point, None if unicodedata.category(chr(point))[0] in "PSZC" else point)


def _normal(text: str, points: _Dropped) -> str:
    if text.isascii():
        return text.lower().encode().translate(None, _ASCII_DROPPED).decode()
    folded = unicodedata.normalize("NFKC", text).casefold()
    gone = [x for x in set(folded) if points[ord(x)] is None]
    if len(gone) > _PASSES:
        return folded.translate(points)
    for x in gone:
        folded = folded.replace(x, "")
    return folded


@F.arrow_udf(T.StringType())
def normalize_text(texts: pa.Array) -> pa.Array:
    """NFKC, full case folding, then punctuation, symbols, separators and control characters dropped.

    Arrow batches. Not an iterator of them, as Spark gives each of those a Python worker of its own, so that a plan with
    several texts has as many workers a task; plain ones share one.
    """
    points = _Dropped()
    return pa.array([None if x is None else _normal(x, points) for x in texts.to_pylist()], pa.string())


#: Its name from when plain texts had a way of their own.
normalize_text_exact = normalize_text


def with_normal_text(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with ``normalize_text`` of a column as another."""
    return rows.withColumn(name, normalize_text(F.col(text)))


def record_text(fields: list[Column], turns: Column) -> Column:
    """What duplicates are compared by: the given fields, then role and content of each turn, a line each; nulls are left out, but not those of turns."""
    said = F.flatten(F.transform(turns, lambda t: F.array(F.coalesce(t["role"], F.lit("")), F.coalesce(t["content"], F.lit("")))))
    return F.concat_ws("\n", F.array_compact(F.array(*fields)), F.coalesce(said, F.array().cast("array<string>")))


def char_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams; of a text no longer than n, its distinct characters."""
    size = F.char_length(text)
    letters = F.split(text, "")
    grams = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).when(size <= n, F.array_distinct(letters)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays: 1 for two empty ones, 0 for one."""
    common, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(common / both)
