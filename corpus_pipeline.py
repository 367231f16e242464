"""A corpus pipeline of five stages over the documents table; each stage is written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.decontaminate import contamination
from loomwright.llm.language import UNKNOWN, identify_languages
from loomwright.llm.mixing import mix_sources
from loomwright.llm.near_dedup import near_duplicates
from loomwright.llm.token_shards import token_shards
from loomwright.llm.tokenizer_files import byte_bpe
from loomwright.storage import stored

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected as being in no known language below this posterior.
MIN_LANGUAGE_SCORE = 0.5


def _row(doc_id: str = "doc_id", text_hash: Column | None = None) -> Column:
    """What a row is known by: its doc_id, which may be null or repeated, and its text."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.xxhash64("text") if text_hash is None else text_hash)


def _only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are in ``chosen`` (doc_id, text_hash)."""
    rows = chosen.select(_row("doc_id", F.col("text_hash")).alias("chosen_row")).distinct()
    return docs.join(rows, _row() == F.col("chosen_row"), "left_semi").select(*_COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; those without letters, and those that fit no language better than the others, go.

    Rows are judged by their own text, whether doc_id is null or repeated; repeated rows stay repeated.
    """
    found = identify_languages(docs)
    return _only(docs, found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the one with the least doc_id (null last), then the least text hash.

    Rows with one doc_id, or none, are near copies only if their texts are. A text without words is a copy of
    nothing but rows with the same doc_id and text.
    """
    keyed = docs.select(*_COLUMNS, _row().alias("row"))
    groups = near_duplicates(keyed.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text_hash"), "row"))
    kept = keyed.join(groups, "row").groupBy("group").agg(first.alias("first")).select(F.col("first.row").alias("kept_row"))
    return keyed.join(kept, F.col("row") == F.col("kept_row"), "left_semi").dropDuplicates(["row"]).select(*_COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without any passage of a benchmark item; each row is judged by its own text."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _only(docs, found.where(F.size("spans") == 0))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents by the words that the mix takes of them.

    A document that the mix takes r times on average over its words appears floor(r) times, or once more where
    the hash of its id falls below what is left of r; so each source keeps its share of words.
    """
    mixed = mix_sources(docs).where("taken > 0").groupBy("doc_id", "text_hash").agg((F.sum("taken") / F.sum("size")).alias("rate"))
    draw = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    copies = mixed.withColumn("copies", F.floor(F.col("rate") + draw).cast("int")).where("copies > 0")
    copies = copies.select(F.col("doc_id").alias("mixed_id"), F.col("text_hash").alias("mixed_hash"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("mixed_id")) & (F.xxhash64("text") == F.col("mixed_hash"))
    return docs.join(copies, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*_COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as token shards and returns what they hold of each document."""
    return token_shards(docs, byte_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("decontaminate", decontamination_stage),
    ("mix", mixing_stage),
    ("tokens", token_stage),
]

#: SQL expresses neither the context trees nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
