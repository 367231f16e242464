"""Deterministic splits, caps and quotas by ranks and running counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import stored


#: Hexadecimal digits by which a selection narrows its candidates in a round, and candidates that the driver sorts.
_DIGITS, _SORTED = 4, 4096


def kth_digest(keys: DataFrame, k: int) -> tuple[str, Any] | None:
    """The ``k``-th (digest, key) of distinct ``keys`` (digest as lower-case hexadecimal, key) in their order; None if there are fewer, or for k of 0.

    Nothing is sorted or ranked: a round counts the candidates by their next digits, as many counts as those digits
    have values, and goes on with those in the range that holds the k-th. When few are left they are sorted.
    """
    if k < 1:
        return None
    prefix = ""
    while True:
        some = keys.where(F.startswith("digest", F.lit(prefix)))
        counts = dict(some.groupBy(F.substring("digest", len(prefix) + 1, _DIGITS).alias("next")).count().collect())
        for value in sorted(counts):
            if k <= counts[value]:
                break
            k -= counts[value]
        else:
            return None
        prefix += value
        if counts[value] <= _SORTED or not value:
            left = keys.where(F.startswith("digest", F.lit(prefix))).select("digest", "key").orderBy("digest", "key").limit(k).collect()
            return tuple(left[k - 1])


def up_to(threshold: tuple[str, Any] | None) -> Column:
    """Whether (digest, key) is at or before a result of ``kth_digest``."""
    if threshold is None:
        return F.lit(False)
    digest, key = (F.lit(x) for x in threshold)
    return (F.col("digest") < digest) | ((F.col("digest") == digest) & (F.col("key") <= key))


def hash_fraction(rows: DataFrame, key: Column, fraction: float) -> DataFrame:
    """(key, heldout): distinct keys ordered by SHA-256, the first round(n * fraction) held out, at least one and never all.

    The last key held out is found by selection (``kth_digest``). The query fails where there are fewer than two keys.
    """
    keys = stored(rows.select(key.alias("key")).distinct().withColumn("digest", F.sha2("key", 256)), "keys")
    total = keys.where("key is not null").count()
    if total < 2:
        raise ValueError("a split needs two keys at least")
    wanted = min(max(1, round(total * fraction)), total - 1)
    return keys.select("key", F.coalesce(up_to(kth_digest(keys, wanted)), F.lit(False)).alias("heldout"))


def capped(rows: DataFrame, key: str, order: str, per_key: int = 0, limit: int = 0) -> DataFrame:
    """The first ``per_key`` rows of each key, then the first ``limit`` of all, in the order of ``order``; 0 is no cap."""
    if per_key > 0:
        rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__k") <= per_key).drop("__k")
    return rows.orderBy(order).limit(limit) if limit > 0 else rows


def ordered_reasons(rows: DataFrame, key: str, order: str, usable: Column, leaks: Column, has_reference: Column, per_key: int, limit: int) -> DataFrame:
    """Adds ``reason``: why a row is skipped, or ``kept``; rows after the one that fills ``limit`` are left out.

    The cap per key counts accepted rows only, so a row is over the cap when as many acceptable rows of its key
    come before it.
    """
    fit = usable & ~leaks & has_reference
    marked = rows.withColumns({"__usable": usable, "__fit": F.coalesce(fit, F.lit(False)), "__leaks": leaks})
    prior = F.coalesce(F.sum(F.col("__fit").cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = marked.withColumn("__prior", prior)
    reason = F.when(~F.col("__usable"), "unusable").when((F.lit(per_key) > 0) & (F.col("__prior") >= per_key), "max_per_character").when(F.col("__leaks"), "leakage").when(~F.col("__fit"), "missing_reference").otherwise("kept")
    marked = marked.withColumn("reason", reason).drop("__usable", "__fit", "__leaks", "__prior")
    # the row that fills the limit is found by a bounded top-k; everything after it is cut off
    last = marked.where("reason = 'kept'").select(order).orderBy(order).limit(max(limit, 1)).agg(F.max(order).alias("__last"), F.count("*").alias("__n"))
    return marked.join(F.broadcast(last), (F.col("__n") < max(limit, 1)) | (F.col(order) <= F.col("__last"))).drop("__last", "__n")


def hamilton(total: Column, ratios: dict[str, float]) -> Column:
    """Largest-remainder quotas as an array of (split, quota)."""
    size = sum(ratios.values())
    order = sorted(ratios, reverse=True)
    shares = F.array(*(F.struct(F.lit(k).alias("split"), F.lit(ratios[k] / size).alias("ratio"), (total * F.lit(ratios[k] / size)).alias("raw")) for k in order))
    ranked = F.array_sort(F.transform(shares, lambda s: F.struct((F.floor(s["raw"]) - s["raw"]).alias("need"), (-s["ratio"]).alias("ratio"), s["split"].alias("split"), F.floor(s["raw"]).alias("floor"))), _by_need)
    given = F.aggregate(ranked, F.lit(0).cast("long"), lambda n, s: n + s["floor"])
    return F.transform(ranked, lambda s, i: F.struct(s["split"].alias("split"), (s["floor"] + F.when(i < total - given, 1).otherwise(0)).alias("quota")))


def _by_need(a: Column, b: Column) -> Column:
    less = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    return F.coalesce(less(a["need"], b["need"]), less(a["ratio"], b["ratio"]), less(b["split"], a["split"]), F.lit(0))


@F.pandas_udf(T.StringType())
def blake2b_8(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The 8-byte BLAKE2b digest as hex; no JVM function has it."""
    for batch in texts:
        yield batch.map(lambda x: hashlib.blake2b(x.encode(), digest_size=8).hexdigest(), na_action="ignore")


def work_disjoint_split(records: DataFrame, ratios: dict[str, float], reserved: Column | None = None) -> DataFrame:
    """(source_work, split): works in the order of their BLAKE2b digests take the quotas of sft, reward and eval_heldout in turn; reserved works are all held out.

    Works are told apart by the digests of the last one of each quota, which are found by selection (``kth_digest``);
    records are only aggregated.
    """
    named = records.where("trim(character) <> ''").withColumn("work", F.trim(F.coalesce(F.nullif("source_work", F.lit("")), "character")))
    groups = named.groupBy("work").agg(F.bool_or(reserved if reserved is not None else F.lit(False)).alias("reserved"))
    open_ = stored(groups.where("not reserved").select(F.col("work").alias("key"), blake2b_8(F.col("work")).alias("digest")), "digests")
    total = open_.count()
    quota = records.sparkSession.range(1).select(F.map_from_entries(hamilton(F.lit(total).cast("long"), ratios))).first()[0]
    first, second = (up_to(kth_digest(open_, n)) for n in (quota["sft"], quota["sft"] + quota["reward"]))
    placed = open_.select(F.col("key").alias("source_work"), F.when(first, "sft").when(second, "reward").otherwise("eval_heldout").alias("split"))
    return placed.unionByName(groups.where("reserved").select(F.col("work").alias("source_work"), F.lit("eval_heldout").alias("split")))


def existing_split(records: DataFrame, order: str, held_out: list[str]) -> tuple[DataFrame, DataFrame]:
    """((split, character), (character, source_work)) of records that name their splits; characters of ``held_out`` are held out wherever they stand, and a character's last work counts."""
    named = records.where("trim(character) <> ''").withColumn("character", F.trim("character"))
    split = F.when(F.col("character").isin(held_out), "eval_heldout").otherwise(F.col("split"))
    works = named.where("trim(source_work) <> ''").groupBy("character").agg(F.max_by(F.trim("source_work"), order).alias("source_work"))
    return named.select(split.alias("split"), "character").distinct(), works


def character_split(records: DataFrame, ratios: dict[str, float], order: str, splits: list[str], held_out: list[str], reserved: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((split, character), (character, source_work)): the records' own splits if each of them names one of ``splits``, else ``work_disjoint_split``."""
    whole = records.agg(F.coalesce(F.bool_and(F.coalesce(F.col("split").isin(splits), F.lit(False))), F.lit(False))).first()[0]
    if whole:
        return existing_split(records, order, held_out)
    named = records.where("trim(character) <> ''").select(F.trim("character").alias("character"), F.trim(F.coalesce(F.nullif("source_work", F.lit("")), "character")).alias("source_work")).distinct()
    placed = work_disjoint_split(records, ratios, F.col("character").isin(held_out) | (reserved if reserved is not None else F.lit(False)))
    return named.join(placed, "source_work").select("split", "character").distinct(), named.select("character", "source_work")


def merged_map(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Two maps as tables of the same columns; where both have a key, the new one's row counts."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def only_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``keys``."""
    return rows.join(keys.select(key), key, "left_semi")


def doubled_entries(table: DataFrame, group: str, entry: str) -> DataFrame:
    """(group) for each group that has an entry more than once."""
    return table.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(entry).alias("k")).where("n <> k").select(group)


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been done: what a resumed run still has to do."""
    return rows.join(done.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without those that ``new`` replaces, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def not_seen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows none of whose ``keys`` occurs in the same column of ``seen``."""
    for key in keys:
        rows = rows.join(seen.select(key).distinct(), key, "left_anti")
    return rows
