"""Arms by axes: score statistics, status counts, metric slots, deltas and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_NUMBER = r"^\s*[+-]?(\d+(_?\d+)*\.?(\d+(_?\d+)*)?|\.\d+(_?\d+)*)([eE][+-]?\d+)?\s*$"


def as_number(value: Column) -> Column:
    """A finite number from a text; words like nan and inf, and types like 1d, are none."""
    return F.when(value.rlike(_NUMBER), F.regexp_replace(F.trim(value), "_", "").try_cast("double"))


def path_text(json: Column, path: str) -> Column:
    """The value at a dotted path; a key with the dots in its name comes first. Booleans and nulls are none."""
    literal = F.get_json_object(json, f"$['{path}']")
    return F.coalesce(literal, F.get_json_object(json, "$." + path)) if "." in path else literal


def first_number(json: Column, paths: list[str]) -> Column:
    return F.coalesce(*(as_number(path_text(json, p)) for p in paths))


def bucket_stats(rows: DataFrame, arms: list[str], axes: list[str]) -> DataFrame:
    """(arm, axis, n, scored, mean, lowest, highest) for every arm and axis, those without rows too; rows have arm, axis and score."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, x) for a in arms for x in axes], "arm string, axis string")
    sums = rows.groupBy("arm", "axis").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.avg("score").alias("mean"), F.min("score").alias("lowest"), F.max("score").alias("highest"))
    return F.broadcast(grid).join(sums, ["arm", "axis"], "left").fillna(0, ["n", "scored"])


def with_deltas(stats: DataFrame, baselines: list[str]) -> DataFrame:
    """Adds ``delta_vs_<arm>``: the mean less that arm's on the same axis, null where either is missing."""
    own = Window.partitionBy("axis")
    return stats.withColumns({f"delta_vs_{b}": F.col("mean") - F.max(F.when(F.col("arm") == b, F.col("mean"))).over(own) for b in baselines})


def status_counts(rows: DataFrame, status: Column) -> DataFrame:
    return rows.withColumn("status", status).groupBy("arm", "axis", "status").agg(F.count("*").alias("n"))


def metric_slots(rows: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(arm, axis, metric, with_values, mean, lowest, highest) for every metric of every bucket; one pass, one shuffle."""
    long = rows.select("arm", "axis", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()))).alias("x")).select("arm", "axis", "x.*")
    return long.groupBy("arm", "axis", "metric").agg(F.count("value").alias("with_values"), F.avg("value").alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


def verdicts(rows: DataFrame, passed: Column, least_rows: int, least_rate: float, trained: list[str]) -> DataFrame:
    """(arm, n, rate, verdict): PASS for enough rows and, for trained arms, a high enough rate."""
    sums = rows.groupBy("arm").agg(F.count("*").alias("n"), F.avg(passed.cast("double")).alias("rate"))
    ok = (F.col("n") >= least_rows) & (~F.col("arm").isin(trained) | (F.col("rate") >= least_rate))
    return sums.withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))
