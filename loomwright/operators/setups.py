"""Setups of evaluation runs: arms, axes and the files of each, with the statistics that they ask for."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregate as A

#: Arms, axes, the metrics of the character axis, and the paths at which scores and statuses stand.
ARMS = ["Base", "SFT", "DPO", "GRPO"]
AXES = ["charactereval", "heldout", "socialbench", "ceval"]
CHARACTER_METRICS = (
    "fluency coherency consistency knowledge_exposure knowledge_accuracy knowledge_hallucination persona_behavior persona_utterance human_likeness "
    "communication_skills expression_diversity empathy mbti_accuracy"
).split()
STATUS_PATHS = ["charactereval.status", "eval.status", "status"]
SCORE_PATHS = {
    "charactereval": ["charactereval.score", "score", "mean_score"],
    "heldout": ["heldout.score", "score", "accuracy", "mean_score"],
    "socialbench": ["socialbench.accuracy", "accuracy", "score", "mean_score"],
    "ceval": ["ceval.accuracy", "accuracy", "score", "mean_score"],
}
OTHER_SCORES = ["score", "mean_score"]


@dataclass(frozen=True)
class Axis:
    name: str
    label: str
    scores: list[str]
    statuses: list[str]
    metrics: dict[str, list[str]] = field(default_factory=dict)


def listed(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def _entries(value, what: str) -> list[dict]:
    if isinstance(value, dict):
        out = [{"name": str(k)} | (dict(v) if isinstance(v, dict) else {}) for k, v in value.items()]
    elif isinstance(value, (list, tuple)):
        out = [dict(v) if isinstance(v, dict) else {"name": str(v)} for v in value]
    else:
        raise ValueError(f"{what} must be a list or an object")
    if any(not str(e.get("name") or "").strip() for e in out):
        raise ValueError(f"{what} need names")
    twice = sorted(n for n, k in Counter(str(e["name"]) for e in out).items() if k > 1)
    if twice:
        raise ValueError(f"{what} named twice: {', '.join(twice)}")
    return out


def arms(config: dict) -> list[dict]:
    """The arms of a setup, as objects with a name."""
    return _entries(config.get("arms") or ARMS, "arms")


def metric_paths(axis: str, metric: str) -> list[str]:
    return [f"{axis}.metrics.{metric}", f"{axis}.{metric}", f"metrics.{metric}", metric]


def axes(config: dict) -> list[Axis]:
    """The axes of a setup with the paths of their scores, statuses and metrics, the usual ones where it names none."""
    out = []
    for e in _entries(config.get("axes") or AXES, "axes"):
        name = str(e["name"]).strip()
        if isinstance(e.get("metric_fields"), dict):
            metrics = {str(m): [str(p) for p in listed(ps)] for m, ps in e["metric_fields"].items()}
        else:
            named = e.get("future_metrics", CHARACTER_METRICS if name == "charactereval" else ())
            metrics = {str(m): metric_paths(name, str(m)) for m in listed(named)}
        out.append(Axis(name, str(e.get("label") or name), [str(p) for p in listed(e.get("score_fields", SCORE_PATHS.get(name, OTHER_SCORES)))], [str(p) for p in listed(e.get("status_fields", STATUS_PATHS))], metrics))
    return out


def input_paths(config: dict) -> dict[tuple[str, str], list[str]]:
    """The files of each arm and axis, from the axes' inputs, the arms' results and the list of result files, each once."""
    text = lambda v: [str(x.get("path") if isinstance(x, dict) else x) for x in listed(v)]
    found = {(str(a["name"]), x.name): [] for a in arms(config) for x in axes(config)}
    for e in _entries(config["axes"], "axes") if config.get("axes") else []:
        for arm, value in (e.get("inputs") or {}).items():
            found.setdefault((str(arm), str(e["name"])), []).extend(text(value))
    for a in arms(config):
        for axis, value in (a.get("results") or {}).items():
            found.setdefault((str(a["name"]), str(axis)), []).extend(text(value))
    for item in listed(config.get("result_files")):
        if not isinstance(item, dict) or not str(item.get("arm") or "").strip() or not str(item.get("axis") or "").strip():
            raise ValueError("result files need arm and axis")
        found.setdefault((str(item["arm"]), str(item["axis"])), []).extend(text(item))
    return {k: list(dict.fromkeys(v)) for k, v in found.items()}


def scored_rows(rows: DataFrame, axis: Axis) -> DataFrame:
    """Adds score, status and a struct of metrics to rows (arm, axis, json): the first number at each list of paths; a status without one is ok with a score."""
    json = F.col("json")
    status = F.coalesce(*(F.nullif(F.trim(A.path_text(json, p)), F.lit("")) for p in axis.statuses), F.lit(None).cast("string"))
    out = rows.where(F.col("axis") == axis.name).withColumn("score", A.first_number(json, axis.scores))
    out = out.withColumn("status", F.coalesce(status, F.when(F.col("score").isNotNull(), "ok").otherwise("missing_status")))
    metrics = [F.struct(F.lit(m).alias("metric"), A.first_number(json, p).alias("value")) for m, p in axis.metrics.items()]
    return out.withColumn("metrics", F.array(*metrics) if metrics else F.array().cast("array<struct<metric:string,value:double>>"))


def all_scored_rows(rows: DataFrame, config: dict) -> DataFrame:
    """``scored_rows`` of every axis; rows of axes that the setup doesn't have are left out."""
    out = None
    for axis in axes(config):
        own = scored_rows(rows, axis)
        out = own if out is None else out.unionByName(own)
    return out


def slot_stats(scored: DataFrame) -> DataFrame:
    """(arm, axis, metric, with_values, mean, lowest, highest) for every metric that an axis asks for."""
    long = scored.select("arm", "axis", F.explode("metrics").alias("m")).select("arm", "axis", "m.*")
    return long.groupBy("arm", "axis", "metric").agg(F.count("value").alias("with_values"), F.avg("value").alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


def status_table(scored: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """(arm, axis, status, n), with the files that could not be read: ``missing`` (arm, axis, status missing_file or file_error)."""
    rows = scored.select("arm", "axis", "status")
    rows = rows if missing is None else rows.unionByName(missing.select("arm", "axis", "status"))
    return rows.groupBy("arm", "axis", "status").agg(F.count("*").alias("n"))


def missing_files(files: DataFrame, allowed: bool) -> DataFrame:
    """(arm, axis, status) of files (arm, axis, path, found, readable) that are missing or can't be read; unless that is allowed, the query fails."""
    status = F.when(~F.col("found"), "missing_file").when(~F.col("readable"), "file_error")
    bad = files.withColumn("status", status).where("status is not null")
    if not allowed:
        bad = bad.withColumn("status", F.raise_error(F.concat("path", F.lit(": "), "status")).cast("string"))
    return bad.select("arm", "axis", "status")
