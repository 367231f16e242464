"""Finding input files, rows of metrics files, and small outputs of a run: summaries, tables, packages."""

from __future__ import annotations

import hashlib
import io
import json
import time
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import METRIC_KEYS, SUFFIXES, read_document, read_lines

#: What is never packed.
FORBIDDEN_ROOTS, FORBIDDEN_SUFFIX = ["work", "backups", ".git"], ".safetensors"


def _files(spark: SparkSession, path: str) -> tuple[bool, bool, list[str]]:
    """(exists, is a folder, files under it in order), by the store's own listing."""
    jvm, at = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return False, False, []
    if not fs.getFileStatus(at).isDirectory():
        return True, False, [path]
    found, listed = [], fs.listFiles(at, True)
    while listed.hasNext():
        found.append(listed.next().getPath().toString())
    del jvm
    return True, True, sorted(found)


def expand_inputs(spark: SparkSession, paths: list[str], kind: str = "data") -> list[str]:
    """The files of ``paths`` in order, folders searched for the suffixes of ``kind``.

    A path that doesn't exist stays in the list, but for kind ledger, which takes any file. A single file stays
    whatever its suffix, but for kind eval.
    """
    suffixes = SUFFIXES[kind]
    fits = lambda f: suffixes is None or f.rsplit("/", 1)[-1].rpartition(".")[2].lower() in suffixes
    out: list[str] = []
    for path in paths:
        exists, folder, files = _files(spark, path)
        if not exists:
            out += [] if kind == "ledger" else [path]
        elif folder:
            out += [f for f in files if fits(f)]
        elif kind != "eval" or fits(path):
            out.append(path)
    return out


def metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, record) of a metrics file: JSON lines, a list, the first list among the usual keys, or one object; every row must be an object."""
    if path.lower().endswith(".jsonl"):
        return read_lines(spark, path).select("path", (F.col("line") - 1).alias("index"), "record")
    rows = read_document(spark, path, METRIC_KEYS)
    good = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    wrong = F.raise_error(F.concat("path", F.lit(": item "), F.col("index").cast("string"), F.lit(" is not an object"))).cast("variant")
    return rows.select("path", F.col("index").cast("long").alias("index"), F.when(good, F.col("record")).otherwise(wrong).alias("record"))


def _write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()


def write_summary(spark: SparkSession, path: str, summary: dict) -> None:
    """A summary as an indented JSON document with sorted keys, to any store."""
    _write_bytes(spark, path, (json.dumps(summary, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def short_number(value: float | None) -> str:
    return "NA" if value is None else f"{float(value):.6g}"


def markdown_table(title: str, rows: list[dict], notes: list[str] | None = None) -> str:
    """The statistics of arms by axes (a few rows, collected) as a Markdown table, always with the deltas against SFT and Base."""
    head = ["arm", "axis", "n", "score_n", "mean", "delta_vs_SFT", "delta_vs_Base", "status_counts", "metric_slots"]
    lines = [f"# {title}", *(f"> {n}" for n in notes or [] if n.strip()), "", "| " + " | ".join(head) + " |", "|---|---|---:|---:|---:|---:|---:|---|---:|"]
    for r in rows:
        counts = ", ".join(f"{k}:{v}" for k, v in sorted((r.get("status_counts") or {}).items())) or "NA"
        numbers = [short_number(r.get(k)) for k in ("mean", "delta_vs_SFT", "delta_vs_Base")]
        lines.append("| " + " | ".join([r["arm"], r["axis"], str(r["n"]), str(r["scored"]), *numbers, counts, f"{r.get('with_values', 0)}/{r.get('configured', 0)}"]) + " |")
    return "\n".join(lines) + "\n"


def safe_entry(name: str) -> bool:
    """Whether a name may stand in a package: inside it, in no working folder, and no weights."""
    parts = name.split("/")
    return not (name.startswith("/") or ".." in parts or parts[0] in FORBIDDEN_ROOTS or name.endswith(FORBIDDEN_SUFFIX))


def write_package(spark: SparkSession, path: str, files: dict[str, bytes]) -> str:
    """A zip of small files by name, with its SHA-256 beside it; returns the digest. A name that isn't safe is an error."""
    bad = [n for n in files if not safe_entry(n)]
    if bad:
        raise ValueError(f"unsafe package entries: {bad}")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name), files[name])
    digest = hashlib.sha256(held.getvalue()).hexdigest()
    _write_bytes(spark, path, held.getvalue())
    _write_bytes(spark, f"{path}.sha256", f"{digest}  {path.rsplit('/', 1)[-1]}\n".encode())
    return digest


def load_config(spark: SparkSession, path: str) -> dict:
    """A JSON or YAML document that is an object; YAML needs its library."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    text = spark.read.text(at.toString(), wholetext=True).first()[0]
    if path.lower().endswith(".json"):
        value = json.loads(text)
    else:
        try:
            import yaml
        except ImportError:
            value = json.loads(text)  # JSON is YAML too
        else:
            value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path}: not an object")
    return value


def synthesize(seeds: DataFrame, prompt: Column, call, retries: int = 2, pause: float = 2.0) -> DataFrame:
    """Adds ``reply`` and ``error`` to seeds by ``call`` (prompt -> text), an injected function; failures are tried again after growing pauses."""
    @F.pandas_udf("struct<reply:string,error:string>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        out = []
        for text in prompts:
            last = None
            for attempt in range(retries + 1):
                if attempt:
                    time.sleep(pause * attempt)
                try:
                    out.append((call(text), None))
                    break
                except Exception as e:  # noqa: BLE001  whatever the service raises
                    last = f"{type(e).__name__}: {e}"
            else:
                out.append((None, last))
        return pd.DataFrame(out, columns=["reply", "error"])

    return seeds.withColumn("synthesis", run(prompt)).select("*", "synthesis.*").drop("synthesis")
