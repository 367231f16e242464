"""Queries over readers, input discovery and evaluation setups, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import setups as U
from ..sources import files, inputs
from ..operators.validate import PLACEHOLDERS
from ..sources.record_lines import first_records, load_records, write_records
from ..sources.walk import discover_records, placeholders_within
from ..storage import new_path
from .build_queries import SQL as BUILD_SQL
from .build_queries import _typed
from .views import ctes, table, view, view_of


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


def _got(rows: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    return rows.select(files.variant_text("record", item).cast("long").alias("item_id"), files.variant_text("record", text).alias("text"))


def _documents(spark: SparkSession, sf_dir: str, body: Column) -> str:
    """A JSON document for each of a few groups of rows."""
    path = new_path(spark, "documents")
    rows = _benchmark(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(5))).groupBy("part").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    rows.select(F.to_json(body).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "csv")
    _benchmark(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return files.read_table(spark, path).select(F.col("item_id").cast("long").alias("item_id"), "text")


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _got(files.read_document(spark, _documents(spark, sf_dir, F.struct(F.lit("x").alias("name"), F.col("items").alias("examples")))))


def metric_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _got(inputs.metric_rows(spark, _documents(spark, sf_dir, F.struct(F.col("items").alias("results")))))


def discovered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records at any depth of a document."""
    items = F.transform("items", lambda x: F.struct(x["item_id"].cast("string").alias("question"), x["text"].alias("answer"), F.lit("1").alias("A")))
    body = F.struct(F.lit("y").alias("question"), F.struct(F.array(F.struct(items.alias("rows"))).alias("deep"), F.lit(1).alias("n")).alias("more"))
    return _got(discover_records(spark, _documents(spark, sf_dir, body)), "question", "answer")


#: JSON of many shapes, read alike by both engines.
_SHAPES = """
select rid, case rid % 6 when 0 then concat('{"question": "', f1, '", "A": "', persona, '", "inner": {"role": "r", "input": "todo"}}')
  when 1 then concat('{"zeta": [{"deep": [{"role": "', persona, '", "prompt": "', f2, '"}, 7, null]}], "alpha": {"name": "Tbd ', persona, '", "target": ', rid, '}}')
  when 2 then concat('[[{"character_name": "', persona, '", "character_profile": "b", "dialogue": []}], {"choices": [1, "fill_me"], "label": "', f1, '"}, null]')
  when 3 then '{"a": {"b": {"c": [1, 2.5, true, "to do", {"d": ["x TODO y"]}]}}}' when 4 then concat('"', id, '"') else '[]' end as json
from records
"""


def walked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records at any depth of a few large documents, numbered in their order."""
    path = new_path(spark, "shapes")
    shapes = view_of(spark, sf_dir, _SHAPES).groupBy(F.pmod("rid", F.lit(3))).agg(F.array_sort(F.collect_list(F.struct("rid", "json"))).alias("items"))
    body = F.concat(F.lit("["), F.array_join(F.col("items.json"), ", "), F.lit("]"))
    shapes.select(body.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    names = ["question", "role", "name", "character_name", "label"]
    return discover_records(spark, path).select("index", F.coalesce(*(F.try_variant_get("record", f"$.{n}", "string") for n in names)).alias("first"))


def placeholders_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a placeholder marker at any depth of records of any shape."""
    rows = view_of(spark, sf_dir, _SHAPES).select("rid", F.parse_json("json").alias("record"))
    return placeholders_within(rows, "rid", "record", PLACEHOLDERS)


def expanded_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a folder of JSON lines and other files gives, and what they hold."""
    path = new_path(spark, "inputs")
    _benchmark(spark, sf_dir).repartition(2).select(F.to_json(F.struct("item_id", "text")).alias("value")).write.text(f"{path}/a")
    for k, file in enumerate(inputs.expand_inputs(spark, [f"{path}/a"], "ledger")):
        if file.endswith(".txt"):
            data = spark.read.text(file, wholetext=True).first()
            inputs._write_bytes(spark, f"{path}/lines/b{k}.JSONL", data[0].encode() if data else b"")
    return _got(files.read_lines(spark, inputs.expand_inputs(spark, [f"{path}/lines"], "data")))


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers through files that many tasks write and read, each a range of the rows: each once, in the order of the rows."""
    path = new_path(spark, "lines")
    table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").select(F.col("o_orderkey").cast("string").alias("value")).write.text(path)
    return files.numbered_lines(spark, path, through=True).select(F.col("line").cast("long").alias("line"), F.col("value").cast("long").alias("o_orderkey"))


def tolerant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before the first broken line of a file."""
    path = new_path(spark, "broken")
    body = F.when(F.col("item_id") == 7, "{broken").otherwise(F.to_json(F.struct("item_id", "text")))
    _benchmark(spark, sf_dir).coalesce(1).sortWithinPartitions("item_id").select(body.alias("value")).write.text(path)
    return _got(files.read_tolerant(spark, path))


def loaded_record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written by the data source and loaded from their lines; each error names its line."""
    path = new_path(spark, "records")
    write_records(_typed(spark, sf_dir), path)
    rows = load_records(spark, path, range_bytes=1 << 16).select(F.try_variant_get("record", "$.rid", "long").alias("rid"), "line", F.posexplode_outer("errors").alias("at", "error"))
    head = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "))
    return rows.where(F.startswith("error", head)).select("rid", F.col("at").cast("long").alias("at"), F.replace("error", head, F.lit("")).alias("error"))


def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a folder that hold no record, counted by what is wrong with them, beside those that do."""
    path = new_path(spark, "broken-lines")
    line = F.when(F.col("o_orderkey") % 7 == 0, "[1, 2]").when(F.col("o_orderkey") % 11 == 0, '{"open": ').when(F.col("o_orderkey") % 13 == 0, " ").otherwise(F.to_json(F.struct("o_orderkey")))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    rows = load_records(spark, path, validate=False, range_bytes=1 << 18)
    return rows.select(F.regexp_replace(F.get("errors", F.lit(0)), "^line [0-9]+: ", "").alias("error"), F.try_variant_get("record", "$.o_orderkey", "long").alias("key")).groupBy("error").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of many files one after another; most of the files are never opened."""
    path = new_path(spark, "first-lines")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    write_records(orders.repartitionByRange(24, "o_orderkey").sortWithinPartitions("o_orderkey"), path)
    rows = first_records(spark, path, 1000)
    return rows.select(*(F.try_variant_get("record", f"$.{c}", "long").alias(c) for c in orders.columns))


def sorted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of JSON lines of nested records: keys in order at every level."""
    path = new_path(spark, "sorted")
    rows = view(spark, sf_dir, "records").select("rid", F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))).alias("turns"), F.col("rejected_answer").alias("lost")).alias("body"), "persona")
    files.write_lines(rows, path)
    return spark.read.text(path).select(F.sha2("value", 256).alias("digest"))


def _setup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "rollouts").select("rid", "arm", "axis")
    own = F.struct(F.struct((F.col("rid") % 5).alias("fluency")).alias("metrics"), F.when(F.col("rid") % 2 == 0, F.lit("0.5")).alias("score"))
    body = F.struct(F.when(F.col("rid") % 3 > 0, own).alias("charactereval"), F.when(F.col("rid") % 3 == 0, F.struct(F.lit("bad").alias("empathy"), F.lit(2).alias("coherency"))).alias("metrics"), (F.col("rid") % 7).alias("accuracy"), F.when(F.col("rid") % 4 == 0, F.lit("error")).alias("status"), F.lit(True).alias("mean_score"))
    return U.all_scored_rows(rows.withColumn("json", F.to_json(body)), {"axes": {"charactereval": {}, "heldout": {"label": "Held out"}}})


def setup_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _setup_rows(spark, sf_dir).select("rid", "axis", "score", "status")


def setup_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.slot_stats(_setup_rows(spark, sf_dir)).select("arm", "axis", "metric", "with_values", F.round("mean", 9).alias("mean"), "lowest", "highest")


def setup_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts with those of two files that could not be read."""
    gone = spark.createDataFrame([("DPO", "heldout", "a.jsonl", False, False), ("DPO", "heldout", "b.jsonl", True, False), ("SFT", "heldout", "c.jsonl", True, True)], "arm string, axis string, path string, found boolean, readable boolean")
    return U.status_table(_setup_rows(spark, sf_dir), U.missing_files(gone, allowed=True))


QUERIES = {f.__name__: f for f in (csv_round_trip, document_items, metric_items, discovered_records, expanded_inputs, numbered_lines, tolerant_lines, loaded_record_errors, broken_lines, first_lines, sorted_lines, walked_documents, placeholders_anywhere, setup_scores, setup_slots, setup_statuses)}

#: Children of a JSON value with their place and name, for DuckDB.
_STEPS = """select w.*, unnest(range(json_array_length(w.v)::bigint)) as i, null as k, unnest(json_extract(w.v, '$[*]')) as child from w where json_type(w.v) = 'ARRAY' and not w.stop
  union all select w.*, unnest(range(len(json_keys(w.v)))) as i, unnest(json_keys(w.v)) as k, unnest(list_transform(json_keys(w.v), lambda n: json_extract(w.v, concat('$."', n, '"')))) as child from w where json_type(w.v) = 'OBJECT' and not w.stop"""
_LIKE = "coalesce(json_type({v}) = 'OBJECT' and ((list_has_any(json_keys({v}), ['question', 'prompt', 'label', 'target', 'input']) and list_has_any(json_keys({v}), ['A', 'choices', 'role', 'name'])) or list_has_all(json_keys({v}), ['character_name', 'character_profile', 'dialogue'])), false)"
_ROWS = "select item_id, text from benchmark"
_SCORED = f"""with {ctes('rollouts')}, s as (select rid, arm, axis, case when axis = 'charactereval' then case when rid % 3 > 0 and rid % 2 = 0 then 0.5 end else (rid % 7)::double end as score, case when rid % 4 = 0 then 'error' end as given from rollouts where axis in ('charactereval', 'heldout')),
f as (select *, coalesce(given, case when score is not null then 'ok' else 'missing_status' end) as status from s)"""
SQL = {
    "csv_round_trip": _ROWS,
    "document_items": _ROWS,
    "metric_items": _ROWS,
    "discovered_records": _ROWS,
    "expanded_inputs": _ROWS,
    "numbered_lines": "select row_number() over (order by o_orderkey) as line, o_orderkey from orders",
    "tolerant_lines": f"{_ROWS} where item_id < coalesce((select item_id from benchmark where item_id = 7), 1e18)",
    "loaded_record_errors": BUILD_SQL["schema_errors"],
    "broken_lines": """with l as (select o_orderkey as k, case when o_orderkey % 7 = 0 then 'record must be a JSON object' when o_orderkey % 11 = 0 then 'invalid JSON: Expecting value' end as error, o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 and o_orderkey % 13 = 0 as blank from orders)
select error, count(*) as n, sum(case when error is null then k end)::bigint as keys from l where not blank group by error""",
    "first_lines": "select o_orderkey, o_custkey from orders order by o_orderkey limit 1000",
    "sorted_lines": f"with {ctes('records')} select sha256(cast(to_json({{'body': {{'lost': rejected_answer, 'turns': [{{'content': question, 'role': 'user'}}]}}, 'persona': persona, 'rid': rid}}) as varchar)) as digest from records",
    "walked_documents": f"""with recursive {ctes('records')}, shapes as ({_SHAPES}), docs as (select rid % 3 as part, concat('[', string_agg(json, ', ' order by rid), ']')::json as v from shapes group by 1),
w(part, place, v, stop) as (select part, ''::varchar, v, false from docs union all select part, concat(place, printf('%08d', i)), child, {_LIKE.format(v='child')} from ({_STEPS}))
select row_number() over (partition by part order by place) - 1 as index, coalesce(json_extract_string(v, '$.question'), json_extract_string(v, '$.role'), json_extract_string(v, '$.name'), json_extract_string(v, '$.character_name'), json_extract_string(v, '$.label')) as first from w where stop""",
    "placeholders_anywhere": f"""with recursive {ctes('records')}, shapes as ({_SHAPES}),
w(rid, field, v, stop) as (select rid, ''::varchar, json::json, false from shapes union all select rid, concat(field, case when k is null then concat('[', i, ']') when field = '' then k else concat('.', k) end), child, false from ({_STEPS}))
select rid, case when field = '' then '<record>' else field end as field from w where json_type(v) = 'VARCHAR' and regexp_matches(json_extract_string(v, '$'), '(?i){'|'.join(PLACEHOLDERS)}')""",
    "setup_scores": f"{_SCORED} select rid, axis, score, status from f",
    "setup_slots": f"""with {ctes('rollouts')}, m as (select unnest([{', '.join(f"'{m}'" for m in U.CHARACTER_METRICS)}]) as metric),
v as (select arm, axis, metric, case when metric = 'fluency' and rid % 3 > 0 then (rid % 5)::double when metric = 'coherency' and rid % 3 = 0 then 2.0::double end as value from rollouts, m where axis = 'charactereval')
select arm, axis, metric, count(value) as with_values, round(avg(value), 9) as mean, min(value) as lowest, max(value) as highest from v group by 1, 2, 3""",
    "setup_statuses": f"{_SCORED} select arm, axis, status, count(*) as n from (select arm, axis, status from f union all select 'DPO', 'heldout', 'missing_file' union all select 'DPO', 'heldout', 'file_error') group by 1, 2, 3",
}
