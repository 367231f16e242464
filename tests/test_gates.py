"""Gates, setups, inputs and small outputs."""

from __future__ import annotations

import hashlib
import io
import json
import random
import zipfile
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomwright.operators import builders as B
from loomwright.operators import gates as K
from loomwright.operators import records as R
from loomwright.operators import setups as U
from loomwright.operators import splits as P
from loomwright.operators.raw_validate import REQUIRED, raw_record_issues
from loomwright.sources import files, inputs, walk


def test_ledger_entries_must_name_license_and_files(spark):
    rows = [("a", "MIT", 3, 1), ("a", "none", 3, 2), ("b", " TODO", 2, 1), ("c", "MIT", 0, 1)]
    entries = spark.createDataFrame(rows, "source_id string, license string, file_count int, n int")
    assert K.ledger_entry(entries, "a", "n").collect()[0].license == "MIT"
    for source in ("b", "c", "nowhere"):
        with pytest.raises(PySparkException):
            K.ledger_entry(entries, source, "n").collect()


def test_model_scores_keep_errors_apart(spark):
    rows = spark.createDataFrame([(k, "p", "d", "bad" if k == 5 else "r") for k in range(8)], "id int, profile string, dialogue string, response string").coalesce(1)

    def scorer(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [float(len(t)) for t in texts]

    got = {r.id: (r.scoring.status, r.scoring.score) for r in K.model_scores(rows, scorer, lambda p, d, r: F.concat(p, d, r), batch=2).collect()}
    assert got == {k: ("error", None) if k in (4, 5) else ("ok", 3.0) for k in range(8)}
    assert {r.scoring.status for r in K.model_scores(rows, None, lambda p, d, r: r).collect()} == {"dry_run"}


def test_trainer_settings():
    assert K.trainer_errors({"beta": 0}) and not K.trainer_errors({"beta": 0.1})
    assert K.trainer_errors({"num_generations": 3, "per_device_train_batch_size": 2, "gradient_accumulation_steps": 2})
    assert not K.trainer_errors({"num_generations": 4, "per_device_train_batch_size": 2, "gradient_accumulation_steps": 2})


def test_setups():
    axes = {a.name: a for a in U.axes({})}
    assert list(axes) == ["charactereval", "heldout", "socialbench", "ceval"] and len(axes["charactereval"].metrics) == 13
    assert axes["charactereval"].metrics["empathy"] == ["charactereval.metrics.empathy", "charactereval.empathy", "metrics.empathy", "empathy"]
    own = U.axes({"axes": [{"name": "x", "metric_fields": {"m": "a.b"}, "score_fields": "s"}, "ceval"]})
    assert own[0].metrics == {"m": ["a.b"]} and own[0].scores == ["s"] and own[1].scores[0] == "ceval.accuracy"
    for bad in ({"arms": ["a", "a"]}, {"arms": [{"x": 1}]}, {"arms": 3}):
        with pytest.raises(ValueError):
            U.arms(bad)
    config = {"arms": {"A": {"results": {"x": ["1", "1"]}}, "B": None}, "axes": {"x": {"inputs": {"B": {"path": "2"}}}}, "result_files": [{"arm": "A", "axis": "y", "path": "3"}]}
    assert U.input_paths(config) == {("A", "x"): ["1"], ("B", "x"): ["2"], ("A", "y"): ["3"]}


def test_missing_files_fail_unless_allowed(spark):
    rows = spark.createDataFrame([("a", "x", "p", False, False)], "arm string, axis string, path string, found boolean, readable boolean")
    assert U.missing_files(rows, True).collect()[0].status == "missing_file"
    with pytest.raises(PySparkException):
        U.missing_files(rows, False).collect()


def test_inputs_are_expanded_in_order(spark, tmp_path):
    for name in ("b/2.json", "b/1.JSONL", "b/x.csv", "b/c/0.parquet", "b/y.txt", "z.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda paths, kind: [p.rsplit("/", 1)[-1] for p in inputs.expand_inputs(spark, [str(tmp_path / p) for p in paths], kind)]
    assert names(["b", "z.txt", "gone"], "data") == ["1.JSONL", "2.json", "0.parquet", "z.txt", "gone"]
    assert names(["b", "z.txt", "gone"], "eval") == ["1.JSONL", "2.json", "0.parquet", "x.csv", "gone"]
    assert names(["b", "z.txt", "gone"], "ledger") == ["1.JSONL", "2.json", "0.parquet", "x.csv", "y.txt", "z.txt"]


def test_small_outputs(spark, tmp_path):
    inputs.write_summary(spark, f"file://{tmp_path}/s.json", {"b": 1, "a": "é"})
    assert (tmp_path / "s.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    assert inputs.load_config(spark, f"file://{tmp_path}/s.json") == {"a": "é", "b": 1}
    digest = inputs.write_package(spark, f"file://{tmp_path}/p.zip", {"a/b.txt": b"x"})
    data = (tmp_path / "p.zip").read_bytes()
    assert digest == hashlib.sha256(data).hexdigest() and (tmp_path / "p.zip.sha256").read_text().startswith(digest)
    assert zipfile.ZipFile(io.BytesIO(data)).read("a/b.txt") == b"x"
    for bad in ("/a", "a/../b", "work/x", ".git/c", "m.safetensors"):
        with pytest.raises(ValueError):
            inputs.write_package(spark, f"file://{tmp_path}/q.zip", {bad: b""})
    table = inputs.markdown_table("run", [{"arm": "A", "axis": "x", "n": 3, "scored": 2, "mean": 0.1234567891, "delta_vs_SFT": None, "status_counts": {"ok": 2, "error": 1}, "with_values": 1, "configured": 13}], ["careful", " "])
    assert table.splitlines()[1] == "> careful" and table.splitlines()[-1] == "| A | x | 3 | 2 | 0.123457 | NA | NA | error:1, ok:2 | 1/13 |"


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("﻿id\ttext\n1\t\"x\ny\"\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "a.tsv"), "\t").collect()] == [("1", "x\ny")]


def test_strict_readers_name_the_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"a": 1}\n\n[2]\n{"a": 3}\n')
    assert [r.line for r in files.read_tolerant(spark, str(tmp_path / "a.jsonl")).collect()] == [1]
    assert [r.line for r in files.unreadable(spark, str(tmp_path / "a.jsonl")).collect()] == [3]
    with pytest.raises(PySparkException, match="line 3"):
        files.read_lines(spark, str(tmp_path / "a.jsonl")).collect()


def test_discovery_stops_at_records(spark, tmp_path):
    inner = {"question": "q", "A": "1", "more": [{"role": "r", "input": "i"}]}
    (tmp_path / "a.json").write_text(json.dumps([1, {"x": {"y": [inner]}, "role": {"name": "n", "answer": "a"}}]))
    got = [json.loads(r[0]) for r in walk.discover_records(spark, str(tmp_path)).orderBy("index").select(F.to_json("record")).collect()]
    assert got == [inner, {"name": "n", "answer": "a"}]


def plain_walk(value):
    """Records of a document, outermost first."""
    if isinstance(value, list):
        return [r for x in value for r in plain_walk(x)]
    if not isinstance(value, dict):
        return []
    keys = set(value)
    asked = keys & set(walk.QUESTION_KEYS)
    if asked and (keys & set(walk.CHOICE_KEYS) or keys & set(walk.ROLE_KEYS)) or set(walk.CARD_KEYS) <= keys:
        return [value]
    return [r for x in value.values() for r in plain_walk(x)]


def plain_texts(value, path=""):
    if isinstance(value, str):
        return [(path or "<record>", value)]
    if isinstance(value, dict):
        return [t for k, v in value.items() for t in plain_texts(v, f"{path}.{k}" if path else k)]
    return [t for i, v in enumerate(value) for t in plain_texts(v, f"{path}[{i}]")] if isinstance(value, list) else []


def odd_documents():
    draw = random.Random(4)
    names = [*walk.QUESTION_KEYS[:3], *walk.ROLE_KEYS[:4], *walk.CARD_KEYS, "A", "z", "a.b", "é", "key", "value"]

    def value(depth):
        kind = draw.randrange(8)
        if depth == 0 or kind < 3:
            return draw.choice([None, 1, -2, True, "text", '{"question": 1, "A": 2}', "[1]", "", "TODO é"])
        if kind < 5:
            return [value(depth - 1) for _ in range(draw.randrange(4))]
        return {k: value(depth - 1) for k in draw.sample(names, draw.randrange(4))}

    return [value(5) for _ in range(40)] + [[], {}, "x", None, 3, [[[[]]]], [value(4) for _ in range(60)]]


def test_documents_of_any_shape_are_walked_in_order(spark, tmp_path):
    docs = odd_documents()
    for k, doc in enumerate(docs):
        (tmp_path / f"{k:03d}.json").write_text(("\ufeff \n" if k % 3 else "") + json.dumps(doc, ensure_ascii=k % 2 == 0, indent=k % 4 or None), encoding="utf-8")
    rows = walk.discover_records(spark, str(tmp_path)).select("path", "index", F.to_json("record").alias("json")).collect()
    got = {(int(r.path[-8:-5]), r["index"]): json.loads(r.json) for r in rows}
    want = {(k, i): record for k, doc in enumerate(docs) for i, record in enumerate(plain_walk(doc))}
    assert got == want and len(rows) == len(want) > 12
    (tmp_path / "bad.json").write_text('[{"a": 1}')
    with pytest.raises(Exception, match="(?i)malformed"):
        walk.discover_records(spark, str(tmp_path / "bad.json")).collect()


def test_texts_of_records_of_any_shape(spark):
    docs = odd_documents()
    rows = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "id long, json string").select("id", F.parse_json("json").alias("record"))
    want = Counter((k, *t) for k, d in enumerate(docs) for t in plain_texts(d))
    assert Counter(map(tuple, walk.texts_within(rows, "id", "record").collect())) == want
    assert Counter(map(tuple, walk.placeholders_within(rows, "id", "record", ["todo"]).collect())) == Counter((k, f) for (k, f, t), n in want.items() for _ in range(n) if "TODO" in t)
    assert walk.texts_within(rows.limit(0), "id", "record").count() == 0


def test_synthesis_is_tried_again(spark):
    calls = spark.createDataFrame([("ok",), ("never",)], "p string").coalesce(1)

    def call(text):
        if text == "never":
            raise OSError("down")
        return text.upper()

    got = {r.p: (r.reply, r.error) for r in inputs.synthesize(calls, F.col("p"), call, retries=1, pause=0.0).collect()}
    assert got == {"ok": ("OK", None), "never": (None, "OSError: down")}


def test_grpo_rows_fail_on_schema_errors(spark):
    raw = spark.createDataFrame([("1", "c", "w", -5)], "id string, character string, source_work string, character_cluster int")
    rows = raw.withColumns({"profile": F.lit("p"), "conversations": F.array().cast(R.TURN), "gold_focus": F.array(F.lit("Style")), "gold_focus_attr": F.lit("a"), "reference_answer": F.lit("r"), "rejected_answer": F.lit(None).cast("string"), "source": F.lit("RoleBench"), "split": F.lit("sft"), "synth_meta": F.lit(None).cast("struct<generator:string,prompt_id:string,rejected_strategy:string,human_reviewed:boolean>"), "n": F.lit(1)})
    with pytest.raises(PySparkException, match="failed schema validation"):
        B.grpo_rows(rows, "n").collect()
    assert B.grpo_rows(rows, "n", validate=False).count() == 1


def test_a_split_needs_two_keys(spark):
    with pytest.raises(ValueError, match="two keys"):
        P.hash_fraction(spark.createDataFrame([("a",)], "k string"), F.col("k"), 0.5)


@pytest.mark.parametrize("held", [1, 3, 4096])
def test_the_kth_digest_is_selected_without_sorting_all(spark, monkeypatch, held):
    monkeypatch.setattr(P, "_SORTED", held)
    monkeypatch.setattr(P, "_DIGITS", 1)
    keys = [hashlib.sha256(str(k).encode()).hexdigest()[:4] for k in range(300)]
    rows = [(d, f"k{n}") for n, d in enumerate(keys)] + [("abcd", f"same{n}") for n in range(9)] + [("", "none"), ("a", "short")]
    df = spark.createDataFrame(rows, "digest string, key string")
    order = sorted(rows)
    for k in (1, 2, 150, len(rows)):
        assert P.kth_digest(df, k) == order[k - 1]
    assert P.kth_digest(df, 0) is None and P.kth_digest(df, len(rows) + 1) is None


def test_works_are_ordered_by_their_digests(spark):
    """A stored order of 8-byte BLAKE2b digests: the first three of ten works, then two, then the rest."""
    order = ["work-5", "work-0", "work-2", "work-7", "work-8", "work-4", "work-3", "work-6", "work-9", "work-1"]
    order.sort(key=lambda w: hashlib.blake2b(w.encode(), digest_size=8).digest())
    rows = [(f"c{k}", f"work-{k % 10}") for k in range(25)] + [("x", "kept back")]
    got = P.work_disjoint_split(spark.createDataFrame(rows, "character string, source_work string"), {"sft": 0.3, "reward": 0.2, "eval_heldout": 0.5}, F.col("source_work") == "kept back")
    split = {r.source_work: r.split for r in got.collect()}
    assert [split[w] for w in order] == ["sft"] * 3 + ["reward"] * 2 + ["eval_heldout"] * 5 and split["kept back"] == "eval_heldout"


def test_raw_records_name_what_is_missing_or_of_another_type(spark):
    rows = spark.createDataFrame([(1, "null"), (2, '"text"'), (3, "{}"), (4, '{"gold_focus": [], "conversations": [null, {"role": "user"}], "synth_meta": null, "character_cluster": 1.5}')], "k long, json string").select("k", F.parse_json("json").alias("record"))
    got = {r.k: [(x.code, x.field) for x in r.issues] for r in raw_record_issues(rows, "k", "record").collect()}
    lone = [("schema.record_type", "<record>")]
    assert got[1] == got[2] == lone
    assert got[3] == [("schema.missing", f) for f in REQUIRED] + [("schema.conversations", "conversations"), ("label.gold_focus", "gold_focus")]
    present = {"gold_focus", "conversations", "synth_meta", "character_cluster"}
    assert got[4] == [("schema.missing", f) for f in REQUIRED if f not in present] + [("schema.character_cluster", "character_cluster"), ("schema.conversation_turn", "conversations[0]"), ("label.gold_focus", "gold_focus"), ("schema.conversation_content", "conversations[1].content")]


def test_markers_of_gold_records(spark):
    said = ["TBD", "Fixme", "待填", "示例文本", "do_not_use", "a Template", "not_a_gold_record", "待填写", "占位", "atodod", "fill_me", "placeholder"]
    rows = spark.createDataFrame([(str(k), [x]) for k, x in enumerate(said)], "id string, text array<string>")
    assert {(r.id, r.field) for r in K.placeholders(rows, "id").collect()} == {(str(k), "text[0]") for k in range(4, len(said))}


def test_the_gold_report_is_the_whole_gate(spark):
    turns, meta = [("user", "你好，请问今天的天气怎么样呢？")], ("g", "p", None, True)
    good = dict(character="甲", source_work="作", profile="一个角色", conversations=turns, gold_focus=["Style"], gold_focus_attr="说话简短", reference_answer="今天的天气很好，适合出门走一走。", rejected_answer=None, source="RoleBench", split="sft", synth_meta=meta, path="/x/gold.jsonl")
    kind = "order long, id string, character string, source_work string, profile string, conversations array<struct<role:string,content:string>>, gold_focus array<string>, gold_focus_attr string, reference_answer string, rejected_answer string, source string, split string, synth_meta struct<generator:string,prompt_id:string,rejected_strategy:string,human_reviewed:boolean>, path string"

    def report(*changes, least=1):
        rows = [{"order": k, "id": f"r{k}"} | good | change for k, change in enumerate(changes)]
        return tuple(K.gold_report(spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in rows], kind), "order", least=least).collect()[0])

    assert report({}, {}) == (2, 0, 0, "")
    assert report({"synth_meta": ("g", "p", None, None)}, {"profile": "TEMPLATE 角色"}, least=3) == (2, 0, 1, "gate.human_reviewed_false:1,gate.placeholder_marker:1,gate.too_few_records:1")
    local = "local_only.hsr_id_prefix:1,local_only.hsr_split:1,local_only.path:1,local_only.source_work_marker:1"
    assert report({"id": "same", "source": "HSR-canon"}, {"id": "same", "path": "/x/a_Template.jsonl"}) == (2, 0, 0, f"gate.template_input:1,{local},schema.duplicate_id:1")
    other = {"character": "乙", "source_work": "集", "split": "eval_heldout"}
    assert report({"split": "reward", "id": " "}, other | {"id": " "}) == (2, 2, 0, "leakage.cross_split_near_duplicate:1,schema.non_empty_string:2")
    assert report({"split": "reward"}, {"reference_answer": "不行。"}, {"source_work": " "}, {"split": "reward", "source_work": " "}) == (4, 2, 0, "leakage.character_record_split_overlap:1,leakage.source_work_record_split_overlap:1,schema.non_empty_string:2")
