"""The data source of JSON lines against plain reading, and what its writer leaves behind."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from loomwright.sources import files, record_lines as L

GOOD = {
    "id": "a", "character": "c", "source_work": "w", "character_cluster": 1, "profile": "p", "conversations": [{"role": "user", "content": "hi"}], "gold_focus": ["Style"], "gold_focus_attr": "x",
    "reference_answer": "r", "source": "RoleBench", "split": "sft",
}


def plain(data: bytes) -> list[tuple]:
    out = []
    for n, line in enumerate(data.removeprefix(b"\xef\xbb\xbf").split(b"\n"), 1):
        if line.strip():
            try:
                value = json.loads(line.decode())
                out.append((n, value, None) if isinstance(value, dict) else (n, None, "record must be a JSON object"))
            except UnicodeDecodeError:
                out.append((n, None, "invalid UTF-8"))
            except json.JSONDecodeError as wrong:
                out.append((n, None, f"invalid JSON: {wrong.msg}"))
    return out


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1 << 20])
def test_ranges_of_any_size_give_each_line_once(spark, tmp_path, range_bytes):
    draw = random.Random(3)
    kinds = [b'{"a": 1}', b"", b"  ", b"[1]", b"{broken", "{\"x\": \"漢字 é\"}".encode(), b'{"long": "' + b"y" * 90 + b'"}', b"\xff\xfe", b'{"a": 1}\r', b"null", b'"text"']
    bodies = [b"\xef\xbb\xbf" + b"\n".join(draw.choice(kinds) for _ in range(40)), b'{"k": 1}\n{"k": 2}\n', b'{"k": 3}', b"", b"\n\n"]
    for k, body in enumerate(bodies if range_bytes > 1 else [bodies[0][:150], *bodies[1:]]):
        (tmp_path / f"f{k}.jsonl").write_bytes(body)
    want = {(f"f{k}.jsonl", n, json.dumps(v, sort_keys=True) if v is not None else None, e) for k in range(5) for n, v, e in plain((tmp_path / f"f{k}.jsonl").read_bytes())}
    rows = L.record_lines(spark, str(tmp_path), range_bytes).select("path", "line", F.to_json("record").alias("json"), "error").collect()
    got = {(r.path.rsplit("/", 1)[1], r.line, json.dumps(json.loads(r.json), sort_keys=True) if r.json else None, r.error) for r in rows}
    assert got == want and len(rows) == len(want)


def test_missing_and_empty_inputs(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        L.record_lines(spark, str(tmp_path / "nowhere")).collect()
    (tmp_path / "none").mkdir()
    assert L.record_lines(spark, str(tmp_path / "none")).count() == 0


def test_typed_records_name_the_line_of_each_error(spark, tmp_path):
    odd = GOOD | {"id": 7, "character_cluster": "x", "gold_focus": "Style", "conversations": {"a": 1}, "synth_meta": {"generator": "g", "human_reviewed": "yes"}, "profile": True, "extra": [1]}
    lines = [json.dumps(GOOD), "", "{broken", "[1]", json.dumps(odd), json.dumps(GOOD | {"rejected_answer": None, "character_cluster": "3"})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows = {r.line: r for r in L.load_records(spark, str(tmp_path / "a.jsonl"), range_bytes=50).collect()}
    assert {n: list(r.errors) for n, r in rows.items()} == {
        1: [], 3: ["line 3: invalid JSON: Expecting property name enclosed in double quotes"], 4: ["line 4: record must be a JSON object"], 6: [],
        5: [f"line 5: {x}" for x in ("character_cluster must be -1 or a non-negative integer", "conversations must contain at least one turn", "gold_focus must contain at least one label", "synth_meta.prompt_id must be a non-empty string", "synth_meta.human_reviewed must be a boolean")],
    }
    assert (rows[5].id, rows[5].profile, rows[5].character_cluster, rows[6].character_cluster, rows[6].rejected_answer) == ("7", "True", -2, 3, None)
    assert [t.content for t in rows[1].conversations] == ["hi"] and rows[1].synth_meta is None
    with pytest.raises(Exception, match="line [34]: "):
        L.load_records(spark, str(tmp_path / "a.jsonl"), strict=True).collect()
    assert L.load_records(spark, str(tmp_path / "a.jsonl"), validate=False).where("size(errors) > 0").count() == 2


def test_keys_are_sorted_at_every_level_in_both_writers(spark, tmp_path):
    rows = spark.createDataFrame([({"b": "2", "a": "1"}, [("hi", "u")], None, '{"z":{"y":1,"x":2}}')], "m map<string,string>, c array<struct<role:string,content:string>>, a int, v string")
    rows = rows.withColumn("v", F.parse_json("v"))
    files.write_lines(rows, str(tmp_path / "jvm"))
    want = '{"a":null,"c":[{"content":"u","role":"hi"}],"m":{"a":"1","b":"2"},"v":{"z":{"x":2,"y":1}}}'
    assert spark.read.text(str(tmp_path / "jvm")).first().value == want
    L.write_records(rows, str(tmp_path / "own"))
    assert spark.read.text(str(tmp_path / "own")).first().value == json.dumps(json.loads(want), sort_keys=True)


def test_a_failed_write_leaves_nothing_and_an_overwrite_only_its_own(spark, tmp_path):
    path = tmp_path / "t"
    rows = spark.range(100).repartition(4)
    L.write_records(rows, str(path))
    L.write_records(rows.selectExpr("id + 100 as id"), str(path))
    assert spark.read.json(str(path)).count() == 200
    before = sorted(x.name for x in path.iterdir())
    with pytest.raises(Exception, match="invalid record"):
        L.write_records(rows.selectExpr("id", "case when id = 57 then array('bad') else array() end as issues"), str(path), "issues")
    assert sorted(x.name for x in path.iterdir()) == before
    L.write_records(rows.selectExpr("id", "array() as issues"), str(path), "issues", "overwrite")
    assert sorted(r.id for r in spark.read.json(str(path)).collect()) == list(range(100)) and (path / "_SUCCESS").exists()


def test_first_records_read_twice_what_they_need_at_most(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"f{k:02d}.jsonl").write_text("".join(f'{{"n": {k * 10 + i}}}\n' + "\n" * (i % 3 == 0) for i in range(10)))
    tables = []
    keep = L.stored
    monkeypatch.setattr(L, "stored", lambda df, name: tables.append(keep(df, name)) or tables[-1])
    for limit, size, needed in ((25, 1 << 20, 3), (1, 1 << 20, 1), (0, 1 << 20, 1), (35, 40, 15), (400, 1 << 20, 40), (900, 1 << 20, 40)):
        tables.clear()
        rows = L.first_records(spark, str(tmp_path), limit, size).select(F.try_variant_get("record", "$.n", "long").alias("n"), "path", "line").collect()
        assert sorted(r.n for r in rows) == list(range(min(max(limit, 1), 400)))
        for r in rows:
            lines = (tmp_path / r.path.rsplit("/", 1)[1]).read_text().split("\n")
            assert json.loads(lines[r.line - 1]) == {"n": r.n}
        assert sum(t.select("range").distinct().count() for t in tables) <= 2 * needed
    (tmp_path / "none").mkdir()
    assert L.first_records(spark, str(tmp_path / "none"), 5).count() == 0


def test_small_ranges_share_tasks(tmp_path):
    """A task for each range of a large file would be as many tasks as ranges."""
    path = tmp_path / "lines.jsonl"
    path.write_text("".join(f'{{"k": {k}, "x": "{"y" * 90}"}}\n' for k in range(2000)))
    reader = L._Reader({"path": f"file://{path}", "rangeBytes": "1000"})
    parts = reader.partitions()
    assert len(reader.ranges()) > 150 and len(parts) == 1
    lines = [x for b in reader.read(parts[0]) for x in b.column("json").to_pylist() if x]
    assert len(lines) == 2000


def test_lines_are_numbered_through_files_in_their_order(spark, tmp_path):
    for k, lines in enumerate((["a", "b"], [], ["c"], ["d", "e"])):
        (tmp_path / f"part-{k}.txt").write_text("".join(x + "\n" for x in lines))
    rows = files.numbered_lines(spark, str(tmp_path), through=True)
    assert [(r.line, r.value) for r in rows.orderBy("line").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
