"""Sources, sinks and streams."""

import json
import time

from textloom.sources import stores as S
from textloom.streaming import answers


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "q": "x"}, {"id": 2}]))
    assert S.read_json_array(spark, str(tmp_path / "a.json"), "id int, q string").count() == 2
    assert S.read_json_tolerant(spark, str(tmp_path / "none*.json"), "id int").count() == 0
    (tmp_path / "cut.json").write_text('[{"id": 1, "t": "a}\\"{"}, {"id": 2, "n": {"x": 1}}, {"id": 3, "t"')
    assert [r["id"] for r in S.read_json_cut(spark, str(tmp_path / "cut.json"), "id int, t string").collect()] == [1, 2]


def test_parts(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n int")
    assert sorted(map(tuple, S.replace_part(old, spark.createDataFrame([("a", 9)], "k string, n int"), "k").collect())) == [("a", 9), ("b", 1)]
    new = spark.createDataFrame([("a", 5), ("c", 6)], "k string, x int")
    assert sorted((r["k"], r["n"]) for r in S.append_part(old, new, "k", "x", "n").collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1)]
    target = str(tmp_path / "t")
    for rows in ([(1,)], [(2,), (3,)]):
        S.write_swapped(spark.createDataFrame(rows, "x int"), target)
        held = S.read_swapped(spark, target)
        assert sorted(tuple(r) for r in held.collect()) == rows
    S.write_swapped(spark.createDataFrame([(4,)], "x int"), target)
    assert sorted(r["x"] for r in held.collect()) == [2, 3]  # readers of the version before go on
    assert [r["x"] for r in S.read_swapped(spark, target).collect()] == [4]
    assert S.write_collection(old, str(tmp_path / "c"), ["k"]) and not S.write_collection(old, str(tmp_path / "c"), ["k"])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "é"), (1, None)], "id int, t string")
    S.write_json_pretty(rows, str(tmp_path / "a/b.json"), ["id"])
    assert (tmp_path / "a/b.json").read_text(encoding="utf-8") == '[\n  {\n    "id": 1,\n    "t": null\n  },\n  {\n    "id": 2,\n    "t": "é"\n  }\n]\n'
    S.write_json_pretty(rows.where("false"), str(tmp_path / "none.json"), ["id"])
    assert json.loads((tmp_path / "none.json").read_text()) == []
    S.write_texts(rows.where("id = 2"), str(tmp_path / "texts"), "id", "t")
    assert [tuple(r) for r in spark.read.text(str(tmp_path / "texts")).collect()] == [("é", 2)]
    split = spark.createDataFrame([("train", "b"), ("dev", "a"), ("train", "c")], "split string, label string")
    S.write_splits(split, str(tmp_path / "s"), labels="label")
    assert {(r["label"], r["id"]) for r in spark.read.json(str(tmp_path / "s/_label_map")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_texts_with_broken_bytes(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"good \xff\xfe bytes")
    (tmp_path / "a.txt").write_text("é")
    assert [(r["part"], r["text"]) for r in S.read_texts(spark, str(tmp_path / "*.txt"), r"(\w)\.txt$").collect()] == [("a", "é"), ("b", "good  bytes")]


def test_client_reducer(spark):
    made = {
        "ok": [("status", None, "search"), ("token", " He", None), ("token", "", None), ("token", "llo ", None), ("done", None, None), ("token", "late", None)],
        "bad": [("status", None, "search"), ("token", "x", None), ("error", None, None)],
        "cut": [("token", "x", None), ("status", None, "write")],
        "none": [("done", None, None)],
    }
    rows = [(k, i, *e) for k, v in made.items() for i, e in enumerate(v)]
    got = {r["session"]: (r["failed"], r["text"], r["status"]) for r in answers.reduce_answers(spark.createDataFrame(rows, "session string, seq long, type string, text string, stage string")).collect()}
    for k, v in made.items():
        one = answers.client_state([{"type": a, "text": b, "stage": c} for a, b, c in v])
        assert got[k] == (one["failed"], one["text"], one["status"])
    assert got["ok"] == (False, "Hello", None) and got["cut"] == (True, "", "write")


def test_sse(spark):
    lines = spark.createDataFrame([('data: {"type": "token", "text": "a"}',), (": ping",), ("",)], "value string")
    assert [tuple(r) for r in S.parse_sse(lines, "type string, text string").collect()] == [("token", "a")]


def test_save_on_done_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [("a", 1, "token", " He"), ("a", 2, "token", "llo"), ("a", 3, "done", None), ("a", 4, "token", "Two"), ("a", 5, "done", None), ("b", 1, "token", "x"), ("b", 2, "error", None), ("c", 1, "token", "y")]
    (source / "1.json").write_text("\n".join(json.dumps(dict(zip(("session", "seq", "type", "text"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema("session string, seq long, type string, text string").json(str(source))
    q = answers.save_on_done(stream).writeStream.format("memory").queryName("saved").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(60):
        if spark.table("saved").count() >= 3:
            break
        time.sleep(1)
    q.stop()
    assert sorted(map(tuple, spark.table("saved").collect())) == [("a", "done", "Hello"), ("a", "done", "Two"), ("b", "error", "")]
