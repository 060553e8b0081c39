"""Stores, callbacks, models, table functions: the places for a user's own code."""

import json
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import adapters as A
from textloom.operators import extension as X


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    more = spark.createDataFrame([(3, "c")], "id int, t string")
    url = f"jdbc:derby:{tmp_path}/base;create=true"
    for store in (X.open_store(spark, str(tmp_path / "files")), X.open_store(spark, url, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")):
        store.replace("things", rows)
        store.append("things", more)
        assert sorted(tuple(r) for r in store.read("things").collect()) == [(1, "a"), (2, "b"), (3, "c")]
        store.replace("things", more)
        assert [tuple(r) for r in store.read("things").collect()] == [(3, "c")]


def test_placeholders():
    sql = "SELECT ':x?', a::int FROM t WHERE b = :name AND c = ?"
    assert X.placeholders(sql, "pyformat") == "SELECT ':x?', a::int FROM t WHERE b = %(name)s AND c = %s" and X.placeholders(sql, "named") == sql


def test_names_and_backends(spark):
    assert X.model_path("word-tagger", "d", {"WORD_TAGGER_PATH": "/m"}) == "/m" and X.model_path("x", "d", {"MODEL_DIR": "/all/"}) == "/all/x" and X.model_path("x", "d", {}) == "d"
    with pytest.raises(ValueError, match="no backend"):
        X.use_backend("nothing")
    X.use_backend("upper", F.upper)
    rows = spark.createDataFrame([("Bio",), ("SS",), ("art",)], "s string")
    assert [r[0] for r in rows.select(X.use_backend("upper")(F.col("s"))).collect()] == ["BIO", "SS", "ART"]
    assert [r["s"] for r in X.canonical(rows, "s", "subject", X.alias_table(spark)).collect()] == ["biology", "social_science", None]


def test_sql_functions(spark):
    X.register_functions(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM word_windows('a b c d e', 3, 2)").collect()] == [(0, "a b c"), (1, "c d e")]
    spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y")], "g string, p string").createOrReplaceTempView("labelled")
    assert spark.sql("SELECT macro_f1(g, p) FROM labelled").first()[0] == pytest.approx((2 / 3 + 2 / 3) / 2)


def test_words_and_models(spark):
    files = spark.createDataFrame([("a", b"one two"), ("b", b"bad")], "path string, content binary")

    def load():
        def parse(content):
            if content == b"bad":
                raise ValueError
            return [{"page": 1, "text": w, "size": 10.0, "fontname": "f", "x0": 0.0, "x1": 1.0, "top": 2.0, "bottom": 3.0} for w in content.decode().split()]

        return parse

    assert [(r["path"], r["text"]) for r in X.positioned_words(files, load).collect()] == [("a", "one"), ("a", "two")]

    def client():
        return lambda prompt: [f"data: {json.dumps({'type': 'token', 'text': ' ' + prompt})}", ": ping", *(['data: {"type": "done"}'] if prompt != "cut" else [])]

    asked = spark.createDataFrame([("hi",), ("cut",), (None,)], "q string").select(X.ask_model(F.col("q"), client).alias("a"))
    assert [r["a"] for r in asked.collect()] == ["hi", None, None]


def test_callback_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps({"session": "s", "seq": k, "type": "token"}) for k in (2, 1)))
    seen = []
    q = X.deliver(spark.readStream.schema("session string, seq long, type string").json(str(source)), lambda e: seen.append(e["seq"]), checkpointLocation=str(tmp_path / "cp"))
    for _ in range(60):
        if len(seen) == 2:
            break
        time.sleep(0.5)
    q.stop()
    assert seen == [1, 2]


def test_standalone(spark):
    rows = spark.createDataFrame([("why?", "what is a cell?"), ("why?", None)], "q string, p string")
    assert [r[0] for r in rows.select(A.standalone(F.col("q"), F.col("p"))).collect()] == ["what is a cell? why?", "why?"]
    for raw, want in (("Question: why is a cell?", "why is a cell?"), ("x" * 400, "what is a cell? why?")):
        assert rows.select(A.standalone(F.col("q"), F.col("p"), F.lit("t"), lambda t, raw=raw: F.lit(raw))).first()[0] == want
