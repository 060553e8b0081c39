"""Generators, vector search on odd tables, numbering of hot keys, memories."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import docs as D
from textloom.functions import text as T
from textloom.operators import chats, memo
from textloom.operators import generators as G
from textloom.operators import records as R
from textloom.operators import vectors as V
from textloom.sources import stores as S


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def test_trivial_questions(spark):
    said = [
        "Green plants are called Producers.", "Osmosis refers to the movement of water through a membrane.", "The cell wall of plants and of some bacteria contains cellulose.",
        "Water moves through the leaf in a process called Transpiration.", "Insulin is a hormone of the body that lowers sugar.",
    ]
    got = [tuple(r) for r in one(spark, lambda t: G.trivial_questions(F.split(t, "\\|")), "|".join(said))]
    assert ("name_the", "What is Green plants called?", "Producers.") in got
    assert ("fill_blank", "_____ is defined as the movement of water through a membrane.", "Osmosis.") in got
    assert ("true_false", "True or False: The cell wall of plants and of some bacteria contains cellulose.", "True. The cell wall of plants and of some bacteria contains cellulose as stated in the NCERT textbook.") in got
    assert ("one_word", "Name the process or structure: Water moves through the leaf in a?", "Transpiration.") in got
    assert ("one_word", "What is Insulin?", "Insulin is a hormone of the body that lowers sugar.") in got
    assert len(got) == 6  # another sentence is true or false


def test_passage_questions(spark):
    text = "Golgi Bodies is a part of cells. Plant Cells differ from it because of many factors in 1898. Its function is important, for example in the process."
    rows = spark.createDataFrame([(1, text)], "k int, p string")
    biology = {(r["intent"], r["question"]) for r in G.passage_questions(rows, "k", "p", F.lit("Cells")).collect()}
    social = {(r["intent"], r["question"]) for r in G.passage_questions(rows, "k", "p", F.lit("Cells"), "Social Science").collect()}
    assert ("compare_concepts", "Compare Golgi Bodies and Plant Cells.") in biology and ("describe_function", "Describe the role of Golgi Bodies in Cells.") in biology
    assert ("list_enumerate", "List the cells of Golgi Bodies.") in biology and ("list_enumerate", "List the factors of Golgi Bodies.") in social
    assert ("short_answer", "What does the figure 1898 represent in the context of Golgi Bodies?") in social
    assert not any("numerical" in i for i, _ in biology) and len(biology) == 23


def test_sentence_entries(spark):
    s = "Photosynthesis is the process in green leaves, while respiration runs in every living cell."
    got = {r["kind"]: (r["question"], r["answer"]) for r in one(spark, lambda t: G.sentence_entries(t, F.lit("Life")), s)}
    assert set(got) == {"true_false", "short_answer", "explain_concept", "definition", "fill_blank", "application_reallife", "analytical", "give_example", "list_enumerate", "compare_concepts", "one_word"}
    assert got["definition"] == ("What does Photosynthesis mean?", s) and "_______" in got["fill_blank"][0] and got["fill_blank"][1].startswith("The missing word is cell.")
    assert got["one_word"] == ("In a word or phrase: what is Photosynthesis?", f"The process in green leaves, while. ({s})")
    assert {r["kind"] for r in one(spark, lambda t: G.sentence_entries(t, F.lit("Life")), "Hm")} == {"true_false", "short_answer", "explain_concept", "application_reallife", "analytical", "give_example"}
    assert one(spark, lambda t: G.assign_topic(t, [("a", ["x"]), ("b", ["Y", "z"])]), "y and Z") == "b"
    assert one(spark, lambda t: G.assign_topic(t, [("a", ["x"]), ("b", ["y"])]), "none") == "a"


def test_merge_short_equals_a_loop(spark):
    rng = random.Random(2)
    for n in (0, 1, 5, 700):
        paras = [" ".join(["w"] * rng.randint(1, 4)) for _ in range(n)]
        want, held = [], ""
        for p in paras:
            held = f"{held} {p}" if held else p
            if len(held.split()) >= 5:
                want.append(held)
                held = ""
        if held:
            want = [*want[:-1], f"{want[-1]} {held}"] if want else [held]
        assert one(spark, lambda t: D.merge_short(F.filter(F.split(t, "\\|"), lambda x: x != ""), 5), "|".join(paras)) == want


def test_first_of_each_and_labels(spark):
    assert one(spark, lambda t: T.first_of_each(F.split(t, " "), F.lower), "b A a B c C c") == ["b", "A", "c"]
    assert one(spark, T.label_map, "hai Sir hai, Delhi !! Delhi") == {"hai": "HI", "Sir": "UNIV", "Delhi": "NE", "!!": "EN"}
    assert one(spark, lambda t: D.is_noise(t), "gnirahsPowers") and not one(spark, lambda t: D.is_noise(t), "The people of the land were many.")


def test_search_batch_odd_tables(spark):
    kind = "vec_id {}, embedding array<float>, label int"
    rows = [(i, [float(i % 3), 1.0], i % 2) for i in range(20)] + [(100, None, 0), (101, [1.0], 0), (102, [None, 1.0], 0), (None, [1.0, 1.0], 0)]
    for key, conv in (("long", lambda i: i), ("string", lambda i: None if i is None else f"{i:03d}")):
        e = spark.createDataFrame([(conv(i), v, y) for i, v, y in rows], kind.format(key)).repartition(3)
        for same in (None, "label"):
            got = {}
            for r in V.search_batch(e, e, 4, same=same).collect():
                got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
            assert set(got) == {conv(i) for i in range(20)} | {conv(101)}
            for i in range(20):
                a = np.array(rows[i][1])
                near = [(-round(float(a @ np.array(v) / np.linalg.norm(a) / np.linalg.norm(v)), 12), conv(j)) for j, v, y in rows[:20] if not same or y == i % 2]
                assert sorted(got[conv(i)]) == [(k + 1, j) for k, (_, j) in enumerate(sorted(near)[:4])]
        none = e.where("false")
        assert V.search_batch(none, e, 4).count() == V.search_batch(e, none, 4).count() == V.similarities(e, none).count() == 0
    assert V.similarities(e, e).count() == 401


def test_search_batch_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_BYTES", 64)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((30, 4))
    e = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in V.search_batch(e, e, 3).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(unit @ unit.T), axis=1)[:, :3]
    assert got == {(q, k + 1): int(want[q, k]) for q in range(30) for k in range(3)}


def test_hot_keys_are_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_ROWS", 20)
    rows = [("hot", i % 67) for i in range(300)] + [(None, i) for i in range(50)] + [("cold", i) for i in range(9)] + [("hot", None)]
    got = S.number_within(spark.createDataFrame(rows, "k string, o int").repartition(5), "k", "o", "n", 10).collect()
    for k in ("hot", None, "cold"):
        of = sorted((r["n"], -1 if r["o"] is None else r["o"]) for r in got if r["k"] == k)
        assert [n for n, _ in of] == list(range(11, 11 + len(of))) and [o for _, o in of] == sorted(o for _, o in of)


def test_split_ranked(spark):
    for n in (1, 2, 10, 101):
        got = R.split_ranked(spark.range(n), "id").groupBy("split").count().collect()
        assert {r["split"]: r["count"] for r in got} == {k: v for k, v in (("train", max(1, int(0.8 * n))), ("dev", n - max(1, int(0.8 * n)))) if v}


def test_memory_is_kept(spark, tmp_path):
    path = str(tmp_path / "memo")
    rows = spark.createDataFrame([("A  b",), ("a b",), ("c",), (None,)], "q string")
    first = memo.enrich_kept(rows, "q", path, "v", "int", F.length, parts=2).collect()
    assert sorted((r["q"] or "", r["v"]) for r in first) == [("", None), ("A  b", 3), ("a b", 3), ("c", 1)]
    again = memo.enrich_kept(rows.union(spark.createDataFrame([("new",)], "q string")), "q", path, "v", "int", lambda k: F.lit(7), parts=2).collect()
    assert sorted((r["q"] or "", r["v"]) for r in again) == [("", None), ("A  b", 3), ("a b", 3), ("c", 1), ("new", 7)]
    assert spark.read.json(path).count() == 3


def test_chats(spark):
    table = spark.createDataFrame([("x", 1.0)], "id string, updated_at double")
    new = spark.createDataFrame([("y", "u", "T", None)], "id string, user_id string, title string, language string")
    made = {r["id"]: r for r in chats.create_chats(table, new, F.lit(2.0)).collect()}
    assert (made["y"]["language"], made["y"]["created_at"], made["y"]["updated_at"], made["x"]["title"]) == ("hinglish", 2.0, 2.0, None)
    texts = spark.createDataFrame([(1, "In INDIA and Peru"), (2, None)], "i int, t string")
    found = chats.containing(texts, "t", spark.createDataFrame([("India",), ("Peru",), ("Chad",)], "p string"), "p").collect()
    assert sorted((r["i"], r["p"]) for r in found) == [(1, "India"), (1, "Peru")]


@pytest.mark.parametrize("n", [200, 20_000])
def test_long_texts_take_linear_time(spark, n):
    text = " ".join(f"Word{i} Other{i % 50}. " for i in range(n))
    for f in (T.label_map, D.extract_sentences, D.noun_phrases, lambda t: D.merge_short(D.paragraphs(F.replace(t, F.lit(". "), F.lit("\n\n"))), 3)):
        assert one(spark, lambda t, f=f: F.size(f(t)), text) >= 0


def test_numbered_questions(spark):
    text = "1. Which is it?\n(a) red one\n(b) blue one\n2. Answer these.\n(a) What is a cell wall made of?\n(b) Why do plants need it at all?\n3. Why?\n"
    one_, two, three = one(spark, G.numbered_questions, text)
    assert (one_["number"], one_["question"], one_["options"], one_["parts"]) == (1, "Which is it?", ["a) red one", "b) blue one"], [])
    assert (two["number"], two["question"], two["options"], [tuple(p) for p in two["parts"]]) == (2, "Answer these.", [], [("a", "What is a cell wall made of?"), ("b", "Why do plants need it at all?")])
    assert (three["question"], three["options"], three["parts"]) == ("Why?", [], [])


def test_vector_scores(spark):
    from textloom.operators import adapters as A
    from textloom.operators import reports as M

    rows = spark.createDataFrame([("a b", "b a"), ("a", "zzz"), ("", "a"), (None, None)], "p string, g string")
    got = M.vector_scores(rows, "p", "g", A.hashed_vectors).collect()
    assert got[0]["f1"] == pytest.approx(1) and got[1]["f1"] < 0.9 and got[2]["f1"] == got[3]["f1"] == 0


def test_plain_metadata(spark):
    rows = spark.createDataFrame([(None, None, None, [1.0], {"a": 1})], "s string, n int, b boolean, v array<double>, m map<string,int>")
    assert tuple(S.plain_metadata(rows).first()) == ("", 0, False, [1.0], '{"a":1}')
