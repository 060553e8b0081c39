"""Fixtures of single operators: scripts, spelling, languages, stops, histories, augmentation."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import docs as D
from textloom.functions import nlp as N
from textloom.functions import text as T
from textloom.operators import chats as C
from textloom.operators import records as R
from textloom.operators import reports as M


def value(spark, column, text=None, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, script",
    [("All living organisms are made up of cells.", "ROMAN"), ("यह एक वाक्य है।", "DEVANAGARI"), ("Cell membrane एक selectively permeable membrane है।", "MIXED"), ("Sabhi living organisms cells se bane hote hain.", "ROMAN"), ("1 2 !", "ROMAN"), (None, "ROMAN")],
)
def test_sentence_script(spark, text, script):
    assert value(spark, T.sentence_script, text)["overall"] == script


@pytest.mark.parametrize("word, tag", [("cells", "EN"), ("mein", "HI"), ("Sir", "UNIV"), ("1665", "UNIV"), ("mitochondria", "EN"), ("aur", "HI"), ("होता", "HI"), ("cellहोता", "MIX"), ("?!", "PUNCT")])
def test_word_language(spark, word, tag):
    assert value(spark, T.word_language, word) == tag


@pytest.mark.parametrize("text, out, changes", [("osmosis kia hota hai", "osmosis kya hota hai", 1), ("cell kya h", "cell kya hai", 1), ("plz batao", "please batao", 1), ("cell membrane hoti hai", "cell membrane hoti hai", 0), ("(plz) Kyu?", "(please) kyun?", 2)])
def test_spelling(spark, text, out, changes):
    r = value(spark, T.normalize_spelling, text)
    assert (r["text"], r["n_changes"]) == (out, changes)


def test_sentence_marks(spark):
    assert value(spark, T.normalize_sentence, "kya  hai ???")["text"] == "kya hai?"


def test_code_mixing(spark):
    c = value(spark, T.language_counts, "cell membrane hoti hai")
    assert (c["hi"], c["en"]) == (2, 2)
    assert spark.range(1).select(T.code_mixing(F.lit(2), F.lit(2))).first()[0] == 50.0


def test_label_map_last_wins(spark):
    m = value(spark, T.label_map, "Cell aur Cell !")
    assert m == {"aur": "HI", "Cell": "NE", "!": "EN"}


def test_stops(spark):
    assert value(spark, T.remove_stops, ["The", "cell", "is", "a", "unit"], "array<string>") == ["cell", "unit"]
    assert value(spark, T.remove_stops, ["not", "all", "cells", "are", "equal"], "array<string>") == ["not", "all", "cells", "equal"]


def test_stems_and_lemmas():
    assert [N.porter(w) for w in ("cells", "running", "relational", "ponies", "hopping", "caresses")] == ["cell", "run", "relat", "poni", "hop", "caress"]
    assert [N.lancaster(w) for w in ("running", "maximum", "presumably")] == ["run", "maxim", "presum"]
    assert [N.lemma(w) for w in ("cells", "running", "studies")] == ["cell", "run", "study"]


def test_gazetteer_prefers_longer():
    phrases = [(("indus",), "PLACE"), (("indus", "valley"), "CIVILISATION")]
    assert N.gazetteer_spans("The Indus Valley and Indus".split(), N.gazetteer_index(phrases)) == [(1, 3, "CIVILISATION"), (4, 5, "PLACE")]


def words(n, at=0):
    return " ".join(f"w{i}" for i in range(at, at + n))


@pytest.mark.parametrize("n, sizes", [(200, [200]), (201, [200, 31]), (370, [200, 200]), (371, [200, 200, 31]), (5, [5])])
def test_word_windows(spark, n, sizes):
    assert [len(x.split()) for x in value(spark, D.word_windows, words(n))] == sizes


def test_merge_short(spark):
    text = "\n\n".join([words(10), words(25), words(40), words(3)])
    assert [len(x.split()) for x in value(spark, lambda c: D.merge_short(D.paragraphs(c)), text)] == [35, 43]
    assert value(spark, lambda c: D.merge_short(D.paragraphs(c)), "a b") == ["a b"]
    assert value(spark, lambda c: D.merge_short(D.paragraphs(c)), None) == []


def test_overprint(spark):
    assert value(spark, D.collapse_overprint, "HHHHHEEEEE") == "HE"
    assert value(spark, D.collapse_overprint, "88..22") == "8.2"
    assert value(spark, D.collapse_glyphs, "DDDDDOOOOO") == "DO"
    assert value(spark, D.strip_doubled, "keep CChhaapptteerr 77 this") == "keep 77 this"
    assert value(spark, D.strip_doubled, "aa bb cc dd x") == "x"


def test_join_lines(spark):
    assert value(spark, lambda c: D.join_lines(F.split(c, "\n")), "mem-\nbrane and\n A-\nB") == "membrane and A-B"


def test_sentences_keep_abbreviations(spark):
    assert value(spark, D.split_sentences, "Dr. Hooke saw cells. He drew them.") == ["Dr. Hooke saw cells.", "He drew them."]


@pytest.mark.parametrize("q, intent", [("Define osmosis", "definition"), ("Why is it so?", "short_answer"), ("Assertion: x Reason: y", "assertion_reason"), ("hmm", "analytical")])
def test_intents(spark, q, intent):
    assert value(spark, T.classify_intent, q) == intent


def test_intent_aliases(spark):
    got = [value(spark, T.normalize_intent, i) for i in ("define_term", "formula_request", "mcq", None)]
    assert got == ["definition", None, "mcq", None]


def test_rewrite(spark):
    clean = lambda raw, q="": value(spark, lambda c: T.standalone_rewrite(c, F.lit(q)), raw)
    assert clean("Standalone question: What is a cell?\nIt is") == "What is a cell?"
    assert clean('"Osmosis kya hai?"') == "Osmosis kya hai?"
    assert clean("") is None and clean("ok") is None and clean("x" * 301) is None and clean("y" * 200, "hi") is None


def test_history(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(20)] + [(1, 20, "system", "no"), (1, 21, "user", "  "), (1, 22, "assistant", "a " * 400)]
    got = C.trim_history(spark.createDataFrame(rows, "chat int, n int, role string, text string"), "chat", "n").orderBy("n").collect()
    assert [r["n"] for r in got] == [15, 16, 17, 18, 19, 22]
    assert got[-1]["text"].endswith("a...") and len(got[-1]["text"]) <= 303


def test_augmentation(spark):
    assert value(spark, R.density_shift, "cell ki membrane.") == "koshika ki jhilli."
    assert value(spark, R.density_shift, "kuch nahi") is None
    assert value(spark, R.connector_swap, "yeh aur woh") == "yeh tatha woh"
    assert value(spark, R.negation, "cell chhota hota hai") == "cell chhota nahi hota hai"
    assert value(spark, R.negation, "nahi hota") is None
    assert value(spark, R.question_form, "cell chhota hai.") == "Sir, cell chhota hai samjhao?"
    assert value(spark, R.formality_shift, "Sir kya hai") is None


def test_validation(spark):
    ok = dict(topic="t", intent="mcq", q="q", a="a", context=" ".join("x" * 30), q_hi="q", a_hi="b")
    check = lambda **k: spark.range(1).select(R.compact_issues(**{n: F.lit(v) for n, v in (ok | k).items()})).first()[0]
    assert check() == []
    assert check(a="", intent="zzz") == ["missing/empty 'a'"]
    assert check(a_hi="a", q_hi="क", context="few words", intent="zzz") == ["unknown intent 'zzz'", "'q_hi' contains Devanagari", "a_hi is identical to the English answer", "ctx too short (2 words)"]


def test_events_fold(spark):
    rows = [("a", 1, "token", " He"), ("a", 2, "token", "llo "), ("a", 3, "done", None), ("b", 1, "token", "x"), ("b", 2, "error", None), ("c", 1, "token", "y")]
    got = {r["session"]: (r["state"], r["text"]) for r in C.fold_events(spark.createDataFrame(rows, "session string, seq int, type string, text string")).collect()}
    assert got == {"a": ("done", "Hello"), "b": ("error", "x"), "c": ("open", "y")}


def test_store(spark):
    chats = spark.createDataFrame([(1, "a", 12.0), (2, "b", None)], "chat int, owner string, upto double")
    messages = spark.createDataFrame([(1, 11.0), (1, 13.0), (2, 1.0)], "chat int, at double")
    assert C.snapshot(messages, chats, "chat", "at", "upto").count() == 1
    assert C.owned(messages, chats, "chat", "owner", "b").count() == 1
    _, rest = C.delete_cascade(chats, messages, "chat", F.col("chat") == 1)
    assert [tuple(r) for r in rest.collect()] == [(2, 1.0)]
    up = C.upsert(chats, spark.createDataFrame([(1, "z"), (3, "c")], "chat int, owner string"), "chat", ["owner"])
    assert sorted((r["chat"], r["owner"], r["upto"]) for r in up.collect()) == [(1, "z", 12.0), (2, "b", None), (3, "c", None)]


def test_scores(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "gold string, pred string")
    s = M.summary(rows).first()
    assert s["accuracy"] == pytest.approx(1 / 3)
    assert s["macro_f1_all"] == pytest.approx((2 / 3 + 0 + 0) / 3) and s["macro_f1_gold"] == pytest.approx(1 / 3)
    assert M.rouge_l("a b c d", "a c d e") == pytest.approx(0.75) and M.chrf("same text", "same text") == pytest.approx(100)


def test_md5_bucket(spark):
    import hashlib

    keys = [f"k{i}" for i in range(50)]
    got = {r["k"]: r["b"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", T.md5_bucket(F.col("k")).alias("b")).collect()}
    assert got == {k: int(hashlib.md5(k.encode()).hexdigest(), 16) % 10_000 for k in keys}
