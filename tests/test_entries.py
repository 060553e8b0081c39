"""Rewriters, keys, labels and requests."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import entries as E


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_entries(spark):
    assert one(spark, E.answer_key(F.lit("mcq"), F.lit("Sahi (B) hai"))) == "b"
    assert one(spark, E.answer_key(F.lit("true_false"), F.lit("Yeh galat hai"))) == "false"
    assert one(spark, E.answer_key(F.lit("definition"), F.lit("(a)"))) is None
    assert one(spark, E.to_statement(F.lit("Cells are small."))) == "Cells are small hain."
    assert tuple(one(spark, E.with_agreement_error(F.lit("cell chhota hai.")))) == ("cell chhota hai.", "cell chhota hain.")
    assert tuple(one(spark, E.with_agreement_error(F.lit("chhota cell.")))) == ("chhota cell hai.", "chhota cell hain.")
    assert one(spark, E.strip_chapter(F.lit("chapter Cells: what is it"), F.lit("Cells"))) == "what is it"
    assert tuple(one(spark, E.split_true_false(F.lit("True/False: it is so")))) == ("it is so", True)
    labels = F.create_map(F.lit("Cell"), F.lit("EN"), F.lit("aur,"), F.lit("HI"))
    assert [one(spark, E.lookup_label(F.lit(w), labels)) for w in ("cell", "CELL.", "aur", "...", "new")] == ["EN", "EN", "HI", "UNIV", "EN"]
    ids, tags = F.array(*[F.lit(x) for x in (-1, 0, 0, 1, -1)]), F.array(F.lit(7), F.lit(8))
    assert one(spark, E.subword_labels(ids, tags)) == [-100, 7, -100, 8, -100]
    assert one(spark, E.subject(F.lit("Social Science"))) == "social_science"
    with pytest.raises(Exception, match="unknown subject"):
        one(spark, E.subject(F.lit("alchemy")))
    assert one(spark, E.escape_html(F.lit("<a href='x'>&"))) == "&lt;a href=&#x27;x&#x27;&gt;&amp;"
    found = E.request_issues(F.lit("q"), F.lit(9), F.lit(16), F.lit("french"), F.lit("9"), F.array())
    assert one(spark, found) == ["query length", "top_k", "language"]
    cut = E.sections(F.lit("x EXERCISES " + "one two three four five six seven eight " + "SUMMARY tail"), ["EXERCISES", "QUESTIONS"], ["SUMMARY"])
    assert [s["content"] for s in one(spark, cut)] == ["one two three four five six seven eight"]
