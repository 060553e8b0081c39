"""Stems, tags, entities, questions and answers over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import docs as D
from textloom.functions import nlp as N
from textloom.functions import text as T
from textloom.operators import adapters as A
from textloom.operators import chats as C
from textloom.operators import generators as G
from textloom.plans import _sql as S
from textloom.plans.p02_documents import SENTENCES
from textloom.registry import load, query


def words(spark, d):
    """Distinct bare words; models see each once."""
    w = load(spark, d, "documents").select(F.explode(T.split_words(F.col("text"))).alias("w")).select(T.bare(F.col("w")).alias("w"))
    return w.where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))


@query("txt22_stems")
def stems(spark, d):
    a = F.array("w")
    return words(spark, d).select("w", "n", N.porter_stems(a)[0].alias("porter"), N.lancaster_stems(a)[0].alias("lancaster"))


@query("txt23_lemmas")
def lemmas(spark, d):
    return words(spark, d).select("w", N.lemmas(F.array("w"))[0].alias("lemma"))


@query("txt24_stems_by_language")
def stems_by_language(spark, d):
    w = words(spark, d)
    return w.select("w", F.when(T.word_language(F.col("w")) == "EN", N.porter_stems(F.array("w"))[0]).otherwise(F.col("w")).alias("stem"))


@query("txt25_tag_counts")
def tag_counts(spark, d):
    return words(spark, d).select(N.tags(F.array("w"))[0].alias("tag"), "n").groupBy("tag").agg(F.sum("n").alias("n"))


@query("txt14_treebank")
def treebank(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(N.treebank_tokens(F.col("text"))).alias("n"), F.size(T.split_words(F.col("text"))).alias("n_split"))


@query("txt15_segments", "SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\\s]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s, ' ')) > 15)) AS n FROM documents")
def segments(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"), 15)).alias("n"))


@query("ner1_gazetteer")
def gazetteer(spark, d):
    phrases = [(("the", "the"), "PLACE"), (("the",), "PERSON"), (("que",), "PROCESS"), (("und",), "CONCEPT")]
    s = load(spark, d, "documents").select("doc_id", F.explode(N.gazetteer(phrases)(T.tokens_stripped(F.col("text")))).alias("s"))
    return s.groupBy("doc_id", "s.label").agg(F.count("*").alias("n"))


@query("ner1_phrases", "SELECT doc_id, len(list_filter(t, lambda w: lower(w) = 'the')) AS n FROM (SELECT doc_id, list_filter(list_transform(" + S.tokens() + ", lambda w: " + S.strip_marks("w") + "), lambda w: w <> '') AS t FROM documents)")
def phrases(spark, d):
    spans = N.gazetteer([(("the",), "CONCEPT")])(T.tokens_stripped(F.col("text")))
    return load(spark, d, "documents").select("doc_id", F.size(spans).alias("n"))


@query("gen04_reactions", "SELECT doc_id, intent, question FROM documents JOIN (VALUES ('license', 'definition', 'What is a license?'), ('und', 'short_answer', 'Which language is this?')) b(trigger, intent, question) ON contains(lower(text), trigger)")
def reactions(spark, d):
    bank = spark.createDataFrame([("license", "definition", "What is a license?"), ("und", "short_answer", "Which language is this?")], "trigger string, intent string, question string")
    return G.reactions(load(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", bank)


@query("gen05_numbered_questions", "SELECT doc_id, 0 AS i, md5(regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g')) AS question_md5, 'a) yes|b) no' AS options FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 1, md5('Why?'), '' FROM documents WHERE text IS NOT NULL")
def numbered(spark, d):
    text = F.concat(F.lit("1. "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n(a) yes\n(b) no\n2. Why?\n"))
    q = load(spark, d, "documents").select("doc_id", F.posexplode(G.numbered_questions(text)).alias("i", "q"))
    return q.select("doc_id", "i", F.md5("q.question").alias("question_md5"), F.array_join("q.options", "|").alias("options"))


_WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower(question), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda w: regexp_full_match(w, '[a-z]{4,}')))"


@query("jon11_best_window", f"""WITH d AS (SELECT doc_id, {SENTENCES} AS x FROM documents), q AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
w AS (SELECT conv_id, turn, {_WORDS} AS words, unnest(range(0, greatest(0, len(x) - 5) + 1, 2)) AS k, x FROM q JOIN d ON doc_id = conv_id WHERE len(x) > 0),
s AS (SELECT conv_id, turn, k, array_to_string(x[k + 1 : k + 5], ' ') AS t, words FROM w), n AS (SELECT conv_id, turn, k, t, len(list_filter(words, lambda y: contains(lower(t), y))) AS n FROM s)
SELECT conv_id, turn, n AS score, md5(t) AS window_md5 FROM n QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, k) = 1""")
def best_window(spark, d):
    """For every question of a conversation the best window of the document of the same number."""
    q = load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    x = load(spark, d, "documents").select("doc_id", D.split_sentences(F.col("text")).alias("x")).where(F.size("x") > 0)
    found = q.join(x, F.col("conv_id") == F.col("doc_id")).withColumn("w", G.scored_window(F.col("question"), F.col("x")))
    return found.select("conv_id", "turn", F.col("w.score").cast("long").alias("score"), F.md5("w.text").alias("window_md5"))


@query("vec01_embed")
def embed(spark, d):
    return load(spark, d, "benchmark").select("item_id", A.embed(F.col("text")).alias("embedding"))


@query("vec13_intents")
def intents(spark, d):
    """The classifier of intents, here with the four languages as classes: rules give the tables one intent only."""
    rows = load(spark, d, "documents").select("doc_id", "text", "lang")
    found = A.predict_intents(A.train_intents(rows.where("doc_id % 5 <> 0"), "text", "lang"), rows.where("text is not null"), "text")
    return found.select("doc_id", "lang", F.col("top")[0]["intent"].alias("first"), F.col("top")[0]["confidence"].alias("confidence"), F.col("top")[1]["intent"].alias("second"))


@query("vec12_answers")
def answers(spark, d):
    """Every user turn: made to stand alone, searched, answered."""
    b = load(spark, d, "benchmark").select("item_id", "text", A.embed(F.col("text")).alias("embedding"))
    turns = load(spark, d, "conversations").withColumn("p", C.previous_question("conv_id", "turn")).where("role = 'user'")
    q = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("q_id"), A.standalone(F.col("text"), F.col("p")).alias("question"))
    return A.answer(q.withColumn("embedding", A.embed(F.col("question"))), b.withColumnRenamed("item_id", "id"))
