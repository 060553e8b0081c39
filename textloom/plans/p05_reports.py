"""Statistics and evaluation over documents, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import reports as M
from textloom.plans import _sql as S
from textloom.registry import load, query

# Gold and predicted labels by rule, so that one label is never predicted and one is never gold.
PRED = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS gold, CASE doc_id % 5 WHEN 0 THEN 'toxic' WHEN 1 THEN 'unsure' ELSE 'good' END AS pred, CASE doc_id % 3 WHEN 0 THEN 'bio' WHEN 1 THEN 'history' ELSE 'civics' END AS subject FROM labels"


def predictions(spark, d):
    k = F.col("doc_id")
    return load(spark, d, "labels").select(
        "doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("bad").alias("gold"),
        F.when(k % 5 == 0, "toxic").when(k % 5 == 1, "unsure").otherwise("good").alias("pred"), F.when(k % 3 == 0, "bio").when(k % 3 == 1, "history").otherwise("civics").alias("subject"),
    )


SCORES = f"""SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (SELECT gold AS label, (gold = pred)::INT AS tp, 0 AS fp, (gold <> pred)::INT AS fn FROM ({PRED}) UNION ALL SELECT pred, 0, (gold <> pred)::INT, 0 FROM ({PRED})) GROUP BY label"""
F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"


@query("agg01_tag_histogram", f"SELECT tag, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM (SELECT {S.lid('b')} AS tag FROM (SELECT {S.bare('w')} AS b FROM ({S.words_of_documents()}))) GROUP BY tag")
def tag_histogram(spark, d):
    from pyspark.sql import Window

    words = load(spark, d, "documents").select(F.explode(T.split_words(F.col("text"))).alias("w")).groupBy(T.bare(F.col("w")).alias("b")).count()
    tags = words.groupBy(T.word_language(F.col("b")).alias("tag")).agg(F.sum("count").alias("n"))  # six rows at most
    return tags.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("agg02_dataset_statistics", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS long_docs, count(DISTINCT source) AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS names, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY lang")
def dataset_statistics(spark, d):
    names = F.array_join(F.sort_array(F.collect_set("source")), ",")
    return load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long_docs"), F.count_distinct("source").alias("sources"), names.alias("names"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("agg03_map_cmi", f"""
WITH k AS (SELECT conv_id, turn, CASE WHEN s = '' THEN w ELSE s END AS k, {S.position_lid('s', 'i', False)} AS v, i FROM (SELECT *, {S.strip_marks('w')} AS s FROM (SELECT conv_id, turn, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT conv_id, turn, {S.tokens()} AS t FROM conversations)))),
l AS (SELECT conv_id, turn, k, arg_max(v, i) AS v FROM k GROUP BY ALL), c AS (SELECT conv_id, turn, count(*) FILTER (WHERE v = 'HI') AS hi, count(*) FILTER (WHERE v = 'EN') AS en FROM l GROUP BY ALL)
SELECT m.conv_id, m.turn, CASE WHEN hi + en > 0 THEN round((1 - greatest(hi, en)::DOUBLE / (hi + en)) * 100, 6) END AS cmi FROM conversations m LEFT JOIN c USING (conv_id, turn)""")
def map_cmi(spark, d):
    v = F.map_values(T.label_map(F.col("text")))
    n = lambda x, t: F.size(F.filter(x, lambda y: y == t))
    cmi = T.let(v, lambda x: F.when(n(x, "HI") + n(x, "EN") > 0, T.code_mixing(n(x, "HI"), n(x, "EN"))))
    return load(spark, d, "conversations").select("conv_id", "turn", F.round(cmi, 6).alias("cmi"))


@query("agg04_confusion", f"SELECT gold, pred, count(*) AS n FROM ({PRED}) GROUP BY ALL")
def confusion(spark, d):
    return M.confusion(predictions(spark, d))


@query("agg05_label_scores", f"SELECT label, tp, fp, fn, tp + fn AS support, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END, 9) AS recall, round({F1}, 9) AS f1 FROM ({SCORES})")
def label_scores(spark, d):
    return M.label_scores(predictions(spark, d)).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("agg06_agg07_summary", f"SELECT round(sum(tp)::DOUBLE / sum(tp + fn), 9) AS accuracy, round(avg({F1}), 9) AS macro_f1_all, round(avg({F1}) FILTER (WHERE tp + fn > 0), 9) AS macro_f1_gold, round(avg(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END), 9) AS mean_recall FROM ({SCORES})")
def summary(spark, d):
    s = M.summary(predictions(spark, d))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


SPANS = "SELECT doc_id, i AS a, length(w) AS z, upper(w[1]) AS kind FROM (" + S.words_of_documents().replace("{", "{{").replace("}", "}}") + ") WHERE regexp_matches(w, '^[A-Z][a-z]') AND i % {m} < {k}"


@query("agg08_span_scores", f"""WITH g AS (SELECT DISTINCT * FROM ({SPANS.format(m=5, k=4)})), p AS (SELECT DISTINCT * FROM ({SPANS.format(m=3, k=2)})), j AS (SELECT coalesce(g.kind, p.kind) AS kind, g.doc_id AS g, p.doc_id AS p FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.a = p.a AND g.z = p.z AND g.kind = p.kind),
t AS (SELECT kind, count(g) AS gold, count(p) AS pred, count(*) FILTER (WHERE g IS NOT NULL AND p IS NOT NULL) AS tp FROM j GROUP BY GROUPING SETS ((kind), ())) SELECT kind, gold, pred, tp, round(CASE WHEN gold + pred = 0 THEN 0.0 ELSE 2.0 * tp / (gold + pred) END, 9) AS f1 FROM t""")
def span_scores(spark, d):
    w = load(spark, d, "documents").select("doc_id", F.posexplode(T.split_words(F.col("text"))).alias("a", "w")).where(F.col("w").rlike("^[A-Z][a-z]"))
    s = w.select("doc_id", "a", F.length("w").alias("z"), F.upper(F.substring("w", 1, 1)).alias("kind"))
    return M.span_scores(s.where("a % 5 < 4"), s.where("a % 3 < 2"), ["doc_id", "a", "z"], "kind").select("kind", "gold", "pred", "tp", F.round("f1", 9).alias("f1"))


@query("agg10_file_summary", "SELECT source, count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS english, count(DISTINCT (lang, n_chars > 1000)) AS kinds FROM documents GROUP BY source")
def file_summary(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("english"), F.count_distinct(F.struct("lang", F.col("n_chars") > 1000)).alias("kinds"))


@query("agg11_grouped_report", f"SELECT subject, gold, count(*) AS n, count(*) FILTER (WHERE gold = pred) AS right_ones FROM ({PRED}) GROUP BY GROUPING SETS ((), (subject), (gold))")
def grouped_report(spark, d):
    return M.grouped(predictions(spark, d), ["subject", "gold"], F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("right_ones"))


@query("agg12_gap_report", "SELECT event_type, round(avg(value), 6) AS pred_mean, round(avg(50), 6) AS ref_mean, round(avg(abs(value - 50)), 6) AS mean_gap FROM events GROUP BY event_type")
def gap_report(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("pred_mean"), F.round(F.avg(F.lit(50)), 6).alias("ref_mean"), F.round(F.avg(F.abs(F.col("value") - 50)), 6).alias("mean_gap"))


@query("agg13_key_accuracy", f"SELECT subject, round(avg((gold = pred)::INT), 9) AS accuracy FROM ({PRED}) WHERE gold IN ('good', 'toxic') GROUP BY subject")
def key_accuracy(spark, d):
    return predictions(spark, d).where("gold in ('good', 'toxic')").groupBy("subject").agg(F.round(F.avg((F.col("gold") == F.col("pred")).cast("int")), 9).alias("accuracy"))


@query("agg14_text_scores")
def text_scores(spark, d):
    rows = load(spark, d, "benchmark").select("item_id", F.col("text").alias("gold"), F.array_join(F.filter(T.split_words(F.col("text")), lambda w, i: i > 0), " ").alias("pred"))
    return M.text_scores(rows, "pred", "gold").select("item_id", F.round("rouge_l", 9).alias("rouge_l"), F.round("chrf", 6).alias("chrf"))


@query("agg14_vector_scores")
def vector_scores(spark, d):
    from textloom.operators.adapters import hashed_vectors

    rows = load(spark, d, "benchmark").select("item_id", F.col("text").alias("gold"), F.array_join(F.filter(T.split_words(F.col("text")), lambda w, i: i > 0), " ").alias("pred"))
    return M.vector_scores(rows, "pred", "gold", hashed_vectors).select("item_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("agg14_perplexity", "SELECT event_type, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY event_type")
def perplexity(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.round(M.perplexity(F.col("value") / 100), 6).alias("perplexity"))


@query("agg15_keyword_hits", "SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'que')::INT) / 3.0 AS rate FROM documents")
def keyword_hits(spark, d):
    keys = F.array(F.lit("the"), F.lit("und"), F.lit("que"))
    return load(spark, d, "documents").select("doc_id", (F.size(F.filter(keys, lambda k: F.contains(F.lower("text"), k))) / F.lit(3.0)).alias("rate"))


@query("agg17_completeness", "SELECT complete, count(*) AS chapters, sum(n)::BIGINT AS entries FROM (SELECT source, count(*) AS n, count(*) >= 50 AS complete FROM documents GROUP BY source) GROUP BY complete")
def completeness(spark, d):
    by = load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return by.groupBy((F.col("n") >= 50).alias("complete")).agg(F.count("*").alias("chapters"), F.sum("n").alias("entries"))


@query("agg18_most_common", f"SELECT w, count(*) AS n FROM ({S.words_of_documents()}) GROUP BY w ORDER BY n DESC, w LIMIT 20")
def most_common(spark, d):
    return load(spark, d, "documents").select(F.explode(T.split_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(20)


@query("agg19_distinct_sorted", "SELECT lang, string_agg(DISTINCT source, ', ' ORDER BY source) AS chapters FROM documents GROUP BY lang")
def distinct_sorted(spark, d):
    return load(spark, d, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("chapters"))


@query("set02_span_difference", f"SELECT (SELECT count(*) FROM (({SPANS.format(m=5, k=4)}) INTERSECT ({SPANS.format(m=3, k=2)}))) AS shared, (SELECT count(*) FROM (({SPANS.format(m=5, k=4)}) EXCEPT ({SPANS.format(m=3, k=2)}))) AS only_gold")
def span_difference(spark, d):
    w = load(spark, d, "documents").select("doc_id", F.posexplode(T.split_words(F.col("text"))).alias("a", "w")).where(F.col("w").rlike("^[A-Z][a-z]"))
    s = w.select("doc_id", "a", F.length("w").alias("z"), F.upper(F.substring("w", 1, 1)).alias("kind"))
    g, p = s.where("a % 5 < 4"), s.where("a % 3 < 2")
    return g.intersect(p).agg(F.count("*").alias("shared")).crossJoin(g.subtract(p).agg(F.count("*").alias("only_gold")))


@query("prj12_card_rows", "SELECT lang, format('| {} | {} | {} |', lang, count(*), count(DISTINCT source)) AS row FROM documents GROUP BY lang")
def card_rows(spark, d):
    g = load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("s"))
    return g.select("lang", F.format_string("| %s | %d | %d |", "lang", "n", "s").alias("row"))


@query("src14_staging", "SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS kept, count(DISTINCT source) AS sources FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def staging(spark, d):
    return load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("kept"), F.count_distinct("source").alias("sources"))
