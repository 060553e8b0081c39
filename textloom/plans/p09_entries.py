"""Entries, answers, labels and requests over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import entries as E
from textloom.functions import text as T
from textloom.plans import _sql as S
from textloom.registry import load, query


def turns(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", "role", "text")


@query("txt41_true_false", "SELECT conv_id, turn, trim(s, ' :-') AS statement FROM (SELECT conv_id, turn, substr(trim(t), 15) AS s FROM (SELECT conv_id, turn, 'True or False: ' || text AS t FROM conversations))")
def true_false(spark, d):
    s = E.split_true_false(F.concat(F.lit("True or False: "), F.col("text")))
    return turns(spark, d).select("conv_id", "turn", s["statement"].alias("statement"))


@query("txt41_chapter_prefix", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5(ltrim(text, ' :,-')) ELSE md5(text) END AS text_md5 FROM documents")
def chapter_prefix(spark, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("chapter "), F.col("source"), F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.md5(E.strip_chapter(t, F.col("source"))).alias("text_md5"))


@query("txt42_statement", "SELECT conv_id, turn, rtrim(trim(text), '.?!') || CASE WHEN regexp_matches(rtrim(trim(text), '.?!'), '(?i)\\b(are|were)\\b') THEN ' hain.' ELSE ' hai.' END AS statement FROM conversations")
def statement(spark, d):
    return turns(spark, d).select("conv_id", "turn", E.to_statement(F.col("text")).alias("statement"))


@query("txt42_query", "SELECT conv_id, turn, trim('Sir, ' || array_to_string((" + S.tokens("rtrim(trim(text), '.?!')") + ")[1:12], ' ') || ' samjhao?') AS question FROM conversations")
def to_query(spark, d):
    return turns(spark, d).select("conv_id", "turn", E.to_query(F.col("text"), F.lit("samjhao?")).alias("question"))


@query("txt42_agreement_error", "SELECT conv_id, turn, rtrim(trim(text), '.') || ' hain.' AS wrong FROM conversations WHERE NOT contains(text, ' hai')")
def agreement_error(spark, d):
    return turns(spark, d).where(~F.col("text").contains(" hai")).select("conv_id", "turn", E.with_agreement_error(F.col("text"))["wrong"].alias("wrong"))


@query("txt44_answer_key", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'true' END AS answer_key FROM events")
def answer_key(spark, d):
    k = F.col("event_id") % 3
    intent = F.when(k == 0, "mcq").when(k == 1, "true_false").otherwise("definition")
    text = F.when(k == 0, "Sahi option ( B ) hai").otherwise("Yeh sahi hai")
    return load(spark, d, "events").select("event_id", E.answer_key(intent, text).alias("answer_key"))


@query("txt47_label_lookup", f"SELECT doc_id, tag, count(*) AS n FROM (SELECT doc_id, CASE WHEN trim(w, '.,?!;:()-/\"''–—…') = '' THEN 'UNIV' WHEN lower(trim(w, '.,?!;:()-/\"''–—…')) = 'the' THEN 'HI' WHEN lower(trim(w, '.,?!;:()-/\"''–—…')) = 'und' THEN 'MIX' ELSE 'EN' END AS tag FROM ({S.words_of_documents()})) GROUP BY ALL")
def label_lookup(spark, d):
    labels = F.create_map(F.lit("the"), F.lit("HI"), F.lit("Und"), F.lit("MIX"))
    w = load(spark, d, "documents").select("doc_id", F.explode(T.split_words(F.col("text"))).alias("w"))
    return w.groupBy("doc_id", E.lookup_label(F.col("w"), labels).alias("tag")).agg(F.count("*").alias("n"))


@query("txt48_subword_labels", f"SELECT doc_id, count(*) AS pieces, count(*) FILTER (WHERE k > 0) AS ignored FROM (SELECT doc_id, unnest(range((length(w) + 3) // 4)) AS k FROM ({S.words_of_documents()})) GROUP BY doc_id")
def subword_labels(spark, d):
    # A piece for every four characters of a word.
    ids = T.let(T.split_words(F.col("text")), lambda ws: F.flatten(F.transform(ws, lambda w, i: F.array_repeat(i, F.floor((F.length(w) + 3) / 4).cast("int")))))
    rows = load(spark, d, "documents").select("doc_id", ids.alias("ids"), F.transform(T.split_words(F.col("text")), lambda w, i: F.lit(1)).alias("labels")).where(F.size("ids") > 0)
    labelled = rows.select("doc_id", E.subword_labels(F.col("ids"), F.col("labels")).alias("l"))
    return labelled.select("doc_id", F.size("l").cast("long").alias("pieces"), F.size(F.filter("l", lambda x: x == -100)).cast("long").alias("ignored"))


@query("aug06_rebuild_labels", f"SELECT doc_id, tag, count(*) AS n FROM (SELECT doc_id, CASE WHEN c = 'the' THEN 'MIX' WHEN lower(c) IN ('nahi', 'mat', 'ka', 'ki', 'ke', 'ko', 'se', 'mein', 'aur', 'tatha', 'lekin', 'parantu', 'kyunki', 'isliye', 'koshika', 'koshikaye', 'jhilli', 'kendr', 'urja-kendra', 'urja') THEN 'HI' WHEN lower(c) = 'sir' THEN 'UNIV' WHEN regexp_full_match(c, '[0-9]+') THEN 'UNIV' WHEN i > 0 AND regexp_matches(c, '^\\p{{Lu}}') THEN 'NE' ELSE 'EN' END AS tag FROM (SELECT doc_id, i, regexp_extract(w, '(?s)^([^\\p{{L}}\\p{{N}}]*)(.*?)([^\\p{{L}}\\p{{N}}]*)$', 2) AS c FROM ({S.words_of_documents()})) WHERE c <> '') GROUP BY ALL")
def rebuild_labels(spark, d):
    w = load(spark, d, "documents").select("doc_id", F.posexplode(T.split_words(F.col("text"))).alias("i", "w")).select("doc_id", "i", T.core_parts(F.col("w"))["core"].alias("c")).where("c <> ''")
    return w.groupBy("doc_id", E.rebuild_label(F.col("c"), F.col("i"), F.create_map(F.lit("the"), F.lit("MIX"))).alias("tag")).agg(F.count("*").alias("n"))


@query("val05_silver_labels", f"SELECT label_source, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN CASE WHEN len({S.tokens()}) > 0 THEN 'silver' ELSE 'none' END ELSE 'gold' END AS label_source FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) GROUP BY label_source")
def silver_labels(spark, d):
    gold = load(spark, d, "labels").select("doc_id").distinct().withColumn("g", F.lit(True))
    rows = load(spark, d, "documents").select("doc_id", F.size(T.split_words(F.col("text"))).alias("n")).join(gold, "doc_id", "left")
    return rows.groupBy(F.when(F.col("g"), "gold").when(F.col("n") > 0, "silver").otherwise("none").alias("label_source")).agg(F.count("*").alias("n"))


@query("snk08_escape", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM documents")
def escape(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(E.escape_html(F.col("text"))).alias("escaped_md5"))


@query("api02_request_issues", "SELECT event_id, CASE WHEN length(event_type) BETWEEN 2 AND 1000 THEN 0 ELSE 1 END + CASE WHEN event_id % 12 BETWEEN 1 AND 8 THEN 0 ELSE 1 END + CASE WHEN event_id % 1000 BETWEEN 16 AND 768 THEN 0 ELSE 1 END AS n FROM events")
def request_issues(spark, d):
    k = F.col("event_id")
    found = E.request_issues(F.col("event_type"), k % 12, k % 1000, F.lit("hinglish"), F.lit(None).cast("string"), F.array())
    return load(spark, d, "events").select("event_id", F.size(found).alias("n"))


@query("vec10_subject_alias", "SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'biology' ELSE 'social_science' END AS subject FROM events")
def subject_alias(spark, d):
    return load(spark, d, "events").select("event_id", E.subject(F.when(F.col("event_id") % 2 == 0, "Bio").otherwise("SS")).alias("subject"))


@query("chk17_sections", "SELECT doc_id, 'E X E R C I S E S' AS marker, md5(c) AS content_md5 FROM (SELECT doc_id, text, CASE WHEN length(text) < 18 THEN trim(text || ' What you have learnt rest', ' ') ELSE trim(text, ' ') END AS c FROM documents) WHERE length(c) > 30 AND NOT contains(text, 'E X E R C I S E S') AND NOT contains(text, 'Q U E S T I O N S') AND NOT contains(text, 'What you have learnt') AND NOT contains(text, 'At a Glance')")
def sections(spark, d):
    text = F.concat(F.lit("intro E X E R C I S E S "), F.col("text"), F.lit(" What you have learnt rest"))
    s = load(spark, d, "documents").select("doc_id", F.explode(E.sections(text, ["E X E R C I S E S", "Q U E S T I O N S"], ["What you have learnt", "At a Glance"])).alias("s"))
    return s.select("doc_id", "s.marker", F.md5("s.content").alias("content_md5"))


_CORE = "trim(w, '.,;:?!\"''()-')"


@query("txt19_trim_garbage", f"""WITH w AS (SELECT doc_id, w, i, regexp_matches({_CORE}, '[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{{4,}}') AS bad, regexp_matches({_CORE}, '^\\p{{Lu}}') AS capital FROM ({S.words_of_documents()})),
s AS (SELECT doc_id, min(i) FILTER (WHERE capital AND NOT bad) AS stop FROM w GROUP BY doc_id), k AS (SELECT doc_id, coalesce(max(i) FILTER (WHERE bad AND (stop IS NULL OR i < stop)), -1) AS cut FROM w JOIN s USING (doc_id) GROUP BY doc_id),
r AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS rest FROM w JOIN k USING (doc_id) WHERE i > cut GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN length(rest) >= 40 THEN rest ELSE text END) AS value FROM documents LEFT JOIN r USING (doc_id)""")
def trim_garbage(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(E.trim_garbage(F.col("text"))).alias("value"))
