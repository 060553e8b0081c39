"""Per-token and per-text analysis over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom import lexicons as lex
from textloom.functions import text as T
from textloom.plans import _sql as S
from textloom.registry import load, query

COUNTS = f"SELECT doc_id, lang, list_transform({S.tokens()}, lambda w: {S.bare('w')}) AS b FROM documents"
TAGS = f"SELECT doc_id, lang, list_transform(b, lambda w: {S.lid('w')}) AS t FROM ({COUNTS})"


def tag_count(tag: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{tag}'))"


@query("txt01_char_scripts", """
SELECT script, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(c, '[\\x{0900}-\\x{097F}]') THEN 'DEVANAGARI' WHEN regexp_matches(c, '[A-Za-z]') THEN 'ROMAN' WHEN regexp_matches(c, '\\p{Nd}') THEN 'NUMERIC' WHEN regexp_matches(c, '[\\s\\p{Z}]') THEN 'SPACE' ELSE 'OTHER' END AS script
FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations) WHERE c <> '') GROUP BY script""")
def char_scripts(spark, d):
    chars = load(spark, d, "conversations").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return chars.groupBy("c").count().groupBy(T.char_script(F.col("c")).alias("script")).agg(F.sum("count").alias("n"))


@query("txt02_word_scripts", f"SELECT script, count(*) AS n FROM (SELECT {S.script('b')} AS script FROM (SELECT {S.bare('w')} AS b FROM ({S.words_of_documents()})) WHERE b <> '') GROUP BY script")
def word_scripts(spark, d):
    words = load(spark, d, "documents").select(F.explode(T.split_words(F.col("text"))).alias("w")).select(T.bare(F.col("w")).alias("b")).where("b <> ''")
    return words.groupBy("b").count().groupBy(T.word_script(F.col("b")).alias("script")).agg(F.sum("count").alias("n"))


@query("txt03_sentence_script", f"""
WITH s AS (SELECT doc_id, list_transform(list_distinct(list_filter({S.tokens()}, lambda w: {S.bare('w')} <> '')), lambda w: {S.script(S.bare('w'))}) AS t FROM documents)
SELECT doc_id, CASE WHEN {tag_count('DEVANAGARI')} = 0 AND {tag_count('MIXED')} = 0 THEN 'ROMAN' WHEN {tag_count('ROMAN')} = 0 AND {tag_count('MIXED')} = 0 THEN 'DEVANAGARI' ELSE 'MIXED' END AS overall,
len(t) AS n_distinct, {tag_count('ROMAN')} AS roman, {tag_count('DEVANAGARI')} AS devanagari, {tag_count('MIXED')} AS mixed FROM s""")
def sentence_script(spark, d):
    return load(spark, d, "documents").select("doc_id", T.sentence_script(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("txt04_strip_punct", """
SELECT prefix, suffix, count(*) AS n, sum(length(core)) AS core_chars FROM (SELECT regexp_extract(w, '(?s)^([^\\p{L}\\p{N}]*)(.*?)([^\\p{L}\\p{N}]*)$', 1) AS prefix, regexp_extract(w, '(?s)^([^\\p{L}\\p{N}]*)(.*?)([^\\p{L}\\p{N}]*)$', 2) AS core, regexp_extract(w, '(?s)^([^\\p{L}\\p{N}]*)(.*?)([^\\p{L}\\p{N}]*)$', 3) AS suffix
FROM (""" + S.words_of_documents() + ")) GROUP BY prefix, suffix")
def strip_punct(spark, d):
    words = load(spark, d, "documents").select(F.explode(T.split_words(F.col("text"))).alias("w")).groupBy("w").count()
    return words.select(T.core_parts(F.col("w")).alias("p"), "count").groupBy("p.prefix", "p.suffix").agg(F.sum("count").alias("n"), F.sum(F.length("p.core") * F.col("count")).alias("core_chars"))


REWRITE = f"""SELECT doc_id, w, coalesce(regexp_extract(w, '(?s)^([^\\p{{L}}\\p{{N}}]*)(.*?)([^\\p{{L}}\\p{{N}}]*)$', 1) || {S.cases(lex.REWRITES, "lower(regexp_extract(w, '(?s)^([^\\p{L}\\p{N}]*)(.*?)([^\\p{L}\\p{N}]*)$', 2))")} || regexp_extract(w, '(?s)^([^\\p{{L}}\\p{{N}}]*)(.*?)([^\\p{{L}}\\p{{N}}]*)$', 3), w) AS r, i FROM ({S.words_of_documents()})"""


@query("txt05_normalize_spelling", f"SELECT doc_id, md5(string_agg(r, ' ' ORDER BY i)) AS text_md5, count(*) FILTER (WHERE r <> w) AS n_changes FROM ({REWRITE}) GROUP BY doc_id")
def normalize_spelling(spark, d):
    return load(spark, d, "documents").select("doc_id", T.normalize_spelling(F.col("text")).alias("s")).where("s.text <> ''").select("doc_id", F.md5("s.text").alias("text_md5"), F.col("s.n_changes").cast("long").alias("n_changes"))


@query("txt06_normalize_sentence", """
WITH s AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')), '\\s+([.,!?;:])', '\\1', 'g'), '[.]{2,}', '.', 'g'), '[!]{2,}', '!', 'g'), '[?]{2,}', '?', 'g') AS s FROM conversations),
p AS (SELECT conv_id, turn, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT conv_id, turn, """ + S.tokens("s") + """ AS t FROM s)),
q AS (SELECT *, regexp_extract(w, '(?s)^([^\\p{L}\\p{N}]*)(.*?)([^\\p{L}\\p{N}]*)$', 1) AS a, regexp_extract(w, '(?s)^([^\\p{L}\\p{N}]*)(.*?)([^\\p{L}\\p{N}]*)$', 2) AS b, regexp_extract(w, '(?s)^([^\\p{L}\\p{N}]*)(.*?)([^\\p{L}\\p{N}]*)$', 3) AS c FROM p)
SELECT conv_id, turn, string_agg(coalesce(a || """ + S.cases(lex.REWRITES, "lower(b)") + """ || c, w), ' ' ORDER BY i) AS normalized FROM q GROUP BY conv_id, turn""")
def normalize_sentence(spark, d):
    rows = load(spark, d, "conversations").select("conv_id", "turn", T.normalize_sentence(F.col("text"))["text"].alias("normalized"))
    return rows.where("normalized <> ''").groupBy("conv_id", "turn").agg(F.max("normalized").alias("normalized"))


@query("txt07_word_lid", f"SELECT tag, count(*) AS n, count(DISTINCT b) AS n_words FROM (SELECT b, {S.lid('b')} AS tag FROM (SELECT {S.bare('w')} AS b FROM ({S.words_of_documents()}))) GROUP BY tag")
def word_lid(spark, d):
    words = load(spark, d, "documents").select(F.explode(T.split_words(F.col("text"))).alias("w")).groupBy(T.bare(F.col("w")).alias("b")).count()
    return words.groupBy(T.word_language(F.col("b")).alias("tag")).agg(F.sum("count").alias("n"), F.count("*").alias("n_words"))


@query("txt08_sentence_lid", f"SELECT doc_id, len(t) AS n_tokens, {tag_count('HI')} AS hi, {tag_count('EN')} AS en, {tag_count('UNIV')} AS univ, {tag_count('MIX')} AS mix, {tag_count('PUNCT')} AS punct FROM ({TAGS})")
def sentence_lid(spark, d):
    return load(spark, d, "documents").select("doc_id", T.language_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


@query("txt08_code_mixing_by_lang", f"""
WITH c AS (SELECT lang, len(t) AS n, {tag_count('HI')} AS hi, {tag_count('EN')} AS en FROM ({TAGS}))
SELECT lang, count(*) AS n_docs, sum(n) AS n_tokens, sum(hi) AS hi, sum(en) AS en, round(avg(CASE WHEN hi + en > 0 THEN (1 - greatest(hi, en)::DOUBLE / (hi + en)) * 100 ELSE 0.0 END), 6) AS mean_cmi FROM c GROUP BY lang""")
def code_mixing_by_lang(spark, d):
    c = load(spark, d, "documents").select("lang", T.language_counts(F.col("text")).alias("c")).select("lang", "c.*")
    return c.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("hi").alias("hi"), F.sum("en").alias("en"), F.round(F.avg(T.code_mixing(F.col("hi"), F.col("en"))), 6).alias("mean_cmi")
    )


@query("txt09_mixing_bands", f"""
WITH c AS (SELECT CASE WHEN hi + en > 0 THEN (1 - greatest(hi, en)::DOUBLE / (hi + en)) * 100 ELSE 0.0 END AS cmi FROM (SELECT {tag_count('HI')} AS hi, {tag_count('EN')} AS en FROM ({TAGS})))
SELECT CASE WHEN cmi = 0 THEN 'monolingual' WHEN cmi < 30 THEN 'low' WHEN cmi < 50 THEN 'moderate' ELSE 'high' END AS band, count(*) AS n FROM c GROUP BY band""")
def mixing_bands(spark, d):
    c = load(spark, d, "documents").select(T.language_counts(F.col("text")).alias("c")).select(T.code_mixing(F.col("c.hi"), F.col("c.en")).alias("cmi"))
    return c.groupBy(T.mixing_band(F.col("cmi")).alias("band")).agg(F.count("*").alias("n"))


for _name, _capitals in (("txt10_position_lid", True), ("txt11_position_lid_plain", False)):

    @query(_name, f"SELECT doc_id, tag, count(*) AS n FROM (SELECT doc_id, {S.position_lid('s', 'i', _capitals)} AS tag FROM (SELECT doc_id, {S.strip_marks('w')} AS s, i FROM ({S.words_of_documents()}))) GROUP BY doc_id, tag")
    def position_lid(spark, d, capitals=_capitals):
        words = load(spark, d, "documents").select("doc_id", F.posexplode(T.split_words(F.col("text"))).alias("i", "w"))
        return words.groupBy("doc_id", T.position_language(F.col("w"), F.col("i"), capitals).alias("tag")).agg(F.count("*").alias("n"))


@query("txt11_label_map", f"""
WITH k AS (SELECT conv_id, turn, CASE WHEN s = '' THEN w ELSE s END AS k, {S.position_lid('s', 'i', False)} AS v, i FROM (SELECT *, {S.strip_marks('w')} AS s FROM (SELECT conv_id, turn, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT conv_id, turn, {S.tokens()} AS t FROM conversations)))),
l AS (SELECT conv_id, turn, k, arg_max(v, i) AS v FROM k GROUP BY conv_id, turn, k)
SELECT conv_id, turn, count(*) AS n_keys, count(*) FILTER (WHERE v = 'NE') AS n_ne, count(*) FILTER (WHERE v = 'HI') AS n_hi FROM l GROUP BY conv_id, turn""")
def label_map(spark, d):
    m = load(spark, d, "conversations").select("conv_id", "turn", F.map_values(T.label_map(F.col("text"))).alias("v")).where(F.size("v") > 0)
    n = lambda t: F.size(F.filter("v", lambda x: x == t)).cast("long")
    return m.groupBy("conv_id", "turn").agg(F.sum(F.size("v")).alias("n_keys"), F.sum(n("NE")).alias("n_ne"), F.sum(n("HI")).alias("n_hi"))


@query("txt12_tokens_stripped", f"SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY i)) AS tokens_md5 FROM (SELECT doc_id, i, {S.strip_marks('w')} AS s FROM ({S.words_of_documents()})) WHERE s <> '' GROUP BY doc_id")
def tokens_stripped(spark, d):
    t = load(spark, d, "documents").select("doc_id", T.tokens_stripped(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("tokens_md5"))


@query("txt13_tokens_symbols", "SELECT doc_id, len(t) AS n, md5(array_to_string(t, '|')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\p{Z}])', 1) AS t FROM documents)")
def tokens_symbols(spark, d):
    t = load(spark, d, "documents").select("doc_id", T.tokens_symbols(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("tokens_md5"))


@query("txt16_sentences", "SELECT doc_id, count(*) AS n, sum(length(s)) AS chars FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\\s]+', '\\1' || chr(1), 'g'), chr(1))), ' ') AS s FROM documents) WHERE length(s) > 30 GROUP BY doc_id")
def sentences(spark, d):
    s = load(spark, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


STOPS = S.listed((lex.ENGLISH_STOPS | lex.DOMAIN_STOPS) - lex.PROTECTED)


@query("txt20_stop_words", f"SELECT doc_id, count(*) AS n_kept, md5(string_agg(w, ' ' ORDER BY i)) AS kept_md5 FROM ({S.words_of_documents()}) WHERE regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+') AND lower(w) NOT IN {STOPS} GROUP BY doc_id")
def stop_words(spark, d):
    k = load(spark, d, "documents").select("doc_id", T.remove_stops(T.split_words(F.col("text"))).alias("k")).where(F.size("k") > 0)
    return k.select("doc_id", F.size("k").cast("long").alias("n_kept"), F.md5(F.array_join("k", " ")).alias("kept_md5"))


@query("txt21_stop_reasons", f"""
SELECT doc_id, reason, count(*) AS n FROM (SELECT doc_id, CASE WHEN NOT regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+') THEN 'PUNCT' WHEN tag = 'EN' AND lower(w) IN {STOPS} THEN 'EN_STOP' WHEN tag = 'HI' AND lower(w) IN {S.listed(lex.HINDI_STOPS)} THEN 'HI_STOP' ELSE 'KEPT' END AS reason
FROM (SELECT doc_id, w, {S.lid('b')} AS tag FROM (SELECT doc_id, w, {S.bare('w')} AS b FROM ({S.words_of_documents()})))) GROUP BY doc_id, reason""")
def stop_reasons(spark, d):
    r = load(spark, d, "documents").select("doc_id", F.explode(T.stop_reasons(T.split_words(F.col("text")))).alias("r"))
    return r.groupBy("doc_id", F.coalesce("r.reason", F.lit("KEPT")).alias("reason")).agg(F.count("*").alias("n"))


@query("txt26_route", f"""
SELECT route, count(*) AS n FROM (SELECT CASE WHEN {tag_count('HI')} > 0 OR len(list_filter(list_transform(b, lambda w: {S.script('w')}), lambda s: s IN ('DEVANAGARI', 'MIXED'))) > 0 THEN 'hinglish' ELSE 'english' END AS route
FROM (SELECT b, list_transform(b, lambda w: {S.lid('w')}) AS t FROM ({COUNTS}))) GROUP BY route""")
def route(spark, d):
    tags = F.transform(T.split_words(F.col("text")), T.word_language)
    mixed = F.exists(tags, lambda t: t.isin("HI", "MIX"))
    return load(spark, d, "documents").groupBy(F.when(mixed, "hinglish").otherwise("english").alias("route")).agg(F.count("*").alias("n"))


@query("txt29_text_stats", f"""
SELECT doc_id, length(text) AS characters, len({S.tokens()}) AS words, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(regexp_replace(s, '[\\s\\p{{Z}}]+', ' ', 'g')) <> '')) AS sentences,
len(list_filter(string_split(text, chr(10) || chr(10)), lambda s: trim(regexp_replace(s, '[\\s\\p{{Z}}]+', ' ', 'g')) <> '')) AS paragraphs FROM documents""")
def text_stats(spark, d):
    some = lambda s: T.squeeze(s) != ""
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", F.length(t).alias("characters"), F.size(T.split_words(t)).alias("words"), F.size(F.filter(F.split(t, "[.!?]+"), some)).alias("sentences"), F.size(F.filter(F.split(t, "\n\n"), some)).alias("paragraphs"))


@query("txt33_repeat_words", f"SELECT doc_id, md5(string_agg(w, ' ' ORDER BY i)) AS text_md5, count(*) AS n FROM (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM ({S.words_of_documents()})) WHERE p IS NULL OR p <> w GROUP BY doc_id")
def repeat_words(spark, d):
    k = load(spark, d, "documents").select("doc_id", T.let(T.split_words(F.col("text")), T.drop_repeats).alias("k")).where(F.size("k") > 0)
    return k.select("doc_id", F.md5(F.array_join("k", " ")).alias("text_md5"), F.size("k").cast("long").alias("n"))


INTENT_RULES = [
    ("list_enumerate", "\\b(list|name all|enumerate|give (two|three|four|five))\\b"),
    ("definition", "\\b(define|what is meant by|what do you mean|meaning of)\\b"),
    ("compare_concepts", "\\b(difference|compare|distinguish|versus)\\b"),
    ("give_example", "\\b(example|illustrate|give an instance)\\b"),
    ("list_enumerate", "\\b(arrange|order|sequence|correct order)\\b"),
    ("short_answer", "\\b(why|give reason|explain why)\\b"),
    ("explain_concept", "\\b(how|describe|explain|discuss|outline)\\b"),
]
INTENT_CASE = "CASE WHEN contains(q, 'assertion') AND contains(q, 'reason') THEN 'assertion_reason' " + " ".join(f"WHEN regexp_matches(q, {S.quoted(p)}) THEN '{n}'" for n, p in INTENT_RULES) + " ELSE 'analytical' END"


@query("txt40_classify_intent", f"SELECT intent, count(*) AS n FROM (SELECT {INTENT_CASE} AS intent FROM (SELECT lower(text) AS q FROM conversations WHERE role = 'user')) GROUP BY intent")
def classify_intent(spark, d):
    return load(spark, d, "conversations").where("role = 'user'").groupBy(T.classify_intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


@query("flt05_normalize_intent", """
SELECT event_type, current_intent, count(*) AS n FROM (SELECT event_type, CASE i WHEN 'define_term' THEN 'definition' WHEN 'apply_concept' THEN 'application_reallife' WHEN 'mcq' THEN 'mcq' END AS current_intent
FROM (SELECT event_type, CASE event_id % 4 WHEN 0 THEN 'define_term' WHEN 1 THEN 'apply_concept' WHEN 2 THEN 'formula_request' ELSE 'mcq' END AS i FROM events)) GROUP BY ALL""")
def normalize_intent(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, "define_term").when(F.col("event_id") % 4 == 1, "apply_concept").when(F.col("event_id") % 4 == 2, "formula_request").otherwise("mcq")
    return load(spark, d, "events").groupBy("event_type", T.normalize_intent(raw).alias("current_intent")).agg(F.count("*").alias("n"))


@query("flt16_clean_rewrite", """
SELECT conv_id, turn, CASE WHEN length(r) BETWEEN 3 AND 300 THEN r END AS rewrite FROM (SELECT conv_id, turn, trim(regexp_replace(trim(string_split(trim(text), chr(10))[1]), '^(standalone question|question)\\s*:\\s*', '', 'i'), ' "''`*') AS r FROM conversations)""")
def clean_rewrite(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", T.standalone_rewrite(F.col("text"), F.lit("")).alias("rewrite"))


@query("flt06_askable", "SELECT count(*) AS n, count(*) FILTER (WHERE length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= 2) AS askable FROM conversations")
def askable(spark, d):
    good = F.length(F.regexp_replace("text", "[^\\p{L}\\p{N}]", "")) >= 2
    return load(spark, d, "conversations").agg(F.count("*").alias("n"), F.count_if(good).alias("askable"))


@query("txt43_devanagari_share", "SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, regexp_matches(text, '[\\x{0900}-\\x{097F}]') AS has_devanagari FROM documents")
def devanagari_share(spark, d):
    return load(spark, d, "documents").select("doc_id", F.length(F.regexp_replace("text", "[^\\p{L}]", "")).alias("letters"), F.col("text").rlike(T.DEVANAGARI).alias("has_devanagari"))


@query("prj06_titles", "SELECT conv_id, turn, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 57)) || '...' END AS title FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM conversations)")
def titles(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", T.squeeze(F.col("text")).alias("t")).select("conv_id", "turn", F.when(F.length("t") <= 60, F.col("t")).otherwise(F.concat(F.rtrim(F.substring("t", 1, 57)), F.lit("..."))).alias("title"))


@query("prj07_previews", "SELECT doc_id, substr(text, 1, 100) || '...' AS preview FROM documents")
def previews(spark, d):
    return load(spark, d, "documents").select("doc_id", F.concat(F.substring("text", 1, 100), F.lit("...")).alias("preview"))
