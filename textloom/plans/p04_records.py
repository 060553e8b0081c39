"""Record sets from documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom import lexicons as lex
from textloom.functions import text as T
from textloom.functions.entries import FIGURE_REFERENCE
from textloom.operators import records as R
from textloom.plans import _sql as S
from textloom.registry import load, query

MD5 = "(CAST(('0x' || md5({k})) AS UHUGEINT) % 10000)"


def docs(spark, d):
    return load(spark, d, "documents")


@query("spl01_hash_split", f"SELECT doc_id, {MD5.format(k='doc_id::VARCHAR')} < 500 AS held_out FROM documents")
def hash_split(spark, d):
    return docs(spark, d).select("doc_id", R.is_held_out(F.col("doc_id").cast("string")).alias("held_out"))


@query("spl02_train_dev", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) <= greatest(1, (SELECT floor(0.8 * count(*)) FROM documents)) THEN 'train' ELSE 'dev' END AS split FROM documents")
def train_dev(spark, d):
    return R.split_ranked(docs(spark, d).select("doc_id"), "doc_id")


@query("spl03_silver_to_train", f"SELECT l.label_source, split, count(*) AS n FROM (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'silver' ELSE 'gold' END AS label_source, CASE WHEN l.doc_id IS NULL OR {MD5.format(k='d.doc_id::VARCHAR')} < 8000 THEN 'train' ELSE 'dev' END AS split FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) l GROUP BY ALL")
def silver_to_train(spark, d):
    gold = load(spark, d, "labels").select("doc_id").distinct().withColumn("g", F.lit(True))
    rows = R.split_by_hash(docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("k")), "k").join(gold, "doc_id", "left")
    source = F.when(F.col("g"), "gold").otherwise("silver")
    return rows.groupBy(source.alias("label_source"), F.when(F.col("g").isNull(), "train").otherwise(F.col("split")).alias("split")).agg(F.count("*").alias("n"))


@query("spl04_intent_dropout", f"SELECT record_id, {MD5.format(k='record_id')} >= 1200 AS keeps FROM (SELECT format('doc_{{:04d}}', doc_id) AS record_id FROM documents)")
def intent_dropout(spark, d):
    return docs(spark, d).select(F.format_string("doc_%04d", "doc_id").alias("record_id")).withColumn("keeps", R.keeps_intent(F.col("record_id")))


@query("set01_union", "SELECT origin, count(*) AS n, count(lang) AS with_lang, count(role) AS with_role FROM (SELECT 'documents' AS origin, lang, NULL AS role FROM documents UNION ALL SELECT 'conversations', NULL, role FROM conversations UNION ALL SELECT 'benchmark', NULL, NULL FROM benchmark) GROUP BY origin")
def union(spark, d):
    parts = [docs(spark, d).select(F.lit("documents").alias("origin"), "lang"), load(spark, d, "conversations").select(F.lit("conversations").alias("origin"), "role"), load(spark, d, "benchmark").select(F.lit("benchmark").alias("origin"))]
    return R.union_all(parts).groupBy("origin").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.count("role").alias("with_role"))


@query("set03_question_dedup", "SELECT conv_id, turn FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY conv_id, turn) = 1")
def question_dedup(spark, d):
    rows = load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5(F.lower(F.trim("text"))).alias("k"))
    return R.first_wins(rows, F.col("k"), F.col("conv_id"), F.col("turn")).select("conv_id", "turn")


@query("set04_id_dedup", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def id_dedup(spark, d):
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role")
    return rows.groupBy("conv_id").agg(F.min_by(F.struct("turn", "role"), "turn").alias("r")).select("conv_id", "r.*")


@query("set05_duplicates", "SELECT text_md5 FROM (SELECT md5(text) AS text_md5 FROM documents GROUP BY 1 HAVING count(*) > 1 UNION SELECT md5(text) FROM documents WHERE text IN (SELECT text FROM benchmark))")
def duplicates(spark, d):
    return R.duplicates(docs(spark, d).select(F.md5("text").alias("text_md5")), load(spark, d, "benchmark").select(F.md5("text").alias("text_md5")), "text_md5")


@query("set06_fingerprint_dedup", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(substr(text, 1, 80)) ORDER BY doc_id) = 1")
def fingerprint_dedup(spark, d):
    return docs(spark, d).groupBy(F.lower(F.substring("text", 1, 80)).alias("k")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("jon04_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join(spark, d):
    return docs(spark, d).select("doc_id").join(load(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_anti")


@query("src11_pending", "SELECT count(*) AS pending FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending(spark, d):
    return docs(spark, d).select("doc_id").join(load(spark, d, "labels"), "doc_id", "left_anti").agg(F.count("*").alias("pending"))


@query("lim01_pending_prefix", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 25")
def pending_prefix(spark, d):
    return docs(spark, d).select("doc_id").join(load(spark, d, "labels"), "doc_id", "left_anti").orderBy("doc_id").limit(25)


@query("src10_override", "SELECT d.doc_id, md5(coalesce(b.text, d.text)) AS text_md5 FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def override(spark, d):
    b = load(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("by_hand"))
    return docs(spark, d).join(b, "doc_id", "left").select("doc_id", F.md5(F.coalesce("by_hand", "text")).alias("text_md5"))


@query("src15_status_ledger", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 0 THEN 'error' WHEN l.toxic = 1 THEN 'skipped' ELSE 'extracted' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY status")
def status_ledger(spark, d):
    s = F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 0, "error").when(F.col("toxic") == 1, "skipped").otherwise("extracted")
    return docs(spark, d).select("doc_id").join(load(spark, d, "labels"), "doc_id", "left").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("jon01_registry", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def registry(spark, d):
    return load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("src06_registered_only", "SELECT count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def registered_only(spark, d):
    n = load(spark, d, "nation").where("n_regionkey = 1")
    return load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).agg(F.count("*").alias("n"))


@query("jon02_lookup_default", "SELECT s_suppkey, coalesce(r_name, 'UNKNOWN') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def lookup_default(spark, d):
    r = load(spark, d, "region").where("r_regionkey < 3")
    n = load(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "r_name")
    return load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("r_name", F.lit("UNKNOWN")).alias("region"))


@query("jon06_positional_zip", "SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM (SELECT doc_id, unnest(w) AS a, unnest(list_reverse(w)) AS b FROM (SELECT doc_id, " + S.tokens() + " AS w FROM documents)) GROUP BY doc_id")
def positional_zip(spark, d):
    pairs = T.let(T.split_words(F.col("text")), lambda w: F.arrays_zip(w.alias("a"), F.reverse(w).alias("b")))
    z = docs(spark, d).select("doc_id", pairs.alias("z")).where(F.size("z") > 0)
    return z.select("doc_id", F.size("z").cast("long").alias("n"), F.size(F.filter("z", lambda x: x["a"] == x["b"])).cast("long").alias("same"))


@query("flt02_coalesce_question", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END), ''), nullif(trim(source), '')) AS question FROM documents")
def coalesce_question(spark, d):
    first = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return docs(spark, d).select("doc_id", F.coalesce(some(first), some(F.col("source"))).alias("question"))


@query("flt01_required_fields", "SELECT count(*) AS n FROM documents WHERE trim(text) <> '' AND trim(source) <> '' AND lang IS NOT NULL")
def required_fields(spark, d):
    return docs(spark, d).where("trim(text) <> '' and trim(source) <> '' and lang is not null").agg(F.count("*").alias("n"))


@query("flt03_flags", "SELECT CASE WHEN toxic = 1 THEN 'gec' WHEN quality = 1 THEN 'query' ELSE 'statement' END AS kind, count(*) AS n FROM labels GROUP BY kind")
def flags(spark, d):
    return load(spark, d, "labels").groupBy(F.when(F.col("toxic") == 1, "gec").when(F.col("quality") == 1, "query").otherwise("statement").alias("kind")).agg(F.count("*").alias("n"))


@query("flt04_topic_keyword", "SELECT doc_id FROM documents WHERE contains(lower(source), lower('SRC1'))")
def topic_keyword(spark, d):
    return docs(spark, d).where(F.contains(F.lower("source"), F.lit("src1"))).select("doc_id")


@query("flt09_confidence_gate", "SELECT event_id, CASE WHEN value IS NULL OR value / 100 >= 0.6 THEN event_type END AS intent FROM events")
def confidence_gate(spark, d):
    return load(spark, d, "events").select("event_id", F.when(F.col("value").isNull() | (F.col("value") / 100 >= 0.6), F.col("event_type")).alias("intent"))


@query("flt14_figure_references", f"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, {S.quoted(FIGURE_REFERENCE)})")
def figure_references(spark, d):
    return docs(spark, d).where(~F.col("text").rlike(FIGURE_REFERENCE)).select("doc_id")


@query("flt15_page_furniture", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_matches(trim(x), '^[0-9]{1,4}$|^(?i:reprint|chapter)\\b') OR len(list_filter(regexp_split_to_array(x, '[\\s\\p{Z}]+'), lambda w: w <> '')) <= 2 GROUP BY doc_id")
def page_furniture(spark, d):
    x = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return x.where(F.trim("x").rlike("^[0-9]{1,4}$|^(?i:reprint|chapter)\\b") | (F.size(T.split_words(F.col("x"))) <= 2)).groupBy("doc_id").agg(F.count("*").alias("n"))


RECORD = "SELECT doc_id, text AS ctx, 'What is ' || source || '?' AS q, lang AS intent FROM documents"


@query("prj03_training_record", f"SELECT doc_id, md5('<start_of_turn>user\nContext:\n' || ctx || '\n\nQuestion:\n' || q || '\n\nIntent Type: ' || intent || '\nAnswer the question in Hinglish using only the given context.<end_of_turn>\n<start_of_turn>model\n' || q || '<end_of_turn>\n') AS text_md5 FROM ({RECORD})")
def training_record(spark, d):
    q = F.concat(F.lit("What is "), F.col("source"), F.lit("?"))
    return docs(spark, d).select("doc_id", F.md5(R.chat_text(R.prompt(F.col("text"), q, F.col("lang")), q)).alias("text_md5"))


@query("prj04_prompt", f"SELECT doc_id, md5('Context:\n' || ctx || '\n\nQuestion:\n' || q || '\n\n' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Intent Type: ' || intent || '\n' END || 'Answer the question in English using only the given context.') AS prompt_md5 FROM ({RECORD})")
def prompt(spark, d):
    q = F.concat(F.lit("What is "), F.col("source"), F.lit("?"))
    return docs(spark, d).select("doc_id", F.md5(R.prompt(F.col("text"), q, F.when(F.col("doc_id") % 2 == 1, F.col("lang")), "english")).alias("prompt_md5"))


@query("prj02_legacy_projection", "SELECT doc_id::VARCHAR AS id, source AS topic, lang AS class, 'legacy' AS lid_label_source, 'documents' AS source_file FROM documents")
def legacy_projection(spark, d):
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("topic"), F.col("lang").alias("class"), F.lit("legacy").alias("lid_label_source"), F.lit("documents").alias("source_file"))


@query("prj01_optional_column", "SELECT doc_id, CASE WHEN lang = 'en' THEN source END AS sub_subject FROM documents")
def optional_column(spark, d):
    return docs(spark, d).select("doc_id", F.when(F.col("lang") == "en", F.col("source")).alias("sub_subject"))


@query("agg09_class_weights", "WITH l(lang) AS (VALUES ('de'), ('en'), ('es'), ('fr'), ('hi')), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, round((SELECT count(*) FROM documents) / (5.0 * coalesce(n, 1)), 4) AS weight FROM l LEFT JOIN c USING (lang)")
def class_weights(spark, d):
    return R.class_weights(docs(spark, d), "lang", ["de", "en", "es", "fr", "hi"])


@query("val02_compact_validation", f"""WITH e AS (SELECT doc_id, coalesce(trim(source), '') AS topic, CASE doc_id % 3 WHEN 0 THEN 'mcq' WHEN 1 THEN 'other' ELSE '' END AS intent, text AS ctx, text AS a, CASE WHEN doc_id % 5 = 0 THEN text ELSE 'x' END AS a_hi FROM documents)
SELECT doc_id, CASE WHEN intent = '' THEN 1 ELSE 0 END + CASE WHEN trim(a) = '' THEN 1 ELSE 0 END + CASE WHEN trim(ctx) = '' THEN 1 ELSE 0 END + CASE WHEN trim(a_hi) = '' THEN 1 ELSE 0 END AS missing,
CASE WHEN intent = '' OR trim(a) = '' OR trim(a_hi) = '' OR trim(ctx) = '' THEN 0 ELSE CASE WHEN intent NOT IN {S.listed(lex.INTENTS)} THEN 1 ELSE 0 END + CASE WHEN trim(a) = trim(a_hi) THEN 1 ELSE 0 END + CASE WHEN len({S.tokens('ctx')}) < 25 THEN 1 ELSE 0 END END AS other FROM e""")
def compact_validation(spark, d):
    k = F.col("doc_id")
    intent = F.when(k % 3 == 0, "mcq").when(k % 3 == 1, "other").otherwise("")
    a = F.col("text")
    found = R.compact_issues(F.lit("q"), a, F.col("text"), F.lit("q"), F.when(k % 5 == 0, a).otherwise("x"), F.col("source"), intent)
    gone = lambda x: F.startswith(x, F.lit("missing"))
    return docs(spark, d).select("doc_id", found.alias("f")).select("doc_id", F.size(F.filter("f", gone)).alias("missing"), F.size(F.filter("f", lambda x: ~gone(x))).alias("other"))


@query("val03_seed_validation", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def seed_validation(spark, d):
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1")


_LAST = f"SELECT conv_id, turn, key, arg_max(upper(tag), i) AS tag FROM (SELECT conv_id, turn, i, CASE WHEN {S.strip_marks('w')} = '' THEN w ELSE {S.strip_marks('w')} END AS key, {S.position_lid(S.strip_marks('w'), 'i', False)} AS tag FROM (SELECT conv_id, turn, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT conv_id, turn, {S.tokens()} AS t FROM conversations))) GROUP BY ALL"


@query("val01_entry_validation", f"""WITH l AS ({_LAST}), n AS (SELECT conv_id, turn, count(*) FILTER (WHERE tag = 'HI') AS hi, count(*) FILTER (WHERE tag = 'EN') AS en FROM l GROUP BY ALL),
j AS (SELECT c.conv_id, c.turn, c.role, c.text, coalesce(hi, 0) AS hi, coalesce(en, 0) AS en FROM conversations c LEFT JOIN n USING (conv_id, turn))
SELECT conv_id, turn, concat_ws('; ', CASE WHEN len(list_filter({S.tokens()}, lambda w: {S.strip_marks('w')} = '')) > 0 AND len(list_filter({S.tokens()}, lambda w: {S.strip_marks('w')} <> '')) > 0 THEN 'labels do not match tokens' END, CASE WHEN role = 'user' THEN 'student query without intent' END, CASE WHEN lower(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')) = 'hello' THEN 'identical texts' END,
CASE WHEN hi + en = 0 THEN 'no code-mixing index' END, CASE WHEN hi + en > 0 AND (1 - greatest(hi, en) / (hi + en)::DOUBLE) * 100 NOT BETWEEN 10 AND 70 THEN 'code-mixing index out of range' END) AS issues FROM j""")
def entry_validation(spark, d):
    rows = load(spark, d, "conversations").select("conv_id", "turn", R.entry_issues(F.lit("hello"), F.col("text"), T.label_map(F.col("text")), F.col("role") == "user", F.lit(None).cast("string")).alias("issues"))
    return rows.select("conv_id", "turn", F.array_join("issues", "; ").alias("issues"))


@query("val04_auto_fix", f"SELECT c.conv_id, c.turn, trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ') AS text, coalesce(l.labels, '') AS labels FROM conversations c LEFT JOIN (SELECT conv_id, turn, string_agg(key || '=' || tag, ' ' ORDER BY key) AS labels FROM ({_LAST}) GROUP BY ALL) l USING (conv_id, turn)")
def auto_fix(spark, d):
    fixed = F.transform_values(T.label_map(F.col("text")), lambda k, v: F.upper(v))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(fixed)), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    return load(spark, d, "conversations").select("conv_id", "turn", T.squeeze(F.col("text")).alias("text"), listed.alias("labels"))


BASE = "SELECT doc_id, 'cell membrane aur nucleus hota hai ' || array_to_string(" + S.tokens() + ", ' ') AS t FROM documents"
WORDS = "SELECT doc_id, w, i, lower(regexp_extract(w, '(?s)^([^\\p{L}\\p{N}]*)(.*?)([^\\p{L}\\p{N}]*)$', 2)) AS c, regexp_extract(w, '(?s)^([^\\p{L}\\p{N}]*)(.*?)([^\\p{L}\\p{N}]*)$', 1) AS a, regexp_extract(w, '(?s)^([^\\p{L}\\p{N}]*)(.*?)([^\\p{L}\\p{N}]*)$', 3) AS z FROM (SELECT doc_id, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT doc_id, " + S.tokens("t") + f" AS x FROM ({BASE})))"


def base(spark, d):
    return docs(spark, d).select("doc_id", F.concat(F.lit("cell membrane aur nucleus hota hai "), F.array_join(T.split_words(F.col("text")), " ")).alias("t"))


def _substitution(table):
    return f"SELECT doc_id, string_agg(coalesce(a || {S.cases(table, 'c')} || z, w), ' ' ORDER BY i) AS text FROM ({WORDS}) GROUP BY doc_id"


for _name, _f, _sql in (
    ("aug01_density_shift", R.density_shift, _substitution(lex.HINDI_EQUIVALENTS)),
    ("aug02_connector_swap", R.connector_swap, _substitution(lex.CONNECTORS)),
    ("aug03_formality_shift", R.formality_shift, f"SELECT doc_id, 'Sir, ' || trim(t) || ' batao.' AS text FROM ({BASE})"),
    ("aug04_question_form", R.question_form, f"SELECT doc_id, 'Sir, ' || rtrim(trim(t), '.?') || ' samjhao?' AS text FROM ({BASE})"),
    ("aug05_negation", R.negation, f"SELECT doc_id, string_agg(CASE WHEN i = f THEN 'nahi ' || w ELSE w END, ' ' ORDER BY i) AS text FROM (SELECT *, min(i) FILTER (WHERE c IN {S.listed(lex.VERBS)}) OVER (PARTITION BY doc_id) AS f, bool_or(c = 'nahi') OVER (PARTITION BY doc_id) AS g FROM ({WORDS})) WHERE NOT g GROUP BY doc_id"),
):

    @query(_name, _sql)
    def variant(spark, d, f=_f):
        return base(spark, d).select("doc_id", f(F.col("t")).alias("text")).where("text is not null")


@query("aug07_variants", f"SELECT doc_id || '_' || k AS id, doc_id AS augmented_from, kind AS augmentation_type FROM documents, (VALUES ('a', 'hindi_density'), ('b', 'connector_swap'), ('c', 'formality_shift')) v(k, kind)")
def variants(spark, d):
    return R.augment(base(spark, d), "doc_id", "t").select("id", "augmented_from", "augmentation_type")


@query("snk07_replace_append", "SELECT chapter, ordinal, doc_id FROM (SELECT source AS chapter, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal, doc_id FROM documents WHERE source <> 'src1' UNION ALL SELECT 'src1', row_number() OVER (ORDER BY item_id), item_id FROM benchmark)")
def replace_append(spark, d):
    from textloom.sources.stores import number_within, replace_part

    old = number_within(docs(spark, d).select(F.col("source").alias("chapter"), "doc_id"), "chapter", "doc_id", "ordinal")
    new = number_within(load(spark, d, "benchmark").select(F.lit("src1").alias("chapter"), F.col("item_id").alias("doc_id")), "chapter", "doc_id", "ordinal")
    return replace_part(old, new, "chapter").select("chapter", "ordinal", "doc_id")


@query("gen09_entry_ids", "SELECT doc_id, format('{}_{:04d}', source, row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS id FROM documents")
def entry_ids(spark, d):
    from textloom.sources.stores import number_within

    return number_within(docs(spark, d).select("doc_id", "source"), "source", "doc_id", "n").select("doc_id", F.format_string("%s_%04d", "source", "n").alias("id"))
