"""Generated questions and entries, topics, answers seen by a client, records kept across runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import docs as D
from textloom.functions import entries as E
from textloom.functions import text as T
from textloom.operators import chats as C
from textloom.operators import generators as G
from textloom.operators import memo
from textloom.operators import question_bank as Q
from textloom.operators import reports as M
from textloom.plans import _sql as S
from textloom.plans import p02_documents as P
from textloom.plans.p06_histories import CHATS, EVENTS, answer_events, chats
from textloom.registry import load, query
from textloom.streaming.answers import reduce_answers

#: Long sentences of documents: what stands between sentence marks and white space.
SENTENCES = "SELECT doc_id, source, unnest(x) AS s, unnest(range(len(x))) AS i FROM (SELECT doc_id, source, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\\s]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 30) AS x FROM documents)"


def sentences(spark, d):
    s = T.sentences(F.col("text"), 30)
    return load(spark, d, "documents").select("doc_id", "source", F.posexplode(s).alias("i", "s"))


def _beside(patterns: list[str], after: bool) -> str:
    part = "trim(substr(s, instr(s, {p}) + {n}), ' ')" if after else "rtrim(trim(substr(s, 1, instr(s, {p}) - 1), ' '), ',')"
    return "CASE " + " ".join(f"WHEN contains(s, {S.quoted(p)}) THEN " + part.format(p=S.quoted(p), n=len(p)) for p in patterns) + " END"


def _filled(template: str) -> str:
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(x if i % 2 else S.quoted(x) for i, x in enumerate(parts) if i % 2 or x)


def _form(kind: str, forms: list[str]) -> str:
    if len(forms) == 1:
        return _filled(forms[0])
    return f"CASE CAST(('0x' || md5('{kind}:' || s)) AS UHUGEINT) % {len(forms)} " + " ".join(f"WHEN {k} THEN {_filled(f)}" for k, f in enumerate(forms)) + " END"


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {S.quoted(w)})" for w in words) + ")"


_BARE = "trim(x, '.,;:?!\"''()')"
_HOLDS = {
    "definition": f"len({S.tokens('term')}) BETWEEN 1 AND 6 AND term IS NOT NULL",
    "fill_blank": "gap IS NOT NULL",
    "list_enumerate": _any("s", Q.LISTING),
    "compare_concepts": _any("lower(s)", Q.CONTRAST),
    "one_word": "n <= 20 AND key IS NOT NULL AND len(string_split(key, ' ')) BETWEEN 1 AND 4 AND key <> ''",
}
ENTRIES = f"""
a AS (SELECT doc_id, source, i, trim(s, ' ') AS s FROM ({SENTENCES})),
b AS (SELECT *, {S.tokens('s')} AS w, len({S.tokens('s')}) AS n, source AS chapter, substr(s, 1, 100) AS short, {_beside(Q.DEFINING, False)} AS term, {_beside(Q.NAMING, False)} AS head, {_beside(Q.NAMING, True)} AS rest FROM a),
c AS (SELECT *, CASE WHEN n >= 8 THEN list_max(list_filter(range(n), lambda k: k >= greatest(n - 7, 0) + 1 AND length(trim(w[k + 1], '.,;:?!"''()')) > 3 AND lower(trim(w[k + 1], '.,;:?!"''()')) NOT IN {S.listed(Q.GAP_STOPS)})) END AS gap,
CASE WHEN head IS NOT NULL THEN array_to_string({S.tokens('head')}, ' ') END AS key, rtrim(array_to_string(({S.tokens("rtrim(rest, '.')")})[1:6], ' '), '.,;:') AS short_rest FROM b),
e AS (SELECT *, array_to_string(list_transform(range(n), lambda k: CASE WHEN k = gap THEN '_______' ELSE w[k + 1] END), ' ') || '.' AS gapped, trim(w[gap + 1], '.,;:?!') AS word, upper(substr(short_rest, 1, 1)) || lower(substr(short_rest, 2)) AS brief FROM c),
f AS ({' UNION ALL '.join(f"SELECT doc_id, i, {k} AS ord, '{kind}' AS kind, {_form(kind, forms)} AS question, {_filled(answer)} AS answer FROM e WHERE {_HOLDS.get(kind, 'true')}" for k, (kind, forms, answer) in enumerate(Q.ENTRIES))})"""


@query("gen06_sentence_entries", f"WITH {ENTRIES} SELECT doc_id, i, kind, question, md5(answer) AS answer_md5 FROM f")
def sentence_entries(spark, d):
    e = sentences(spark, d).select("doc_id", "i", F.explode(G.sentence_entries(F.col("s"), F.col("source"))).alias("e"))
    return e.select("doc_id", "i", "e.kind", "e.question", F.md5("e.answer").alias("answer_md5"))


TOPICS = [("articles", ["the", "der", "la"]), ("joins", ["and", "und", "que"]), ("places", ["in", "sur", "auf"])]


@query("txt39_topic", "SELECT doc_id, i, CASE WHEN a >= greatest(b, c) THEN 'articles' WHEN b >= c THEN 'joins' ELSE 'places' END AS topic FROM (SELECT doc_id, i, " + ", ".join(" + ".join(f"contains(lower(s), '{w}')::INT" for w in words) + f" AS {n}" for (_, words), n in zip(TOPICS, "abc", strict=True)) + f" FROM ({SENTENCES}))")
def topic(spark, d):
    return sentences(spark, d).select("doc_id", "i", G.assign_topic(F.col("s"), TOPICS).alias("topic"))


_HEAD = "array_to_string((" + S.tokens() + ")[1:20], ' ')"
_END = "rtrim(trim(h, ' '), '.?!')"


@query("gen08_chapter_quota", f"""SELECT source, r, CASE WHEN r <= 75 THEN 'statement' WHEN r <= 90 THEN 'query' ELSE 'gec' END AS kind,
CASE WHEN r <= 75 OR r > 90 THEN {_END} || CASE WHEN regexp_matches({_END}, '(?i)\\b(are|were)\\b') THEN ' hain.' ELSE ' hai.' END ELSE trim('Sir, ' || array_to_string(({S.tokens(_END)})[1:12], ' ') || ' samjhao?') END AS text,
CASE WHEN r > 90 THEN CASE WHEN regexp_matches({_END}, '(?i)\\b(are|were)\\b') THEN {_END} || ' hainn.' ELSE {_END} || ' hain.' END END AS wrong
FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, {_HEAD} AS h FROM documents WHERE NOT contains(lower(text), ' hai')) WHERE r <= 95""")
def chapter_quota(spark, d):
    """The first 95 texts of each source: 75 statements, 15 questions, 5 with an error of agreement."""
    rows = load(spark, d, "documents").where(~F.contains(F.lower("text"), F.lit(" hai")))
    rows = rows.select("source", "text", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("r")).where("r <= 95")
    head = F.array_join(F.slice(T.split_words(F.col("text")), 1, 20), " ")
    stated = E.to_statement(head)
    kind = F.when(F.col("r") <= 75, "statement").when(F.col("r") <= 90, "query").otherwise("gec")
    return rows.select("source", "r", kind.alias("kind"), F.when(kind == "query", E.to_query(head, F.lit("samjhao?"))).otherwise(stated).alias("text"), F.when(kind == "gec", E.with_agreement_error(stated)["wrong"]).alias("wrong"))


#: A doubled letter three times over, and runs of one character.
_GARBLED = "(?:" + "|".join(c * 2 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + "){3}|" + P.RUN5
_CALLED = "([A-Z][A-Za-z\\s]{2,25}?)\\s+(?:is|are)\\s+(?:called|known as|termed|referred to as)\\s+([A-Z][A-Za-z\\s]{1,25}?)(?:\\.|,)"
_DEFINED = "^([A-Z][A-Za-z\\s]{2,25}?)\\s+(?:is defined as|refers to|means|is the process of)\\s+(.{15,100}?)(?:\\.|$)"
_PROCESS = "(?is)^(.*?)(?:process called|process of|organ called|structure called|phenomenon called|method called)\\s+([A-Z][A-Za-z]{2,25})"
_BEING = "^([A-Z][A-Za-z\\s]{2,25}?)\\s+(?:is|are)\\s+(?:a|an|the)\\s+"


def _got(pattern: str, k: int) -> str:
    return f"trim(regexp_extract(s, '{pattern}', {k}), ' ')"


def _starts(x: str) -> str:
    return f"lower(regexp_split_to_array({x}, '[\\s\\p{{Z}}]+')[1]) NOT IN {S.listed(D.STARTS)}"


_BEFORE = f"trim(regexp_extract(regexp_extract(s, '{_PROCESS}', 1), '([^.]*)$', 1), ' ')"
_WORDS_OF = f"len({S.tokens('s')})"


@query("gen01_trivial_questions", f"""WITH s AS (SELECT doc_id, trim(s, ' ') AS s FROM ({P.EACH}) WHERE i < 5), f AS (SELECT * FROM s WHERE length(s) >= 20 AND NOT regexp_matches(s, {S.quoted(_GARBLED)}))
SELECT doc_id, 'name_the' AS kind, 'What is ' || {_got(_CALLED, 1)} || ' called?' AS question, rtrim({_got(_CALLED, 2)}, '.,;') || '.' AS answer FROM f WHERE {_got(_CALLED, 1)} <> '' AND {_starts(_got(_CALLED, 1))} AND len({S.tokens(f"rtrim({_got(_CALLED, 2)}, '.,;')")}) BETWEEN 1 AND 4
UNION ALL SELECT doc_id, 'fill_blank', '_____ is defined as ' || {_got(_DEFINED, 2)} || '.', {_got(_DEFINED, 1)} || '.' FROM f WHERE {_got(_DEFINED, 1)} <> '' AND {_starts(_got(_DEFINED, 1))} AND len({S.tokens(_got(_DEFINED, 1))}) <= 4
UNION ALL SELECT doc_id, 'true_false', 'True or False: ' || rtrim(s, '.') || '.', 'True. ' || rtrim(s, '.') || ' as stated in the NCERT textbook.' FROM f WHERE {_WORDS_OF} BETWEEN 8 AND 22 AND NOT suffix(s, '?') AND len(list_filter(string_split(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: regexp_full_match(w, 'is|are|was|were|have|has|can|produces?|contains?'))) > 0
UNION ALL SELECT doc_id, 'one_word', 'Name the process or structure: ' || {_BEFORE} || '?', {_got(_PROCESS, 2)} || '.' FROM f WHERE regexp_matches(s, '{_PROCESS}') AND len({S.tokens(_BEFORE)}) >= 4
UNION ALL SELECT doc_id, 'one_word', 'What is ' || {_got(_BEING, 1)} || '?', CASE WHEN {_WORDS_OF} <= 20 THEN s ELSE array_to_string(({S.tokens('s')})[1:20], ' ') || '.' END FROM f WHERE {_got(_BEING, 1)} <> '' AND {_starts(_got(_BEING, 1))} AND len({S.tokens(_got(_BEING, 1))}) <= 3 AND {_WORDS_OF} >= 6""")
def trivial(spark, d):
    q = load(spark, d, "documents").select("doc_id", F.explode(G.trivial_questions(D.split_sentences(F.col("text")))).alias("q"))
    return q.select("doc_id", "q.*")


def _passages(spark, d):
    return load(spark, d, "documents").select(F.struct("doc_id", "source").alias("k"), F.explode(D.passages(F.col("text"))).alias("p"))


def _asked(bank: list[tuple[str, str, str]], cues: dict[str, str], subject: str) -> str:
    """A row for each form of a bank that applies to a passage."""
    special = {"start": P.good_start("first"), "one": "len(np) >= 1", "two": "len(np) >= 2", "few": "len(np) < 2"}
    facts = f"""p AS (SELECT doc_id, source AS chapter, p AS text FROM ({P.PASSAGES}) JOIN documents USING (doc_id) WHERE length(p) >= 250 AND length(p) - length(replace(p, '?', '')) <= 3 AND NOT regexp_matches(p, {S.quoted(P.RUN5)})),
c AS (SELECT *, {P.capitals('text')} AS x FROM p), n AS (SELECT *, {P.phrases('x')} AS np, {P.key_term('text', 'x')} AS kt, coalesce(({P.SENTENCES})[1], string_split(text, '.')[1]) AS first, lower(regexp_extract(text, {S.quoted(cues['list'])}, 1)) AS list, regexp_extract(text, {S.quoted(cues['number'])}, 1) AS number FROM c),
f AS (SELECT *, np[1] AS a, np[2] AS b, {S.quoted(subject)} AS subject, {S.quoted(subject.lower())} AS low FROM n)"""
    rows = []
    for k, (condition, intent, template) in enumerate(bank):
        holds = " AND ".join(special.get(c) or f"regexp_matches(text, {S.quoted(cues[c])})" for c in condition.split()) or "true"
        rows.append(f"SELECT doc_id, {k} AS ord, '{intent}' AS intent, {_filled(template)} AS question, md5(text) AS answer_md5 FROM f WHERE {holds}")
    return f"WITH {facts} " + " UNION ALL ".join(rows)


@query("gen02_biology_questions", _asked(Q.BIOLOGY, Q.BIOLOGY_CUES, "biology"))
def biology(spark, d):
    return G.passage_questions(_passages(spark, d), "k", "p", F.col("k.source")).select("k.doc_id", "ord", "intent", "question", F.md5("answer").alias("answer_md5"))


@query("gen03_social_science_questions", _asked(Q.SOCIAL_SCIENCE, Q.CUES, "Social Science"))
def social_science(spark, d):
    return G.passage_questions(_passages(spark, d), "k", "p", F.col("k.source"), "Social Science").select("k.doc_id", "ord", "intent", "question", F.md5("answer").alias("answer_md5"))


@query("gen05_exercise_answers", "SELECT doc_id, 'Which word is it?' AS question, CASE WHEN contains(lower(text), 'that') OR NOT contains(lower(text), 'with') THEN 'The correct answer is (a) that.' ELSE 'The correct answer is (b) with.' END AS answer FROM documents")
def exercise_answers(spark, d):
    list_ = F.lit("1. Which word is it?\n(a) that\n(b) with\n")
    q = load(spark, d, "documents").select("doc_id", "text", F.explode(G.numbered_questions(list_)).alias("q"))
    return q.select("doc_id", "q.question", G.derived_answer(F.col("q.question"), F.col("q.options"), F.coalesce("text", F.lit(""))).alias("answer"))


@query("str04_client_reducer", f"""WITH e AS (SELECT * FROM ({EVENTS})), k AS (SELECT session, min(seq) FILTER (WHERE type IN ('done', 'error')) AS stop FROM e GROUP BY session)
SELECT k.session, coalesce(max(e.type) FILTER (WHERE e.seq = k.stop) <> 'done', true) AS failed, CASE WHEN max(e.type) FILTER (WHERE e.seq = k.stop) = 'done' THEN trim(coalesce(string_agg(e.text, '' ORDER BY e.seq) FILTER (WHERE e.type = 'token' AND (k.stop IS NULL OR e.seq < k.stop)), ''), ' ') ELSE '' END AS text FROM k JOIN e USING (session) GROUP BY k.session, k.stop""")
def client_reducer(spark, d):
    events = answer_events(spark, d).withColumn("stage", F.lit(None).cast("string"))
    return reduce_answers(events).select("session", "failed", "text")


@query("db02_create_chat", f"SELECT conv_id, user_id, 'New chat' AS title, 'hinglish' AS language, 5.0 AS created_at, 5.0 AS updated_at FROM (SELECT 2000000 AS conv_id, 3 AS user_id) UNION ALL SELECT conv_id, user_id, NULL, NULL, NULL, updated_at FROM ({CHATS})")
def create_chat(spark, d):
    new = spark.createDataFrame([(2_000_000, 3, "New chat")], "conv_id long, user_id long, title string")
    return C.create_chats(chats(spark, d), new, F.lit(5.0)).select("conv_id", "user_id", "title", "language", "created_at", "updated_at")


@query("agg14_token_accuracy", "WITH t AS (SELECT item_id, " + S.tokens() + " AS w FROM benchmark) SELECT item_id, round(len(list_filter(range(len(w)), lambda k: k + 1 < len(w) AND w[k + 1] = w[k + 2])) / len(w)::DOUBLE, 9) AS accuracy FROM t WHERE len(w) > 0")
def token_accuracy(spark, d):
    """Of texts against themselves without their first word."""
    words = T.split_words(F.col("text"))
    rows = load(spark, d, "benchmark").select("item_id", words.alias("gold"), F.filter(words, lambda w, i: i > 0).alias("pred")).where(F.size("gold") > 0)
    return rows.select("item_id", F.round(M.token_accuracy(F.col("pred"), F.col("gold")), 9).alias("accuracy"))


@query("val06_memo", "SELECT source, count(*) AS n, length(lower(source)) AS v FROM documents GROUP BY source")
def memo_cache(spark, d):
    """Half of the sources are known already; the rest is made once each."""
    rows = load(spark, d, "documents").select("source")
    known = rows.distinct().where("length(source) % 2 = 0").select(memo.clean_key(F.col("source")).alias("key"), F.length("source").alias("v"))
    _, out = memo.enrich(rows, "source", known, "v", F.length)
    return out.groupBy("source").agg(F.count("*").alias("n"), F.min("v").alias("v"))


_LABELS = f"SELECT conv_id, turn, key, arg_max(tag, i) AS tag FROM (SELECT conv_id, turn, i, CASE WHEN {S.strip_marks('w')} = '' THEN w ELSE {S.strip_marks('w')} END AS key, {S.position_lid(S.strip_marks('w'), 'i', False)} AS tag FROM (SELECT conv_id, turn, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT conv_id, turn, {S.tokens()} AS t FROM conversations))) GROUP BY ALL"


@query("gen07_labelled_entries", f"WITH l AS (SELECT conv_id, turn, string_agg(key || '=' || tag, ' ' ORDER BY key) AS labels FROM ({_LABELS}) GROUP BY ALL) SELECT format('chat_{{:04d}}', row_number() OVER (ORDER BY conv_id * 1000 + turn)) AS id, coalesce(labels, '') AS labels, role = 'user' AS is_student_query, role = 'system' AS is_gec_sample FROM conversations LEFT JOIN l USING (conv_id, turn)")
def labelled_entries(spark, d):
    kind = F.when(F.col("role") == "user", "query").when(F.col("role") == "system", "gec").otherwise("statement")
    rows = load(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("o"), "text", "role", kind.alias("kind"))
    e = G.labelled_entries(rows, "chat", "o", "text", "text", "role", "kind")
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("word_level_labels")), lambda x: F.concat_ws("=", x["key"], x["value"])), " ")
    return e.select("id", listed.alias("labels"), "is_student_query", "is_gec_sample")
