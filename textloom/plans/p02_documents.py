"""Cleaning, chunking and layout over documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import docs as D
from textloom.functions import text as T
from textloom.operators import layout
from textloom.plans import _sql as S
from textloom.registry import load, query

PARAS = "SELECT doc_id, unnest(p) AS p, unnest(range(len(p))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents)"
MERGED = f"""
w AS (SELECT doc_id, p, i, len({S.tokens('p')}) AS n FROM ({PARAS})),
m AS (SELECT doc_id, i, n, 0 AS g, n AS acc FROM w WHERE i = 0 UNION ALL SELECT w.doc_id, w.i, w.n, CASE WHEN m.acc >= 30 THEN m.g + 1 ELSE m.g END, CASE WHEN m.acc >= 30 THEN w.n ELSE m.acc + w.n END FROM m JOIN w ON w.doc_id = m.doc_id AND w.i = m.i + 1),
t AS (SELECT doc_id, g, sum(n) AS n FROM m GROUP BY ALL), z AS (SELECT doc_id, max(g) AS last FROM t GROUP BY doc_id),
f AS (SELECT m.doc_id, m.i, CASE WHEN m.g = z.last AND t.n < 30 AND z.last > 0 THEN m.g - 1 ELSE m.g END AS g FROM m JOIN z USING (doc_id) JOIN t ON t.doc_id = m.doc_id AND t.g = m.g),
a AS (SELECT doc_id, g, string_agg(p, ' ' ORDER BY i) AS p FROM f JOIN w USING (doc_id, i) GROUP BY doc_id, g)"""
CHUNKS = f"""WITH RECURSIVE {MERGED},
s AS (SELECT doc_id, g, p, {S.tokens('p')} AS w FROM a),
c AS (SELECT doc_id, g, 0 AS k, p AS c, len(w) AS n FROM s WHERE len(w) <= 200 UNION ALL SELECT doc_id, g, k, array_to_string(w[k * 170 + 1 : k * 170 + 200], ' '), len(w[k * 170 + 1 : k * 170 + 200]) FROM (SELECT doc_id, g, w, unnest(range(CAST(ceil((len(w) - 200) / 170.0) AS BIGINT) + 1)) AS k FROM s WHERE len(w) > 200)),
o AS (SELECT doc_id, c, n, row_number() OVER (PARTITION BY doc_id ORDER BY g, k) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM c)"""


def chunk_rows(spark, d):
    t = load(spark, d, "documents").select("doc_id", "lang", D.chunks(F.col("text"), "\n").alias("c"))
    rows = t.select("doc_id", "lang", F.posexplode("c").alias("chunk_index", "chunk"), F.size("c").alias("total_chunks"))
    return rows.withColumn("word_count", F.size(T.split_words(F.col("chunk"))))


@query("chk01_paragraphs", f"SELECT doc_id, count(*) AS n, sum(length(p)) AS chars FROM ({PARAS}) GROUP BY doc_id")
def paragraphs(spark, d):
    p = load(spark, d, "documents").select("doc_id", F.explode(D.paragraphs(F.col("text"), "\n")).alias("p"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("p")).alias("chars"))


@query("chk02_merge_short", f"WITH RECURSIVE {MERGED} SELECT doc_id, count(*) AS n, md5(string_agg(p, chr(10) ORDER BY g)) AS merged_md5 FROM a GROUP BY doc_id")
def merge_short(spark, d):
    m = load(spark, d, "documents").select("doc_id", D.merge_short(D.paragraphs(F.col("text"), "\n")).alias("m")).where(F.size("m") > 0)
    return m.select("doc_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join("m", "\n")).alias("merged_md5"))


@query("chk03_word_windows", f"""WITH s AS (SELECT doc_id, {S.tokens()} AS w FROM documents), k AS (SELECT doc_id, w, unnest(range(CASE WHEN len(w) <= 200 THEN 1 ELSE CAST(ceil((len(w) - 200) / 170.0) AS BIGINT) + 1 END)) AS k FROM s)
SELECT doc_id, k, len(w[k * 170 + 1 : k * 170 + 200]) AS n, md5(array_to_string(w[k * 170 + 1 : k * 170 + 200], ' ')) AS window_md5 FROM k""")
def word_windows(spark, d):
    joined = F.array_join(T.split_words(F.col("text")), " ")
    w = load(spark, d, "documents").select("doc_id", joined.alias("t")).select("doc_id", F.posexplode(D.word_windows(F.col("t"))).alias("k", "c"))
    return w.select("doc_id", "k", F.size(T.split_words(F.col("c"))).alias("n"), F.md5("c").alias("window_md5"))


@query("chk04_chunks", CHUNKS + " SELECT format('doc{}_chunk_{:03d}', doc_id, chunk_index) AS chunk_id, chunk_index, total_chunks, n AS word_count, md5(c) AS text_md5 FROM o WHERE n >= 10")
def chunks(spark, d):
    return chunk_rows(spark, d).where("word_count >= 10").select(F.format_string("doc%d_chunk_%03d", "doc_id", "chunk_index").alias("chunk_id"), "chunk_index", "total_chunks", "word_count", F.md5("chunk").alias("text_md5"))


@query("chk05_chunk_statistics", CHUNKS + " SELECT lang, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, min(n) AS least, max(n) AS most, sum(n) AS words FROM o JOIN documents USING (doc_id) WHERE n >= 10 GROUP BY lang")
def chunk_statistics(spark, d):
    return chunk_rows(spark, d).where("word_count >= 10").groupBy("lang").agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.min("word_count").alias("least"), F.max("word_count").alias("most"), F.sum("word_count").alias("words"))


@query("agg16_chunk_summary", CHUNKS + " SELECT count(*) AS n, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, count(DISTINCT doc_id) AS n_docs FROM o WHERE n >= 10")
def chunk_summary(spark, d):
    return chunk_rows(spark, d).where("word_count >= 10").agg(F.count("*").alias("n"), F.min("word_count").alias("least"), F.max("word_count").alias("most"), F.round(F.avg("word_count"), 6).alias("mean"), F.count_distinct("doc_id").alias("n_docs"))


def _rows(name, column, sql=None, table="documents", key="doc_id"):
    @query(name, sql)
    def run(spark, d):
        return load(spark, d, table).select(key, column().alias("value"))

    return run


t = lambda: F.col("text")
#: A run of five or more of one character, written out for the characters of the tables: the counterpart's patterns know no back-references.
_CHARS = "abcdefghijklmnopqrstuvwxyzäöüßéèêçàáíóúñABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÀÁÍÓÚÑ0123456789 #$%&*.,!?|_=:;'\"()<>/@-"
RUN5 = "|".join((c if c.isalnum() or c == " " else f"[{c}]") + "{5,}" for c in _CHARS)
#: Splitting before a capital: the counterpart's patterns look neither ahead nor behind, so the letter is put back.
SPLIT = "regexp_replace(regexp_replace(coalesce(text, ''), " + S.quoted("(^|[^\\p{L}\\p{N}_])" + D.ABBREVIATIONS.replace("(?i)\\b", "(?i)")) + ", '\\1\\2<DOT>', 'g'), '\\.\\s+([A-Z])', chr(1) || '\\1', 'g')"
SENTENCES = f"list_transform(list_filter(list_transform(string_split({SPLIT}, chr(1)), lambda p: trim(replace(p, '<DOT>', '.'), ' ')), lambda p: length(p) > 3), lambda p: rtrim(p, '.') || '.')"
EACH = f"SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS i FROM (SELECT doc_id, {SENTENCES} AS x FROM documents)"


def _exploded(name, column, sql):
    @query(name, sql)
    def run(spark, d):
        return load(spark, d, "documents").select("doc_id", F.posexplode(column()).alias("i", "value"))

    return run


_exploded("txt17_split_sentences", lambda: D.split_sentences(t()), f"SELECT doc_id, i, s AS value FROM ({EACH})")
_PASSAGE = "array_to_string(x[k + 1 : k + 5], ' ')"
for _p, _by in (("\\(\\s*\\)", ""), ("\\(\\s*[Ff]ig(?:ure)?[^)]{0,20}\\)", ""), *[("(^|[^\\p{L}\\p{N}_(])-\\s*[0-9]{1,3}($|[^\\p{L}\\p{N}_])", "\\1\\2")] * 2, ("\\bMeet a (?:Scientist|Researcher|Expert)\\b", ""), ("[\\s\\p{Z}]+", " ")):
    _PASSAGE = f"regexp_replace({_PASSAGE}, {S.quoted(_p)}, {S.quoted(_by)}, 'g')"
PASSAGES = f"SELECT doc_id, k, trim({_PASSAGE}, ' ') AS p FROM (SELECT doc_id, x, unnest(range(0, len(x) - 1, 3)) AS k FROM (SELECT doc_id, {SENTENCES} AS x FROM documents))"
_exploded("chk06_passages", lambda: F.transform(D.passages(t()), F.md5), f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, md5(p) AS value FROM ({PASSAGES}) WHERE length(p) >= 250 AND length(p) - length(replace(p, '?', '')) <= 3 AND NOT regexp_matches(p, {S.quoted(RUN5)})")
_rows("flt10_flt11_clean_text", lambda: D.is_clean(t()), """
WITH c AS (SELECT k, doc_id, unnest(ch) AS c, unnest(range(len(ch))) AS i FROM (SELECT row_number() OVER () AS k, doc_id, string_split(text, '') AS ch FROM documents WHERE text IS NOT NULL)),
n AS (SELECT k, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2, lead(c, 3) OVER w AS c3, lead(c, 4) OVER w AS c4, lead(c, 5) OVER w AS c5 FROM c WINDOW w AS (PARTITION BY k ORDER BY i)),
b AS (SELECT k, bool_or(coalesce((c = c1 AND c1 = c2 AND c2 = c3 AND c3 = c4 AND c NOT IN (chr(10), chr(13))) OR (c = c1 AND c2 = c3 AND c4 = c5 AND regexp_matches(c || c2 || c4, '^[A-Za-z]{3}$')), false)) AS bad FROM n GROUP BY k)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN NOT coalesce(bad, false) END AS value FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents) LEFT JOIN b USING (k)""")
#: Whether all blocks of so many characters of w are of one character.
_BLOCKS = "length(w) % {k} = 0 AND length(w) >= {m} AND len(list_filter(range(length(w)), lambda i: w[i + 1] <> w[i + 1 - i % {k}])) = 0"
_KTH = "array_to_string(list_transform(range(length(w) // {k}), lambda i: w[i * {k} + 1]), '')"
_PRINTED = "CASE WHEN length(w) IN (4, 5) AND len(list_distinct(string_split(w, ''))) = 1 THEN w[1] " + " ".join(f"WHEN {_BLOCKS.format(k=k, m=2 * k)} THEN {_KTH.format(k=k)}" for k in (5, 4, 3, 2)) + " ELSE w END"
_rows("txt32_collapse_overprint", lambda: F.md5(F.array_join(F.transform(T.split_words(t()), D.collapse_overprint), " ")), f"WITH t AS ({S.words_of_documents()}), k AS (SELECT w, {_PRINTED} AS c FROM (SELECT DISTINCT w FROM t)), j AS (SELECT doc_id, string_agg(c, ' ' ORDER BY i) AS x FROM t JOIN k USING (w) GROUP BY doc_id) SELECT doc_id, md5(coalesce(x, '')) AS value FROM documents LEFT JOIN j USING (doc_id)")
_rows("txt30_strip_doubled", lambda: F.md5(D.strip_doubled(t())), f"""
WITH t AS (SELECT doc_id, unnest(x) AS w, unnest(range(len(x))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS x FROM documents)), k AS (SELECT w, w <> '' AND NOT contains(w, chr(10)) AND regexp_matches(w, '[\\p{{L}}\\p{{N}}]') AND {_BLOCKS.format(k=2, m=2)} AS f FROM (SELECT DISTINCT w FROM t)),
n AS (SELECT doc_id, w, i, f, coalesce(lead(f, 1) OVER o, false) AS a, coalesce(lead(f, 2) OVER o, false) AS b, coalesce(lag(f, 1) OVER o, false) AS y, coalesce(lag(f, 2) OVER o, false) AS z FROM t JOIN k USING (w) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
j AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS x FROM n WHERE NOT (f AND (length(w) >= 10 OR (a AND b) OR (y AND a) OR (y AND z))) GROUP BY doc_id) SELECT doc_id, CASE WHEN text IS NOT NULL THEN md5(coalesce(x, '')) END AS value FROM documents LEFT JOIN j USING (doc_id)""")
#: Doubled tokens of w's neighbours leave: see strip_doubled.
_DOUBLED = f"w <> '' AND NOT contains(w, chr(10)) AND regexp_matches(w, '[\\p{{L}}\\p{{N}}]') AND {_BLOCKS.format(k=2, m=2)}"
_LEAVES = "(f AND (length(w) >= 10 OR (a AND b) OR (y AND a) OR (y AND z)))"
_BAD = ["(?i)^Reprint\\s+[0-9]{4}[-–][0-9]{2,4}$", "Reprint 2025-26", "Reprint 2024-25", "(?i)^(Fig\\.|Figure|Table)\\s*[0-9.]+", "^Activity\\s*_{2,}\\s*[0-9]+", "^[A-Z]{3,}(\\s+[A-Z]{3,}){2,}$", "^[0-9]{5,}(\\s*[0-9]{5,})*\\s*$", "^(wonk ot eroM|rethguaD sllec|Meiosis-II|Meiosis-I)$"]
_rows("txt31_chunk_lines", lambda: F.md5(D.chunk_lines(t())), f"""
WITH l AS (SELECT doc_id, i, trim(x, ' ') AS x FROM (SELECT doc_id, unnest(y) AS x, unnest(range(len(y))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS y FROM documents))),
t AS (SELECT doc_id, i, unnest(v) AS w, unnest(range(len(v))) AS k FROM (SELECT doc_id, i, string_split(x, ' ') AS v FROM l)), d AS (SELECT w, {_DOUBLED} AS f FROM (SELECT DISTINCT w FROM t)),
n AS (SELECT doc_id, i, w, k, f, coalesce(lead(f, 1) OVER o, false) AS a, coalesce(lead(f, 2) OVER o, false) AS b, coalesce(lag(f, 1) OVER o, false) AS y, coalesce(lag(f, 2) OVER o, false) AS z FROM t JOIN d USING (w) WINDOW o AS (PARTITION BY doc_id, i ORDER BY k)),
s AS (SELECT doc_id, i, trim(string_agg(w, ' ' ORDER BY k), ' ') AS y FROM n WHERE NOT {_LEAVES} GROUP BY doc_id, i),
g AS (SELECT doc_id, i, CASE WHEN x = '' THEN '' ELSE y END AS y FROM l LEFT JOIN s USING (doc_id, i) WHERE x = '' OR (length(coalesce(y, '')) >= 20 AND NOT ({' OR '.join(f'regexp_matches(x, {S.quoted(p)})' for p in _BAD)}))),
j AS (SELECT doc_id, string_agg(y, chr(10) ORDER BY i) AS z FROM g GROUP BY doc_id)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(z, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[A-Z]{{4,}}[a-z]{{4,}}[A-Z][\\p{{L}}\\p{{N}}_.()]*(?:\\s+[0-9.()]{{4,}})*', '', 'g'), '  +', ' ', 'g'), ' ')) AS value FROM documents LEFT JOIN j USING (doc_id)""")
#: A doubled letter three times over.
PAIRS3 = "(?:" + "|".join(c * 2 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + "){3}"
_PART = "x"
for _p in (PAIRS3, RUN5, "\\b(?:Grade\\s+[0-9]+|Reprint\\s+[0-9]{4}|ExplorationGrade[0-9]+)\\s+\\w*", "\\bCuriosity\\s+", "\\sy\\s+(?:Where|How|What|Why|When|Which|Who|Can|Is|Are|Do|Does)\\b[^.!?]*[.!?]?", "[\\s\\p{Z}]+"):
    _PART = f"regexp_replace({_PART}, {S.quoted(_p)}, ' ', 'g')"
_rows("txt36_clean_blob", lambda: F.md5(D.clean_blob(t())), f"""
WITH l AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\\r\\n|[\\n\\x0B\\f\\r]', chr(10), 'g'), chr(10)) AS y FROM documents),
b AS (SELECT doc_id, CASE WHEN len(y) > 5 THEN array_to_string(list_filter(list_transform(y, lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, {S.quoted(D.SKIPPED_LINE)}) AND NOT regexp_matches(x, '^[0-9]+$') AND NOT regexp_matches(x, {S.quoted(PAIRS3 + '|' + RUN5)})), ' ')
ELSE array_to_string(list_filter(list_transform(string_split(regexp_replace(array_to_string(y, ' '), {S.quoted(D.PAGE_MARK)}, chr(1), 'g'), chr(1)), lambda x: trim({_PART}, ' ')), lambda x: length(x) > 50), ' ') END AS z FROM l)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(z, '^[A-Z][A-Za-z:\\s]{{5,60}}(?:Life|Science|Society|History|Geography|Economics|Civics|Action)\\s+([A-Z][a-z])', '\\1'), '^Chapter\\s+[0-9]+\\s+', ''), ' ')) AS value FROM b""")


def touched(c: str, pattern: str) -> str:
    """All matches of a pattern that no letter or digit touches. White space is doubled, since a match takes one of it, and halved again."""
    found = f"regexp_extract_all(regexp_replace({c}, '(\\s)', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_])({pattern})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)"
    return f"list_transform({found}, lambda x: regexp_replace(x, '(\\s)\\s', '\\1', 'g'))"


def capitals(c: str) -> str:
    return f"list_filter({touched(c, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){1,3}')}, lambda x: lower(regexp_extract(x, '^\\S+')) NOT IN {S.listed(D.STARTS)})"


def phrases(x: str) -> str:
    """The first two of a list of runs that differ in more than case."""
    return f"list_transform((list_sort(list_transform(list_distinct(list_transform({x}, lambda y: lower(y))), lambda y: list_position(list_transform({x}, lambda z: lower(z)), y))))[1:2], lambda k: {x}[k])"


def key_term(c: str, runs: str) -> str:
    """c: a text; runs: its capitalised runs."""
    defined = f"trim(regexp_extract({c}, '^([A-Z][^.!?]{{3,50}}?)\\s+(?:is|are|refers to|means|can be defined)', 1), ' ')"
    words = f"regexp_split_to_array(lower({defined}), '[\\s\\p{{Z}}]+')"
    single = f"list_filter({touched(c, '[A-Z][a-z]{4,}')}, lambda x: lower(x) NOT IN {S.listed(D.STARTS)})[1]"
    return f"CASE WHEN {c} IS NOT NULL THEN coalesce(CASE WHEN length({defined}) >= 4 AND {words}[1] NOT IN {S.listed(D.STARTS)} AND {words}[-1] NOT IN {S.listed(D.STARTS)} AND len({words}) <= 6 THEN {defined} END, list_filter({runs}, lambda x: length(x) >= 5)[1], {single}, 'the concept') END"


def good_start(c: str) -> str:
    return f"({c} IS NOT NULL AND length({c}) BETWEEN 15 AND 150 AND lower(regexp_extract({c}, '^\\s*(\\S+)', 1)) NOT IN {S.listed(_SKIPPED)} AND NOT regexp_matches({c}, '\\(\\s*\\)|\\(\\s*-\\s*[0-9]|\\(\\s*Fig') AND NOT regexp_matches({c}, '[A-Z]{{3,}}|[0-9]{{4,}}|[_=<>{{}}\\[\\]]') AND NOT regexp_matches({c}, '(?i)\\b(Meet a|Curiosity|Grade [0-9]|Reprint)\\b'))"


_SKIPPED = [*D.STARTS, *"so yet also together inside outside therefore however additionally furthermore moreover nevertheless otherwise firstly secondly thirdly finally note observe remember recall".split()]
_rows("txt37_key_term", lambda: D.key_term(t()), f"SELECT doc_id, {key_term('text', 'x')} AS value FROM (SELECT doc_id, text, {capitals('text')} AS x FROM documents)")
_rows("txt38_noun_phrases", lambda: F.array_join(D.noun_phrases(t()), "|"), f"SELECT doc_id, coalesce(array_to_string({phrases('x')}, '|'), '') AS value FROM (SELECT doc_id, {capitals('text')} AS x FROM documents)")
CLEAN = "array_to_string(list_transform(" + S.tokens() + ", lambda w: w), ' ')"
for _p, _by in (
    ("(?i)(the fundamental unit of life|chapter\\s*[0-9]+|science|class\\s*(ix|x|9|10)|ncert)", ""), ("(?i)\\b[0-9]{4}CH[0-9]{2}\\b", ""), ("(?i)\\b(Think It Over)\\b", ""), ("Fig(?:ure|\\.)\\s*[0-9]+[.0-9]*\\s*[:-]?\\s*", ""), ("Table\\s*[0-9]+[.0-9]*\\s*[:-]?\\s*", ""),
    ("[“”]", '"'), ("[‘’]", "'"), ("[–—]", "-"), ("…", "..."), ("[ \\t]{2,}", " "), ("[^\\p{L}\\p{N}_\\s.,;:!?()\\[\\]\"'%°/+=²³₂₃→←↔-]", ""),
):
    CLEAN = f"regexp_replace({CLEAN}, {S.quoted(_p)}, {S.quoted(_by)}, 'g')"
#: Texts without runs of equal characters, which the counterpart's patterns cannot collapse.
_PLAIN = "NOT regexp_matches(text, '" + "|".join(f"{c}{{3,}}" for c in "abcdefghijklmnopqrstuvwxyzäöüßéèêçàáíóúñABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789#$%&*.,!?|_=-") + "')"


@query("txt28_clean_pages", f"SELECT doc_id, md5(trim({CLEAN}, ' ')) AS value FROM documents WHERE {_PLAIN.replace('*{', chr(92) + '*{').replace('$', chr(92) + '$').replace('.{', chr(92) + '.{').replace('?{', chr(92) + '?{').replace('||', '|' + chr(92) + '|')}")
def clean_pages(spark, d):
    plain = ~F.col("text").rlike("([a-zäöüßéèêçàáíóúñA-Z0-9#$%&*.,!?|_=-])\\1{2,}")
    return load(spark, d, "documents").where(plain).select("doc_id", F.md5(D.clean_pages(F.col("text"))).alias("value"))


#: Runs of equal characters of the distinct tokens.
GLYPHS = f"""w AS (SELECT w, count(*) AS n FROM ({S.words_of_documents()}) GROUP BY w), c AS (SELECT w, unnest(string_split(w, '')) AS c, unnest(range(length(w))) AS i FROM w),
g AS (SELECT *, sum(new) OVER (PARTITION BY w ORDER BY i) AS g FROM (SELECT *, (c IS DISTINCT FROM lag(c) OVER (PARTITION BY w ORDER BY i))::INT AS new FROM c)),
r AS (SELECT w, g, any_value(c) AS c, count(*) AS k FROM g GROUP BY w, g), q AS (SELECT w, string_agg(c, '' ORDER BY g) AS single, min(k) AS least, count(*) AS runs FROM r GROUP BY w)"""


@query("txt27_collapse_glyphs", f"WITH {GLYPHS} SELECT w, n AS count, single AS c FROM w JOIN q USING (w) WHERE (least >= 4 OR least >= 3 AND (runs >= 2 OR length(w) >= 6)) AND single <> w")
def collapse_glyphs(spark, d):
    words = load(spark, d, "documents").select(F.explode(T.split_words(F.col("text"))).alias("w")).groupBy("w").count()
    return words.withColumn("c", D.collapse_glyphs(F.col("w"))).where("c <> w")


NOISE = f"""length(s) < 10 OR (s = upper(s) AND s <> lower(s) AND length(s) < 30) OR (len({S.tokens('s')}) >= 2 AND len(list_filter({S.tokens('s')}, lambda w: length(w) > 2)) = 0 AND length(s) <= 20) OR regexp_matches(s, '{D.CONSONANTS}')
OR regexp_matches(s, '{D.MARGIN}') OR length(regexp_replace(s, '[\\x00-\\x7F]', '', 'g')) > length(s) * 0.3"""


@query("flt13_noise_lines", f"SELECT doc_id, count(*) FILTER (WHERE {NOISE}) AS noise, count(*) AS lines FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS s FROM documents) GROUP BY doc_id")
def noise_lines(spark, d):
    lines = load(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(D.is_noise(F.col("line"))).alias("noise"), F.count("*").alias("lines"))


_LONG = "length(s) BETWEEN 60 AND 600 AND length(regexp_replace(s, '[^\\p{L} ]', '', 'g')) / length(s) >= 0.6 AND len(" + S.tokens("s") + f") >= 8 AND NOT regexp_matches(s, '^\\p{{Ll}}') AND NOT regexp_matches(substr(s, 1, 60), '{D.CONSONANTS}')"
_exploded("txt18_extract_sentences", lambda: D.extract_sentences(t()), f"""
WITH l AS (SELECT doc_id, x, i, trim(x, ' ') AS s FROM (SELECT doc_id, unnest(y) AS x, unnest(range(len(y))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS y FROM documents))),
j AS (SELECT doc_id, trim(regexp_replace(string_agg(x, ' ' ORDER BY i), '[\\s\\p{{Z}}]+', ' ', 'g'), ' ') AS t FROM l WHERE NOT ({NOISE}) GROUP BY doc_id),
p AS (SELECT doc_id, trim(unnest(z), ' ') AS s, unnest(range(len(z))) AS k FROM (SELECT doc_id, string_split(regexp_replace(t, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS z FROM j)),
u AS (SELECT doc_id, s, k FROM p WHERE {_LONG} QUALIFY row_number() OVER (PARTITION BY doc_id, lower(substr(s, 1, 80)) ORDER BY k) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, s AS value FROM u""")


@query("flt12_good_first_sentence", f"SELECT doc_id, s FROM ({EACH}) WHERE i = 0 AND {good_start('s')}")
def good_first(spark, d):
    return load(spark, d, "documents").select("doc_id", F.get(D.split_sentences(F.col("text")), F.lit(0)).alias("s")).where(D.is_good_start(F.col("s")))


@query("txt34_join_lines", """
WITH RECURSIVE l AS (SELECT doc_id, unnest(p) AS p, unnest(range(len(p))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents)),
a AS (SELECT doc_id, 0 AS i, p AS s FROM l WHERE i = 0 UNION ALL SELECT l.doc_id, l.i, CASE WHEN suffix(a.s, '-') AND NOT suffix(a.s, ' -') THEN CASE WHEN regexp_matches(l.p, '^\\p{Ll}') THEN a.s[:-2] || l.p ELSE a.s || l.p END ELSE a.s || ' ' || l.p END FROM a JOIN l ON l.doc_id = a.doc_id AND l.i = a.i + 1)
SELECT doc_id, md5(trim(regexp_replace(arg_max(s, i), '[\\s\\p{Z}]+', ' ', 'g'))) AS value FROM a GROUP BY doc_id""")
def join_lines(spark, d):
    return load(spark, d, "documents").where("trim(text) <> ''").select("doc_id", F.md5(D.join_lines(F.split("text", "\n"))).alias("value"))


@query("src07_page_text", "SELECT page_id, length(x) AS char_count FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) AS x FROM pages) WHERE length(x) > 20")
def page_text(spark, d):
    x = T.squeeze(F.regexp_replace("html", "<[^>]*>", " "))
    return load(spark, d, "pages").select("page_id", F.length(x).alias("char_count")).where("char_count > 20")


# Words with places on a page, made from the first tokens of documents by rule.
BOXES = f"""
b AS (SELECT doc_id, w, i, (i % 9) * 60.0 + (doc_id % 3) * 2 AS x0, (i % 9) * 60.0 + (doc_id % 3) * 2 + length(w) * 5.0 AS x1, (i // 9) * 13.0 + 60 AS top, CASE WHEN i % 31 = 0 THEN 14.0 WHEN (doc_id + i) % 7 = 0 THEN 9.0 ELSE 10.0 END AS size FROM ({S.words_of_documents()}))"""


def boxes(spark, d):
    w = load(spark, d, "documents").select("doc_id", F.posexplode(T.split_words(F.col("text"))).alias("i", "w"))
    x0 = (F.col("i") % 9) * 60.0 + (F.col("doc_id") % 3) * 2
    return w.select(
        "doc_id", "w", "i", x0.alias("x0"), (x0 + F.length("w") * 5.0).alias("x1"), (F.floor(F.col("i") / 9) * 13.0 + 60).alias("top"),
        F.when(F.col("i") % 31 == 0, 14.0).when((F.col("doc_id") + F.col("i")) % 7 == 0, 9.0).otherwise(10.0).alias("size"),
    )


@query("chk07_body_size", f"WITH {BOXES}, c AS (SELECT doc_id, size, count(*) AS n, min(i) AS f FROM b GROUP BY doc_id, size) SELECT doc_id, size AS body FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1")
def body_size(spark, d):
    return layout.body_size(boxes(spark, d), ["doc_id"], "size", "i").withColumnRenamed("size", "body")


@query("chk08_word_class", f"WITH {BOXES} SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN top > 0.92 * 800 OR (top < 0.085 * 800 AND size < 20) THEN NULL WHEN 10.9 <= size AND size < 40 THEN 'heading' WHEN abs(size - 10) < 0.45 THEN 'body' WHEN 8.6 <= size AND size <= 9.55 THEN 'box' END AS kind FROM b) GROUP BY doc_id, kind")
def word_class(spark, d):
    kind = layout.word_class(F.col("size"), F.lit("Serif"), F.col("top"), F.col("w"), F.lit(10.0), F.lit(800.0))
    return boxes(spark, d).groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("chk09_column_starts", f"WITH {BOXES} SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, round_even(x0 / 2, 0) * 2 AS x FROM b WHERE x0 > 540 * 0.45) GROUP BY doc_id, x HAVING count(*) >= 5")
def column_starts(spark, d):
    return layout.column_starts(boxes(spark, d), ["doc_id"], 540.0)


@query("chk12_in_any_box", f"WITH {BOXES}, a AS (SELECT * FROM (VALUES (100.0, 100.0, 200.0, 150.0), (300.0, 60.0, 420.0, 90.0)) v(l, t, r, m)) SELECT doc_id, count(*) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.x0 >= l - 2 AND b.x1 <= r + 2 AND b.top >= t - 2 AND b.top <= m + 2) GROUP BY doc_id")
def in_any_box(spark, d):
    areas = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("ltrb", x, strict=True)]) for x in ((100.0, 100.0, 200.0, 150.0), (300.0, 60.0, 420.0, 90.0))])
    return boxes(spark, d).where(~layout.in_any(F.col("x0"), F.col("x1"), F.col("top"), areas)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("chk13_column_bounds", f"WITH {BOXES}, r AS (SELECT doc_id, x0, row_number() OVER (PARTITION BY doc_id ORDER BY x0) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM b) SELECT doc_id, max(x0) FILTER (WHERE k = n // 4) AS low, max(x0) FILTER (WHERE k = 3 * n // 4) AS high FROM r GROUP BY doc_id")
def column_bounds(spark, d):
    return layout.column_bounds(boxes(spark, d), ["doc_id"], "x0")


@query("chk10_line_segments")
def line_segments(spark, d):
    return layout.line_segments(boxes(spark, d), ["doc_id"])


@query("chk11_blocks")
def blocks(spark, d):
    return layout.blocks(layout.line_segments(boxes(spark, d), ["doc_id"]), ["doc_id"], 10.0)


@query("chk15_merge_headings", f"""WITH {BOXES}, h AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY doc_id ORDER BY i) < 35 THEN 0 ELSE 1 END AS s FROM b WHERE size = 14), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM h)
SELECT doc_id, g, string_agg(w, ' ' ORDER BY i) AS heading FROM g GROUP BY doc_id, g""")
def merge_headings(spark, d):
    return layout.merge_near(boxes(spark, d).where("size = 14"), ["doc_id"], "i", "top", "w", 35.0).withColumnRenamed("text", "heading")


@query("txt35_tables", "SELECT n_regionkey AS region, string_agg(n_nationkey || ' | ' || n_name, ' / ' ORDER BY n_nationkey) AS rendered FROM nation GROUP BY n_regionkey HAVING count(*) >= 2")
def tables(spark, d):
    rows = load(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r")).where(F.size("r") >= 2)
    return rows.select("region", F.array_join(F.transform("r", lambda x: F.concat_ws(" | ", x["n_nationkey"].cast("string"), x["n_name"])), " / ").alias("rendered"))


@query("chk19_candidate_sentences", """
WITH s AS (SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS i FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[\\s]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 40) AS x FROM documents)),
t AS (SELECT *, contains(lower(s), 'tion') AS hit FROM s), n AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS hits FROM t GROUP BY doc_id)
SELECT doc_id, count(*) AS n, sum(length(s)) AS chars FROM t JOIN n USING (doc_id) WHERE hit OR hits < 10 GROUP BY doc_id""")
def candidate_sentences(spark, d):
    s = load(spark, d, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", "(?<=[.!?])\\s+"), lambda x: F.length(x) > 40)).alias("i", "s")).withColumn("hit", F.contains(F.lower("s"), F.lit("tion")))
    s = s.withColumn("hits", F.count_if("hit").over(Window.partitionBy("doc_id")))
    return s.where("hit or hits < 10").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))
