"""Conversation stores, histories and answer events over conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import chats as C
from textloom.plans import _sql as S
from textloom.registry import load, query
from textloom.sources.stores import parse_sse

CHATS = "SELECT conv_id, conv_id % 10 AS user_id, CASE WHEN conv_id % 4 = 0 THEN conv_id * 1000.0 + 2 END AS share_upto, max(conv_id * 1000.0 + turn) AS updated_at FROM conversations GROUP BY conv_id"
MESSAGES = "SELECT conv_id, turn, role, text, conv_id * 1000.0 + turn AS created_at FROM conversations"
SQUEEZED = "SELECT conv_id, turn, role, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS text FROM conversations"


def messages(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", "role", "text", (F.col("conv_id") * F.lit(1000.0) + F.col("turn")).alias("created_at"))


def chats(spark, d):
    c = F.col("conv_id")
    g = messages(spark, d).groupBy("conv_id").agg(F.max("created_at").alias("updated_at"))
    return g.select("conv_id", (c % 10).alias("user_id"), F.when(c % 4 == 0, c * F.lit(1000.0) + 2).alias("share_upto"), "updated_at")


@query("win02_trim_history", f"SELECT conv_id, turn, role, CASE WHEN length(text) > 300 THEN rtrim(substr(text, 1, 300)) || '...' ELSE text END AS text FROM ({SQUEEZED}) WHERE text <> '' AND role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def trim_history(spark, d):
    return C.trim_history(load(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("win03_last_messages", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def last_messages(spark, d):
    return C.last_messages(load(spark, d, "conversations"), "conv_id", "turn", 6).select("conv_id", "turn", "role")


@query("win04_txt45_standalone", "SELECT conv_id, turn, trim(coalesce(p || ' ', '') || text) AS standalone FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM conversations) WHERE role = 'user'")
def standalone(spark, d):
    rows = load(spark, d, "conversations").withColumn("p", C.previous_question("conv_id", "turn"))
    return rows.where("role = 'user'").select("conv_id", "turn", F.trim(F.concat_ws(" ", "p", "text")).alias("standalone"))


@query("txt46_rewrite_transcript", "SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Student: ' ELSE 'Tutor: ' END || text, chr(10) ORDER BY turn) AS transcript FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def transcript(spark, d):
    rows = load(spark, d, "conversations").where("role in ('user', 'assistant')")
    line = F.concat(F.when(F.col("role") == "user", "Student: ").otherwise("Tutor: "), F.col("text"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda x: x["x"]), "\n").alias("transcript"))


@query("flt17_is_followup", "SELECT conv_id, count(*) FILTER (WHERE role IN ('user', 'assistant') AND trim(text) <> '') > 0 AS followup FROM conversations GROUP BY conv_id")
def is_followup(spark, d):
    return load(spark, d, "conversations").groupBy("conv_id").agg((F.count_if(F.col("role").isin("user", "assistant") & (F.trim("text") != "")) > 0).alias("followup"))


@query("win01_sequence", "SELECT conv_id, turn, format('c{}_{:04d}', conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS id FROM conversations")
def sequence(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return load(spark, d, "conversations").select("conv_id", "turn", F.format_string("c%d_%04d", "conv_id", n).alias("id"))


@query("win05_first_per_key", "SELECT role, min(conv_id * 1000 + turn) AS first_seen FROM conversations GROUP BY role")
def first_per_key(spark, d):
    return load(spark, d, "conversations").groupBy("role").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_seen"))


@query("win06_runs", "SELECT conv_id, g, role, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS s FROM conversations)) GROUP BY conv_id, g, role")
def runs(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, d, "conversations").withColumn("s", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)).withColumn("g", F.sum("s").over(w))
    return rows.groupBy("conv_id", "g", "role").agg(F.count("*").alias("n"))


@query("win07_cyclic_repeat", "WITH n AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation) SELECT n_regionkey, n_nationkey, k * n + pos AS place FROM n, range(12) t(k) WHERE k * n + pos < 12")
def cyclic_repeat(spark, d):
    """Each region's nations again and again, up to 12 rows a region, which is the feature."""
    return C.cyclic_repeat(load(spark, d, "nation").select("n_regionkey", "n_nationkey"), "n_regionkey", "n_nationkey", 12).select("n_regionkey", "n_nationkey", "place")


@query("win08_positional_slices", "SELECT part, count(*) AS n FROM (SELECT CASE WHEN r <= 2 THEN 'opening' WHEN r <= 4 THEN 'middle' ELSE 'rest' END AS part FROM (SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)) GROUP BY part")
def positional_slices(spark, d):
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = load(spark, d, "conversations").select(r.alias("r"))
    return rows.groupBy(F.when(F.col("r") <= 2, "opening").when(F.col("r") <= 4, "middle").otherwise("rest").alias("part")).agg(F.count("*").alias("n"))


@query("win09_running_budget", "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations) WHERE run <= 400")
def running_budget(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, d, "conversations").withColumn("run", F.sum(F.length("text")).over(w)).where("run <= 400").select("conv_id", "turn")


@query("srt02_db03_list_chats", f"SELECT conv_id, updated_at FROM ({CHATS}) WHERE user_id = 3 ORDER BY updated_at DESC")
def list_chats(spark, d):
    return chats(spark, d).where("user_id = 3").select("conv_id", "updated_at").orderBy(F.desc("updated_at"))


@query("srt03_longest_first", "SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(" + S.tokens() + "), lambda w: (-length(w), w))), lambda x: x[2]), ' ') AS ordered FROM benchmark")
def longest_first(spark, d):
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct(T.split_words(F.col("text"))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    return load(spark, d, "benchmark").select("item_id", F.array_join(ordered, " ").alias("ordered"))


@query("srt01_lexicographic", "SELECT coalesce(doc_id::VARCHAR, '') AS id FROM documents ORDER BY id")
def lexicographic(spark, d):
    return load(spark, d, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")).orderBy("id")


@query("top01_top_k", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def top_k(spark, d):
    return load(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(10)


@query("lim02_first_variants", "SELECT doc_id, k, v FROM (SELECT doc_id, unnest(x) AS v, unnest(range(len(x))) AS k FROM (SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'a' END, lang, CASE WHEN doc_id % 3 = 0 THEN 'c' END, 'd'], lambda v: v IS NOT NULL)[1:3] AS x FROM documents))")
def first_variants(spark, d):
    k = F.col("doc_id")
    options = F.array(F.when(k % 2 == 0, "a"), F.col("lang"), F.when(k % 3 == 0, "c"), F.lit("d"))
    return load(spark, d, "documents").select("doc_id", F.posexplode(F.slice(F.filter(options, lambda v: v.isNotNull()), 1, 3)).alias("k", "v"))


@query("jon03_semi_join", f"SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM ({CHATS}) WHERE user_id = 3)")
def semi_join(spark, d):
    return C.owned(messages(spark, d), chats(spark, d), "conv_id", "user_id", 3).select("conv_id", "turn")


@query("jon05_db08_snapshot", f"SELECT m.conv_id, m.turn, m.role FROM ({MESSAGES}) m JOIN ({CHATS}) c ON m.conv_id = c.conv_id AND m.created_at <= c.share_upto")
def snapshot(spark, d):
    return C.snapshot(messages(spark, d), chats(spark, d), "conv_id", "created_at", "share_upto").select("conv_id", "turn", "role")


@query("jon08_cross_reduce", "SELECT r_name, count(*) AS n FROM region, nation WHERE contains(n_name, substr(r_name, 1, 1)) GROUP BY r_name")
def cross_reduce(spark, d):
    r, n = load(spark, d, "region"), load(spark, d, "nation")
    return n.join(r, F.contains("n_name", F.substring("r_name", 1, 1))).groupBy("r_name").agg(F.count("*").alias("n"))


@query("jon09_parent_exists", f"SELECT count(*) AS n FROM conversations m JOIN ({CHATS}) c USING (conv_id) WHERE c.user_id IN (1, 2)")
def parent_exists(spark, d):
    return messages(spark, d).join(chats(spark, d).where("user_id in (1, 2)"), "conv_id").agg(F.count("*").alias("n"))


@query("jon10_db06_cascade", f"SELECT m.conv_id, m.turn FROM conversations m WHERE conv_id NOT IN (SELECT conv_id FROM ({CHATS}) WHERE user_id = 7)")
def cascade(spark, d):
    _, rest = C.delete_cascade(chats(spark, d), messages(spark, d), "conv_id", F.col("user_id") == 7)
    return rest.select("conv_id", "turn")


@query("jon07_containment", "SELECT n_name, count(*) AS n FROM nation JOIN documents ON contains(lower(text), lower(n_name)) GROUP BY n_name")
def containment(spark, d):
    held = C.containing(load(spark, d, "documents"), "text", load(spark, d, "nation"), "n_name")
    return held.groupBy("n_name").agg(F.count("*").alias("n"))


@query("db01_upsert", f"SELECT conv_id, CASE WHEN conv_id < 20 THEN 99 ELSE user_id END AS user_id FROM ({CHATS}) UNION ALL SELECT 1000000, 99")
def upsert(spark, d):
    table = chats(spark, d).select("conv_id", "user_id")
    new = table.where("conv_id < 20").select("conv_id", F.lit(99).cast("long").alias("user_id")).union(spark.sql("SELECT 1000000L AS conv_id, 99L AS user_id"))
    return C.upsert(table, new, "conv_id", ["user_id"])


@query("db04_get_chat", f"SELECT conv_id, updated_at FROM ({CHATS}) WHERE conv_id = 13 AND user_id = 3")
def get_chat(spark, d):
    return chats(spark, d).where("conv_id = 13 and user_id = 3").select("conv_id", "updated_at")


@query("db05_db07_update", f"SELECT conv_id, CASE WHEN user_id = 3 THEN updated_at END AS share_upto FROM ({CHATS})")
def update(spark, d):
    c = chats(spark, d).withColumn("share_upto", F.lit(None).cast("double"))
    return C.set_where(c, F.col("user_id") == 3, share_upto=F.col("updated_at")).select("conv_id", "share_upto")


@query("db09_add_message", f"SELECT conv_id, count(*) AS n, max(created_at) AS updated_at FROM (SELECT conv_id, created_at FROM ({MESSAGES}) UNION ALL SELECT conv_id, updated_at + 1 FROM ({CHATS}) WHERE user_id = 3) GROUP BY conv_id")
def add_message(spark, d):
    new = chats(spark, d).where("user_id = 3").select("conv_id", (F.col("updated_at") + 1).alias("created_at"))
    return messages(spark, d).select("conv_id", "created_at").union(new).groupBy("conv_id").agg(F.count("*").alias("n"), F.max("created_at").alias("updated_at"))


@query("db10_feedback", f"SELECT conv_id, turn, CASE WHEN role = 'assistant' AND conv_id IN (SELECT conv_id FROM ({CHATS}) WHERE user_id = 3) THEN 1 ELSE 0 END AS feedback FROM conversations")
def feedback(spark, d):
    mine = chats(spark, d).where("user_id = 3").select("conv_id", F.lit(True).alias("mine"))
    rows = messages(spark, d).join(mine, "conv_id", "left").withColumn("feedback", F.lit(0))
    return C.set_where(rows, F.col("mine") & (F.col("role") == "assistant"), feedback=F.lit(1)).select("conv_id", "turn", "feedback")


@query("db11_migration", "SELECT conv_id, turn, NULL::VARCHAR AS feedback FROM conversations")
def migration(spark, d):
    return spark.createDataFrame([], "conv_id long, turn long, feedback string").unionByName(load(spark, d, "conversations").select("conv_id", "turn"), allowMissingColumns=True)


@query("db13_json_decode", "SELECT event_id, len(json_keys(props)) AS n_keys FROM events")
def json_decode(spark, d):
    return load(spark, d, "events").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@query("prj09_public_columns", f"SELECT conv_id, updated_at FROM ({CHATS})")
def public_columns(spark, d):
    return chats(spark, d).select("conv_id", "updated_at")


@query("prj08_rename", "SELECT s_suppkey AS class_num, s_name AS title FROM supplier")
def rename(spark, d):
    return load(spark, d, "supplier").withColumnsRenamed({"s_suppkey": "class_num", "s_name": "title"}).select("class_num", "title")


@query("prj10_backfill_messages", "SELECT conv_id, turn, md5(role || ':' || text) AS message_md5 FROM conversations")
def backfill_messages(spark, d):
    given = F.lit(None).cast("array<struct<role:string,content:string>>")
    m = F.coalesce(given, F.array(F.struct("role", F.col("text").alias("content"))))
    return load(spark, d, "conversations").select("conv_id", "turn", F.md5(F.concat_ws(":", m[0]["role"], m[0]["content"])).alias("message_md5"))


@query("prj11_timings", "SELECT user_id, count(DISTINCT event_type) AS n_steps FROM events GROUP BY user_id")
def timings(spark, d):
    steps = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("sec"))
    m = steps.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "sec"))).alias("m"))
    return m.select("user_id", F.size("m").cast("long").alias("n_steps"))


# Answer events of each conversation: tokens of its messages, then done, error, or nothing.
EVENTS = "SELECT conv_id AS session, turn AS seq, 'token' AS type, text || ' ' AS text FROM conversations UNION ALL SELECT conv_id, 1000, CASE conv_id % 3 WHEN 0 THEN 'done' ELSE 'error' END, NULL FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 < 2"


def answer_events(spark, d):
    c = load(spark, d, "conversations")
    tokens = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.lit("token").alias("type"), F.concat("text", F.lit(" ")).alias("text"))
    ends = c.select("conv_id").distinct().where("conv_id % 3 < 2").select(F.col("conv_id").alias("session"), F.lit(1000).cast("long").alias("seq"), F.when(F.col("conv_id") % 3 == 0, "done").otherwise("error").alias("type"), F.lit(None).cast("string").alias("text"))
    return tokens.unionByName(ends)


FOLDED = f"SELECT session, coalesce(min(CASE WHEN type IN ('done', 'error') THEN type END), 'open') AS state, trim(string_agg(text, '' ORDER BY seq) FILTER (WHERE type = 'token')) AS text, count(*) AS n_events FROM ({EVENTS}) GROUP BY session"


@query("str01_event_protocol", f"SELECT state, count(*) AS n, sum(n_events)::BIGINT AS events FROM ({FOLDED}) GROUP BY state")
def event_protocol(spark, d):
    return C.fold_events(answer_events(spark, d)).groupBy("state").agg(F.count("*").alias("n"), F.sum("n_events").alias("events"))


@query("str02_token_concat", f"SELECT session, md5(text) AS text_md5 FROM ({FOLDED})")
def token_concat(spark, d):
    return C.fold_events(answer_events(spark, d)).select("session", F.md5("text").alias("text_md5"))


@query("str03_db12_save_on_done", f"SELECT session, length(text) AS chars FROM ({FOLDED}) WHERE state = 'done'")
def save_on_done(spark, d):
    return C.fold_events(answer_events(spark, d)).where("state = 'done'").select("session", F.length("text").alias("chars"))


@query("str06_sse_parse", "SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0")
def sse_parse(spark, d):
    j = F.to_json(F.struct("conv_id", "turn"))
    lines = load(spark, d, "conversations").select(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("data: "), j)).otherwise(": keep-alive").alias("value"))
    return parse_sse(lines, "conv_id long, turn long")
