"""Conversations: histories, stores with owners, snapshots, and answer events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import held_by, squeeze


def trim_history(messages: DataFrame, chat: str, order: str, role: str = "role", text: str = "text", most: int = 6, chars: int = 300) -> DataFrame:
    """The last messages of each chat that are the user's or the assistant's and not blank; long ones are cut."""
    rows = messages.withColumn(text, squeeze(F.col(text))).where((F.col(text) != "") & F.col(role).isin("user", "assistant"))
    w = Window.partitionBy(chat).orderBy(F.desc(order))
    rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    return rows.withColumn(text, F.when(F.length(text) > chars, F.concat(F.rtrim(F.substring(text, 1, chars)), F.lit("..."))).otherwise(F.col(text)))


def last_messages(messages: DataFrame, chat: str, order: str, most: int) -> DataFrame:
    w = Window.partitionBy(chat).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def previous_question(chat: str, order: str, role: str = "role", text: str = "text") -> Column:
    """The chat's last user message before this one."""
    w = Window.partitionBy(chat).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(F.col(role) == "user", F.col(text)), ignorenulls=True).over(w)


def snapshot(messages: DataFrame, chats: DataFrame, chat: str, created: str, upto: str) -> DataFrame:
    """Messages of shared chats, up to the moment of sharing."""
    shared = chats.where(F.col(upto).isNotNull()).select(F.col(chat).alias("_c"), upto)
    return messages.join(shared, (messages[chat] == F.col("_c")) & (messages[created] <= F.col(upto))).drop("_c", upto)


def owned(rows: DataFrame, chats: DataFrame, chat: str, owner: str, user: object) -> DataFrame:
    return rows.join(chats.where(F.col(owner) == user).select(chat), chat, "left_semi")


def upsert(table: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of known keys take the new columns, unknown keys are added."""
    fresh = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    joined = table.join(fresh, key, "left")
    updated = joined.select(*[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])
    return updated.unionByName(new.join(table, key, "left_anti"), allowMissingColumns=True)


def create_chats(table: DataFrame, new: DataFrame, now: Column, language: str = "hinglish") -> DataFrame:
    """The table with new chats: a language if none is named, made and last changed now. Columns that either side lacks are null."""
    given = F.coalesce(F.col("language"), F.lit(language)) if "language" in new.columns else F.lit(language)
    return new.withColumns({"language": given, "created_at": now, "updated_at": now}).unionByName(table, allowMissingColumns=True)


def delete_cascade(parents: DataFrame, children: DataFrame, key: str, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents that go, and without their children."""
    dead = parents.where(gone).select(key)
    return parents.where(~gone), children.join(dead, key, "left_anti")


def set_where(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return rows.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()})


def fold_events(events: DataFrame, session: str = "session", order: str = "seq") -> DataFrame:
    """session, state, text: tokens joined in order; saved only where the last event is done.

    state is done, error, or open (no last event: the connection closed).
    """
    # A session is one answer; its events are few.
    rows = events.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(order, "type", "text"))).alias("_e"))
    pieces = F.filter(F.transform(F.filter("_e", lambda e: e["type"] == "token"), lambda e: F.coalesce(e["text"], F.lit(""))), lambda t: t != "")
    end = F.get(F.filter("_e", lambda e: e["type"].isin("done", "error")), F.lit(0))["type"]
    return rows.select(session, F.coalesce(end, F.lit("open")).alias("state"), F.trim(F.array_join(pieces, "")).alias("text"), F.size("_e").alias("n_events"))


def cyclic_repeat(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Each key's rows in order, from the start again until there are ``most``; place counts from 0. Of keys with more, the first."""
    w = Window.partitionBy(key).orderBy(order)
    first = rows.withColumn("_at", F.row_number().over(w) - 1).where(F.col("_at") < most)
    counts = first.groupBy(key).agg(F.count("*").alias("_n"))
    placed = first.join(counts, key).withColumn("place", F.explode(F.sequence(F.col("_at").cast("long"), F.lit(most - 1).cast("long"), F.col("_n"))))
    return placed.drop("_at", "_n")


#: Phrases that one expression holds.
PHRASES = 1000


def containing(rows: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """A row for each phrase that a text contains, whatever the case. The phrases stand in the expression, in blocks, so that no join pairs them with the texts."""
    every = [r[0] for r in phrases.select(phrase).where(F.col(phrase).isNotNull()).distinct().toLocalIterator()]
    found = [rows.where(F.lit(False)).withColumn(phrase, F.lit("").cast("string"))]
    for k in range(0, len(every), PHRASES):
        listed = F.array(*[F.struct(F.lit(p.lower()).alias("low"), F.lit(p).alias("p")) for p in every[k : k + PHRASES]])
        found.append(rows.withColumn(phrase, F.explode(F.transform(held_by(F.col(text), listed, "low"), lambda x: x["p"]))))
    return reduce(DataFrame.unionAll, found)
