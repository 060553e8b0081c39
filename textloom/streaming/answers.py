"""Answer events and event windows as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def save_on_done(events: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """session, state, text: each answer of a session when it is done, an empty one on error or when nothing follows.

    events: session string, seq long, type string, text string, in the order of seq. Tokens are held per
    session; blank ones are skipped and the first is stripped on its left.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "state": ["open"], "text": [""]})
            return
        # The rows of a session and trigger are sorted as one, since their batches come in any order.
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        held, ended = state.get[0] if state.exists else None, []
        for kind, text in rows[["type", "text"]].itertuples(index=False):
            if kind == "token" and text:
                held = held + text if held else text.lstrip()
            elif kind in ("done", "error"):
                ended.append((key[0], kind, (held or "").strip() if kind == "done" else ""))
                held = None  # what follows is the session's next answer
            elif held is None:
                held = ""
        if held is not None:
            state.update((held,))
            state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
        if ended:
            yield pd.DataFrame(ended, columns=["session", "state", "text"])

    return events.groupBy("session").applyInPandasWithState(run, "session string, state string, text string", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Events by window and type; works on streams and tables. Times without a zone are taken in the session's."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    return rows.groupBy(F.window("_t", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Runs of a user's events with no gap as long as ``gap``."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    return rows.groupBy(F.session_window("_t", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def client_state(events: list[dict], placeholder: str = "") -> dict:
    """What a client shows after an answer's events (type, text, stage, payload), in order.

    The placeholder stands until the first token; tokens add up, the first stripped on its left; the last status is kept
    until the end. An error, or an end of events without ``done`` (a closed connection), rolls back: the
    answer goes, the question is given back and ``failed`` is set.
    """
    text, status, meta = None, None, None
    for e in events:
        kind = e.get("type")
        if kind == "status":
            status = e.get("stage")
        elif kind == "meta":
            meta = e.get("payload")
        elif kind == "token" and e.get("text"):
            text = e["text"].lstrip() if text is None else text + e["text"]
        elif kind == "done":
            return {"text": (text or "").strip(), "status": None, "meta": meta, "failed": False}
        elif kind == "error":
            break
    return {"text": placeholder, "status": status, "meta": meta, "failed": True}


def reduce_answers(events: DataFrame) -> DataFrame:
    """session, failed, text, status: ``client_state`` of every session, in expressions; events: session, seq, type, text, stage."""
    ordered = events.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "type", "text", "stage"))).alias("e"))
    end = F.filter(F.transform("e", lambda x, i: F.when(x["type"].isin("done", "error"), F.struct(i.alias("i"), x["type"].alias("type")))), lambda x: x.isNotNull())
    rows = ordered.select("session", "e", F.get(end, F.lit(0)).alias("end"))
    before = F.when(F.col("end").isNull(), F.col("e")).otherwise(F.slice("e", F.lit(1), F.col("end.i")))
    tokens = F.filter(F.transform(F.filter(before, lambda x: x["type"] == "token"), lambda x: x["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    stages = F.transform(F.filter(before, lambda x: x["type"] == "status"), lambda x: x["stage"])
    failed = F.coalesce(F.col("end.type") != "done", F.lit(True))
    return rows.select("session", failed.alias("failed"), F.when(failed, "").otherwise(F.trim(F.array_join(tokens, ""))).alias("text"), F.when(failed, F.try_element_at(stages, F.lit(-1))).alias("status"))
