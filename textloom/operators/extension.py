"""Where a user's own code plugs in: stores, callbacks, models, backends, table functions and aggregates."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Store(Protocol):
    """Tables by name, wherever they are kept."""

    def read(self, name: str) -> DataFrame: ...

    def append(self, name: str, rows: DataFrame) -> None: ...

    def replace(self, name: str, rows: DataFrame) -> None: ...


class FileStore:
    """Tables as versioned Parquet folders; replacing one is a single rename (see write_swapped)."""

    def __init__(self, spark: SparkSession, where: str) -> None:
        self.spark, self.where = spark, where.rstrip("/")

    def read(self, name: str) -> DataFrame:
        from textloom.sources.stores import read_swapped

        return read_swapped(self.spark, f"{self.where}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        self.replace(name, self.read(name).unionByName(rows, allowMissingColumns=True))

    def replace(self, name: str, rows: DataFrame) -> None:
        from textloom.sources.stores import write_swapped

        write_swapped(rows, f"{self.where}/{name}")


class JdbcStore:
    """Tables of a database. ``split`` names a numeric column and its bounds, by which reads are spread over tasks."""

    def __init__(self, spark: SparkSession, url: str, options: Mapping[str, str] | None = None, split: tuple[str, int, int, int] | None = None) -> None:
        self.spark, self.url, self.options, self.split = spark, url, dict(options or {}), split

    def read(self, name: str) -> DataFrame:
        if self.split:
            column, low, high, parts = self.split
            return self.spark.read.jdbc(self.url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=self.options)
        return self.spark.read.jdbc(self.url, name, properties=self.options)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.jdbc(self.url, name, "append", self.options)

    def replace(self, name: str, rows: DataFrame) -> None:
        rows.write.option("truncate", True).jdbc(self.url, name, "overwrite", self.options)


def open_store(spark: SparkSession, where: str, **options: str) -> Store:
    """By what ``where`` is: a JDBC address, or a folder."""
    return JdbcStore(spark, where, options) if where.startswith("jdbc:") else FileStore(spark, where)


def placeholders(sql: str, style: str) -> str:
    """:name and ? to a driver's own marks: "pyformat" has %(name)s and %s, "named" and "qmark" stay. Text in quotes and casts (::) stay."""
    if style != "pyformat":
        return sql
    return re.sub(r"('(?:[^']|'')*'|::)|:(\w+)|\?", lambda m: m[1] or (f"%({m[2]})s" if m[2] else "%s"), sql)


def deliver(events: DataFrame, on_event: Callable[[dict], None], order: tuple[str, ...] = ("session", "seq"), **options: str) -> StreamingQuery:
    """Call back for every event of a stream, each micro-batch in order. The callback runs on the driver, one row in hand at a time."""

    def run(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy(*order).toLocalIterator():
            on_event(row.asDict())

    return events.writeStream.options(**options).foreachBatch(run).start()


def model_path(name: str, default: str, env: Mapping[str, str] | None = None) -> str:
    """Where a model lies: the variable NAME_PATH, else MODEL_DIR/name if that is set, else the default."""
    env = os.environ if env is None else env
    key = re.sub(r"\W", "_", name).upper() + "_PATH"
    if env.get(key):
        return env[key]
    return f"{env['MODEL_DIR'].rstrip('/')}/{name}" if env.get("MODEL_DIR") else default


#: Functions from a column to a column, by name; see use_backend.
BACKENDS: dict[str, Callable[[Column], Column]] = {"none": lambda c: F.lit(None).cast("string"), "echo": lambda c: c}


def use_backend(name: str, make: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    """The backend of that name; with ``make`` it is named so first."""
    if make is not None:
        BACKENDS[name] = make
    if name not in BACKENDS:
        raise ValueError(f"no backend {name!r}; there are {sorted(BACKENDS)}")
    return BACKENDS[name]


def alias_table(spark: SparkSession) -> DataFrame:
    """kind, alias, name: other names of intents and subjects, as a table to join or to extend."""
    from textloom import lexicons as lex
    from textloom.functions.entries import SUBJECTS

    rows = [("intent", k, v) for k, v in {**{i: i for i in lex.INTENTS}, **lex.INTENT_ALIASES}.items()] + [("subject", k, v) for k, v in SUBJECTS.items()]
    return spark.createDataFrame(rows, "kind string, alias string, name string")


def canonical(rows: DataFrame, column: str, kind: str, aliases: DataFrame) -> DataFrame:
    """The column's values by the alias table; unknown ones are null."""
    names = aliases.where(F.col("kind") == kind).select(F.col("alias").alias("_a"), F.col("name").alias("_n"))
    return rows.join(names, F.lower(F.col(column)) == F.col("_a"), "left").withColumn(column, F.col("_n")).drop("_a", "_n")


def register_functions(spark: SparkSession) -> None:
    """SQL names: word_windows(text, size, step), a table function; macro_f1(gold, pred), an aggregate over a bounded group."""
    from pyspark.sql.functions import pandas_udf, udtf

    @udtf(returnType="place int, words string")
    class Windows:
        def eval(self, text: str, size: int, step: int) -> Iterator[tuple[int, str]]:
            words = (text or "").split()
            for k, at in enumerate(range(0, max(1, len(words) - size + step), step)):
                if words[at : at + size]:
                    yield k, " ".join(words[at : at + size])

    @pandas_udf("double")
    def macro_f1(gold: pd.Series, pred: pd.Series) -> float:
        scores = []
        for label in sorted(set(gold.dropna())):
            hit = ((gold == label) & (pred == label)).sum()
            total = (gold == label).sum() + (pred == label).sum()
            scores.append(2 * hit / total if total else 0.0)
        return float(sum(scores) / len(scores)) if scores else 0.0

    spark.udtf.register("word_windows", Windows)
    spark.udf.register("macro_f1", macro_f1)


def positioned_words(files: DataFrame, load: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """Word boxes of documents by a user's parser: path, page, text, size, fontname, x0, x1, top, bottom.

    files: path, content (as the binaryFile source gives them). A file that the parser refuses gives no words.
    """
    schema = "path string, page int, text string, size double, fontname string, x0 double, x1 double, top double, bottom double"
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = load()
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    words = parse(bytes(content))
                except Exception:  # noqa: BLE001  a parser's own errors are many
                    continue
                yield pd.DataFrame([{"path": path, **w} for w in words], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def ask_model(prompts: Column, load: Callable[[], Callable[[str], Iterator[str]]]) -> Column:
    """What a served model answers: ``load`` makes a client once for each task, which yields the server's lines ("data: {json}" with type and text)."""
    import json

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from textloom.streaming.answers import client_state

        client = load()
        for b in batches:
            out = []
            for prompt in b:
                events = [json.loads(line[6:]) for line in client(prompt) if line.startswith("data: ")] if prompt is not None else []
                state = client_state(events)
                out.append(None if state["failed"] else state["text"])
            yield pd.Series(out, dtype=object)

    return run(prompts)
