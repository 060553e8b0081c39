"""Expensive functions with a memory that outlives the run: each distinct cleaned source is asked once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import squeeze


def clean_key(source: Column) -> Column:
    """What a source is known by: lower case, one space between words."""
    return F.lower(squeeze(source))


def enrich(rows: DataFrame, column: str, known: DataFrame, name: str, make: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(what had to be made: key, name; the rows with name). known: key, name. Null sources stay without a value."""
    keyed = rows.withColumn("_key", clean_key(F.col(column)))
    missing = keyed.where(F.col("_key").isNotNull()).select(F.col("_key").alias("key")).distinct().join(known, "key", "left_anti")
    made = missing.withColumn(name, make(F.col("key")))
    every = known.select("key", name).unionByName(made).withColumnRenamed("key", "_key")
    return made, keyed.join(every, "_key", "left").drop("_key")


def read_memory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The memory's lines; of a key written twice the last one written counts. Missing files give an empty memory."""
    from textloom.sources.stores import read_json_tolerant

    rows = read_json_tolerant(spark, path, f"key string, at timestamp, {schema}", lines=True)
    names = [c for c in rows.columns if c not in ("key", "at")]
    return rows.where("key is not null").groupBy("key").agg(F.max_by(F.struct(*names), F.coalesce("at", F.lit(0).cast("timestamp"))).alias("r")).select("key", "r.*")


def append_memory(made: DataFrame, path: str) -> None:
    """Add lines to the memory; a run that stops has kept what it appended."""
    made.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def enrich_kept(rows: DataFrame, column: str, path: str, name: str, kind: str, make: Callable[[Column], Column], parts: int = 8) -> DataFrame:
    """As ``enrich`` with the memory at ``path``; new values are appended part by part, so that a stopped run goes on where it was."""
    spark = rows.sparkSession
    for k in range(parts):
        some = rows.where(F.pmod(F.xxhash64(clean_key(F.col(column))), F.lit(parts)) == k)
        made, _ = enrich(some, column, read_memory(spark, path, f"{name} {kind}"), name, make)
        append_memory(made, path)
    return enrich(rows, column, read_memory(spark, path, f"{name} {kind}"), name, lambda key: F.lit(None).cast(kind))[1]
