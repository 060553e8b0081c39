"""Where queries register under their name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.shipping import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


#: Tables whose rows are texts: work on them outweighs moving them.
TEXTS = ("documents", "pages")
#: Bytes from which it pays to deal them out.
SPREAD_BYTES = 4_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def spread(rows: DataFrame) -> DataFrame:
    """Rows of Parquet files with fewer row groups than there are tasks, dealt out to all tasks.

    A row group is read by one task, so a table in one row group would keep one core busy. Tables
    of many files, as any large one is, are read as they are; only the footers of few files are looked at.
    Rows that are not of Parquet files stay as they are. Rows are dealt by their place in the file, which needs no sort
    of whole texts beside the row group in memory, as a round robin does, and is the same if a task is repeated.
    """
    spark = rows.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    files = rows.inputFiles()
    if len(files) >= tasks or not all(f.endswith(".parquet") for f in files):
        return rows
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    groups = size = 0
    for f in files:
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        groups += reader.getRowGroups().size()
        size += file.getLength()
        reader.close()
    if groups >= tasks or size < SPREAD_BYTES:
        return rows
    try:
        return rows.repartition(tasks, F.col("_metadata.row_index"))
    except AnalysisException:  # no rows as they stand in files
        return rows.repartition(tasks)
