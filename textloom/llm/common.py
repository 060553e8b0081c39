"""Shared plumbing of the corpus operators: whole-text scans, Arrow mapping, checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.registry import load
from textloom.shipping import ship_package

#: Bytes of text handled at once by a Python worker.
SLICE_BYTES = 3_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a local master may do without: it gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = Path(tempfile.mkdtemp(prefix="textloom-")).as_uri()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder and read back.

    Lost executors lose nothing: the rows are in the shared store. The table goes when the
    driver ends, or before by ``discard``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/textloom/{uuid.uuid4().hex}"
    fs, where = hadoop_path(spark, path)
    df.write.parquet(path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for t in tables:
        fs, where = hadoop_path(t.sparkSession, t._table)
        fs.delete(where, True)


def slices(ids: list, texts: list, most: int = SLICE_BYTES) -> Iterator[tuple[list, list]]:
    """Cut a batch into runs of rows of at most ``most`` characters (one row at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield ids[start:], texts[start:]


def batch_slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[tuple[list, list]]:
    """The first two columns of an Arrow batch as Python lists, of at most ``most`` bytes (one row at least) at a time."""
    ids, texts = batch.column(0), batch.column(1)
    each = pc.multiply(pc.list_value_length(texts), 8) if pa.types.is_list(texts.type) else pc.binary_length(texts)
    total = np.cumsum(pc.fill_null(each, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(total):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
        yield ids.slice(start, end - start).to_pylist(), texts.slice(start, end - start).to_pylist()
        start = end


def arrow_schema(spark_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str, fn: Callable[[list, list], dict[str, list]], text: str = "string") -> DataFrame:
    """Run ``fn(ids, texts) -> columns`` over slices of whole texts by Arrow batches.

    Reads the two columns only, so extra columns of any name play no part. A row gives
    whatever rows ``fn`` returns for it.
    """
    ship_package(df.sparkSession)
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    arrow = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in batch_slices(b):
                cols = fn(ids, texts)
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast(text).alias("_text")).mapInArrow(run, out)


def keep_where(df: DataFrame, text_col: str, load: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows whose text a function keeps, with all their columns, in one pass: nothing is joined or written.

    Columns may be of any type that Arrow carries.
    ``load`` makes the function once for each task; it gets slices of whole texts (null ones too).
    """
    ship_package(df.sparkSession)
    plain = df.schema[text_col].dataType.simpleString() == "string"
    at = df.columns.index(text_col) if plain else len(df.columns)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = load()
        for b in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), b.column(at)], ["none", "text"])
            mask = [k for _, part in batch_slices(texts) for k in keep(part)]
            rows = b.filter(pa.array(mask, pa.bool_()))
            yield pa.RecordBatch.from_arrays(rows.columns[: len(names)], names)

    spare = "_text" + "_" * max(map(len, names))
    whole = df if plain else df.select("*", F.col(text_col).cast("string").alias(spare))
    return whole.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id"):
    """Fold 0 of five: crc32 of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
