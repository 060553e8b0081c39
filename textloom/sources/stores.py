"""Record stores: scans of JSON and text, atomic and partial replacement, numbering."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that each hold one JSON array (or one object) of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_json_tolerant(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """As read_json_array (or, with lines, one record a line); missing paths and corrupt files or lines give no rows."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    path_ = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not path_.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path_):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("mode", "DROPMALFORMED").json(path, multiLine=not lines)


def read_json_cut(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Complete top-level objects of JSON arrays that may end in the middle."""

    def objects(batches):
        import re

        import pandas as pd

        # Strings are passed over whole; what is left are braces.
        mark = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z)|[{}]', re.DOTALL)
        for b in batches:
            out = []
            for text in b["value"]:
                depth = start = 0
                for m in mark.finditer(text):
                    if m[0] == "{":
                        start, depth = (m.start(), 1) if not depth else (start, depth + 1)
                    elif m[0] == "}" and depth:
                        depth -= 1
                        if not depth:
                            out.append(text[start : m.end()])
            yield pd.DataFrame({"value": out})

    whole = spark.read.text(path, wholetext=True)
    return whole.mapInPandas(objects, "value string").select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")


def read_texts(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, text (and part: the pattern's first group in the path) of whole files, by path. Bytes that are no UTF-8 are left out."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.try_validate_utf8("content").alias("text"), "content")
    rows = rows.withColumn("text", F.coalesce("text", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")))).drop("content")
    return (rows.withColumn("part", F.regexp_extract("path", pattern, 1)) if pattern else rows).orderBy("path")


def parse_sse(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Events of "data: {json}" lines."""
    return lines.where(F.startswith(F.col(column), F.lit("data: "))).select(F.from_json(F.substring(F.col(column), F.lit(7), F.length(column)), schema).alias("e")).select("e.*")


#: A key's rows that one task may sort to number them, and ranges that a key is cut into at most.
HOT_ROWS = 1_000_000
MOST_RANGES = 50_000


def number_within(rows: DataFrame, key: str, order: str, name: str, start: int | Column = 0) -> DataFrame:
    """Numbers from start + 1 in each key's order.

    Keys with more than HOT_ROWS rows and a thousandth of all (so at most a thousand keys) are cut into ranges of the
    order, at values of a sample that the driver holds (ten a range); ranges are numbered side by side, each from the
    count of those before it.
    """
    counts = rows.groupBy(key).count()
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = {r[key]: r["count"] for r in counts.where(F.col("count") > max(HOT_ROWS, total // 1000)).collect()}
    if not hot:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long") + start)
    is_hot = F.coalesce(F.col(key).isin([k for k in hot if k is not None]), F.lit(None in hot))
    ranges = {k: min(MOST_RANGES, -(-n // HOT_ROWS) * 2) for k, n in hot.items()}
    seen: dict = {k: [] for k in hot}
    for r in rows.where(is_hot).select(key, order).sample(min(1.0, 10 * sum(ranges.values()) / sum(hot.values())), seed=7).toLocalIterator():
        if r[order] is not None:
            seen[r[key]].append(r[order])
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, order)}
    cuts = []
    for k, values in seen.items():
        values.sort()
        parts = ranges[k]
        cuts.append((k, sorted({values[len(values) * i // parts] for i in range(1, parts)} if values else set())))
    bounds = rows.sparkSession.createDataFrame(cuts, f"_k {kinds[key]}, _cuts array<{kinds[order]}>")
    place = F.size(F.filter(F.coalesce("_cuts", F.array().cast(f"array<{kinds[order]}>")), lambda c: c < F.col(order)))
    placed = rows.join(F.broadcast(bounds), F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("_part", place).drop("_k", "_cuts")
    sizes = placed.where(is_hot).groupBy(key, "_part").count()
    ahead = F.sum("count").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # ranges, not rows
    sizes = sizes.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    numbered = placed.join(F.broadcast(sizes), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    number = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)).cast("long") + F.coalesce("_ahead", F.lit(0)) + start
    return numbered.withColumn(name, number).drop("_k", "_p", "_part", "_ahead")


def replace_part(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows with every key that the new rows name replaced by them."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def append_part(rows: DataFrame, new: DataFrame, key: str, order: str, ordinal: str) -> DataFrame:
    """New rows numbered on from their key's last ordinal."""
    last = rows.groupBy(key).agg(F.max(ordinal).alias("_last"))
    numbered = number_within(new.join(last, key, "left"), key, order, ordinal)
    return rows.unionByName(numbered.withColumn(ordinal, F.col(ordinal) + F.coalesce("_last", F.lit(0))).drop("_last"), allowMissingColumns=True)


def write_swapped(df: DataFrame, path: str) -> None:
    """Write a whole new version beside the others, then name it as the current one.

    path/_current holds the name of the version that ``read_swapped`` reads. It is replaced by one rename
    that overwrites, so readers find the old version or the new one, never none; the version before stays for readers
    that began with it and goes with the next write.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = folder.getFileSystem(conf)
    before = current_version(spark, path)
    side, name = hadoop.Path(f"{path}/_{version}"), hadoop.Path(f"{path}/_current")
    out = fs.create(side, True)
    out.write(bytearray(version, "ascii"))
    out.close()
    context = hadoop.FileContext.getFileContext(folder.toUri(), conf) if folder.toUri().getScheme() else hadoop.FileContext.getFileContext(conf)
    overwrite = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context.rename(side, name, overwrite)
    for status in fs.listStatus(folder):
        if status.isDirectory() and status.getPath().getName() not in (version, before):
            fs.delete(status.getPath(), True)


def current_version(spark: SparkSession, path: str) -> str | None:
    name = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_current")
    fs = name.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(name):
        return None
    held = fs.open(name)
    try:
        return bytes(held.readAllBytes()).decode("ascii")
    finally:
        held.close()


def read_swapped(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table of ``write_swapped``."""
    return spark.read.parquet(f"{path.rstrip('/')}/{current_version(spark, path)}")


def write_collection(df: DataFrame, path: str, keys: list[str], force: bool = False) -> bool:
    """Vectors partitioned by metadata; an existing collection stays unless forced. True if written."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) and not force:
        return False
    plain_metadata(df).write.partitionBy(*keys).mode("overwrite").parquet(path)
    return True


def plain_metadata(df: DataFrame) -> DataFrame:
    """Metadata as stores of vectors take it: text, numbers and truth values stay, missing ones become "" or 0 or false; arrays of numbers (vectors) stay; all else becomes JSON text."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if kind.startswith(("array<float", "array<double")):
            out.append(c)
        elif kind == "string":
            out.append(F.coalesce(c, F.lit("")).alias(f.name))
        elif kind == "boolean":
            out.append(F.coalesce(c, F.lit(False)).alias(f.name))
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            out.append(F.coalesce(c, F.lit(0).cast(kind)).alias(f.name))
        elif kind.startswith(("struct", "array", "map")):
            out.append(F.coalesce(F.to_json(c), F.lit("")).alias(f.name))
        else:
            out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def first_match(files: DataFrame, names: list[str], path: str = "path") -> DataFrame:
    """Of files whose name is a candidate, the one of the earliest candidate (ties by path)."""
    base = F.regexp_extract(path, "([^/]+)$", 1)
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), base)
    return files.where(rank > 0).withColumn("_r", rank).orderBy("_r", path).limit(1).drop("_r")


def read_or_seed(spark: SparkSession, path: str, seed: DataFrame) -> DataFrame:
    """The file's records, or the seed rows where it is missing or holds none."""
    rows = read_json_tolerant(spark, path, seed.schema)
    return seed if rows.isEmpty() else rows


def write_splits(df: DataFrame, path: str, split: str = "split", labels: str | None = None) -> None:
    """One folder for each split; with a label column also path/label_map: label, id (by name, from 0)."""
    df.write.partitionBy(split).mode("overwrite").parquet(path)
    if labels:
        label_map(df, labels).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/_label_map")


#: Labels that a map may have.
MOST_LABELS = 10_000


def label_map(df: DataFrame, column: str) -> DataFrame:
    """label, id: the distinct labels numbered by name."""
    names = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().limit(MOST_LABELS + 1).collect()]
    if len(names) > MOST_LABELS:
        raise ValueError(f"{column} has more than {MOST_LABELS} labels")
    return df.sparkSession.createDataFrame([(n, k) for k, n in enumerate(sorted(names))], "label string, id int")


def write_json_pretty(df: DataFrame, path: str, order: list[str]) -> None:
    """One JSON array in one file, two spaces an indent, in the given order, UTF-8; values that JSON lacks as text.

    The array is streamed through the driver row by row, so that it need not fit there; parents are made.
    """
    import json

    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    first = True
    for r in df.orderBy(*order).toLocalIterator():
        body = json.dumps(r.asDict(recursive=True), ensure_ascii=False, indent=2, default=str)
        out.write(bytearray(("[\n" if first else ",\n") + "\n".join("  " + x for x in body.split("\n")), "utf-8"))
        first = False
    out.write(bytearray("[]\n" if first else "\n]\n", "utf-8"))
    out.close()


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    """One text file for each key, in folders key=value, as it is."""
    df.select(key, text).write.partitionBy(key).mode("overwrite").option("lineSep", "\n").text(path)
