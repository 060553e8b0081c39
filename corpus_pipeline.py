"""A training corpus from documents: toxic texts out, unknown languages out, one of each group
of near-duplicates stays, and what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. The first three
return the columns of documents; the last returns pieces with their places. Documents in fewer
Parquet row groups than there are tasks are dealt out to all tasks by the first two stages.

Defined results: null and empty texts, and texts without a letter, have no language and go in
stage 2, as do longer texts that are far from all learned languages; short ones stay. An empty table
passes through. A row is judged by its own text, whatever its id: rows without an id, or with
an id that other rows have too, neither go nor stay together. Of a group of near-duplicates
the row with the smallest id stays, one without an id only where no row of the group has one.
Extra columns stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import lang_id, packing, simhash_vp
from textloom.llm import toxicity as tox
from textloom.llm.common import discard, held_out, materialize, table
from textloom.llm.queries import toxicity_machine
from textloom.registry import spread


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tox.keep_clean(spread(docs), toxicity_machine(spark, sf_dir))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").where(~held_out() & F.col("lang").isNotNull())
    prototypes = lang_id.learn(known)
    return lang_id.keep_known(spread(docs), prototypes, lang_id.floor(known, prototypes))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_vp.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("best_fit_packing", best_fit_packing)]
#: No stage before the packing can be said in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if before:
            discard(before)
        before = docs
    return docs
