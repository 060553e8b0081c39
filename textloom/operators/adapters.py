"""Where learned models plug in, with stand-ins that need none.

A model is a function over lists: it is made once per Python worker by ``load`` and called
with batches. Stand-ins are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import docs as D
from textloom.functions import text as T
from textloom.operators import records as R
from textloom.operators import vectors as V


def hashed_vectors(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Hashed words and letter trigrams, of length 1."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            low = (t or "").lower()
            for g in [*low.split(), *(low[k : k + 3] for k in range(len(low) - 2))]:
                h = zlib.crc32(g.encode())
                out[i, h % dimensions] += 1 if h >> 16 & 1 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embed(texts: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]] = hashed_vectors) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series(model(b.tolist()))

    return run(texts)


def enrich_distinct(rows: DataFrame, column: str, name: str, enrich: Callable[[Column], Column]) -> DataFrame:
    """Call an expensive function once for each distinct value, and join back."""
    distinct = rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, enrich(F.col(column)))
    return rows.join(distinct, column, "left")


def extractive_answer(context: Column, question: Column) -> Column:
    """The sentence that shares most words with the question."""
    words = F.array_distinct(F.transform(T.split_words(question), lambda w: F.lower(T.bare(w))))
    scored = F.transform(D.split_sentences(context), lambda s, i: F.struct(F.size(F.filter(words, lambda w: F.contains(F.lower(s), w))).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.coalesce(F.array_max(scored)["s"], context)


def standalone(question: Column, previous: Column, transcript: Column | None = None, rewrite: Callable[[Column], Column] | None = None) -> Column:
    """The question as it stands alone: without an earlier question itself; else a model's rewrite of the transcript if it looks sane, else the two joined."""
    joined = F.trim(F.concat_ws(" ", previous, question))
    if rewrite is None or transcript is None:
        return joined
    return F.when(previous.isNull(), question).otherwise(F.coalesce(T.standalone_rewrite(rewrite(transcript), question), joined))


NOT_FOUND = "This is not covered in the given chapters."


def answer(questions: DataFrame, chunks: DataFrame, k: int = 3, least: float = 0.25, generate: Callable[[Column, Column], Column] = extractive_answer) -> DataFrame:
    """q_id, question, intent, best, prompt, answer. chunks: id, text, embedding; questions: q_id, question, embedding.

    Retrieve, gate on the best hit, pack the context, build the prompt, generate.
    """
    hits = V.search_batch(chunks.withColumnRenamed("id", "vec_id"), questions.select(F.col("q_id").alias("vec_id"), "embedding"), k)
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    texts = chunks.select(F.col("id").alias("_c"), "text", F.size(T.split_words(F.col("text"))).alias("words"))
    packed = V.pack_context(hits.withColumn("best", best).join(texts, F.col("id") == F.col("_c")), "query_id", "rank", "words")
    context = packed.groupBy("query_id").agg(F.first("best").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
    rows = questions.join(context, questions["q_id"] == context["query_id"], "left")
    intent = T.classify_intent(F.col("question"))
    found = F.col("best") >= least
    return rows.select("q_id", "question", intent.alias("intent"), "best", F.when(found, R.prompt(F.col("context"), F.col("question"), intent)).alias("prompt"), F.when(found, generate(F.col("context"), F.col("question"))).otherwise(NOT_FOUND).alias("answer"))


def train_intents(rows: DataFrame, text: str, label: str, features: int = 4096):
    """Logistic regression over hashed words, weighted so that every intent counts the same."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StringIndexer

    rows = rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()).withColumn("_words", T.split_words(F.lower(text)))
    counts = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg((F.sum("_c") / F.count("*")).alias("_t"))
    weighted = rows.join(counts.crossJoin(F.broadcast(total)).select(label, (F.col("_t") / F.col("_c")).alias("_w")), label)  # a row for each intent
    stages = [StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_w", maxIter=20, regParam=0.01)]
    return Pipeline(stages=stages).fit(weighted)


def predict_intents(model, rows: DataFrame, text: str, k: int = 3) -> DataFrame:
    """Adds top: the k likeliest intents with their confidence, 4 digits."""
    from pyspark.ml.functions import vector_to_array

    names = model.stages[0].labels
    scored = rows.withColumn("_words", T.split_words(F.lower(text)))
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    pairs = F.transform(vector_to_array("probability"), lambda p, i: F.struct((-p).alias("n"), F.get(F.array(*[F.lit(x) for x in names]), i).alias("intent")))
    top = F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x["intent"].alias("intent"), F.round(-x["n"], 4).alias("confidence")))
    return scored.withColumn("top", top).select(*rows.columns, "top")
