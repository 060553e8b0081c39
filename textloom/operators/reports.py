"""Evaluation of labels, spans and texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    return rows.groupBy(gold, pred).agg(F.count("*").alias("n"))


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def label_scores(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 of every label of either kind."""
    cells = confusion(rows, gold, pred)
    n = F.col("n")
    sides = F.array(
        F.struct(F.col(gold).alias("label"), F.when(F.col(gold) == F.col(pred), n).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col(gold) != F.col(pred), n).otherwise(0).alias("fn")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col(gold) != F.col(pred), n).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    sums = cells.select(F.explode(sides).alias("s")).groupBy("s.label").agg(F.sum("s.tp").alias("tp"), F.sum("s.fp").alias("fp"), F.sum("s.fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("label", "tp", "fp", "fn", (tp + fn).alias("support"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def summary(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """accuracy, macro F1 over all labels and over those in gold, and mean recall of those in gold."""
    s = label_scores(rows, gold, pred)
    there = F.col("support") > 0
    return s.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1_all"), F.avg(F.when(there, F.col("f1"))).alias("macro_f1_gold"), F.avg(F.when(there, F.col("recall"))).alias("mean_recall"),
    )


def span_scores(gold: DataFrame, pred: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Precision, recall and F1 of exact spans by label, and over all (label null)."""
    g, p = gold.select(*keys, label).distinct().withColumn("_g", F.lit(1)), pred.select(*keys, label).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, [*keys, label], "full")
    t = both.groupBy(label, *[]).agg(F.count("_g").alias("gold"), F.count("_p").alias("pred"), F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"))
    t = t.unionByName(t.agg(F.lit(None).cast("string").alias(label), F.sum("gold").alias("gold"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp")))
    return t.withColumns({"precision": ratio(F.col("tp"), F.col("pred")), "recall": ratio(F.col("tp"), F.col("gold")), "f1": ratio(2 * F.col("tp"), F.col("gold") + F.col("pred"))})


def grouped(rows: DataFrame, by: list[str], *measures: Column) -> DataFrame:
    """The measures over all rows and by each column alone."""
    return rows.groupingSets([[], *[[F.col(c)] for c in by]], *[F.col(c) for c in by]).agg(*measures)


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, row by row with bit arithmetic."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(pred: str | None, gold: str | None) -> float:
    import re

    a, b = (re.findall(r"[a-z0-9]+", (t or "").lower()) for t in (pred, gold))
    n = common_length(a, b)
    return 2 * n / (len(a) + len(b)) if n else 0.0


def chrf(pred: str | None, gold: str | None, chars: int = 6, words: int = 2, beta: float = 2.0) -> float:
    """Character and word n-gram F score, 0 to 100."""
    from collections import Counter

    def grams(x, n):
        return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))

    scores = []
    for unit, most in ((lambda t: "".join((t or "").split()), chars), (lambda t: (t or "").split(), words)):
        a, b = unit(pred), unit(gold)
        for n in range(1, most + 1):
            p, g = grams(a, n), grams(b, n)
            if not p and not g:
                continue
            hit = sum((p & g).values())
            precision, recall = hit / max(1, sum(p.values())), hit / max(1, sum(g.values()))
            scores.append((1 + beta**2) * precision * recall / (beta**2 * precision + recall) if hit else 0.0)
    return 100 * sum(scores) / len(scores) if scores else 0.0


def text_scores(rows: DataFrame, pred: str, gold: str) -> DataFrame:
    """Adds rouge_l and chrf."""
    @F.pandas_udf("struct<rouge_l:double,chrf:double>")
    def score(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"rouge_l": [rouge_l(a, b) for a, b in zip(p, g, strict=True)], "chrf": [chrf(a, b) for a, b in zip(p, g, strict=True)]})

    return rows.withColumn("_s", score(pred, gold)).select(*rows.columns, "_s.rouge_l", "_s.chrf")


def perplexity(loss: Column) -> Column:
    return F.exp(F.avg(loss))


def token_accuracy(pred: Column, gold: Column) -> Column:
    """Share of the gold tokens that the prediction has at the same place; null without gold tokens."""
    same = F.size(F.filter(F.zip_with(gold, F.slice(pred, F.lit(1), F.size(gold)), lambda a, b: a.eqNullSafe(b) & a.isNotNull()), lambda x: x))
    return F.try_divide(same, F.size(gold))


def matched_similarity(pred: np.ndarray, gold: np.ndarray) -> tuple[float, float, float]:
    """Precision, recall and F of greedily matched token vectors (of length 1): each token counts by its best partner."""
    if not len(pred) or not len(gold):
        return 0.0, 0.0, 0.0
    near = pred @ gold.T
    p, r = float(near.max(1).mean()), float(near.max(0).mean())
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


def vector_scores(rows: DataFrame, pred: str, gold: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """Adds precision, recall, f1 of matched token vectors by an embedding function; each distinct word of a batch is embedded once."""
    @F.pandas_udf("struct<precision:double,recall:double,f1:double>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        embed = load()
        for p, g in batches:
            pairs = [((a or "").split(), (b or "").split()) for a, b in zip(p, g, strict=True)]
            words = sorted({w for a, b in pairs for w in (*a, *b)})
            place = {w: k for k, w in enumerate(words)}
            vectors = np.array(embed(words)) if words else np.zeros((0, 1))
            yield pd.DataFrame([matched_similarity(vectors[[place[w] for w in a]], vectors[[place[w] for w in b]]) for a, b in pairs], columns=["precision", "recall", "f1"])

    return rows.withColumn("_s", score(pred, gold)).select(*rows.columns, "_s.*")
