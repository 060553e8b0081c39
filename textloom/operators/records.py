"""Record sets: building, joining, deduplicating, splitting, validating, augmenting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import lexicons as lex
from textloom.functions import text as T

INSTRUCTIONS = {"hinglish": "Answer the question in Hinglish using only the given context.", "english": "Answer the question in English using only the given context."}


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Parts of different columns; what a part lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_wins(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row of each key: the first in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicates(batch: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Keys that the batch holds twice or that exist already."""
    twice = batch.groupBy(key).count().where("count > 1").select(key)
    return twice.union(batch.join(existing, key, "left_semi").select(key)).distinct()


def is_held_out(key: Column, share: float = 0.05) -> Column:
    return T.md5_bucket(key) < int(share * 10_000)


def keeps_intent(key: Column, dropout: float = 0.12) -> Column:
    return T.md5_bucket(key) >= int(dropout * 10_000)


def split_by_hash(rows: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """split: train or dev, the same share for every row order. Ranks are not needed: the hash decides."""
    return rows.withColumn("split", F.when(T.md5_bucket(F.col(key)) < int(share * 10_000), "train").otherwise("dev"))


def class_weights(rows: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """total / (labels * count), 4 digits; 1 as the count of what is missing."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(x,) for x in labels], f"{label} string")
    counts = rows.groupBy(label).count()
    total = rows.agg(F.count("*").alias("_t"))
    joined = F.broadcast(every).join(counts, label, "left").crossJoin(F.broadcast(total))  # one row
    return joined.select(label, F.round(F.col("_t") / (len(labels) * F.coalesce("count", F.lit(1))), 4).alias("weight"))


def prompt(context: Column, question: Column, intent: Column, language: str = "hinglish") -> Column:
    line = F.when(intent.isNull() | (intent == ""), "").otherwise(F.concat(F.lit("Intent Type: "), intent, F.lit("\n")))
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion:\n"), question, F.lit("\n\n"), line, F.lit(INSTRUCTIONS[language]))


def chat_text(user: Column, model: Column) -> Column:
    return F.concat(F.lit("<start_of_turn>user\n"), user, F.lit("<end_of_turn>\n<start_of_turn>model\n"), model, F.lit("<end_of_turn>\n"))


def issues(*checks: tuple[Column, str | Column]) -> Column:
    """Texts of the checks that hold."""
    return F.array_compact(F.array(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in checks]))


def compact_issues(q: Column, a: Column, context: Column, q_hi: Column, a_hi: Column, topic: Column, intent: Column) -> Column:
    """Missing fields; only if none is missing, the other rules."""
    fields = {"topic": topic, "intent": intent, "q": q, "a": a, "ctx": context, "q_hi": q_hi, "a_hi": a_hi}
    missing = issues(*[(F.coalesce(F.trim(c), F.lit("")) == "", f"missing/empty '{k}'") for k, c in fields.items()])
    words = F.size(T.split_words(context))
    rest = issues(
        (~T.among(intent, lex.INTENTS), F.concat(F.lit("unknown intent '"), intent, F.lit("'"))),
        (q_hi.rlike(T.DEVANAGARI), "'q_hi' contains Devanagari"),
        (a_hi.rlike(T.DEVANAGARI), "'a_hi' contains Devanagari"),
        (F.trim(a_hi) == F.trim(a), "a_hi is identical to the English answer"),
        (words < 25, F.concat(F.lit("ctx too short ("), words.cast("string"), F.lit(" words)"))),
    )
    return F.when(F.size(missing) > 0, missing).otherwise(rest)


def entry_issues(english: Column, hinglish: Column, labels: Column, is_query: Column, intent: Column) -> Column:
    """Rules over an annotated sentence and its map of labels."""

    def checks(x: Column) -> Column:
        tokens, keys, values = x["tokens"], x["keys"], x["values"]
        n = lambda t: F.size(F.filter(values, lambda v: v == t))
        unequal = (F.size(F.array_except(tokens, keys)) > 0) | (F.size(F.array_except(keys, tokens)) > 0)
        return T.let(
            F.struct(n("HI").alias("hi"), n("EN").alias("en")),
            lambda c: issues(
                ((F.size(tokens) > 0) & (F.size(keys) > 0) & unequal, "labels do not match tokens"),
                (F.exists(values, lambda v: ~v.isin(lex.LID_TAGS)), "invalid labels"),
                (is_query & (F.coalesce(intent, F.lit("")) == ""), "student query without intent"),
                (F.lower(T.squeeze(english)) == F.lower(T.squeeze(hinglish)), "identical texts"),
                (c["hi"] + c["en"] == 0, "no code-mixing index"),
                ((c["hi"] + c["en"] > 0) & ~T.code_mixing(c["hi"], c["en"]).between(10, 70), "code-mixing index out of range"),
            ),
        )

    parts = T.let(labels, lambda m: F.struct(T.tokens_stripped(hinglish).alias("tokens"), F.map_keys(m).alias("keys"), F.map_values(m).alias("values")))
    return T.let(parts, checks)


def substitute(text: Column, table: dict[str, str]) -> Column:
    """Words replaced by the table, their marks kept; null if none is."""

    def word(w: Column) -> Column:
        return F.when(T.among(F.lower(T.core(w)), table), T.let(T.core_parts(w), lambda p: F.concat(p["prefix"], T.lookup(table, F.lower(p["core"])), p["suffix"]))).otherwise(w)

    return T.let(F.array_join(T.split_words(text), " "), lambda old: T.let(F.array_join(F.transform(T.split_words(text), word), " "), lambda new: F.when(new != old, new)))


def has_any(text: Column, table: dict[str, str]) -> Column:
    return F.exists(T.split_words(text), lambda w: T.among(F.lower(T.core(w)), table))


def density_shift(text: Column) -> Column:
    return substitute(text, lex.HINDI_EQUIVALENTS)


def connector_swap(text: Column) -> Column:
    return substitute(text, lex.CONNECTORS)


def formality_shift(text: Column) -> Column:
    base = F.trim(text)
    return F.when(~F.startswith(F.lower(base), F.lit("sir")), F.concat(F.lit("Sir, "), base, F.lit(" batao.")))


def question_form(text: Column) -> Column:
    base = F.rtrim(F.trim(text), F.lit(".?"))
    return F.when(~F.startswith(F.lower(base), F.lit("sir")), F.concat(F.lit("Sir, "), base, F.lit(" samjhao?")))


def negation(text: Column) -> Column:
    """"nahi" before the first verb; null if there is none, or a "nahi" already."""

    def insert(words: Column) -> Column:
        cores = F.transform(words, lambda w: F.lower(T.core(w)))

        def at(c: Column) -> Column:
            place = F.get(F.filter(F.transform(c, lambda x, i: F.when(T.among(x, lex.VERBS), i)), lambda i: i.isNotNull()), F.lit(0))
            new = F.concat(F.slice(words, F.lit(1), place), F.array(F.lit("nahi")), F.slice(words, place + 1, F.size(words)))
            return F.when(place.isNotNull() & ~F.array_contains(c, "nahi"), F.array_join(new, " "))

        return T.let(cores, at)

    return T.let(T.split_words(text), insert)


def no_sir(text: Column) -> Column:
    return ~F.startswith(F.lower(F.trim(text)), F.lit("sir"))


def can_negate(text: Column) -> Column:
    cores = F.transform(T.split_words(text), lambda w: F.lower(T.core(w)))
    return T.let(cores, lambda c: F.exists(c, lambda x: T.among(x, lex.VERBS)) & ~F.array_contains(c, "nahi"))


#: Each variant, and whether it changes a text, which is cheaper to tell than to make it.
VARIANTS = {
    "hindi_density": (density_shift, lambda t: has_any(t, lex.HINDI_EQUIVALENTS)),
    "connector_swap": (connector_swap, lambda t: has_any(t, lex.CONNECTORS)),
    "formality_shift": (formality_shift, no_sir),
    "question_form": (question_form, no_sir),
    "negation": (negation, can_negate),
}


def augment(rows: DataFrame, id_col: str, text_col: str, most: int = 3) -> DataFrame:
    """id (with a letter), augmented_from, augmentation_type, text: the first variants that change a text. Only these are made, and only if asked for."""
    kinds = F.array_compact(F.array(*[F.when(applies(F.col(text_col)), F.lit(k)) for k, (_, applies) in VARIANTS.items()]))
    some = rows.select(id_col, text_col, F.posexplode(F.slice(kinds, 1, most)).alias("i", "kind"))
    text = F.lit(None).cast("string")
    for k, (make, _) in VARIANTS.items():
        text = F.when(F.col("kind") == k, make(F.col(text_col))).otherwise(text)
    return some.select(F.concat(F.col(id_col).cast("string"), F.lit("_"), F.substring(F.lit("abcdefghij"), F.col("i") + 1, F.lit(1))).alias("id"), F.col(id_col).alias("augmented_from"), F.col("kind").alias("augmentation_type"), text.alias("text"))


def split_ranked(rows: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """split: train for the first max(1, int(share * rows)) rows by the hash of their key, dev for the rest.

    The cut is found by counting rows of hash buckets, so no task sorts all rows: only the bucket that holds the cut is ranked.
    """
    hashed = rows.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 4))
    counts = hashed.groupBy("_b").count().orderBy("_b").collect()  # 65,536 rows at most
    cut, before, at = max(1, int(share * sum(r["count"] for r in counts))), 0, ""
    for r in counts:
        if before + r["count"] >= cut:
            at = r["_b"]
            break
        before += r["count"]
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", F.col(key)))
    ranked = hashed.where(F.col("_b") == at).withColumn("split", F.when(rank <= cut - before, "train").otherwise("dev"))
    sure = hashed.where(F.col("_b") != at).withColumn("split", F.when(F.col("_b") < at, "train").otherwise("dev"))
    return sure.unionByName(ranked).drop("_h", "_b")
