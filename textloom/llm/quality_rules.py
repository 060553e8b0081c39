"""Quality by weak supervision (operator 1), in DataFrame functions only.

Each rule votes good, bad or abstains on a text. Expectation-maximisation estimates every
rule's accuracy and the share of good texts from how the rules agree, without labels. A
text's posterior probability of being good decides, not all rules at once. The estimate works
on counts of vote patterns over all texts: at most 3 ** rules of them, whatever the input.

Defined results: null and empty texts have no words and fail the base. Repeated rows get
equal results. A posterior of just KEEP_AT keeps a row. A very long text costs time and memory of a few
times its size, in one row. Without rows there is no result.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

WHITE = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: ASCII characters that are no letters and no sentence punctuation.
MARKS = "#*$%&|<>@^~`_=+/\\\\{}[]0123456789"
WINDOW = 5
KEEP_AT = 0.5
ROUNDS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def repeat_words(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more."""

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda k, d: F.coalesce(F.get(s, k)["h"] == F.get(s, k + d)["h"], F.lit(False))
            twice = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(same(k, 1) | ((k > 0) & same(k, -1)), F.get(s, k)["i"]))
            return F.array_sort(F.filter(twice, lambda i: i.isNotNull()))

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(let(ordered, starts), zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    none = F.lit(0).cast("long")
    return let(words, lambda w: F.when(F.size(w) <= WINDOW, none).otherwise(let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    counts = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    plain = F.translate(text, WHITE, "")
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        let(words, counts).alias("w"),
        by_line.alias("l"),
        let(plain, lambda t: F.struct(F.length(t).cast("long").alias("word_chars"), count_of(t, SYMBOLS).alias("n_symbols"), count_of(t, "0123456789").alias("n_digits"), count_of(t, ".!?").alias("n_ends"), count_of(t, MARKS).alias("n_marks"))).alias("c"),
    )
    return rows.select("doc_id", "w.*", "l.*", "c.*")


def vote(good: Column, bad: Column) -> Column:
    """1 good, 0 bad, 2 abstains."""
    return F.when(bad, 0).when(good, 1).otherwise(2)


def rules() -> dict[str, Column]:
    n, c = F.col("n_words"), F.col("word_chars")
    return {
        "length": vote(n >= 40, n < 10),
        "symbols": vote(1000 * F.col("n_symbols") <= 5 * c, 100 * F.col("n_symbols") > 5 * c),
        "lines": vote(F.col("n_dup_lines") == 0, 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "repeats": vote(100 * F.col("n_repeat_words") <= 2 * n, 100 * F.col("n_repeat_words") > 15 * n),
        "letters": vote(100 * F.col("n_marks") <= 5 * c, 100 * F.col("n_marks") > 15 * c),
        "word_length": vote((c >= 3 * n) & (c <= 10 * n), (2 * c < 5 * n) | (c > 14 * n)),
        "sentences": vote(50 * F.col("n_ends") >= n, (100 * F.col("n_ends") < n) & (n >= 60)),
        "digits": vote(100 * F.col("n_digits") <= 10 * c, 100 * F.col("n_digits") > 30 * c),
    }


def estimate(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]], dict[str, float]]:
    """(share of good, each rule's accuracy on good and on bad texts, each pattern's posterior).

    patterns: counts of vote patterns. A rule has a chance of each vote on good texts and one on
    bad texts, so that votes that come whatever the text weigh nothing. At the start texts
    against which no rule votes count as good, those against which one votes as bad rather.
    """
    if not patterns:
        return 0.5, [], {}
    order = sorted(patterns)
    size = len(order[0])
    total = sum(patterns.values())
    good = {k: 0.95 if "0" not in k else 0.25 for k in order}
    prior, chance = 0.5, []
    for _ in range(rounds):
        mass = sum(good[k] * patterns[k] for k in order)
        prior = min(0.99, max(0.01, mass / total))
        chance = []
        for i in range(size):
            n = {v: [1.0, 1.0] for v in "01"}  # one text of each kind and vote beforehand
            for k in order:
                if k[i] != "2":
                    n[k[i]][0] += good[k] * patterns[k]
                    n[k[i]][1] += (1 - good[k]) * patterns[k]
            chance.append({v: tuple(n[v][j] / (n["0"][j] + n["1"][j]) for j in (0, 1)) for v in "01"})
        for k in order:
            a, b = prior, 1 - prior
            for i, v in enumerate(k):
                if v != "2":  # who abstains says nothing
                    a, b = a * chance[i][v][0], b * chance[i][v][1]
            good[k] = a / (a + b)
    return prior, [(c["1"][0], c["0"][1]) for c in chance], good


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """Features, base_failed, votes, posterior and kept of every row."""
    n = F.col("n_words")
    rows = features(df, id_col, text_col).withColumn("base_failed", (n < 10) | (100 * F.col("n_repeat_words") > 20 * n))
    rows = materialize(rows.withColumn("votes", F.concat(*[v.cast("string") for v in rules().values()])))
    patterns = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}
    _, _, posterior = estimate(patterns)
    listed = json.dumps([{"votes": k, "posterior": v} for k, v in posterior.items()])
    table = df.sparkSession.sql("SELECT inline(from_json(:listed, 'array<struct<votes:string,posterior:double>>'))", {"listed": listed})
    out = rows.join(F.broadcast(table), "votes")  # at most 3 ** rules rows
    kept = ~F.col("base_failed") & (F.col("posterior") >= keep_at)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "votes", "posterior")
