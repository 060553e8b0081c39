"""Questions and entries from passages: cue patterns joined to templates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import docs as D
from textloom.functions import text as T
from textloom.operators import question_bank as Q
from textloom.operators.records import first_wins


def fill(template: str, values: dict[str, Column]) -> Column:
    """The template with its {names} replaced."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x])


def passage_questions(passages: DataFrame, key: str, text: str, chapter: Column, subject: str = "biology") -> DataFrame:
    """key, ord, intent, question, answer: a row for each question form whose cue is in the passage, in the bank's order.

    subject: "biology" has a bank of its own; any other takes that of the social sciences.
    """
    bank, cues = (Q.BIOLOGY, Q.BIOLOGY_CUES) if subject == "biology" else (Q.SOCIAL_SCIENCE, Q.CUES)
    t = F.col(text)
    facts = F.struct(
        D.key_term(t).alias("kt"),
        D.noun_phrases(t).alias("np"),
        F.coalesce(F.get(D.split_sentences(t), F.lit(0)), F.get(F.split(t, "\\."), F.lit(0))).alias("first"),
        F.lower(F.regexp_extract(t, cues["list"], 1)).alias("list"),
        F.regexp_extract(t, cues["number"], 1).alias("number"),
        *[t.rlike(p).alias(f"has_{c}") for c, p in cues.items()],
    )
    rows = passages.select(key, t.alias("_t"), chapter.alias("_chapter"), facts.alias("_f"))
    f = lambda n: F.col(f"_f.{n}")
    values = {"kt": f("kt"), "a": F.get(f("np"), F.lit(0)), "b": F.get(f("np"), F.lit(1)), "first": f("first"), "list": f("list"), "number": f("number"), "chapter": F.col("_chapter"), "subject": F.lit(subject), "low": F.lit(subject.lower())}
    special = {"start": D.is_good_start(f("first")), "one": F.size(f("np")) >= 1, "two": F.size(f("np")) >= 2, "few": F.size(f("np")) < 2}
    asked = []
    for k, (condition, intent, template) in enumerate(bank):
        holds = F.lit(True)
        for c in condition.split():
            holds = holds & special.get(c, f(f"has_{c}") if c in cues else F.lit(False))
        asked.append(F.when(holds, F.struct(F.lit(k).alias("ord"), F.lit(intent).alias("intent"), fill(template, values).alias("question"))))
    return rows.select(key, F.explode(F.array_compact(F.array(*asked))).alias("q"), F.col("_t").alias("answer")).select(key, "q.*", "answer")


def trivial_questions(sentences: Column) -> Column:
    """kind, question, answer over the first five sentences: naming, gaps, true or false, named processes, what something is."""
    # The patterns of the five kinds.
    called = "([A-Z][A-Za-z\\s]{2,25}?)\\s+(?:is|are)\\s+(?:called|known as|termed|referred to as)\\s+([A-Z][A-Za-z\\s]{1,25}?)(?:\\.|,)"
    defined = "^([A-Z][A-Za-z\\s]{2,25}?)\\s+(?:is defined as|refers to|means|is the process of)\\s+(.{15,100}?)(?:\\.|$)"
    verbs = "(?i)\\b(?:is|are|was|were|have|has|can|produces?|contains?)\\b"
    process = "(?is)^(.*?)(?:process called|process of|organ called|structure called|phenomenon called|method called)\\s+([A-Z][A-Za-z]{2,25})"
    being = "^([A-Z][A-Za-z\\s]{2,25}?)\\s+(?:is|are)\\s+(?:a|an|the)\\s+"

    def of(s: Column) -> Column:
        get = lambda p, k: F.trim(F.regexp_extract(s, p, k))
        starts = lambda x: ~T.among(F.lower(F.get(F.split(x, T.SPACE), F.lit(0))), D.STARTS)
        n = lambda x: F.size(T.split_words(x))
        row = lambda kind, q, a: F.struct(F.lit(kind).alias("kind"), q.alias("question"), a.alias("answer"))
        whole = F.rtrim(s, F.lit("."))
        before = F.trim(F.regexp_extract(F.regexp_extract(s, process, 1), "([^.]*)$", 1))
        twenty = F.when(n(s) <= 20, s).otherwise(F.concat(F.array_join(F.slice(T.split_words(s), 1, 20), " "), F.lit(".")))
        found = F.array(
            F.when((get(called, 1) != "") & starts(get(called, 1)) & n(F.rtrim(get(called, 2), F.lit(".,;"))).between(1, 4), row("name_the", F.concat(F.lit("What is "), get(called, 1), F.lit(" called?")), F.concat(F.rtrim(get(called, 2), F.lit(".,;")), F.lit(".")))),
            F.when((get(defined, 1) != "") & starts(get(defined, 1)) & (n(get(defined, 1)) <= 4), row("fill_blank", F.concat(F.lit("_____ is defined as "), get(defined, 2), F.lit(".")), F.concat(get(defined, 1), F.lit(".")))),
            F.when(n(s).between(8, 22) & ~F.endswith(s, F.lit("?")) & s.rlike(verbs), row("true_false", F.concat(F.lit("True or False: "), whole, F.lit(".")), F.concat(F.lit("True. "), whole, F.lit(" as stated in the NCERT textbook.")))),
            F.when(s.rlike(process) & (n(before) >= 4), row("one_word", F.concat(F.lit("Name the process or structure: "), before, F.lit("?")), F.concat(get(process, 2), F.lit(".")))),
            F.when((get(being, 1) != "") & starts(get(being, 1)) & (n(get(being, 1)) <= 3) & (n(s) >= 6), row("one_word", F.concat(F.lit("What is "), get(being, 1), F.lit("?")), twenty)),
        )
        return F.when((F.length(s) >= 20) & D.is_clean(s), F.array_compact(found))

    return F.flatten(F.array_compact(F.transform(F.transform(F.slice(sentences, 1, 5), lambda s: F.trim(s)), of)))


def sentence_entries(sentence: Column, chapter: Column) -> Column:
    """kind, question, answer: up to eleven entries of a sentence, in a fixed order; forms are picked by the sentence's hash."""
    s, low = F.trim(sentence), F.lower(F.trim(sentence))

    def before(s: Column, patterns: list[str]) -> tuple[Column, Column]:
        """What stands before and after the first of the patterns, in their order, that the sentence holds."""
        head, tail = F.lit(None).cast("string"), F.lit(None).cast("string")
        for p in reversed(patterns):
            held, at = F.contains(s, F.lit(p)), F.instr(s, p)
            head = F.when(held, F.substring(s, F.lit(1), at - 1)).otherwise(head)
            tail = F.when(held, F.substring(s, at + len(p), F.length(s))).otherwise(tail)
        return F.rtrim(F.trim(head), F.lit(",")), F.trim(tail)

    def make(w: Column) -> Column:
        n = F.size(w)
        term, _ = before(s, Q.DEFINING)
        key, rest = before(s, Q.NAMING)
        bare = lambda x: F.btrim(x, F.lit(".,;:?!\"'()"))
        # Of the last words but the first ones, the last that is no stop word.
        fit = F.filter(F.transform(w, lambda x, i: F.when((i >= F.greatest(n - 7, F.lit(0)) + 1) & (F.length(bare(x)) > 3) & ~T.among(F.lower(bare(x)), Q.GAP_STOPS), i)), lambda i: i.isNotNull())
        at = F.when(n >= 8, F.try_element_at(fit, F.lit(-1)))
        gapped = F.concat(F.array_join(F.transform(w, lambda x, i: F.when(i == at, "_______").otherwise(x)), " "), F.lit("."))
        key = F.array_join(T.split_words(key), " ")
        brief = F.rtrim(F.array_join(F.slice(T.split_words(F.rtrim(rest, F.lit("."))), 1, 6), " "), F.lit(".,;:"))
        brief = F.concat(F.upper(F.substring(brief, 1, 1)), F.lower(F.substring(brief, F.lit(2), F.length(brief))))
        values = {"s": s, "short": F.substring(s, 1, 100), "chapter": chapter, "term": term, "gapped": gapped, "word": F.btrim(F.get(w, at), F.lit(".,;:?!")), "key": key, "brief": brief}
        any_of = lambda x, words: F.exists(F.array(*[F.lit(y) for y in words]), lambda y: F.contains(x, y))
        holds = {"definition": F.size(T.split_words(term)).between(1, 6) & term.isNotNull(), "fill_blank": at.isNotNull(), "list_enumerate": any_of(s, Q.LISTING), "compare_concepts": any_of(low, Q.CONTRAST), "one_word": (n <= 20) & key.isNotNull() & F.size(T.split_words(key)).between(1, 4)}
        rows = []
        for kind, forms, answer in Q.ENTRIES:
            chosen = F.get(F.array(*[fill(x, values) for x in forms]), T.md5_bucket(F.concat(F.lit(f"{kind}:"), s), len(forms)).cast("int")) if len(forms) > 1 else fill(forms[0], values)
            rows.append(F.when(holds.get(kind, F.lit(True)), F.struct(F.lit(kind).alias("kind"), chosen.alias("question"), fill(answer, values).alias("answer"))))
        return F.array_compact(F.array(*rows))

    return T.let(T.split_words(s), make)


def assign_topic(sentence: Column, topics: list[tuple[str, list[str]]]) -> Column:
    """The topic with most of its keywords in the sentence, the first of equals and of none; "General" without topics."""
    if not topics:
        return F.lit("General")
    low = F.lower(sentence)
    scored = [F.struct(F.size(F.filter(F.array(*[F.lit(k.lower()) for k in words]), lambda k: F.contains(low, k))).alias("n"), F.lit(-i).alias("at"), F.lit(name).alias("topic")) for i, (name, words) in enumerate(topics)]
    return F.array_max(F.array(*scored))["topic"]


def pick(options: list[str], key: Column) -> Column:
    """One of the options by the key's hash: the same for every run."""
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(F.xxhash64(key), F.lit(len(options))).cast("int"))


#: Rows of a bank that one expression holds.
BANK_ROWS = 500


def reactions(passages: DataFrame, key: str, text: str, bank: DataFrame) -> DataFrame:
    """Bank rows (trigger, intent, question) whose trigger is in the passage.

    The bank stands in the expression, so that no join pairs passages with it; a large one goes in blocks.
    """
    rows = [r.asDict() for r in bank.select("trigger", "intent", "question").toLocalIterator()]
    out = [passages.sparkSession.createDataFrame([], f"{key} {passages.schema[key].dataType.simpleString()}, intent string, question string")]
    for k in range(0, len(rows), BANK_ROWS):
        listed = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("trigger", "intent", "question")]) for r in rows[k : k + BANK_ROWS]])
        out.append(passages.select(key, F.explode(T.held_by(F.col(text), listed, "trigger")).alias("r")).select(key, "r.intent", "r.question"))
    return reduce(DataFrame.unionAll, out)


def derived_answer(question: Column, options: Column, chapter: Column) -> Column:
    """Of the options ("a) text") the one with most words in the chapter, the first of equals; without options the best window."""
    low = F.lower(chapter)

    def scored(o: Column, i: Column) -> Column:
        words = F.array_distinct(F.regexp_extract_all(F.lower(F.substring(o, F.lit(3), F.length(o))), F.lit("\\b([a-z]{4,})\\b"), F.lit(1)))
        return F.struct(F.size(F.filter(words, lambda w: F.contains(low, w))).alias("n"), (-i).alias("at"), o.alias("o"))

    best = F.array_max(F.transform(options, scored))["o"]
    named = F.concat(F.lit("The correct answer is ("), F.substring(best, 1, 1), F.lit(") "), F.trim(F.substring(best, F.lit(3), F.length(best))), F.lit("."))
    return F.when(F.size(options) > 0, named).otherwise(best_window(question, D.split_sentences(chapter)))


def numbered_questions(text: Column) -> Column:
    """number, question, options ("a) text"), parts ("(a) text" of 15 characters or more where there are no two options) of a numbered list."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "(?m)^\\s*(?=[0-9]{1,2}[.)]\\s)"), lambda p: p.rlike("^[0-9]{1,2}[.)]\\s"))
    bare = lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")

    def of(p: Column) -> Column:
        options = F.transform(F.regexp_extract_all(p, F.lit("\\(([a-d]\\)\\s*[^\\n(]+)"), F.lit(1)), bare)
        found = F.regexp_extract_all(p, F.lit("(?s)(\\([a-f]\\)\\s*[^(]{15,}?)(?=\\s*\\([a-f]\\)|\\z)"), F.lit(1))
        long_ = F.filter(F.transform(found, lambda x: F.struct(F.substring(x, 2, 1).alias("label"), bare(F.substring(x, F.lit(4), F.length(x))).alias("text"))), lambda x: F.length(x["text"]) > 15)
        question = bare(F.regexp_extract(p, "(?s)^[0-9]{1,2}[.)]\\s+(.*?)(?=\\s*\\n\\s*\\([a-f]\\)|\\z)", 1))
        none = F.slice(long_, F.lit(1), F.lit(0))
        # Options are short lines; parts are questions of their own.
        asked = F.exists(long_, lambda x: F.endswith(x["text"], F.lit("?"))) | (F.size(options) < 2)
        return F.struct(F.regexp_extract(p, "^([0-9]{1,2})", 1).cast("int").alias("number"), question.alias("question"), F.when(asked & (F.size(long_) > 0), F.slice(options, F.lit(1), F.lit(0))).otherwise(options).alias("options"), F.when(asked, long_).otherwise(none).alias("parts"))

    return F.transform(parts, of)


def labelled_entries(rows: DataFrame, id_prefix: str, order: str, english: str, hinglish: str, topic: str, kind: str) -> DataFrame:
    """Hand-made entries as labelled sentences: id (prefix_0001 on), the texts, the map of word labels, and flags by kind ("statement", "query", "gec").

    The entries come as a table; numbers follow the order over all rows, counted without a single sort.
    """
    from textloom.sources.stores import number_within

    numbered = number_within(rows.withColumn("_all", F.lit(id_prefix)), "_all", order, "_number")
    return numbered.select(
        F.format_string("%s_%04d", F.col("_all"), F.col("_number")).alias("id"),
        F.col(english).alias("original_english"), F.col(hinglish).alias("hinglish_roman"), T.label_map(F.col(hinglish)).alias("word_level_labels"), F.col(topic).alias("topic"),
        (F.col(kind) == "query").alias("is_student_query"), (F.col(kind) == "gec").alias("is_gec_sample"), F.when(F.col(kind) == "query", T.classify_intent(F.col(english))).alias("intent"),
    )


def best_window(question: Column, sentences: Column, window: int = 5) -> Column:
    return scored_window(question, sentences, window)["text"]


def scored_window(question: Column, sentences: Column, window: int = 5) -> Column:
    """score, at, text of the window of sentences that holds most of the question's words of four letters or more; the first of equals."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(question), F.lit("\\b([a-z]{4,})\\b"), F.lit(1)))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(sentences) - window), F.lit(2))

    def scored(k: Column) -> Column:
        return T.let(F.array_join(F.slice(sentences, k + 1, F.lit(window)), " "), lambda w: F.struct(F.size(F.filter(words, lambda x: F.contains(F.lower(w), x))).alias("score"), (-k).alias("at"), w.alias("text")))

    return F.array_max(F.transform(starts, scored))


def distinct_questions(parts: list[DataFrame], key: str) -> DataFrame:
    """All generators' questions, each once: by order of generators, then key, then place."""
    rows = [p.withColumn("_gen", F.lit(k)) for k, p in enumerate(parts)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r, allowMissingColumns=True)
    return first_wins(every, F.lower("question"), F.col("_gen"), F.col(key), F.col("question")).drop("_gen")
