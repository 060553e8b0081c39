"""Column functions over text and token arrays. All stay in Spark's expressions.

White space is Unicode white space, words are letters, digits and underscore without
combining marks, so that results do not depend on an engine's idea of either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom import lexicons as lex

SPACE = "[\\s\\p{Z}]+"
NOT_WORD = "[^\\p{L}\\p{N}_]"
DEVANAGARI = "[\\x{0900}-\\x{097F}]"
ROMAN = "[A-Za-z]"
PUNCTUATION = ".,?!;:\"'()"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of_each(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first value of each key, in place; sorted instead of compared pair by pair."""
    keyed = F.array_sort(F.transform(values, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = let(keyed, lambda p: F.filter(p, lambda x, i: (i == 0) | ~x["k"].eqNullSafe(F.get(p, i - 1)["k"])))
    return F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x["x"])


def held_by(text: Column, rows: Column, field: str) -> Column:
    """Those of an array of structs whose field the text in lower case contains."""
    return let(F.lower(text), lambda t: F.filter(rows, lambda r: F.contains(t, r[field])))


def lookup(table: dict[str, str], key: Column) -> Column:
    """The table's value of a key, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def among(key: Column, words: Iterable[str]) -> Column:
    return key.isin(sorted(words))


def split_words(text: Column) -> Column:
    """Runs of other than white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def bare(word: Column) -> Column:
    """The word's letters, digits and underscores."""
    return F.regexp_replace(word, NOT_WORD, "")


def core_parts(word: Column) -> Column:
    """prefix, core, suffix: what stands before the first and after the last letter or digit."""
    part = lambda k: F.regexp_extract(word, "(?s)^([^\\p{L}\\p{N}]*)(.*?)([^\\p{L}\\p{N}]*)$", k)
    return F.struct(part(1).alias("prefix"), part(2).alias("core"), part(3).alias("suffix"))


def core(word: Column) -> Column:
    """From the first to the last letter or digit."""
    return F.regexp_replace(word, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")


def strip_marks(word: Column) -> Column:
    """Without sentence punctuation, quotes and brackets at its ends."""
    return F.btrim(word, F.lit(PUNCTUATION))


def word_script(word: Column) -> Column:
    dev, rom = word.rlike(DEVANAGARI), word.rlike(ROMAN)
    return F.when(dev & rom, "MIXED").when(dev, "DEVANAGARI").when(rom, "ROMAN").otherwise("OTHER")


def char_script(char: Column) -> Column:
    return F.when(char.rlike("^" + DEVANAGARI), "DEVANAGARI").when(char.rlike("^" + ROMAN), "ROMAN").when(char.rlike("^\\p{Nd}"), "NUMERIC").when(char.rlike("^[\\s\\p{Z}]"), "SPACE").otherwise("OTHER")


def sentence_script(text: Column) -> Column:
    """overall script, distinct tokens, and how many of each script; shares are over distinct tokens."""
    tokens = F.array_distinct(F.filter(split_words(text), lambda w: bare(w) != ""))

    def counts(scripts: Column) -> Column:
        n = lambda s: F.size(F.filter(scripts, lambda x: x == s))
        overall = F.when((n("DEVANAGARI") == 0) & (n("MIXED") == 0), "ROMAN").when((n("ROMAN") == 0) & (n("MIXED") == 0), "DEVANAGARI").otherwise("MIXED")
        return F.struct(overall.alias("overall"), F.size(scripts).alias("n_distinct"), n("ROMAN").alias("roman"), n("DEVANAGARI").alias("devanagari"), n("MIXED").alias("mixed"))

    return let(F.transform(tokens, lambda w: word_script(bare(w))), counts)


def word_language(word: Column) -> Column:
    """PUNCT, MIX, HI, UNIV or EN by ordered rules."""

    def rules(w: Column) -> Column:
        low = F.lower(w)
        # The lists hold Roman words only, so they can be asked before the scripts are.
        return (
            F.when(w == "", "PUNCT")
            .when(among(low, lex.UNIVERSAL), "UNIV")
            .when(among(low, lex.SCIENCE), "EN")
            .when(among(low, lex.HINDI), "HI")
            .when(~w.rlike(DEVANAGARI + "|^\\p{Nd}+$"), "EN")
            .when(w.rlike(DEVANAGARI), F.when(w.rlike(ROMAN), "MIX").otherwise("HI"))
            .otherwise("UNIV")
        )

    return let(bare(word), rules)


def code_mixing(hindi: Column, english: Column) -> Column:
    """(1 - larger share) * 100; 0 without Hindi and English words. Not rounded."""
    total = hindi + english
    return F.when(total > 0, (1 - F.greatest(hindi, english) / total) * 100).otherwise(0.0)


def mixing_band(cmi: Column) -> Column:
    return F.when(cmi == 0, "monolingual").when(cmi < 30, "low").when(cmi < 50, "moderate").otherwise("high")


def language_counts(text: Column) -> Column:
    """Tokens by language tag."""
    n = lambda tags, t: F.size(F.filter(tags, lambda x: x == t))
    return let(F.transform(split_words(text), word_language), lambda tags: F.struct(F.size(tags).alias("n_tokens"), *[n(tags, t).alias(t.lower()) for t in ("HI", "EN", "UNIV", "MIX", "PUNCT")]))


def position_language(word: Column, position: Column, capitals: bool = True) -> Column:
    """Language tag with named entities by capital and place. capitals: words in capitals are English."""

    def rules(w: Column) -> Column:
        low = F.lower(w)
        rule = F.when(w.rlike(DEVANAGARI), "HI").when(among(low, lex.UNIVERSAL), "UNIV").when(among(low, lex.HINDI), "HI")
        if capitals:
            rule = rule.when(w.rlike("^[0-9,.-]+$"), "UNIV").when((w == F.upper(w)) & (w != low) & (F.length(w) > 1), "EN")
        else:
            rule = F.when(w == "", "EN").otherwise(rule.when(w.rlike("^[0-9]+$"), "UNIV").when((position > 0) & w.rlike("^\\p{Lu}"), "NE").otherwise("EN"))
            return rule
        return rule.when((position > 0) & w.rlike("^\\p{Lu}"), "NE").otherwise("EN")

    return let(strip_marks(word), rules)


def label_map(text: Column) -> Column:
    """Stripped token (the raw one if nothing is left) to tag; the last of equal tokens counts."""
    key = lambda w: let(strip_marks(w), lambda x: F.when(x == "", w).otherwise(x))
    pairs = F.array_sort(F.transform(split_words(text), lambda w, i: F.struct(key(w).alias("key"), i.alias("i"), position_language(w, i, capitals=False).alias("value"))))
    last = let(pairs, lambda p: F.filter(p, lambda x, i: ~x["key"].eqNullSafe(F.get(p, i + 1)["key"])))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))


def normalize_spelling(text: Column) -> Column:
    """text: known variants and shorthand rewritten, marks kept; n_changes."""

    def word(w: Column) -> Column:
        # One pattern and a hash set tell which words change; only those are taken apart.
        known = among(F.lower(core(w)), lex.REWRITES)
        return F.when(known, let(core_parts(w), lambda p: F.concat(p["prefix"], lookup(lex.REWRITES, F.lower(p["core"])), p["suffix"]))).otherwise(w)

    return let(split_words(text), lambda old: let(F.transform(old, word), lambda new: F.struct(F.array_join(new, " ").alias("text"), F.size(F.filter(F.arrays_zip(old.alias("a"), new.alias("b")), lambda x: x["a"] != x["b"])).alias("n_changes"))))


def normalize_sentence(text: Column) -> Column:
    s = squeeze(text)
    s = F.regexp_replace(s, "\\s+([.,!?;:])", "$1")
    for mark in ".!?":
        s = F.regexp_replace(s, f"[{mark}]{{2,}}", mark)
    return normalize_spelling(s)


def tokens_stripped(text: Column) -> Column:
    return F.filter(F.transform(split_words(text), strip_marks), lambda w: w != "")


def tokens_symbols(text: Column) -> Column:
    """Words, and every other symbol by itself."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\p{Z}])"), F.lit(1))


def stop_reasons(tokens: Column) -> Column:
    """Each token with PUNCT, EN_STOP, HI_STOP or null (kept)."""

    def reason(w: Column) -> Column:
        low = F.lower(w)
        english = among(low, (lex.ENGLISH_STOPS | lex.DOMAIN_STOPS) - lex.PROTECTED)
        hindi = among(low, lex.HINDI_STOPS)
        # Only words that some list holds are asked for their language.
        listed = F.when(english | hindi, let(word_language(w), lambda tag: F.when((tag == "EN") & english, "EN_STOP").when((tag == "HI") & hindi, "HI_STOP")))
        why = F.when(~w.rlike("^[\\p{L}\\p{N}]+$"), "PUNCT").otherwise(listed)
        return F.struct(w.alias("token"), why.alias("reason"))

    return F.transform(tokens, reason)


def remove_stops(tokens: Column) -> Column:
    """English tokens that stay: letters and digits only, no stop word unless protected."""
    return F.filter(tokens, lambda w: w.rlike("^[\\p{L}\\p{N}]+$") & ~among(F.lower(w), (lex.ENGLISH_STOPS | lex.DOMAIN_STOPS) - lex.PROTECTED))


def sentences(text: Column, more_than: int = 30) -> Column:
    """Cut after . ! ? before white space; only longer ones stay."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "(?<=[.!?])\\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > more_than)


def drop_repeats(words: Column) -> Column:
    """Without words that equal the one before."""
    return F.filter(words, lambda w, i: (i == 0) | (w != F.get(words, i - 1)))


def classify_intent(question: Column, options: Column | None = None, parts: Column | None = None) -> Column:
    """Ordered patterns over the question."""
    q = F.lower(question)
    zero = F.lit(0)
    return (
        F.when(q.contains("assertion") & q.contains("reason"), "assertion_reason")
        .when((zero if options is None else options) >= 3, "mcq")
        .when((zero if parts is None else parts) >= 2, "case_study")
        .when(q.rlike("\\b(list|name all|enumerate|give (two|three|four|five))\\b"), "list_enumerate")
        .when(q.rlike("\\b(define|what is meant by|what do you mean|meaning of)\\b"), "definition")
        .when(q.rlike("\\b(difference|compare|distinguish|versus)\\b"), "compare_concepts")
        .when(q.rlike("\\b(example|illustrate|give an instance)\\b"), "give_example")
        .when(q.rlike("\\b(arrange|order|sequence|correct order)\\b"), "list_enumerate")
        .when(q.rlike("\\b(why|give reason|explain why)\\b"), "short_answer")
        .when(q.rlike("\\b(how|describe|explain|discuss|outline)\\b"), "explain_concept")
        .otherwise("analytical")
    )


def normalize_intent(intent: Column) -> Column:
    current = F.coalesce(lookup(lex.INTENT_ALIASES, intent), intent)
    return F.when(among(current, lex.INTENTS), current)


def standalone_rewrite(raw: Column, question: Column) -> Column:
    """A model's rewrite if it looks sane, else null."""
    first = F.trim(F.get(F.split(F.trim(F.coalesce(raw, F.lit(""))), "\\R"), F.lit(0)))
    text = F.btrim(F.regexp_replace(first, "(?i)^(standalone question|question)\\s*:\\s*", ""), F.lit(" \"'`*"))
    return F.when((F.length(text) >= 3) & (F.length(text) <= 300) & ((question == "") | (F.length(text) <= 6 * F.length(question) + 120)), text)


def devanagari_share(text: Column) -> Column:
    """Share of Devanagari among the letters."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, "[^\\p{L}]|[^\\x{0900}-\\x{097F}]", "")) / letters).otherwise(0.0)


def md5_bucket(key: Column, buckets: int = 10_000) -> Column:
    """The 128-bit digest modulo buckets, limb by limb."""
    limbs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substring(F.md5(key), k * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(limbs, F.lit(0).cast("long"), lambda a, x: (a * F.lit(2**32 % buckets) + x) % buckets)
