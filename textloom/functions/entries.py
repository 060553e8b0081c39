"""Column functions over labelled sentences, questions, answers and requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom import lexicons as lex
from textloom.functions.text import among, let, lookup, split_words

# Questions that need a figure.
FIGURE_REFERENCE = (
    "(?i)\\b(refer to (the )?(fig|figure|picture|diagram|table|image|graph)|look at (the )?(fig|figure|picture|diagram|table|image|graph|above)|shown in (the )?(fig|figure|above|below|diagram)|given in (the )?(fig|figure|above|below)|"
    "from the (fig|figure|picture|diagram|table|above|graph)|(fig|figure)\\s*[0-9]+|the (picture|diagram|graph|table) (given|shown|above|below)|following (figure|picture|diagram|table))\\b"
)
# Subjects and their other names.
SUBJECTS = {
    "biology": "biology", "bio": "biology", "chemistry": "chemistry", "chem": "chemistry", "physics": "physics", "phys": "physics", "mathematics": "mathematics", "maths": "mathematics", "math": "mathematics",
    "social_science": "social_science", "social science": "social_science", "ss": "social_science",
}
TRUE_FALSE = ["true or false:", "true or false -", "true/false:"]
MARKS = ".,?!;:()-/\"'–—…"


def strip_chapter(text: Column, chapter: Column) -> Column:
    """Without a leading "Chapter <title>"."""
    prefix = F.concat(F.lit("Chapter "), chapter)
    rest = F.ltrim(F.substring(text, F.length(prefix) + 1, F.length(text)), F.lit(" :,-"))
    return F.when((chapter != "") & F.startswith(F.lower(text), F.lower(prefix)), rest).otherwise(text)


def split_true_false(text: Column) -> Column:
    """statement, is_true_false."""
    t = F.trim(text)
    out = None
    for p in TRUE_FALSE:
        hit = F.startswith(F.lower(t), F.lit(p))
        row = F.struct(F.btrim(F.substring(t, F.lit(len(p) + 1), F.length(t)), F.lit(" :-")).alias("statement"), F.lit(True).alias("is_true_false"))
        out = F.when(hit, row) if out is None else out.when(hit, row)
    return out.otherwise(F.struct(text.alias("statement"), F.lit(False).alias("is_true_false")))


def answer_key(intent: Column, text: Column) -> Column:
    """The option or truth value that an answer names, else null."""
    t = F.lower(F.trim(text))
    option = F.nullif(F.regexp_extract(t, "\\(\\s*(iv|v|i{1,3}|[a-d])\\s*\\)", 1), F.lit(""))
    truth = F.nullif(F.regexp_extract(t, "\\b(true|false|sahi|galat)\\b", 1), F.lit(""))
    return F.when(intent.isin("mcq", "assertion_reason"), option).when(intent == "true_false", F.when(truth == "sahi", "true").when(truth == "galat", "false").otherwise(truth))


def to_statement(english: Column) -> Column:
    base = F.rtrim(F.trim(english), F.lit(".?!"))
    return F.concat(base, F.when(base.rlike("(?i)\\b(are|were)\\b"), " hain.").otherwise(" hai."))


def to_query(english: Column, suffix: Column) -> Column:
    words = F.array_join(F.slice(split_words(F.rtrim(F.trim(english), F.lit(".?!"))), 1, 12), " ")
    return F.trim(F.concat(F.lit("Sir, "), words, F.lit(" "), suffix))


def _first(text: Column, old: str, new: str) -> Column:
    at = F.instr(text, old)
    return F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text)))


def with_agreement_error(hinglish: Column) -> Column:
    """correct, wrong: the first " hai" (or " hain") of the sentence in the other number."""
    t = F.trim(hinglish)
    own = F.concat(F.rtrim(t, F.lit(".")), F.lit(" hai."))
    pair = lambda c, w: F.struct(c.alias("correct"), w.alias("wrong"))
    return F.when(t.contains(" hai"), pair(t, _first(t, " hai", " hain"))).otherwise(pair(own, _first(own, " hai", " hain")))


def lookup_label(word: Column, labels: Column) -> Column:
    """A word's tag in a map: as it is, in other cases, without marks, any key that is equal so; else UNIV or EN."""
    cased = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    tries = lambda w: F.coalesce(F.element_at(labels, w), F.element_at(labels, F.lower(w)), F.element_at(labels, cased(w)))
    bare = F.btrim(word, F.lit(MARKS))
    near = F.get(F.filter(F.map_entries(labels), lambda e: F.lower(F.btrim(e["key"], F.lit(MARKS))) == F.lower(bare)), F.lit(0))["value"]
    return F.coalesce(tries(word), tries(bare), F.when(bare != "", near), F.when(bare == "", "UNIV"), F.lit("EN"))


def subword_labels(word_ids: Column, labels: Column, ignored: int = -100) -> Column:
    """A word's first piece takes its label; later pieces and what belongs to no word (null or below 0) are ignored."""
    return F.transform(word_ids, lambda w, i: F.when(w.isNull() | (w < 0) | ((i > 0) & w.eqNullSafe(F.get(word_ids, i - 1))), F.lit(ignored)).otherwise(F.coalesce(F.get(labels, w), F.lit(ignored))))


def rebuild_label(core: Column, position: Column, labels: Column) -> Column:
    """A token's tag after augmentation: the one it had, else by rule."""
    low = F.lower(core)
    hindi = {"nahi", "mat", "ka", "ki", "ke", "ko", "se", "mein"} | set(lex.CONNECTORS) | set(lex.HINDI_EQUIVALENTS.values())
    rule = F.when(low == "sir", "UNIV").when(among(low, hindi), "HI").when(low.rlike("^[0-9]+$"), "UNIV").when((position > 0) & core.rlike("^\\p{Lu}"), "NE").otherwise("EN")
    return F.coalesce(F.element_at(labels, core), rule)


def subject(name: Column) -> Column:
    """The subject's own name; unknown names raise."""
    key = F.lower(F.trim(name))
    return F.coalesce(lookup(SUBJECTS, key), F.raise_error(F.concat(F.lit("unknown subject: "), name)).cast("string"))


def request_issues(query: Column, top_k: Column, max_new_tokens: Column, language: Column, class_num: Column, history: Column) -> Column:
    """Which limits a request breaks."""
    checks = {
        "query length": ~F.length(query).between(2, 1000), "top_k": ~top_k.between(1, 8), "max_new_tokens": ~max_new_tokens.between(16, 768), "language": ~language.isin("hinglish", "english"),
        "class_num": class_num.isNotNull() & ~class_num.isin("9", "10"), "history": F.size(history) > 12,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sections(text: Column, markers: list[str], ends: list[str], least: int = 30) -> Column:
    """What follows each marker, up to the nearest end or other marker; longer than ``least``."""

    def after(marker: str) -> Column:
        parts = F.split(text, "\\Q" + marker + "\\E")
        stops = "|".join("\\Q" + e + "\\E" for e in [*ends, *(m for m in markers if m != marker)])
        cut = lambda p: F.trim(F.regexp_extract(p, f"(?s)^(.{{0,20}}.*?)(?:(?<=.{{20}})(?:{stops})|\\z)", 1))
        return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), lambda p: F.struct(F.lit(marker).alias("marker"), cut(p).alias("content")))

    return F.filter(F.concat(*[after(m) for m in markers]), lambda s: F.length(s["content"]) > least)


def trim_garbage(sentence: Column, garbage: str = "[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{4,}", least: int = 40) -> Column:
    """Without leading words up to the last garbled one before a capitalised word; unchanged if little would be left."""

    def cut(words: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("keep"), F.lit(False).alias("stop"))

        def step(a: Column, w: Column) -> Column:
            bad = F.btrim(w, F.lit(".,;:?!\"'()-")).rlike(garbage)
            good = F.btrim(w, F.lit(".,;:?!\"'()-")).rlike("^\\p{Lu}")
            return F.struct((a["i"] + 1).alias("i"), F.when(~a["stop"] & bad, a["i"] + 1).otherwise(a["keep"]).alias("keep"), (a["stop"] | (~bad & good)).alias("stop"))

        rest = F.array_join(F.slice(words, F.aggregate(words, start, step)["keep"] + 1, F.greatest(F.size(words), F.lit(1))), " ")
        return let(rest, lambda r: F.when(F.length(r) >= least, r).otherwise(sentence))

    return let(split_words(sentence), cut)
