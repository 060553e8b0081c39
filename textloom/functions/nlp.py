"""Word-level English processing from published algorithms, as Arrow-batched functions.

Porter (1980) and Paice/Husk (Lancaster, 1990) stemmers, Treebank tokenisation, a suffix
lemmatiser and a lexicon-and-suffix tagger. The last two stand in for dictionaries and models
that are not part of this package; results are approximate there.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = set("aeiou")


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in VOWELS and (c != "y" or i == 0 or not _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 1) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 3) and w[-1] not in "wxy"


# The suffix tables of the published algorithm.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


@functools.lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and _vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        hit = max((x for x in table if w.endswith(x[0])), key=lambda x: len(x[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    hit = max((s for s in _STEP4 if w.endswith(s)), key=len, default=None)
    if hit and _measure(w[: -len(hit)]) > 1 and (hit != "ion" or w[: -len(hit)].endswith(("s", "t"))):
        w = w[: -len(hit)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# The published rule list; reversed ending, * if only on whole words, letters to drop, letters to add, > to go on.
_LANCASTER = (
    "ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> "
    "lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. "
    "tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."
).split()
_RULES = [(m[1][::-1], bool(m[2]), int(m[3]), m[4], m[5] == ">") for r in _LANCASTER if (m := re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])", r))]


@functools.lru_cache(maxsize=100_000)
def lancaster(word: str) -> str:
    w, whole = word.lower(), True
    while True:
        for end, intact, drop, add, on in _RULES:
            if w.endswith(end) and (whole or not intact):
                stem = w[: len(w) - drop] + add
                base = w[: len(w) - drop]
                good = len(base) >= 2 if base[:1] in VOWELS else len(base) >= 3 and any(c in "aeiouy" for c in base)
                if good:
                    w, whole = stem, False
                    if not on:
                        return w
                    break
        else:
            return w


# Irregular forms.
_IRREGULAR = {"mice": "mouse", "feet": "foot", "teeth": "tooth", "men": "man", "women": "woman", "children": "child", "went": "go", "gone": "go", "was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "had": "have", "has": "have", "did": "do", "done": "do", "made": "make", "better": "good", "best": "good", "worse": "bad", "ran": "run", "nuclei": "nucleus", "data": "datum", "leaves": "leaf", "lives": "life"}


def lemma(word: str) -> str:
    """Of noun, verb and adjective readings, the shortest; the first of equally short ones."""
    w = word.lower()
    if w in _IRREGULAR:
        return _IRREGULAR[w]
    found = [w]
    for end, by in (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("s", ""), ("ing", ""), ("ed", "")):
        if w.endswith(end) and len(w) - len(end) >= 3 and not w.endswith(("ss", "us", "is")):
            base = w[: -len(end)] + by
            if end in ("ing", "ed"):
                if not _vowel(base):
                    continue
                if len(base) > 2 and base[-1] == base[-2] and base[-1] not in "lsz":
                    base = base[:-1]
                elif _measure(base) == 1 and _cvc(base):
                    base += "e"
            found.append(base)
            break
    return min(found, key=len)


_TREEBANK = [
    (re.compile(r"^\""), "`` "), (re.compile(r"([ (\[{<])\""), r"\1 `` "), (re.compile(r"\.\.\."), " ... "), (re.compile(r"([,;:@#$%&])(?!\d)"), r" \1 "), (re.compile(r"([^.])(\.)([\])}>\"']*)\s*$"), r"\1 \2\3 "),
    (re.compile(r"[?!]"), r" \g<0> "), (re.compile(r"[\[\](){}<>]"), r" \g<0> "), (re.compile(r"--"), " -- "), (re.compile(r"\""), " '' "), (re.compile(r"([^' ])('s|'m|'d|'ll|'re|'ve|n't|')(?= |$)", re.I), r"\1 \2 "), (re.compile(r"\b(can)(not)\b", re.I), r"\1 \2"), (re.compile(r"\b(gon|wan)(na)\b", re.I), r"\1 \2"),
]


def treebank(text: str) -> list[str]:
    for pattern, by in _TREEBANK:
        text = pattern.sub(by, text)
    return text.split()


# Closed-class words by tag.
_TAGS = {w: t for t, ws in {"DT": "the a an this that these those", "IN": "in on at of for by with from into through during over under between", "CC": "and or but nor", "PRP": "i you he she it we they me him her us them", "MD": "can could will would shall should may might must", "TO": "to", "VBZ": "is has does", "VBP": "are have do am", "VBD": "was were had did", "RB": "not very also never too"}.items() for w in ws.split()}
_ENDS = [("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ous", "JJ"), ("ful", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("ive", "JJ"), ("al", "JJ"), ("est", "JJS"), ("s", "NNS")]


def tag(word: str) -> str:
    w = word.lower()
    if w in _TAGS:
        return _TAGS[w]
    if re.fullmatch(r"[\d.,]+", w):
        return "CD"
    if not any(c.isalnum() for c in w):
        return "."
    if word[:1].isupper():
        return "NNP"
    return next((t for e, t in _ENDS if w.endswith(e) and len(w) > len(e) + 2), "NN")


def over_arrays(f: Callable[[str], str], tokens: Column) -> Column:
    """A word function over token arrays: each distinct word of a batch is asked once, and remembered within bounds."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for b in batches:
            rows = [None if ts is None else list(ts) for ts in b]
            missing = {t for ts in rows if ts for t in ts}.difference(known)
            if len(known) + len(missing) > WORDS_KEPT:
                known.clear()
                missing = {t for ts in rows if ts for t in ts}
            known.update((t, None if t is None else f(t)) for t in missing)
            yield pd.Series([None if ts is None else [known[t] for t in ts] for ts in rows], dtype=object)

    return run(tokens)


#: Words that a task remembers with their stems or tags.
WORDS_KEPT = 200_000


def porter_stems(tokens: Column) -> Column:
    return over_arrays(porter, tokens)


def lancaster_stems(tokens: Column) -> Column:
    return over_arrays(lancaster, tokens)


def lemmas(tokens: Column) -> Column:
    return over_arrays(lemma, tokens)


def tags(tokens: Column) -> Column:
    return over_arrays(tag, tokens)


def treebank_tokens(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: treebank(t) if t is not None else None)

    return run(text)


def gazetteer_index(phrases: list[tuple[tuple[str, ...], str]]) -> dict[str, list[tuple[int, int, tuple[str, ...], str]]]:
    """Phrases by their first word, each with its length and rank: longest first, then as given."""
    index: dict[str, list[tuple[int, int, tuple[str, ...], str]]] = {}
    for rank, (words, label) in enumerate(sorted(phrases, key=lambda p: -len(p[0]))):
        if words:
            index.setdefault(words[0], []).append((rank, len(words), words, label))
    return index


def gazetteer_spans(tokens: list[str], index: dict[str, list[tuple[int, int, tuple[str, ...], str]]]) -> list[tuple[int, int, str]]:
    """(start, end, label) of the longest phrases first, without overlaps. Only phrases that start with a token are tried there."""
    low = [t.lower() for t in tokens]
    hits = [(rank, i, n, label) for i, t in enumerate(low) for rank, n, words, label in index.get(t, ()) if tuple(low[i : i + n]) == words]
    taken, out = [False] * len(low), []
    for _, i, n, label in sorted(hits):
        if not any(taken[i : i + n]):
            taken[i : i + n] = [True] * n
            out.append((i, i + n, label))
    return sorted(out)


def gazetteer(phrases: list[tuple[tuple[str, ...], str]]):
    index = gazetteer_index(phrases)

    @F.pandas_udf("array<struct<start:int,end:int,label:string>>")
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: [{"start": a, "end": b, "label": c} for a, b, c in gazetteer_spans(list(ts), index)] if ts is not None else None)

    return run
