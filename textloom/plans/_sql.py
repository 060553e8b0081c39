"""Pieces of DuckDB SQL that several counterparts share."""

from __future__ import annotations

from collections.abc import Iterable

from textloom import lexicons as lex


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words: Iterable[str]) -> str:
    return "(" + ", ".join(quoted(w) for w in sorted(words)) + ")"


def cases(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + " END"


def tokens(text: str = "text") -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\s\\p{{Z}}]+'), lambda w: w <> '')"


def bare(w: str) -> str:
    return f"regexp_replace({w}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


DEV = "'[\\x{0900}-\\x{097F}]'"


def script(w: str) -> str:
    return f"CASE WHEN regexp_matches({w}, {DEV}) AND regexp_matches({w}, '[A-Za-z]') THEN 'MIXED' WHEN regexp_matches({w}, {DEV}) THEN 'DEVANAGARI' WHEN regexp_matches({w}, '[A-Za-z]') THEN 'ROMAN' ELSE 'OTHER' END"


def lid(w: str) -> str:
    """w: a bare word."""
    return (
        f"CASE WHEN {w} = '' THEN 'PUNCT' WHEN regexp_matches({w}, {DEV}) AND regexp_matches({w}, '[A-Za-z]') THEN 'MIX' WHEN regexp_matches({w}, {DEV}) THEN 'HI' WHEN regexp_full_match(lower({w}), '\\p{{Nd}}+') THEN 'UNIV' "
        f"WHEN lower({w}) IN {listed(lex.UNIVERSAL)} THEN 'UNIV' WHEN lower({w}) IN {listed(lex.SCIENCE)} THEN 'EN' WHEN lower({w}) IN {listed(lex.HINDI)} THEN 'HI' ELSE 'EN' END"
    )


def strip_marks(w: str) -> str:
    return f"trim({w}, '.,?!;:\"''()')"


def position_lid(w: str, i: str, capitals: bool) -> str:
    """w: a stripped word; i: its place from 0."""
    rule = f"WHEN regexp_matches({w}, {DEV}) THEN 'HI' WHEN lower({w}) IN {listed(lex.UNIVERSAL)} THEN 'UNIV' WHEN lower({w}) IN {listed(lex.HINDI)} THEN 'HI' "
    if capitals:
        return f"CASE {rule} WHEN regexp_full_match({w}, '[0-9,.-]+') THEN 'UNIV' WHEN {w} = upper({w}) AND {w} <> lower({w}) AND length({w}) > 1 THEN 'EN' WHEN {i} > 0 AND regexp_matches({w}, '^\\p{{Lu}}') THEN 'NE' ELSE 'EN' END"
    return f"CASE WHEN {w} = '' THEN 'EN' {rule} WHEN regexp_full_match({w}, '[0-9]+') THEN 'UNIV' WHEN {i} > 0 AND regexp_matches({w}, '^\\p{{Lu}}') THEN 'NE' ELSE 'EN' END"


def words_of_documents(columns: str = "doc_id") -> str:
    """A row for each token: the columns, w, and i from 0."""
    return f"SELECT {columns}, unnest(t) AS w, unnest(range(len(t))) AS i FROM (SELECT {columns}, {tokens()} AS t FROM documents)"
