"""Licence scans by canonical digests (operator 10), in DataFrame functions only.

A text is made canonical: lower case, copyright lines out, punctuation and white space to
single spaces, equivalent spellings to one. The SHA-256 of the whole canonical text is
hash-joined to the digests of known licences. One-line notices are found the same way, line
by line, in lines that have a word of an opening (OPENS). ``scan_sql`` looks at lines that
match 'licen[cs]' only, so it misses openings such as "Released under MIT"; nor does it
know STANDARD and HOLDER.

Defined results: null and empty texts have the digest of the empty text and no licence.
Repeated rows get equal results. A very long text costs memory of a few times its size, in one row. A text
with several notices lists each licence once. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.license_texts import NAMES, OPENINGS, SPELLINGS, STANDARD, TEXTS

COPYRIGHT = "(?m)^[ \\t#*/;-]*(?:copyright[ \\t]*(?:\\(c\\)|©|:|[0-9]{4}|<|\\[)|\\(c\\)[ \\t]*[0-9]{4}|©|all rights reserved)[^\\n]*$"
#: Words of prose: a line that starts with "copyright" and has one of them names no holder, unless it has a year.
ABOUT = "notices?|holders?|owners?|licen[cs]es?|licensed|laws?|interests?|statements?|treaty|treaties|protection|rights?|ownership|infringement|disclaimers?|doctrines|permission|assignment"
PROSE = f"{ABOUT}|the|of|to|in|is|are|be|this|that|these|which|for|any|all|with|as|under|on|or|an|a|you|your|we|it|if|not|no|may|must|shall|will|can|from|at|such|other|works?"
#: Copyright lines that start with the holder: "Copyright Jane Doe 2020", "Copyright (by) Jane Doe", "(c) Jane Doe".
HOLDER = (
    f"(?m)^[ \\t#*/;-]*(?:copyright[ \\t]+(?!(?:{ABOUT})\\b)[^\\n]{{1,100}}?\\b[0-9]{{4}}\\b[^\\n]{{0,60}}"
    f"|(?:copyright|\\(c\\))(?:[ \\t]+(?!(?:{PROSE})\\b)[^ \\t\\n;:()]{{1,40}}){{1,5}}[ \\t]*)$"
)
OTHER = "[^a-z0-9]+"
#: Every opening of a notice has one of these words; other lines need no digest.
OPENS = "licen[cs]|released|distributed"


def canonical_text(text: str | None) -> str:
    """The canonical form in plain Python, for tables of known licences and for tests."""
    s = re.sub(OTHER, " ", re.sub(HOLDER, " ", re.sub(COPYRIGHT, " ", (text or "").lower())))
    s = f" {s.strip()} "
    for old, new in SPELLINGS:
        s = s.replace(old, new)
    return s.strip(" ")


def canonical(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, " "), HOLDER, " "), OTHER, " ")
    s = F.concat(F.lit(" "), F.trim(s), F.lit(" "))
    for old, new in SPELLINGS:
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.trim(s)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def known_texts() -> dict[str, str]:
    """Digest to licence: whole texts, with and without their title line."""
    out: dict[str, str] = {}
    for name, text in TEXTS.items():
        out.setdefault(digest(canonical_text(text)), name)
        title, _, rest = text.partition("\n\n")
        if len(title) < 40:
            out.setdefault(digest(canonical_text(rest)), name)
    return out


def known_notices() -> dict[str, str]:
    out: dict[str, str] = {}
    for opening in OPENINGS:
        for name, spelled in NAMES.items():
            for s in spelled:
                for the in ("", "the "):
                    out.setdefault(digest(canonical_text(f"{opening} {the}{s}")), name)
    return out


def table(spark: SparkSession, known: dict[str, str]) -> DataFrame:
    listed = json.dumps([{"known": k, "license_id": v} for k, v in known.items()])
    return spark.sql("SELECT inline(from_json(:listed, 'array<struct<known:string,license_id:string>>'))", {"listed": listed})


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id (null if none), is_license, notices (sorted, comma-joined)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    notices = known_notices()
    named = F.create_map(*[F.lit(x) for kv in sorted(notices.items()) for x in kv])
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike(OPENS))
    found = F.array_compact(F.transform(lines, lambda x: F.element_at(named, F.sha2(canonical(x), 256))))
    notice = F.when(F.lower(text).rlike(OPENS), F.array_join(F.array_sort(F.array_distinct(found)), ",")).otherwise("")
    rows = df.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(text), 256).alias("digest"), notice.alias("notices"))
    # The table of known digests is part of this program: under a thousand rows.
    out = rows.join(F.broadcast(table(df.sparkSession, STANDARD | known_texts())), F.col("digest") == F.col("known"), "left")
    return out.select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"), "notices")


def scan_sql() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda d: ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(d.items()))

    def form(c: str) -> str:
        s = f"' ' || trim(regexp_replace(regexp_replace(lower({c}), {quote(COPYRIGHT)}, ' ', 'g'), {quote(OTHER)}, ' ', 'g'), ' ') || ' '"
        for old, new in SPELLINGS:
            s = f"replace({s}, {quote(old)}, {quote(new)})"
        return f"sha256(trim({s}, ' '))"

    return f"""
WITH known_text(known, license_id) AS (VALUES {values(known_texts())}), known_notice(known, license_id) AS (VALUES {values(known_notices())}),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT DISTINCT k, license_id FROM (SELECT k, {form("line")} AS known FROM l WHERE regexp_matches(lower(line), 'licen[cs]')) JOIN known_notice USING (known)),
g AS (SELECT k, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM n GROUP BY k),
c AS (SELECT k, doc_id, {form("text")} AS digest FROM d)
SELECT doc_id, digest, license_id, license_id IS NOT NULL AS is_license, coalesce(notices, '') AS notices
FROM c LEFT JOIN known_text ON digest = known LEFT JOIN g USING (k)"""
