"""Pieces of the SQL that queries are held against, written apart from the operators."""

from __future__ import annotations

from driftnet.functions import text as T


def quoted(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


STOPS = quoted(T.STOP_WORDS)
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
WORDLIKE = r"[\p{L}\p{N}_]+"
SPACE = r"[\t-\r\x{85}\p{Z}]+"


def words(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '{LETTERS}')"


def terms(t: str) -> str:
    return f"list_filter({words(t)}, lambda w: length(w) >= 3 AND w NOT IN {STOPS})"


def tokens(t: str) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '{WORDLIKE}'), lambda w: length(w) >= 2)"


def plain_tokens(t: str) -> str:
    return f"list_filter({tokens(t)}, lambda w: w NOT IN {STOPS})"


def squeeze(t: str) -> str:
    return f"trim(regexp_replace({t}, '{SPACE}', ' ', 'g'))"


def word_count(t: str) -> str:
    return f"CASE WHEN {squeeze(t)} = '' THEN 0 ELSE len(string_split({squeeze(t)}, ' ')) END"


def clean(t: str) -> str:
    heading = T.HEADING.removeprefix("(?i)")
    rights = T.RIGHTS.removeprefix("(?i)")
    return f"regexp_replace(regexp_replace({t}, '{heading}', ' ', 'gi'), '{rights}', ' ', 'gi')"


def usable(t: str) -> str:
    w = words(t)
    return f"coalesce(len({w}) >= 40 AND len(list_filter({w}, lambda w: w IN {STOPS})) / len({w}) >= 0.25, false)"


def tfidf(name: str, tf: str, n: str, least: int = 1, share: float = 1.0, keep: str = "") -> str:
    """CTEs ending in <name>(doc, term, w, keep) from a relation tf(doc, term, tf, keep)."""
    k = f", {keep}" if keep else ""
    tk = f", t.{keep}" if keep else ""
    return f"""
{name}_df AS (SELECT term, count(*) AS df FROM {tf} GROUP BY term HAVING count(*) >= {least} AND count(*) <= ({n}) * {share}::DOUBLE),
{name}_raw AS (SELECT doc, t.term, (1 + ln(tf)) * (ln((1 + ({n})) / (1 + df)) + 1) AS raw{tk} FROM {tf} t JOIN {name}_df USING (term)),
{name} AS MATERIALIZED (SELECT doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS w{k} FROM {name}_raw)"""


def mean(name: str, vectors: str, group: str) -> str:
    return f"""
{name}_s AS (SELECT {group}, term, sum(w) AS s FROM {vectors} GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {group}, term, s / sqrt(sum(s * s) OVER (PARTITION BY {group})) AS w FROM {name}_s)"""


#: One text a work: the longest title and abstract, ties to the smaller.
ONE_ABSTRACT = """
said AS (SELECT work, concat_ws(' ', title, abstract) AS text FROM abstracts WHERE abstract IS NOT NULL AND abstract <> '' AND work IS NOT NULL),
one AS (SELECT work, text FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY length(text) DESC, text) AS r FROM said) WHERE r = 1)"""

FIELD_OF = "field_of AS (SELECT work, min(coalesce(nullif(field, ''), nullif(domain, ''), work)) AS field FROM papers WHERE work IS NOT NULL GROUP BY work)"

RECORDS = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, "freeze" ORDER BY retrieved DESC NULLS LAST, record) AS r FROM records
  WHERE format = 1 AND topic IS NOT NULL AND "freeze" IS NOT NULL) WHERE r = 1)"""


def counts(cur: str = "cur") -> str:
    parts = [f"""SELECT "freeze", '{w}' AS win, topic AS cited, unnest(map_keys(cited_by_{w})) AS citing, unnest(map_values(cited_by_{w})) AS n FROM {cur}""" for w in ("before", "train", "recent")]
    return "counts AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n IS NOT NULL AND citing <> '' AND lower(citing) <> 'unknown')"
