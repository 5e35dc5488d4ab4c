"""Text rules as column expressions; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common English function words. A parameter wherever it is used.
STOP_WORDS = (
    "a about above after again against all also although am an and any are as at be because been before being below "
    "between both but by can cannot could did do does doing down during each either few for from further had has have "
    "having he her here hers him his how i if in into is it its itself just less may me might more most much must my "
    "neither no nor not now of off on once one only or other our out over own per same she should since so some such "
    "than that the their them then there these they this those though through thus to too two under until up upon us "
    "very was we well were what when where whether which while who whom why will with within without would yet you your"
).split()

#: Words that speak about the paper rather than its subject.
DOCUMENT_WORDS = "abstract approach article author data finding method paper result review study".split()

#: Publisher and database boilerplate, dropped from topic vectors.
BOILERPLATE = "copyright elsevier springer wiley psycinfo apa ltd inc llc gmbh".split()

#: The headings of structured abstracts, and rights notices.
HEADING = (
    r"(?i)\b(?:background|objectives?|methods?|results|conclusions?|purpose|aims?|introduction|design|setting|"
    r"participants|findings|keywords)\s*:"
)
RIGHTS = r"(?i)©|\(c\)|all rights reserved"

#: Letters in the widest sense: letters, letter numbers, other numbers, but no decimal digits.
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
WORDLIKE = r"[\p{L}\p{N}_]+"


def word_list(path: str) -> list[str]:
    """Words of a file, separated by white space, lines after # left out: a full stop list is a parameter like any other."""
    with open(path, encoding="utf-8") as f:
        return [w for line in f for w in line.partition("#")[0].lower().split()]


def changed_list(words: list[str], without: list[str], more: list[str]) -> list[str]:
    """A list made from another: without some words, with some more, each once and in order."""
    return list(dict.fromkeys([w for w in words if w not in set(without)] + list(more)))


def literal_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def words(text: Column) -> Column:
    """Runs of letters of the lower-cased text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of two or more letters, digits and underscores of the lower-cased text."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORDLIKE), F.lit(0)), lambda w: F.length(w) >= 2)


def letter_tokens(text: Column) -> Column:
    """Those of tokens() made of letters alone; 'covid19' gives nothing."""
    return F.filter(tokens(text), lambda w: w.rlike(f"^{LETTERS}$"))


def without(tokenised: Column, stops: list[str]) -> Column:
    return F.filter(tokenised, lambda w: ~w.isin(*stops)) if stops else tokenised


def terms(text: Column, stops: list[str] = STOP_WORDS, least: int = 3) -> Column:
    """Words of `least` or more letters that are no stop words."""
    return F.filter(words(text), lambda w: (F.length(w) >= least) & ~w.isin(*stops))


def squeeze(text: Column) -> Column:
    """White space of any kind as single spaces, none around."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    squeezed = squeeze(text)
    return F.when(squeezed == "", 0).otherwise(F.size(F.split(squeezed, " ")))


def clean(text: Column) -> Column:
    """Without the headings of structured abstracts and rights notices, each replaced by a space."""
    return F.regexp_replace(F.regexp_replace(text, HEADING, " "), RIGHTS, " ")


def usable(text: Column, least_words: int = 40, least_share: float = 0.25, stops: list[str] = STOP_WORDS) -> Column:
    """True for an English text long enough to say what it is about; false for null."""
    found = words(text)
    stop = F.size(F.filter(found, lambda w: w.isin(*stops)))
    return F.coalesce((F.size(found) >= least_words) & (stop / F.size(found) >= least_share), F.lit(False))


def stem(word: Column) -> Column:
    """Without a final s, if the word has more than three letters."""
    return F.when((F.length(word) > 3) & word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def avoided(text: Column, avoid: Column) -> Column:
    """The words of `avoid` that the text uses, whatever their case or plural."""
    used = F.transform(words(text), stem)
    return F.filter(avoid, lambda a: F.array_contains(used, stem(F.lower(a))))


def fingerprint(problem: Column, approach: Column) -> Column:
    """A description's words in order."""
    return F.array_join(words(F.concat_ws(" ", problem, approach)), " ")


def abstract_text(inverted: Column) -> Column:
    """Text from a map of words to positions: words by position, gaps closed; '' for null."""
    placed = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(placed), lambda x: x.w), " "), F.lit(""))


def short_id(url: Column) -> Column:
    """The last segment of a path."""
    return F.element_at(F.split(url, "/"), -1)


def model_name(model: Column) -> Column:
    return F.concat(model.getField("id"), F.lit(" ("), model.getField("provider"), F.lit(")"))


def safe_name(name: Column) -> Column:
    """Fit for a file name."""
    return F.regexp_replace(name, r"[^\w.-]", "_")


def safe_text(name: str) -> str:
    """As safe_name, of a plain string."""
    return re.sub(r"[^\w.-]", "_", name, flags=re.ASCII)


def needs_check(unit: Column) -> Column:
    """One unit in twenty, by the SHA-256 of its name modulo 20.

    Modulo 4 is in the last hex digit; modulo 5 is the sum of the digits, since 16 is 1 modulo 5.
    """
    digest = F.sha2(unit, 256)
    value = lambda c: F.conv(c, 16, 10).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0), lambda acc, i: acc + value(F.substring(digest, i, F.lit(1))))
    return (value(F.right(digest, F.lit(1))) % 4 == 0) & (total % 5 == 0)


def bridge_id(a: Column, b: Column) -> Column:
    return F.concat(F.lit("b-"), F.least(a, b), F.lit("-"), F.greatest(a, b))


def prompt(instructions: Column, title: Column, abstract: Column, avoid: Column) -> Column:
    """The parts that are there, a blank line between."""
    return F.concat_ws(
        "\n\n", instructions, F.concat(F.lit("Title: "), title), F.concat(F.lit("Abstract: "), abstract),
        F.when(F.size(avoid) > 0, F.concat(F.lit("Do not use: "), F.array_join(avoid, ", "))),
    )


def json_block(body: Column) -> Column:
    """The first fenced JSON block of an issue's body; null if there is none."""
    return F.nullif(F.regexp_extract(body, r"(?s)```json[ \t]*\r?\n(.*?)\r?\n?```", 1), F.lit(""))


def fenced(payload: Column) -> Column:
    return F.concat(F.lit("```json\n"), payload, F.lit("\n```"))


def answer(text: Column, least_words: int = 4) -> Column:
    """struct(problem, approach, fault) from a model's answer.

    Thinking between tags is dropped and the JSON object from the first { to the last } read. Both
    parts must be strings of least_words or more; else they are null and fault names what is wrong.
    A variant tells strings from numbers, which reading into a string type would not.
    """
    body = F.regexp_extract(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(body)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant"))
    part = lambda k: squeeze(F.try_variant_get(parsed, f"$.{k}", "string"))
    is_text = (kind("problem") == "STRING") & (kind("approach") == "STRING")
    short = (word_count(part("problem")) < least_words) | (word_count(part("approach")) < least_words)
    fault = (
        F.when(F.coalesce(body, F.lit("")) == "", "no object")
        .when(parsed.isNull(), "not JSON")
        .when(~F.coalesce(is_text, F.lit(False)), "a part is missing or no text")
        .when(short, "a part is too short")
    )
    ok = fault.isNull()
    return F.struct(F.when(ok, part("problem")).alias("problem"), F.when(ok, part("approach")).alias("approach"), fault.alias("fault"))


def link_key(link: Column) -> Column:
    """A lookup key for a paper's published link or bare id: arXiv (new and old), PMC, DOI; else null."""
    arxiv = F.nullif(F.regexp_extract(link, r"(?i)^(?:https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/)?(\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?(?:\.pdf)?$", 1), F.lit(""))
    pmc = F.nullif(F.regexp_extract(link, r"(?i)(PMC\d+)/?$", 1), F.lit(""))
    doi = F.nullif(F.regexp_extract(link, r"(10\.\d{4,9}/\S+)$", 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("doi:10.48550/arxiv."), F.lower(arxiv)), F.concat(F.lit("pmcid:"), F.upper(pmc)), F.concat(F.lit("doi:"), F.lower(doi)))
