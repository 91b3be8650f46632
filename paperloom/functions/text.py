"""Text functions as column expressions. White space is Unicode white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.fixed import DOMAIN_KEYWORDS, GENERAL_DOMAIN

#: The tokenizer's pattern, and what page extraction leaves behind.
TOKEN = "[가-힣]+|[A-Za-z0-9]+"
GLYPH_CODES = r"\(cid:\d+\)"
LEADING_MARKS = r"^[\s.。,]+"


def stripped(text: Column) -> Column:
    """Without white space at both ends; trim() would take spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalized(text: Column) -> Column:
    """Each run of white space is one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cleaned(text: Column) -> Column:
    """Extracted page text without glyph codes, white space runs and leading punctuation; null is empty."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?U){GLYPH_CODES}", "")
    return F.trim(F.regexp_replace(normalized(plain), f"(?U){LEADING_MARKS}", ""))


def tokens(text: Column) -> Column:
    """Runs of Hangul or of ASCII letters and digits, case kept; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def augmented(search_text: Column, title: Column, aliases: Column, quotes: Column, terms: Column) -> Column:
    """What the index sees of a corpus record: its parts, parted by spaces; empty parts are left out, empty list elements are not."""
    some = lambda c: F.when(c != "", c)
    full = lambda a: F.when(F.size(a) > 0, F.array_join(a, " ", ""))
    return stripped(F.concat_ws(" ", some(search_text), some(title), full(aliases), full(quotes), full(terms)))


def markdown(content_json: Column) -> Column:
    """A JSON object as Markdown: a heading for each key in file order, lists as bullet points."""
    entries = F.map_entries(F.from_json(content_json, "map<string,string>"))

    def section(e: Column) -> Column:
        items = F.from_json(e["value"], "array<string>")
        body = F.when(e["value"].startswith("[") & items.isNotNull(), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(e["value"])
        return F.concat(F.lit("## "), F.replace(e["key"], F.lit("_"), F.lit(" ")), F.lit("\n"), F.coalesce(body, F.lit("")), F.lit("\n"))

    return stripped(F.array_join(F.transform(entries, section), "\n"))


def keyword_score(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in lower-cased text; a word listed twice counts twice. A sum that stays in generated code."""
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def prefix(text: Column, most: int = 1500) -> Column:
    """The first characters."""
    return F.substring(text, 1, most)


def best_name(scores: dict[str, Column], otherwise: str) -> Column:
    """The first name with the highest score, or otherwise where all are zero."""
    top = F.greatest(*scores.values())
    out = F.when(top == 0, F.lit(otherwise))
    for name, score in scores.items():
        out = out.when(score == top, F.lit(name))
    return out


def detect_domain(paragraph: Column, question: Column, question_plus: Column) -> Column:
    """The exam domain with the most keywords in a record's text."""
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (paragraph, question, question_plus)]))
    return best_name({d: keyword_score(whole, w) for d, w in DOMAIN_KEYWORDS.items()}, GENERAL_DOMAIN)


def enumerated(choices: Column, style: str = "dash") -> Column:
    """Choices as text: dash '1 - a', dot '1. a', bullet '- a', one to a line; comma 'a, b'."""
    forms = {
        "dash": lambda c, i: F.concat((i + 1).cast("string"), F.lit(" - "), c),
        "dot": lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c),
        "bullet": lambda c, i: F.concat(F.lit("- "), c),
        "comma": lambda c, i: c,
    }
    return F.array_join(F.transform(choices, forms[style]), ", " if style == "comma" else "\n")


def choice_at(choices: Column, answer: Column) -> Column:
    """The choice with a 1-based number; null where there is none."""
    return F.when(answer >= 1, F.get(choices, (answer - 1).cast("int")))


def full_question(question: Column, question_plus: Column) -> Column:
    """A question with what belongs to it, on a line of its own."""
    plus = F.coalesce(question_plus, F.lit(""))
    return F.when(plus != "", F.concat(question, F.lit("\n"), plus)).otherwise(question)


def unfenced(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return stripped(F.when(inner != "", inner).otherwise(text))
