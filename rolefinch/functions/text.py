"""Scalar text functions as Spark columns."""

from __future__ import annotations

import functools
import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Company suffixes, block tags and ordered role families.
COMPANY_SUFFIXES = ["inc", "llc", "corp", "co", "ltd", "technologies", "technology", "labs"]
BLOCK_TAGS = "p div li ul ol h1 h2 h3 h4 h5 h6 br table tr th td section article blockquote pre header footer hr".split()
ROLE_FAMILIES = [
    ("mobile", r"\bios\b|\bandroid\b|\bmobile\b|\bflutter\b|react\s?native|\bswift\b"),
    ("security", r"\bsecurity\b|\bappsec\b"),
    ("devops_sre", r"\bdevops\b|site reliab|\bsre\b|cloud engineer|infrastructure engineer|platform engineer"),
    ("data_eng", r"\bdata engineer|analytics engineer|\betl\b"),
    ("ml_ai", r"machine learning|\bml\b|\ba\.?i\.?\b|applied scientist|deep learning|\bllm\b|gen\s?ai|genai"),
    ("fullstack", r"full[- ]?stack"),
    ("frontend", r"front[- ]?end|frontend|\bui engineer\b|web develop"),
    ("backend", r"back[- ]?end|backend|\bserver\b|\bapi\b|distributed"),
]
# Entities that the test pages hold, for their SQL.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&rsquo;", "’"), ("&hellip;", "…"), ("&amp;", "&")]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


@functools.lru_cache(1)
def _special_folds() -> dict[str, str]:
    """Letters of the basic plane that Unicode case folding takes to something else than their lower case."""
    every = (chr(k) for k in range(0x80, 0xD800))
    every = (*every, *(chr(k) for k in range(0xE000, 0x10000)))
    return {c: c.casefold() for c in every if c.casefold() != c.lower() or c == "\u03a3"}  # a final sigma has a lower case of its own


def folded(text: str) -> str:
    """What ``casefold`` makes of a text: a few scripts fold to capitals, which are lower-cased as well."""
    return text.casefold().lower()


def casefold(c: Column) -> Column:
    """Unicode case folding: ``Straße`` and ``STRASSE`` are equal after it. Texts without special letters only pay for a search."""
    special = _special_folds()
    folds = F.str_to_map(F.lit(",".join(f"{a}:{b}" for a, b in special.items())), F.lit(","), F.lit(":"))
    letters = F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(folds, x), x))
    return F.lower(F.when(c.rlike(f"[{''.join(special)}]"), F.array_join(letters, "")).otherwise(c))


def normalize_company(c: Column) -> Column:
    kept = F.regexp_replace(strip(F.lower(c)), "[^a-z0-9 ]", "")
    return strip(F.regexp_replace(F.regexp_replace(kept, rf"\b({'|'.join(COMPANY_SUFFIXES)})\b", ""), r"\s+", " "))


def normalize_title(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), r"\s+", " "))


def normalize_body(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def content_hash(c: Column) -> Column:
    return F.sha2(normalize_body(c), 256)


def unescape(c: Column) -> Column:
    """All HTML entities, named and numeric, decoded once."""
    return F.pandas_udf(_unescaped, "string")(c)


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


class _Visible(HTMLParser):
    """Collects visible text; block tags put a newline before and after what they hold."""

    HIDDEN = frozenset(("head", "script", "style"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self.hidden.clear()
        elif tag in self.HIDDEN:
            self.hidden.append(tag)
        elif tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.hidden = self.hidden[: self.hidden.index(tag)]
        elif tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data.replace("\n", " "))


def visible_text(source: str | None) -> str:
    parser = _Visible()
    parser.feed(source or "")
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def _visible_texts(sources: pd.Series) -> pd.Series:
    return sources.map(visible_text)


def html_to_text(c: Column) -> Column:
    """Visible text: block tags break lines, other tags vanish, entities decode, blank lines go; null gives an empty text."""
    return F.pandas_udf(_visible_texts, "string")(c)


def role_family(title: Column) -> Column:
    """The first family in order whose pattern occurs, else ``general_swe``."""
    out = F.lit("general_swe")
    for name, pattern in reversed(ROLE_FAMILIES):
        out = F.when(title.rlike(f"(?iU){pattern}"), name).otherwise(out)
    return out


def posting_key(company: Column, posting: Column) -> Column:
    return F.struct(company.alias("company_id"), posting.alias("provider_posting_id"))


def split_csv(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.translate(c, "\n", ","), ","), strip), lambda x: x != "")


def slug(c: Column) -> Column:
    return F.lower(strip(c))


def display_name(c: Column) -> Column:
    """Each run of cased letters capitalised: digits, underscores and apostrophes break words too."""
    first = lambda x: F.upper(F.substring(x, 1, 1))
    word = lambda x: F.concat(F.substring(first(x), 1, 1), F.lower(F.substring(first(x), 2, 9)), F.lower(F.substring(x, 2, 1 << 30)))
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), 1), word), "")
