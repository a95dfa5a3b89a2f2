"""Sentence, section, heading and frame functions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sections in order of priority and words of our own that tell them, for the generic evidence bank; briefs.SECTIONS holds the packets' rules.
SECTIONS = [
    ("guidance", "outlook|guidance|expects"),
    ("revenue", "revenue|sales"),
    ("risk_or_uncertainty", "risk|uncertain"),
    ("earnings_or_eps", "earnings|income"),
    ("legal", "licen[sc]e|warranty"),
]
#: Words of titles.
HEADING_WORDS = ["results", "financial highlights", "guidance", "outlook", "summary"]
#: Stance words in front of a claim.
STANCE = "^(Notably|Importantly|Clearly|Encouragingly|Unfortunately), "


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: s != "")


def section_of(text: Column) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(SECTIONS):
        out = F.when(F.lower(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def packed_paragraphs(text: Column, most: int = 950) -> Column:
    """Greedy packing of sentences into paragraphs of at most so many characters."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc, s):
        fits = (F.length(acc["open"]) == 0) | (F.length(acc["open"]) + 1 + F.length(s) <= most)
        joined = F.when(F.length(acc["open"]) == 0, s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, joined).otherwise(s).alias("open"))

    return F.aggregate(sentences(text), empty, add, lambda acc: F.when(F.length(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def looks_like_heading(text: Column, tag: Column | None = None) -> Column:
    """A heading element, or a text of at most 140 characters that ends in a colon or has at most 12 words, all in capitals or with a word that titles have."""
    t = F.trim(text)
    few = F.size(F.split(t, r"\s+")) <= 12
    capitals = (t == F.upper(t)) & (t != F.lower(t))
    titled = F.lower(t).rlike("|".join(HEADING_WORDS))
    plain = (F.length(t) <= 140) & (t.endswith(":") | (few & (capitals | titled)))
    return plain if tag is None else tag.rlike("^h[0-9]+$") | plain


def protected_tokens(text: Column) -> Column:
    """Numbers, dates and ids as a sorted list, repeats kept."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,][0-9]+)*%?|[SX][0-9]{3,4})"), F.lit(1)))


def safe_edit(claim: Column) -> Column:
    """The claim without an opening stance, if its protected tokens stay the same."""
    bare = F.regexp_replace(claim, STANCE, "")
    edited = F.concat(F.upper(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))
    return F.when((bare != claim) & (protected_tokens(edited) == protected_tokens(claim)), edited).otherwise(claim)


def repaired_ids(text: Column) -> Column:
    """Source ids with one or two digits padded to three."""
    one = F.regexp_replace(text, r"\b([SX])(?=\d\b)", "$1" + "\\00")
    return F.regexp_replace(one, r"\b([SX])(?=\d{2}\b)", "$1" + "\\0")


def marker_count(text: Column, words: list[str]) -> Column:
    return F.regexp_count(F.lower(text), F.lit(r"\b(" + "|".join(words) + r")\b"))


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles and tags dropped, common entities decoded, white space squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))
