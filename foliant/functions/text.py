"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a keyword query drops.
STOPWORDS = frozenset(
    """
    a an the is are was were be been being have has had do does did will would could should may might shall can need must
    in on at to for of with by from as into about between through during before after above below up down out off over under
    how what which who whom when where why that this these those it its and but or nor not no so if then
    i me my we our you your he she they his her them their
    """.split()
)

# Section names of back and front matter.
BACK_MATTER = ("index", "bibliography", "glossary", "colophon", "about the authors", "about the author", "references", "further reading")
FRONT_MATTER = ("copyright", "title page", "dedication", "half title", "cover", "table of contents", "contents", "list of figures", "list of tables")

SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Letters U+0080 to U+1FFF whose canonical base is one other letter, and those bases."""
    pairs = []
    for code in range(0x80, 0x2000):
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(code) and chr(code).isalpha():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents, as the keyword index sees it.  Plain ASCII needs no table."""
    src, dst = accent_table()
    low = F.lower(text)
    return F.when(F.length(text) == F.octet_length(text), low).otherwise(F.regexp_replace(F.translate(low, src, dst), r"\p{M}+", ""))


def tokens(text: Column) -> Column:
    """Runs of letters and digits; everything else separates."""
    return F.filter(F.split(fold(text), SEPARATORS), lambda t: t != "")


def fold_py(text: str) -> str:
    """fold() for a query on the driver."""
    src, dst = accent_table()
    return "".join(c for c in text.lower().translate(str.maketrans(src, dst)) if not unicodedata.category(c).startswith("M"))


def tokens_py(text: str) -> list[str]:
    out, held = [], ""
    for c in fold_py(text) + " ":
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            held += c
        elif held:
            out.append(held)
            held = ""
    return out


@F.pandas_udf(T.StringType())
def normalize_unicode(s: pd.Series) -> pd.Series:
    """NFKD without combining marks, lower case; Spark has no built-in for it."""
    return s.map(normalize_py, na_action="ignore")


def normalize_py(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def boilerplate(path: Column) -> Column:
    """Whether a section path has a front or back matter name, or an appendix."""
    names = BACK_MATTER + FRONT_MATTER
    return F.coalesce(F.exists(path, lambda x: F.lower(x).isin(*names) | F.lower(x).startswith("appendix")), F.lit(False))


def joined_path(path: Column) -> Column:
    return F.array_join(path, " > ")


def section_matches(query: str, path_text: Column) -> Column:
    """Normalised substring; a query that ends in a digit must not run on in a word."""
    query = normalize_py(query).strip()
    if not query:
        return F.lit(False)
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", query)
    if query[-1].isdigit():
        return path_text.rlike(rf"{quoted}([^\p{{L}}\p{{N}}_]|$)")
    return path_text.contains(query)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def split_authors(text: Column) -> Column:
    """Names separated by semicolons if there are any, else by commas."""
    parts = F.when(text.contains(";"), F.split(text, ";")).otherwise(F.split(text, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def strip_edition(title: Column) -> Column:
    ordinal = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth"
    return F.trim(F.regexp_replace(title, rf"(?i)[,:(]?\s*\b(\d+(st|nd|rd|th)|{ordinal})\s+edition\b\)?", ""))


def find_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b((19|20)\d{2})\b", 1), F.lit(""))


def isbn_clean(text: Column) -> Column:
    """Digits and X of an ISBN of 10 or 13 places, else null."""
    bare = F.upper(F.regexp_replace(F.regexp_replace(text, "(?i)^urn:isbn:", ""), "[^0-9Xx]", ""))
    return F.when(bare.rlike("^([0-9]{9}[0-9X]|[0-9]{13})$"), bare)


def _digit(c: Column) -> Column:
    return F.when(c == "X", 10).otherwise(F.try_to_number(c, F.lit("9")).cast("int"))


def isbn_valid(text: Column) -> Column:
    """Checksum of a clean ISBN."""
    places = F.transform(F.split(text, ""), lambda c, i: F.struct(_digit(c).alias("d"), i.alias("i")))
    ten = F.aggregate(places, F.lit(0), lambda a, x: a + x["d"] * (10 - x["i"])) % 11 == 0
    thirteen = F.aggregate(places, F.lit(0), lambda a, x: a + x["d"] * F.when(x["i"] % 2 == 0, 1).otherwise(3)) % 10 == 0
    prefix = text.startswith("978") | text.startswith("979")
    return F.coalesce(F.when(F.length(text) == 10, ten).when(F.length(text) == 13, thirteen & prefix), F.lit(False))


def isbn_13(text: Column) -> Column:
    """The 13-digit form of a valid clean ISBN, else null."""
    body = F.concat(F.lit("978"), F.substring(text, 1, 9))
    places = F.transform(F.split(body, ""), lambda c, i: _digit(c) * F.when(i % 2 == 0, 1).otherwise(3))
    check = (10 - F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10) % 10
    return F.when(isbn_valid(text), F.when(F.length(text) == 10, F.concat(body, check.cast("string"))).otherwise(text))


def plain_name(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\W+", ""))


def looks_like_file_name(title: Column) -> Column:
    """No spaces, but two or more hyphens or underscores."""
    marks = F.length(title) - F.length(F.regexp_replace(title, "[-_]", ""))
    return ~title.contains(" ") & (marks >= 2)


# Parts of names of monospace fonts.
MONOSPACE = ("courier", "consolas", "mono", "menlo", "sourcecode", "cmtt", "nimbusmon", "inconsolata", "sftt", "txtt", "lucidaconsole", "firacode")


def monospace(font: Column) -> Column:
    """Whether the letters of a font's name, after the last plus sign, hint at fixed width."""
    return F.regexp_replace(F.lower(F.element_at(F.split(font, r"\+"), -1)), "[^a-z]", "").rlike("|".join(MONOSPACE))


def is_monospace(font: str) -> bool:
    """The same of one name, outside a plan."""
    return re.search("|".join(MONOSPACE), re.sub("[^a-z]", "", font.lower().rpartition("+")[2])) is not None


def dehyphenate(text: Column) -> Column:
    """Join words that a line end cut between lower-case letters."""
    return F.regexp_replace(text, r"(?<=\p{Ll})[-­]\n(?=\p{Ll})", "")


def truncate_at_boundary(text: Column, limit: int) -> Column:
    """At most limit characters, cut after a sentence or at a space in the last two fifths, else hard."""
    head = F.substring(text, 1, limit)

    def last(mark: str) -> Column:
        at = F.locate(mark[::-1], F.reverse(head))
        return F.when(at > 0, limit - at + 1 - len(mark) + 1)

    cut = None
    for mark in (". ", "! ", "? ", ".\n"):
        at = last(mark)
        here = F.when(at - 1 >= int(limit * 0.6), at)
        cut = here if cut is None else F.coalesce(cut, here)
    space = last(" ")
    cut = F.coalesce(cut, F.when(space - 1 >= int(limit * 0.6), space - 1), F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.substring(text, F.lit(1), cut.cast("int")))


def preview(text: Column, limit: int = 80) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def is_ascii_art(text: Column) -> Column:
    """Two lines or more of 20 or more characters, over 15 % (and over 5) of them drawing characters."""
    box = r"[^─-╿|+\-=<>/\\^v*#]"
    drawn = F.length(F.regexp_replace(text, box, ""))
    return (F.length(text) >= 20) & (F.size(F.split(F.trim(text), "\n")) >= 2) & (drawn > 5) & (drawn / F.length(text) > 0.15)


def code_language(classes: Column) -> Column:
    """The language in a class list like ``language-python`` or ``lang-js``."""
    return F.nullif(F.lower(F.regexp_extract(classes, r"(?i)\b(?:language|lang)-([A-Za-z0-9+#]+)", 1)), F.lit(""))


def is_math(text: Column) -> Column:
    return text.rlike(r"(?s)<math|\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{")


def token_count(text: Column) -> Column:
    """Words and punctuation marks; the default token counter."""
    return F.when(F.length(text) == 0, 0).otherwise(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")))


def table_text(rows: Column) -> Column:
    """Pipe rows of array<array<string>> with a rule below the first."""
    escaped = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(escaped, 1, 1), F.array(rule), F.slice(escaped, F.lit(2), F.greatest(F.size(escaped) - 1, F.lit(0)))), "\n")
