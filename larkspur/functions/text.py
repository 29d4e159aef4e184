"""Names and titles as column expressions, all of them built-in functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: quote and dash variants
QUOTES = "‘’ʼ`´ʹ′"
DASHES = "­‐‑‒–—―−－"
#: fixed values: post-nominals
POSTNOMINALS = ("AO", "AM", "OAM", "AC", "AK", "OL", "FAA", "FAHMS", "FTSE", "FASSA", "FAHA", "FRS", "FREng", "CBE", "OBE", "MBE", "KBE", "DBE")
#: fixed values: words of field names that carry no content
FIELD_STOPWORDS = ("a", "an", "and", "at", "excl", "for", "in", "incl", "of", "other", "the", "to")
#: fixed values: entities and what they stand for, in the order they are replaced
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))
#: fixed values: macros that only set type
MACROS = ("mathbb", "mathrm", "mathit", "mathsf", "mathcal", "textit", "textbf", "textrm", "emph", "it", "rm", "bf", "sf")
#: fixed values: letters with a bare and a two-letter spelling
SPELLINGS = {"ü": ("u", "ue"), "ö": ("o", "oe"), "ä": ("a", "ae"), "ß": ("s", "ss"), "ø": ("o", "oe"), "å": ("a", "aa"), "ł": ("l",)}


def _bare_letters() -> tuple[str, str]:
    """Every character whose canonical decomposition is one ASCII character and marks, and that character."""
    marked, bare = ["ı", "İ"], ["i", "I"]
    for code in range(0xA0, 0x2000):
        plain = unicodedata.normalize("NFD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1 and code != 0x130:
            marked.append(chr(code))
            bare.append(plain)
    return "".join(marked), "".join(bare)


_MARKED, _BARE = _bare_letters()


def canonical_punctuation(c: Column) -> Column:
    return F.translate(F.translate(c, QUOTES, "'" * len(QUOTES)), DASHES, "-" * len(DASHES))


def strip_diacriticals(c: Column) -> Column:
    """Quotes and dashes made plain, marks taken off letters, and all else that is not ASCII dropped; null stays null."""
    return F.regexp_replace(F.translate(canonical_punctuation(c), _MARKED, _BARE), r"[^\x00-\x7F]", "")


def strip_postnominals(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?i)(?:[\s,]+(?:" + "|".join(POSTNOMINALS) + r"))+\s*$", ""), r"^\s+|\s+$", "")


def strip_parens(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", ""))


def norm_alpha(c: Column) -> Column:
    """A key of lower-case letters only."""
    return F.regexp_replace(F.lower(strip_diacriticals(strip_parens(c))), "[^a-z]", "")


def letter_runs(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def tokens(c: Column) -> Column:
    return letter_runs(strip_diacriticals(c))


def name_part_tokens(c: Column) -> Column:
    """Letter runs, apostrophes dropped; runs of two to four letters without a vowel are initials and split. None for null."""
    runs = letter_runs(F.regexp_replace(strip_diacriticals(F.coalesce(c, F.lit(""))), "'", ""))
    return F.flatten(F.transform(runs, lambda t: F.when(t.rlike("^[^aeiouy]{2,4}$"), F.filter(F.split(t, ""), lambda x: x != "")).otherwise(F.array(t))))


def spellings(c: Column) -> Column:
    """Every spelling of a name, sorted, in lower case: each letter with two spellings doubles them; none for null or empty."""
    ways = F.create_map(*[x for letter, all_ in SPELLINGS.items() for x in (F.lit(letter), F.array(*map(F.lit, all_)))])
    letters = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), ""), lambda x: x != "")
    grown = F.aggregate(letters, F.array(F.lit("")), lambda so_far, letter: F.flatten(F.transform(so_far, lambda s: F.transform(F.coalesce(F.element_at(ways, letter), F.array(letter)), lambda w: F.concat(s, w)))))
    return F.array_sort(F.filter(F.array_distinct(F.transform(grown, lambda s: F.trim(strip_diacriticals(s)))), lambda s: s != ""))


def field_tokens(c: Column) -> Column:
    """Content words of a field's name; none for null."""
    return F.filter(letter_runs(F.coalesce(c, F.lit(""))), lambda t: (F.length(t) > 1) & ~t.isin(*FIELD_STOPWORDS))


def expanded_field_tokens(own: Column, canonical: Column, aliases: Column) -> Column:
    """Sorted union of the words of a name, of its canonical name (or null), and of its aliases (an array or null)."""
    of_aliases = F.flatten(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), field_tokens))
    return F.array_sort(F.array_distinct(F.concat(field_tokens(own), field_tokens(canonical), of_aliases)))


def longest(names: Column) -> Column:
    """The longest string of an array, the first of equals; null for none."""
    return F.aggregate(names, F.lit(None).cast("string"), lambda best, t: F.when(best.isNull() | (F.length(t) > F.length(best)), t).otherwise(best))


def name_key(family: Column, first: Column) -> Column:
    f, g = norm_alpha(family), F.substring(F.lower(strip_diacriticals(F.trim(first))), 1, 1)
    return F.when((f != "") & (g != ""), F.concat_ws("_", f, g))


def title_key(c: Column) -> Column:
    """Entities, tags, type-setting, accents, quotes, dashes, slashes, trailing punctuation, space and case made alike; null for null or empty."""
    out = c
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, "<[^>]+>", "")
    for _ in range(3):  # nested macros
        out = F.regexp_replace(out, r"\\(?:" + "|".join(MACROS) + r")\s*\{([^{}]*)\}", "$1")
    out = F.regexp_replace(out, "\\\\[\"'`^~]", "")
    out = strip_diacriticals(F.regexp_replace(out, r"\\", ""))
    out = F.regexp_replace(out, r"[${}^_\"']", "")
    out = F.regexp_replace(out, r"[.?!:;]+\s*$", "")
    out = F.regexp_replace(F.regexp_replace(out, "-", " "), r"\s*/\s*", "/")
    return F.when(c != "", F.lower(F.trim(F.regexp_replace(out, r"\s+", " "))))


def loose_title_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))


def author_id(url: Column) -> Column:
    return F.regexp_extract(url, "([0-9]+)$", 1).try_cast("bigint")


def leading_year(c: Column) -> Column:
    """The four digits that a string begins with, or null."""
    return F.nullif(F.regexp_extract(c, r"^\d{4}", 0), F.lit(""))


def strip_code_prefix(c: Column) -> Column:
    """'0801 - Artificial intelligence' without its code."""
    return F.regexp_replace(c, r"^[0-9]+\s*-\s*", "")
