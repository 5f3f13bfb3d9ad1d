"""Text normalization as column expressions; all of it stays in the JVM.

NFKC and case folding come from the ICU library that Spark ships. Plain ASCII takes the cheap branch. Java's classes
for \\d, \\s and \\w are ASCII only, so Unicode properties are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.settings import COUNTRY_ALIASES, DEFAULTS, LEGAL_SUFFIXES, Settings

_APOSTROPHES = "‘’ʼ`´"
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def safe(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _ascii(c: Column) -> Column:
    return c.rlike(r"^\p{ASCII}*$")


def nfkc(c: Column) -> Column:
    return F.when(_ascii(c), c).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)))


def fold(c: Column) -> Column:
    return F.when(_ascii(c), F.lower(c)).otherwise(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True)))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def _words(c: Column, strip_apostrophes: bool) -> Column:
    c = F.translate(fold(nfkc(safe(c))), _APOSTROPHES, "'" * len(_APOSTROPHES))
    c = F.replace(c, F.lit("'"), F.lit("" if strip_apostrophes else " "))
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", " "))


def strip_legal_suffix(c: Column) -> Column:
    """Drops one trailing token that is a legal suffix."""
    return F.regexp_replace(c, f"(^| )({'|'.join(LEGAL_SUFFIXES)})$", "")


def normalize_name(c: Column, strip_apostrophes: bool = True, strip_suffix: bool = False) -> Column:
    c = _words(c, strip_apostrophes)
    return strip_legal_suffix(c) if strip_suffix else c


def normalize_address(c: Column, strip_apostrophes: bool = True) -> Column:
    return _words(c, strip_apostrophes)


def normalize_country(c: Column) -> Column:
    c = collapse(F.replace(fold(nfkc(safe(c))), F.lit("."), F.lit("")))
    aliases = F.create_map(*[F.lit(x) for pair in COUNTRY_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, c), c)


def normalize_source(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Adds the three normalized columns; raw ones stay."""
    return df.withColumns({s.name_norm: normalize_name(F.col(s.name)), s.address_norm: normalize_address(F.col(s.address)), s.country_norm: normalize_country(F.col(s.country))})


def normalize_ascii_fallback(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(nfkc(safe(c))), r"[^0-9a-zA-Z\s]", " "))


def profile_normalize(c: Column) -> Column:
    """The profiler's: keeps underscores, drops combining marks; nan, none and null are empty."""
    c = F.trim(safe(c))
    c = F.when(F.lower(c).isin("nan", "none", "null"), "").otherwise(c)
    return collapse(F.regexp_replace(fold(nfkc(c)), r"[^\p{L}\p{N}_\s]", " "))


def is_missing(c: Column) -> Column:
    return F.lower(collapse(safe(c))).isin("", "nan", "none", "null", "n/a", "na")


def id_prefix(c: Column) -> Column:
    """S and digits before the first hyphen, upper-cased; <OTHER> for other ids; null for blank ones."""
    p = F.upper(F.regexp_extract(F.trim(safe(c)), r"(?i)^(S\p{Nd}+)-", 1))
    return F.when(F.trim(safe(c)) != "", F.when(p != "", p).otherwise("<OTHER>"))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def digit_runs(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), F.lit(1)))


def postal_candidate(c: Column) -> Column:
    """The first of the longest digit runs of 4 to 6 digits."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), F.lit(1))
    first = lambda n: F.try_element_at(F.filter(runs, lambda r: F.char_length(r) == n), F.lit(1))
    return F.coalesce(first(6), first(5), first(4))


def house_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\p{Nd}+)", 1), F.lit(""))


def first_token(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def prefix_key(c: Column, n: int = DEFAULTS.bucket_chars) -> Column:
    return F.substring(c, 1, n)


def char_wb_ngrams(c: Column, sizes: tuple[int, ...] = DEFAULTS.grams) -> Column:
    """Character n-grams of each word padded by a blank on both sides, with multiplicity."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))

        def sized(n: int) -> Column:
            places = F.sequence(F.lit(1), F.char_length(padded) - n + 1)
            return F.when(F.char_length(padded) >= n, F.transform(places, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

        return F.concat(*map(sized, sizes))

    return F.flatten(F.transform(tokens(c), of))


def digest(c: Column) -> Column:
    """SHA-1 of the text in UTF-8, null as the empty text."""
    return F.sha1(F.encode(safe(c), "UTF-8"))


def formatted_number(c: Column) -> Column:
    """With commas between thousands."""
    return F.format_number(c, 0)


def formatted_percent(c: Column) -> Column:
    """With two decimals and a percent sign."""
    return F.concat(F.format_string("%.2f", c.cast("double")), F.lit("%"))
