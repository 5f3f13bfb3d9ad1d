"""String similarities. Token measures are column expressions; the character measure is the one Arrow function here."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.text import tokens


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def char_ratio(a: str, b: str, method: str = "indel") -> float:
    """2 * LCS / total length, or the matcher of the standard library; 0 if either is empty."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if method == "indel" else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    from tessera.functions.crossed import char_sims_of_pairs  # it imports this module

    return pd.Series(char_sims_of_pairs(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")


@F.pandas_udf(DoubleType())
def _gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([char_ratio(x or "", y or "", "gestalt") for x, y in zip(a, b, strict=True)], dtype="float64")


def char_sim(a: Column, b: Column, method: str = "indel") -> Column:
    return (_indel if method == "indel" else _gestalt)(a, b)


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def token_sort_sim(a: Column, b: Column, method: str = "indel") -> Column:
    return char_sim(sorted_tokens(a), sorted_tokens(b), method)


def token_set_sides(a: Column, b: Column) -> tuple[Column, Column]:
    """Common tokens followed by each side's own."""
    return token_set_sides_of(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


def token_set_sides_of(x: Column, y: Column) -> tuple[Column, Column]:
    """Of arrays of distinct tokens."""
    join = lambda t: F.array_join(F.array_sort(t), " ")
    common = join(F.array_intersect(x, y))
    return F.trim(F.concat_ws(" ", common, join(F.array_except(x, y)))), F.trim(F.concat_ws(" ", common, join(F.array_except(y, x))))


def token_set_sim(a: Column, b: Column, method: str = "indel") -> Column:
    left, right = token_set_sides(a, b)
    return F.when((a == "") | (b == ""), 0.0).otherwise(char_sim(left, right, method))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; 0 if both or either are empty."""
    return set_jaccard(F.array_distinct(a), F.array_distinct(b))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeats. The intersection is in no branch, so that it is computed once for all measures of a row."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0)), F.lit(0.0))


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """df with columns of 0 to 1 rounded as round does. That writes each number in decimals, which costs more than the measures do; here only one that may lie half-way is, for what is farther from it than a double's error can't be rounded wrong."""
    at = 10.0**places

    def one(c: Column) -> Column:
        return F.when(F.abs(c * at - F.floor(c * at) - 0.5) < 1e-4, F.round(c, places)).otherwise(F.floor(c * at + 0.5) / at)

    return df.withColumns({n: one(F.col(n)) for n in columns})


def containment(a: Column, b: Column) -> Column:
    return set_containment(F.array_distinct(a), F.array_distinct(b))


def set_containment(a: Column, b: Column) -> Column:
    """Of arrays without repeats."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.least(F.size(a), F.size(b)), F.lit(0)), F.lit(0.0))


def length_diff(a: Column, b: Column) -> Column:
    return relative_difference(F.char_length(a), F.char_length(b))


def relative_difference(x: Column, y: Column) -> Column:
    return F.abs(x - y) / F.greatest(x, y, F.lit(1))
