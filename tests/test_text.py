import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx

CASES = [
    ("O'Reilly & Sons", "name", "oreilly sons"), ("O’Reilly—Sons", "name", "oreilly sons"), ("Café  Münch", "name", "café münch"),
    ("राम स्टोर्स", "name", "राम स्टोर्स"), ("ಕನ್ನಡ ಅಂಗಡಿ", "name", "ಕನ್ನಡ ಅಂಗಡಿ"), ("A_B", "name", "a b"), ("ＡＢＣ", "name", "abc"),
    ("Straße", "name", "strasse"), ("", "name", ""), (None, "name", ""), ("  ", "name", ""),
    ("1795 Westchester Dr., High Point NC", "address", "1795 westchester dr high point nc"),
    ("U.S.A.", "country", "us"), ("France", "country", "fr"), (" Atlantis ", "country", "atlantis"), (None, "country", ""),
]


def test_normalization_cases(spark):
    kinds = {"name": tx.normalize_name, "address": tx.normalize_address, "country": tx.normalize_country}
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(CASES)], "i int, v string")
    got = {r.i: r for r in df.select("i", *[f(F.col("v")).alias(k) for k, f in kinds.items()]).collect()}
    for i, (v, kind, want) in enumerate(CASES):
        assert got[i][kind] == want, (v, got[i][kind])


def test_options(spark):
    df = spark.createDataFrame([("O'Brien Ltd",), ("ltd",)], "v string")
    assert [r[0] for r in df.select(tx.normalize_name(F.col("v"), strip_apostrophes=False)).collect()] == ["o brien ltd", "ltd"]
    assert [r[0] for r in df.select(tx.normalize_name(F.col("v"), strip_suffix=True)).collect()] == ["obrien", ""]


def test_numbers(spark):
    v = ["12 main 12345 678901", "1234567 9999", "no digits", "४५ रोड 1234"]
    rows = spark.createDataFrame([(x,) for x in v], "v string").select(tx.postal_candidate(F.col("v")).alias("p"), tx.house_number(F.col("v")).alias("h"), tx.digit_runs(F.col("v")).alias("r")).collect()
    assert [r.p for r in rows] == ["678901", "9999", None, "1234"]
    assert [r.h for r in rows] == ["12", "1234567", None, "४५"]
    assert rows[0].r == ["12", "12345", "678901"]


def test_missing_and_prefix(spark):
    v = [" N/A ", "nan", "x", None, "s12-9", "zz", ""]
    rows = spark.createDataFrame([(x,) for x in v], "v string").select(tx.is_missing(F.col("v")).alias("m"), tx.id_prefix(F.col("v")).alias("p")).collect()
    assert [r.m for r in rows] == [True, True, False, True, False, False, True]
    assert [r.p for r in rows] == ["<OTHER>", "<OTHER>", "<OTHER>", None, "S12", "<OTHER>", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngrams_against_enumeration(spark, seed):
    rng = random.Random(seed)
    names = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 3))) for _ in range(30)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.char_wb_ngrams(F.col("n")).alias("g")).collect()
    for r in rows:
        want = [f" {w} "[i : i + n] for w in r.n.split() for n in (3, 4, 5) for i in range(len(w) + 3 - n)]
        assert sorted(r.g) == sorted(want)


def test_random_ascii_and_latin(spark):
    rng = random.Random(3)
    v = ["".join(rng.choice("aB3 .,'_-éÜß²ﬁ") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "v string").select(tx.normalize_name(F.col("v"))).collect()]
    for x, g in zip(v, got, strict=True):
        y = unicodedata.normalize("NFKC", x).casefold().replace("'", "")
        assert g == " ".join("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in y).split())
