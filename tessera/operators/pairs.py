"""The 26 features of candidate pairs, and their labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text as tx
from tessera.functions.crossed import PLACES, RATIO_BITS, Crossed, words_of
from tessera.settings import DEFAULTS, Settings

#: The order of the features is part of the contract.
FEATURES = [
    "name_missing_s1", "name_missing_cand", "name_exact_match", "name_char_sim", "name_token_sort_sim", "name_token_set_sim",
    "name_token_jaccard", "name_token_containment", "name_len_diff", "address_missing_s1", "address_missing_cand",
    "address_exact_match", "address_char_sim", "address_token_jaccard", "address_len_diff", "address_numeric_jaccard",
    "postal_both_present", "postal_match", "house_number_both_present", "house_number_match", "country_missing_s1",
    "country_missing_cand", "country_match", "name_address_sim_product", "name_high_address_low_conflict", "name_low_address_high_support",
]
CHAR_FEATURES = ["name_char_sim", "name_token_sort_sim", "name_token_set_sim", "address_char_sim"]
DERIVED_FEATURES = ["name_address_sim_product", "name_high_address_low_conflict", "name_low_address_high_support"]
RATIO_FEATURES = ["name_token_jaccard", "name_token_containment", "name_len_diff", "address_token_jaccard", "address_len_diff", "address_numeric_jaccard"]  # other native ones are 0 or 1
NATIVE_FEATURES = [f for f in FEATURES if f not in CHAR_FEATURES + DERIVED_FEATURES]


def get_feature_names() -> list[str]:
    return list(FEATURES)


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def side_values(name: Column, address: Column) -> dict[str, Column]:
    """What the native features need of one side: its words and digits as sets, postal code and house number."""
    return {"t": F.array_distinct(tx.tokens(name)), "u": F.array_distinct(tx.tokens(address)), "d": tx.digit_runs(address), "p": tx.postal_candidate(address), "h": tx.house_number(address)}


def native_features(prepared: bool = False) -> dict[str, Column]:
    """Of the columns n1, n2, a1, a2, c1, c2 (names, addresses, countries of both sides), in doubles. prepared: each side's values are columns too (t1, t2, ...), computed before the pairs were made."""
    n1, n2, a1, a2, c1, c2 = map(F.col, ("n1", "n2", "a1", "a2", "c1", "c2"))
    names, addresses, countries = (n1 != "") & (n2 != ""), (a1 != "") & (a2 != ""), (c1 != "") & (c2 != "")
    on = lambda both, value, default=0.0: F.when(both, value).otherwise(default)
    x, y = ({k: F.col(f"{k}{i}") for k in "tudph"} if prepared else side_values(n, a) for i, n, a in ((1, n1, a1), (2, n2, a2)))
    p1, p2, h1, h2 = x["p"], y["p"], x["h"], y["h"]
    postal, house = p1.isNotNull() & p2.isNotNull(), h1.isNotNull() & h2.isNotNull()
    return {
        "name_missing_s1": _flag(n1 == ""), "name_missing_cand": _flag(n2 == ""), "name_exact_match": _flag(names & (n1 == n2)),
        "name_token_jaccard": sim.set_jaccard(x["t"], y["t"]), "name_token_containment": sim.set_containment(x["t"], y["t"]),
        "name_len_diff": on(names, sim.length_diff(n1, n2), 1.0),
        "address_missing_s1": _flag(a1 == ""), "address_missing_cand": _flag(a2 == ""), "address_exact_match": _flag(addresses & (a1 == a2)),
        "address_token_jaccard": sim.set_jaccard(x["u"], y["u"]), "address_len_diff": on(addresses, sim.length_diff(a1, a2), 1.0),
        "address_numeric_jaccard": sim.set_jaccard(x["d"], y["d"]),
        "postal_both_present": _flag(addresses & postal), "postal_match": _flag(addresses & postal & (p1 == p2)),
        "house_number_both_present": _flag(addresses & house), "house_number_match": _flag(addresses & house & (h1 == h2)),
        "country_missing_s1": _flag(c1 == ""), "country_missing_cand": _flag(c2 == ""), "country_match": _flag(countries & (c1 == c2)),
    }


def _with_side(rows: DataFrame, side_id: str, i: int, sources: list[DataFrame], s: Settings, prepared: bool = False) -> DataFrame:
    """prepared: also what features need of the side's texts (side_values, and s, the name's words in order). It is found for each row of the sources, not for each pair."""

    def lookup(df: DataFrame, rank: int) -> DataFrame:
        return df.select(F.col(s.entity_id).alias(side_id), F.struct(F.lit(rank).alias("rank"), F.col(s.name_norm).alias("n"), F.col(s.address_norm).alias("a"), F.col(s.country_norm).alias("c")).alias("v"))

    rows_of = [lookup(d, rank) for rank, d in enumerate(sources)]
    once = reduce(DataFrame.unionByName, rows_of).groupBy(side_id).agg(F.min("v").alias("v"))
    names = [f"{x}{i}" for x in "nac"]
    values = side_values(F.col("v.n"), F.col("v.a")) | {"s": sim.sorted_tokens(F.col("v.n"))} if prepared else {}
    out = rows.join(once.select(side_id, *[F.col(f"v.{n[0]}").alias(n) for n in names], *[c.alias(f"{k}{i}") for k, c in values.items()]), side_id, "left")
    return out.withColumns({f"{k}{i}": F.coalesce(f"{k}{i}", F.array().cast("array<string>")) for k in "tud" if k in values}).na.fill("", names + [f"s{i}"] * prepared)


def with_left_attributes(rows: DataFrame, s1: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Rows with n1, a1, c1 of their left id; empty for unknown ids, the least attributes of one that repeats."""
    return _with_side(rows, s.left_id, 1, [s1], s)


def with_right_attributes(rows: DataFrame, s2: DataFrame, s3: DataFrame | None, s: Settings = DEFAULTS) -> DataFrame:
    """Rows with n2, a2, c2 of their candidate; empty for unknown ids. An id that repeats counts once: of s2 before s3, then the least attributes."""
    return _with_side(rows, s.right_id, 2, [s2] if s3 is None else [s2, s3], s)


def with_attributes(pairs: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame | None, s: Settings = DEFAULTS) -> DataFrame:
    """Pairs with the attributes of both sides. Pairs that a join makes of few rows are better made of sides that have them: then no pair is shuffled."""
    return with_right_attributes(with_left_attributes(pairs, s1, s), s2, s3, s)


def build_features(pairs: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame | None = None, s: Settings = DEFAULTS, already_normalized: bool = True, method: str = "indel") -> DataFrame:
    """Pair ids and the 26 features as floats; computed in doubles, cast last. Directories that aren't normalized pass through the ASCII fallback."""
    if not already_normalized:
        plain = {s.name_norm: tx.normalize_ascii_fallback(F.col(s.name)), s.address_norm: tx.normalize_ascii_fallback(F.col(s.address)), s.country_norm: tx.normalize_ascii_fallback(F.col(s.country))}
        s1, s2 = s1.withColumns(plain), s2.withColumns(plain)
        s3 = None if s3 is None else s3.withColumns(plain)
    d = _with_side(_with_side(pairs, s.left_id, 1, [s1], s, True), s.right_id, 2, [s2] if s3 is None else [s2, s3], s, True)
    addresses = (F.col("a1") != "") & (F.col("a2") != "")
    # pairs aren't shuffled to find equal ones: a batch's equal pairs of texts are compared once. All measures are asked for in one step, so that rows go to the kernel once
    left, right = sim.token_set_sides_of(F.col("t1"), F.col("t2"))
    d = d.select("*", sim.char_sim(F.col("n1"), F.col("n2"), method).alias("name_char_sim"), sim.char_sim(F.col("s1"), F.col("s2"), method).alias("name_token_sort_sim"), sim.char_sim(left, right, method).alias("name_token_set_sim"), sim.char_sim(F.col("a1"), F.col("a2"), method).alias("address_char_sim"))
    d = d.withColumn("name_token_set_sim", F.when((F.col("n1") != "") & (F.col("n2") != ""), F.col("name_token_set_sim")).otherwise(0.0)).withColumns(native_features(prepared=True))
    f4, f13 = F.col("name_char_sim"), F.col("address_char_sim")
    d = d.withColumns({
        "name_address_sim_product": f4 * f13,
        "name_high_address_low_conflict": _flag((f4 >= 0.85) & addresses & (f13 <= 0.4)),
        "name_low_address_high_support": _flag((f4 <= 0.6) & (f13 >= 0.8)),
    })
    return d.select(s.left_id, s.right_id, *[F.col(f).cast("float").alias(f) for f in FEATURES])


#: Rows of both sides that are compared with each other at a time, and rows of a result that are handed on at a time.
LEFT_ROWS, RIGHT_ROWS, OUT_ROWS = 256, 2048, 1 << 15
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bundles(df: DataFrame, key: list[str], side_id: str, i: int, size: int) -> DataFrame:
    """Rows of up to size rows of one key: arrays of ids, names, addresses, countries and, where df has them, true matches (m)."""
    ranked = df.withColumn(f"_b{i}", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(side_id)) - 1) / size))
    row = F.struct(F.col(side_id).alias("id"), *[F.col(f"{x}{i}").alias(x) for x in "nac"], *[c for c in ("m",) if c in df.columns])
    return ranked.groupBy(*key, f"_b{i}").agg(F.collect_list(row).alias(f"_s{i}"))


def _fields(column: pa.ListArray, at: int) -> tuple[pa.Array, dict[str, list[str]], list[list[str]] | None]:
    rows = column[at].values
    return rows.field("id"), {x: rows.field(x).to_pylist() for x in "nac"}, rows.field("m").to_pylist() if rows.type.get_field_index("m") >= 0 else None


def _true_counts(matches: list[list[str] | None], ids: pa.Array) -> np.ndarray:
    """(left, right): how often the left row's matches have the right id."""
    where: dict[str, list[int]] = {}
    for k, v in enumerate(ids.to_pylist()):
        where.setdefault(v, []).append(k)
    out = np.zeros((len(matches), len(ids)), np.int32)
    for i, m in enumerate(matches):
        for v in m or ():
            out[i, where.get(v, [])] += 1
    return out


def with_matches(left: DataFrame, truth: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """left with m, the ids that the truth has for its id; repeats stay. crossed_features labels pairs by it."""
    return left.join(build_training_labels(truth, s).groupBy(s.left_id).agg(F.collect_list(s.right_id).alias("m")), s.left_id, "left")


def crossed_features(left: DataFrame, right: DataFrame, key: list[str], features: list[str], s: Settings = DEFAULTS, kind: str = "float", score: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Features of all pairs of a left and a right row with equal keys (not null). Bundles of rows are joined, not rows: a kernel makes the pairs and their features as matrices, so that no pair is shuffled and nothing is larger than a bundle by a bundle.

    left has its id, n1, a1 and c1, right has its id, n2, a2 and c2; ids and values aren't null. kind: float, double or code (native features, rounded and packed into integers for decoded).
    Where left has m (with_matches), pairs get the label that attach_labels gives them; its repeats too.
    score: of the features (feature, pair) of a batch, the column proba; it then stands in place of the features.
    """
    spark, lid, rid = left.sparkSession, s.left_id, s.right_id
    if spark.conf.get(_BATCH) == "67108864b":  # Spark's default; another value is the user's
        spark.conf.set(_BATCH, "4m")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    bundles = _bundles(left, key, lid, 1, LEFT_ROWS).join(_bundles(right, key, rid, 2, RIGHT_ROWS), key)
    bundles = bundles.repartition(n, *key, "_b1", "_b2").select("_s1", "_s2")
    dtype, labels = np.float32 if kind == "float" else np.float64, "m" in left.columns
    coded = words_of(features, RATIO_FEATURES) if kind == "code" else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (ids1, x, matches), (ids2, y, _) = (_fields(batch.column(c), at) for c in (0, 1))
                both, step = Crossed(x, y), max(1, OUT_ROWS // len(ids2))
                true = _true_counts(matches, ids2) if labels else None
                for i in range(0, len(ids1), step):
                    rows = slice(i, min(i + step, len(ids1)))
                    out = {lid: ids1.take(pa.array(np.repeat(np.arange(i, rows.stop), len(ids2)))), rid: pa.concat_arrays([ids2] * (rows.stop - i))}
                    if labels:
                        times = true[rows].ravel()
                        out["label"] = pa.array((times > 0).astype(np.int8))
                    if coded:
                        out |= {w: pa.array(both.packed(*word, RATIO_FEATURES, rows)) for w, word in coded.items()}
                        yield pa.RecordBatch.from_pydict(out)
                        continue
                    values = [both.feature(f, rows, dtype) for f in features]
                    out |= dict(zip(features, map(pa.array, values), strict=True)) if score is None else {"proba": pa.array(score(np.stack(values)))}
                    out = pa.RecordBatch.from_pydict(out)
                    if labels and times.max() > 1:
                        out = out.take(pa.array(np.repeat(np.arange(len(times)), np.maximum(times, 1))))
                    yield out

    columns = [f"{lid} string", f"{rid} string", *["label byte"] * labels, *([f"{w} long" for w in coded] or [f"{f} {kind}" for f in features] if score is None else ["proba double"])]
    return bundles.mapInArrow(run, ", ".join(columns))


def decoded(features: list[str]) -> dict[str, Column]:
    """The features that crossed_features gives as kind code, in doubles."""
    place = {f: (w, at) for w, (_, fields) in words_of(features, RATIO_FEATURES).items() for f, at in fields}
    bits = lambda f, size: F.shiftright(F.col(place[f][0]), place[f][1]).bitwiseAND(F.lit((1 << size) - 1).cast("long")).cast("double")
    return {f: bits(f, RATIO_BITS) / 10.0**PLACES if f in RATIO_FEATURES else bits(f, 1) for f in features}


def build_training_labels(truth: DataFrame, s: Settings = DEFAULTS, dedupe: bool = False) -> DataFrame:
    """One row for each id in the comma lists; blanks are dropped, ids trimmed, repeats kept unless asked otherwise."""
    d = truth.select(s.left_id, F.explode(F.split(F.coalesce(s.matches, F.lit("")), ",")).alias(s.right_id))
    d = d.withColumn(s.right_id, F.trim(s.right_id)).filter(F.col(s.right_id) != "")
    return d.distinct() if dedupe else d


def attach_labels(features: DataFrame, truth: DataFrame, s: Settings = DEFAULTS, dedupe: bool = False) -> DataFrame:
    """Adds label: 1 if the pair is in the truth, else 0. An id repeated in a truth list repeats its row, unless dedupe."""
    positive = build_training_labels(truth, s, dedupe).withColumn("label", F.lit(1))
    return features.join(positive, [s.left_id, s.right_id], "left").withColumn("label", F.coalesce("label", F.lit(0)).cast("byte"))
