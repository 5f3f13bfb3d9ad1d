"""Profiles of directories and of the truth, as rows of metrics. They hold aggregates, countries and id prefixes, never names or addresses."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.settings import DEFAULTS, Settings

log = logging.getLogger(__name__)
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _present(df: DataFrame, s: Settings) -> list[str]:
    missing = [c for c in s.directory_columns if c not in df.columns]
    if missing:
        log.warning("columns are missing: %s", missing)
    return [c for c in s.directory_columns if c in df.columns]


def missing_counts(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(column, rows, n_missing, n_empty), in one pass."""
    cols = _present(df, s)
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(tx.is_missing(F.col(c))).alias(f"m{i}"), F.count_if(tx.safe(F.col(c)) == "").alias(f"e{i}")]
    row = df.agg(*aggs)
    return row.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("n_missing"), F.col(f"e{i}").alias("n_empty")) for i, c in enumerate(cols)])).alias("x")).select("x.column", "rows", "x.n_missing", "x.n_empty")


def length_stats(df: DataFrame, s: Settings = DEFAULTS, exact: bool = True) -> DataFrame:
    """(column, min, max, p25, p50, p75, p95) of the lengths of names and addresses that aren't missing, over all rows; linear interpolation, or approximate."""
    cols = [c for c in (s.name, s.address) if c in df.columns]
    size = lambda c: F.when(~tx.is_missing(F.col(c)), F.char_length(F.col(c)))
    q = F.percentile if exact else F.percentile_approx
    aggs = [a for i, c in enumerate(cols) for a in (F.min(size(c)).alias(f"lo{i}"), F.max(size(c)).alias(f"hi{i}"), q(size(c), list(QUANTILES.values())).alias(f"q{i}"))]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").cast("long").alias("min_len"), F.col(f"hi{i}").cast("long").alias("max_len"), *[F.col(f"q{i}")[j].cast("double").alias(n) for j, n in enumerate(QUANTILES)]) for i, c in enumerate(cols)])
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def top_countries(df: DataFrame, n: int = 20, s: Settings = DEFAULTS) -> DataFrame:
    c = F.trim(tx.safe(F.col(s.country)))
    return df.groupBy(F.when(c == "", "<EMPTY>").otherwise(c).alias("country")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "country").limit(n)


def prefix_counts(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    return df.select(tx.id_prefix(F.col(s.entity_id)).alias("prefix")).filter("prefix is not null").groupBy("prefix").agg(F.count("*").alias("n"))


def id_counts(df: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(n_ids, n_unique, n_duplicates) of the ids that aren't blank."""
    ids = df.select(F.trim(tx.safe(F.col(s.entity_id))).alias("id")).filter("id <> ''")
    return ids.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_ids"), F.count("*").alias("n_unique")).withColumn("n_duplicates", F.col("n_ids") - F.col("n_unique"))


def duplicate_rates(df: DataFrame, s: Settings = DEFAULTS, approximate: bool = False) -> DataFrame:
    """(column, n_nonempty, n_distinct, n_duplicates, duplicate_pct) of the profiler's normal form of names and addresses. The columns are counted one by one, so rows aren't expanded."""
    out = None
    for c in (s.name, s.address):
        if c not in df.columns:
            continue
        v = df.select(tx.profile_normalize(F.col(c)).alias("v")).filter("v <> ''")
        if approximate:
            one = v.agg(F.count("*").alias("n_nonempty"), F.approx_count_distinct("v").alias("n_distinct"))
        else:
            one = v.groupBy("v").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nonempty"), F.count("*").alias("n_distinct"))
        extra = F.col("n_nonempty") - F.col("n_distinct")
        one = one.select(F.lit(c).alias("column"), "n_nonempty", "n_distinct", extra.alias("n_duplicates"), F.when(F.col("n_nonempty") > 0, F.round(100.0 * extra / F.col("n_nonempty"), 6)).otherwise(0.0).alias("duplicate_pct"))
        out = one if out is None else out.unionByName(one)
    return out


def _ids_of(truth: DataFrame, s: Settings) -> DataFrame:
    missing = [c for c in s.truth_columns if c not in truth.columns]
    if missing:
        raise ValueError(f"the truth lacks columns {missing}")
    ids = F.array_distinct(F.filter(F.transform(F.split(tx.safe(F.col(s.matches)), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return truth.select(F.trim(tx.safe(F.col(s.left_id))).alias("id"), ids.alias("ids"))


def truth_distribution(truth: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(n_matches, n_entities) of distinct ids in each list."""
    return _ids_of(truth, s).groupBy(F.size("ids").cast("long").alias("n_matches")).agg(F.count("*").alias("n_entities"))


def truth_summary(truth: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row: rows, zero, single and multi matches, the most, all links, ids that don't look like ids, rows that repeat an entity."""
    d = _ids_of(truth, s)
    n = F.size("ids")
    bad = F.size(F.filter("ids", lambda x: ~x.rlike(r"(?i)^S\p{Nd}+-")))
    one = d.groupBy("id").agg(F.count("*").alias("rows"), F.count_if(n == 0).alias("zero"), F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("multi"), F.max(n).alias("most"), F.sum(n).alias("links"), F.sum(bad).alias("malformed"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return one.agg(*map(total, ("rows", "zero", "single", "multi", "links", "malformed")), F.coalesce(F.max("most"), F.lit(0)).cast("long").alias("most"), F.coalesce(F.sum(F.when(F.col("id") != "", F.col("rows") - 1)), F.lit(0)).cast("long").alias("duplicate_rows"))


def overall_summary(files: dict[str, DataFrame], s: Settings = DEFAULTS) -> DataFrame:
    """(file, rows) and the total, without gathering rows."""
    out = None
    for name, df in files.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("file"), "rows")
        out = one if out is None else out.unionByName(one)
    return out.unionByName(out.agg(F.sum("rows").alias("rows")).select(F.lit("<TOTAL>").alias("file"), "rows"))


def observations(files: dict[str, DataFrame], s: Settings = DEFAULTS) -> DataFrame:
    """(kind, file, column, value): more than two countries over all files; names or addresses missing in over 5 % of rows; normal forms repeated in over 20 %."""
    countries = None
    out = None
    for name, df in files.items():
        c = df.select(F.trim(tx.safe(F.col(s.country))).alias("c")).filter("c <> ''").distinct()
        countries = c if countries is None else countries.unionByName(c)
        miss = missing_counts(df, s).filter(F.col("column").isin(s.name, s.address)).select(F.lit("missing").alias("kind"), F.lit(name).alias("file"), "column", F.when(F.col("rows") > 0, F.round(100.0 * F.col("n_missing") / F.col("rows"), 6)).otherwise(0.0).alias("value")).filter("value > 5")
        dup = duplicate_rates(df, s).select(F.lit("duplicates").alias("kind"), F.lit(name).alias("file"), "column", F.col("duplicate_pct").alias("value")).filter("value > 20")
        part = miss.unionByName(dup)
        out = part if out is None else out.unionByName(part)
    many = countries.distinct().agg(F.count("*").alias("n")).filter("n > 2").select(F.lit("countries").alias("kind"), F.lit("<ALL>").alias("file"), F.lit(s.country).alias("column"), F.col("n").cast("double").alias("value"))
    return out.unionByName(many)


def profile_source_file(df: DataFrame, s: Settings = DEFAULTS) -> dict[str, DataFrame]:
    return {"missing": missing_counts(df, s), "lengths": length_stats(df, s), "countries": top_countries(df, s=s), "prefixes": prefix_counts(df, s), "ids": id_counts(df, s), "duplicates": duplicate_rates(df, s)}


def profile_ground_truth(truth: DataFrame, s: Settings = DEFAULTS) -> dict[str, DataFrame]:
    return {"distribution": truth_distribution(truth, s), "summary": truth_summary(truth, s)}


def report(files: dict[str, DataFrame], truth: DataFrame | None = None, s: Settings = DEFAULTS) -> str:
    """All profiles as text: the summary first, observations last."""
    lines: list[str] = []

    def add(title: str, df: DataFrame) -> None:
        lines.append(f"== {title}")
        lines.append("\t".join(df.columns))
        lines.extend("\t".join(f"{v:,}" if isinstance(v, int) else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) for r in df.collect())  # aggregates only
        lines.append("")

    add("rows", overall_summary(files, s))
    for name, df in files.items():
        for kind, d in profile_source_file(df, s).items():
            add(f"{name}: {kind}", d)
    if truth is not None:
        for kind, d in profile_ground_truth(truth, s).items():
            add(f"truth: {kind}", d)
    add("observations", observations(files, s))
    return "\n".join(lines)
