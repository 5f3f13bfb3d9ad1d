"""SimHash fingerprints and search within a Hamming radius, in DataFrame operations only.

The terms of a text are the runs of five of its words (lower-cased, between ASCII white space), or the words of a
shorter text, weighted by how often they occur: each occurrence votes with the bits of the term's hash, and the
fingerprint has the bits that win. Votes for four bits share one 64-bit sum, for stretches of at most 65,535 terms, so
a text's votes are 16 sums, combined before the shuffle: a row for each stretch leaves a task, not one for each term.

Search: the 64 bits are cut into 6 blocks. Two fingerprints within RADIUS = 3 agree on at least 3 whole blocks, so
they meet in one of the 20 tables that are keyed by 3 blocks each (32 bits or so, which few unrelated ones share). A
pair counts in the first table where it meets. Equal fingerprints are one row with a count.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, keyed

RUN, RADIUS, STRETCH = 5, 3, 65_535
ROWS_PER_BUCKET = 4_096
RANGES = 20_000  # of ids from quantiles, and first rows of ranges that the driver pairs; beyond, ranges are divided and paired in steps
_LANES = 0x0001000100010001
_BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]  # first bit, bits
_TABLES = [sum(((1 << n) - 1) << at for at, n in chosen) for chosen in combinations(_BLOCKS, len(_BLOCKS) - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, fingerprint long) for each row; keys must tell rows apart. Null, empty and blank texts have fingerprint 0, and equal texts have equal ones."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")
    d = texts.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("w"))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - RUN), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(RUN)]))
    d = d.select(*keys, F.when(F.size("w") >= RUN, runs).otherwise(F.col("w")).alias("t"))
    terms = d.select(*keys, F.posexplode_outer("t").alias("at", "h"))  # a text without words votes for nothing
    terms = terms.withColumn("stretch", F.coalesce(F.expr(f"at div {STRETCH}"), F.lit(0)))
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES))).alias(f"s{i}") for i in range(16)]
    sums = terms.groupBy(*keys, "stretch").agg(F.count("h").alias("n"), *lanes)
    votes = [F.sum(F.shiftrightunsigned(f"s{i}", 16 * j).bitwiseAND(F.lit(0xFFFF))).alias(f"v{i + 16 * j}") for j in range(4) for i in range(16)]
    sums = sums.groupBy(*keys).agg(F.sum("n").alias("n"), *votes)
    won = [F.when(F.col(f"v{i}") * 2 > F.col("n"), F.lit(_signed(1 << i))).otherwise(F.lit(0).cast("long")) for i in range(64)]
    quarters = [reduce(lambda x, y: x.bitwiseOR(y), won[at : at + 16]).alias(f"q{at}") for at in range(0, 64, 16)]
    return sums.select(*keys, *quarters).select(*keys, F.col("q0").bitwiseOR(F.col("q16")).bitwiseOR(F.col("q32")).bitwiseOR(F.col("q48")).alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def within_radius(queries: DataFrame, all_rows: DataFrame) -> DataFrame:
    """(fingerprint, other, distance): the distinct fingerprints of all_rows within RADIUS of each distinct one of queries, itself included. Null fingerprints match nothing."""

    def tables(d: DataFrame, name: str) -> DataFrame:
        d = d.filter("fingerprint is not null").select(F.col("fingerprint").alias(name)).distinct()
        keys = F.array(*[F.col(name).bitwiseAND(F.lit(_signed(m))) for m in _TABLES])
        return d.select(name, F.posexplode(keys).alias("table", "key"))

    q, a = tables(queries, "fingerprint"), tables(all_rows, "other")
    x = F.col("fingerprint").bitwiseXOR(F.col("other"))
    first = F.lit(len(_TABLES))
    for i, m in reversed(list(enumerate(_TABLES))):
        first = F.when(x.bitwiseAND(F.lit(_signed(m))) == 0, F.lit(i)).otherwise(first)
    q, a = q.alias("q"), a.alias("a")
    on = (F.col("q.table") == F.col("a.table")) & (F.col("q.key") == F.col("a.key")) & (F.bit_count(x) <= RADIUS) & (first == F.col("q.table"))
    return q.join(a.hint("merge"), on).select("fingerprint", "other", F.bit_count(x).alias("distance"))


def _cuts_below(x: Column, cuts: list[int], low: int, high: int) -> Column:
    """How many of the sorted cuts are below x: those in earlier cells of equal width, and those to compare in its own cell."""
    if not cuts:
        return F.lit(0)
    cells = 4 * len(cuts) + 1
    width = max(float(high - low) / cells, 1e-9)
    starts = np.searchsorted([min(cells - 1, math.floor(float(c - low) / width)) for c in cuts], range(cells + 1)).tolist()
    cell = F.least(F.lit(cells - 1), F.floor((x - F.lit(low)).cast("double") / F.lit(width))).cast("int")
    start, stop = F.get(F.lit(starts), cell), F.get(F.lit(starts), cell + 1)
    return start + F.size(F.filter(F.slice(F.lit(cuts), start + 1, stop - start), lambda c: c < x))


def _bucket(x: Column, cuts: list[int], low: int, high: int, parts: int) -> Column:
    """The number of x's range between cuts, each divided into equal parts."""
    at = _cuts_below(x, cuts, low, high)
    if parts == 1:
        return at.cast("long")
    first, last = (F.get(F.lit(ends).cast("array<bigint>"), at.cast("int")).cast("double") for ends in ([low, *cuts], [*cuts, high]))
    part = F.floor((x.cast("double") - first) * parts / (last - first + 1))
    return at.cast("long") * parts + F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1))


def _next_heads(heads: DataFrame, count: int) -> DataFrame:
    """(bucket, head) of the row that follows each bucket: the first of the next bucket that has rows, after the last that of the first. Many buckets are paired within groups of them, and the groups likewise."""
    if count <= RANGES:
        firsts = sorted((r.bucket, r.head) for r in heads.collect())  # RANGES rows at most
        return heads.sparkSession.createDataFrame(pa.table({"bucket": pa.array([b for b, _ in firsts], pa.int64()), "head": pa.array([k for _, k in firsts[1:] + firsts[:1]], pa.int64())}))
    d = heads.withColumn("group", F.expr(f"bucket div {ROWS_PER_BUCKET}"))
    groups = _next_heads(d.groupBy(F.col("group").alias("bucket")).agg(F.min("head").alias("head")), -(-count // ROWS_PER_BUCKET)).select(F.col("bucket").alias("group"), F.col("head").alias("then"))
    following = F.lead("head").over(Window.partitionBy("group").orderBy("bucket"))
    return d.withColumn("next", following).join(groups, "group").select("bucket", F.coalesce("next", "then").alias("head"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k, doc_id, text, next_k, edited) of each row: edited is the text with its last quarter (rounded down) of characters replaced by the first as many of the next row's text, in the order of ids; the first row follows the last.

    Rows are dealt to ranges of ids, so the order of all rows is never made in one task; each range hands on its first row.
    """
    source = keyed(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows, low, high = source.agg(F.count("*"), F.min("_k"), F.max("_k")).first()
    wanted = max(1, -(-rows // ROWS_PER_BUCKET))
    n = min(RANGES, wanted)
    cuts = source.agg(F.percentile_approx("_k", [i / n for i in range(1, n)], 100_000)).first()[0] if n > 1 else []
    bucket = _bucket(F.col("_k"), sorted(set(cuts)), low, high, -(-wanted // n))
    d = source.withColumn("bucket", bucket)
    w = Window.partitionBy("bucket").orderBy("_k")
    d = d.withColumn("next_k", F.lead("_k").over(w)).withColumn("next_text", F.lead("text").over(w))
    heads = source.withColumn("bucket", bucket).groupBy("bucket").agg(F.min("_k").alias("head"))
    after = _next_heads(heads, wanted)
    first_texts = source.select(F.col("_k").alias("head"), F.col("text").alias("head_text")).join(F.broadcast(after) if wanted <= RANGES else after.hint("merge"), "head")
    d = d.join(first_texts.hint("merge"), "bucket", "left")
    d = d.withColumn("next_text", F.coalesce("next_text", "head_text")).withColumn("next_k", F.coalesce("next_k", "head"))
    quarter = F.expr("char_length(text) div 4").cast("int")
    edited = F.concat(F.expr("left(text, cast(char_length(text) - char_length(text) div 4 as int))"), F.when(quarter > 0, F.substring("next_text", F.lit(1), quarter)).otherwise(F.lit("")))
    return d.select("_k", "doc_id", "text", "next_k", edited.alias("edited"))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k, doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs; fingerprints are 16 hexadecimal digits, likeness is the share of equal bits.

    Null text counts as empty; texts without words have the fingerprint 0. The only row is its own next one. Rows that
    repeat an id are documents of their own, ordered by text; a null id sorts first. An empty table gives an empty
    result. Other columns of docs play no part.
    """
    scratch = Scratch(docs.sparkSession)
    d = with_next(docs, id_col, text_col)
    both = d.select("_k", "doc_id", "next_k", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("sha"), F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), "text"), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")))).alias("x"))
    keys = ["_k", "doc_id", "next_k", "n_chars", "sha", "is_edited"]
    prints = scratch.put(fingerprints(both.select(*keys[:-1], "x.is_edited", "x.text"), keys))
    own = prints.filter("not is_edited").withColumnRenamed("fingerprint", "f")
    other = prints.filter("is_edited").select("_k", F.col("fingerprint").alias("e"))
    following = own.select(F.col("_k").alias("next_k"), F.col("f").alias("nf"))
    like = lambda a, b: 1 - distance(F.col(a), F.col(b)) / F.lit(64.0)
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return own.join(other.hint("merge"), "_k").join(following.hint("merge"), "next_k").select("_k", "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.col("f").alias("bits"), text("f").alias("fingerprint"), text("e").alias("edited_fingerprint"), like("f", "e").alias("near_edited"), like("f", "nf").alias("near_next"))


def neighbour_counts(prints: DataFrame, every: int = 50) -> DataFrame:
    """prints (of document_fingerprints, stored) with n_near: for rows whose id divides by `every`, how many rows have a fingerprint within RADIUS, itself included; null for others."""
    asked = F.col("doc_id") % every == 0
    pairs = within_radius(prints.filter(asked).select(F.col("bits").alias("fingerprint")), prints.select(F.col("bits").alias("fingerprint")))
    rows = prints.groupBy(F.col("bits").alias("other")).agg(F.count("*").alias("n"))
    near = pairs.join(rows.hint("merge"), "other").groupBy(F.col("fingerprint").alias("near_bits")).agg(F.sum("n").alias("near"))
    near = Scratch(prints.sparkSession).put(near)  # the join that follows is of plain shuffles, whose large partitions Spark splits
    return prints.join(near.hint("merge"), prints.bits == near.near_bits, "left").withColumn("n_near", F.when(asked, F.col("near"))).drop("near", "near_bits", "bits", "_k")
