"""What the corpus operators share: document keys, Arrow kernels, hash kernels, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import Scratch

#: Odd multipliers for mixing 64-bit hashes.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
BATCH_BYTES = "4m"  # of rows that a kernel gets at once; a longer row comes alone
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@cache
def _libc() -> ctypes.CDLL | None:
    try:
        lib = ctypes.CDLL("libc.so.6")
        lib.malloc_trim  # noqa: B018  another C library lacks it
    except (OSError, AttributeError):
        return None
    return lib


def release() -> None:
    """Gives back what a finished kernel held: workers are reused, and the memory of one operator would stay through the next."""
    pa.default_memory_pool().release_unused()
    if lib := _libc():
        lib.malloc_trim(0)


def kernel(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """mapInArrow with batches of bounded bytes; the worker's memory is given back at the end of each task."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":  # Spark's default; another value is the user's or this one
        conf.set(_BATCH, BATCH_BYTES)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(released, schema)


def repeats_ids(d: DataFrame, id_col: str) -> bool:
    return d.groupBy(F.col(id_col).cast("long").alias("i")).agg(F.count("*").alias("n")).filter("n > 1 or i is null").limit(1).count() > 0


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "_k") -> DataFrame:
    """docs with a unique key in front, which sorts rows by id (null first), then by the hash of the text.

    It is the id itself where ids are unique and not null. Otherwise it is a rank, from a sort by ranges of id, hash
    and a number of the row, so rows with one id, null or not, are dealt over as many ranges as their share calls for.
    """
    i = F.col(id_col).cast("long")
    rest = [c for c in docs.columns if c != key]
    if not repeats_ids(docs, id_col):
        return docs.select(i.alias(key), *rest)
    order = [i.asc_nulls_first(), F.xxhash64(F.col(text_col).cast("string")), F.col("_row")]
    ranked = docs.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return Scratch(docs.sparkSession).put(ranked.select(F.monotonically_increasing_id().alias(key), *rest))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k long, doc_id, text) of with_key."""
    d = with_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return d.select("_k", "doc_id", "text")


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers. np.unique goes through a hash table where only the values are asked for, which is slower by far."""
    a = np.sort(a)
    return a[np.append(True, a[1:] != a[:-1])[: len(a)]]


class _Memo(dict):
    def __missing__(self, w: bytes) -> int:
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


class WordHasher:
    """64-bit hashes of words, remembered up to a number of words."""

    def __init__(self, limit: int = 200_000):
        self.memo, self.limit = _Memo(), limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > self.limit:
            self.memo.clear()
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], hasher: WordHasher, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of the whole if it is shorter; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    a = hasher(words)
    if len(a) < size:
        return np.array([xxhash.xxh3_64_intdigest(a.tobytes())], np.uint64)
    n = len(a) - size + 1
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = (h ^ a[j : j + n]) * MIX[j % 5]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b), root the smallest node that it reaches: large-star and small-star rounds until nothing changes.

    Minima combine before the shuffle and are written, so that both sides of the joins that follow are plain shuffles,
    whose large partitions Spark splits: a hub's edges are spread over tasks.
    """
    e = scratch.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was = mark
        both = e.union(e.select("v", "u"))
        least = scratch.put(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = scratch.put(both.join(least.hint("merge"), "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = scratch.put(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, scratch.put(small)
        scratch.drop(old, least, large, down)
