"""Near duplicates by bottom-k sketches of one hash function.

Each text becomes the set of hashes of its 5-word shingles; the k smallest hashes are its sketch. Texts with
equal sets form a class, and only classes are compared. Inverted lists of retained values propose pairs: a value's
list holds the classes that have it among their rarest retained values, so that a passage which many texts share
proposes nothing by itself. Within a list the sketch of the union estimates the similarity, and pairs whose estimate
is within the stated error of the threshold are verified on the full sets. A long list is cut into blocks, and each
pair of blocks is a group of its own; a group hands on one packed row with its pairs, and after verification only the
links that connect its members, so no step writes all pairs of a group. Every proposed pair is verified.

Recall: at the threshold itself a pair shares fewer than MIN_SHARED of its INDEX smallest hashes with probability
below 4e-6, and its estimate misses the cut with probability below 2e-6; sets of at most INDEX hashes are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, WordHasher, connected_components, kernel, keyed, shingles, words_of

SKETCH, INDEX, MIN_SHARED, BLOCK = 64, 16, 4, 256
PERCENT = 75  # links need 100 * intersection >= PERCENT * union


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for b in batches:
        n, hi, lo, sk = [], [], [], []
        for t in b.column("text").to_pylist():
            a = shingles(words_of(t), hasher)
            d = xxhash.xxh3_128_digest(a.tobytes())
            n.append(len(a))
            hi.append(int.from_bytes(d[:8], "little", signed=True))
            lo.append(int.from_bytes(d[8:], "little", signed=True))
            sk.append(a[:SKETCH].view(np.int64))
        offsets = np.cumsum([0] + [len(x) for x in sk]).astype(np.int32)
        flat = np.concatenate(sk) if sk else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["_k", "doc_id", "n", "hi", "lo", "sketch"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of batches sorted by them; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        edges = np.flatnonzero(change)
        at = 0
        for e in edges.tolist():
            yield pa.Table.from_batches([*held, b.slice(at, e - at)])
            held, at = [], e
        held.append(b.slice(at))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _ragged(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        v, o = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [v[o[i] : o[i + 1]] for i in range(len(o) - 1)]
    return out


def _common(rows: list[np.ndarray]) -> np.ndarray:
    """How many values each two rows have in common; rows hold distinct values."""
    m = len(rows)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    out = np.zeros((m, m), np.float32)
    if not len(flat):
        return out
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(r) for r in rows])
    keep = counts[inverse] > 1
    renumber = np.cumsum(counts > 1) - 1
    owner, column = owner[keep], renumber[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((m, min(width, total - at)), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    return out


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group of one list: the members and the pairs to verify."""
    sure = PERCENT / 100
    for t in _groups(batches, ["v", "bi", "bj"]):
        if t.num_rows < 2:
            continue
        rep, n, side = (t.column(c).to_numpy() for c in ("rep", "n", "side"))
        sketch = [a.view(np.uint64) for a in _ragged(t.column("sketch"))]
        ok = np.triu(np.ones((len(rep), len(rep)), bool), 1)
        if t.column("bi")[0].as_py() != t.column("bj")[0].as_py():
            ok &= side[:, None] != side[None, :]
        ok &= 100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :])
        if not ok.any():
            continue
        ok &= _common(_ragged(t.column("earlier"))) == 0  # another list has this pair
        i, j = np.nonzero(ok)
        keep = np.zeros(len(i), bool)
        wide = np.full((len(rep), SKETCH), np.uint64(0xFFFFFFFFFFFFFFFF))
        for r, s in enumerate(sketch):
            wide[r, : len(s)] = s
        size = np.minimum(n, SKETCH)
        for at in range(0, len(i), 20_000):
            a, b = i[at : at + 20_000], j[at : at + 20_000]
            both = np.sort(np.concatenate([wide[a], wide[b]], axis=1), axis=1)
            same = both[:, 1:] == both[:, :-1]
            real = np.arange(1, 2 * SKETCH)[None, :] < (size[a] + size[b])[:, None]
            same &= real
            rank = np.cumsum(np.concatenate([np.ones((len(a), 1), bool), ~same], axis=1), axis=1)
            union = size[a] + size[b] - same.sum(1)
            whole = (n[a] <= SKETCH) & (n[b] <= SKETCH)
            k = np.where(whole, union, np.minimum(union, SKETCH))
            shared = (same & (rank[:, 1:] <= k[:, None])).sum(1)
            cut = sure - 4.75 * np.sqrt(sure * (1 - sure) / np.maximum(k, 1))
            keep[at : at + 20_000] = np.where(whole, 100 * shared >= PERCENT * union, shared >= cut * k)
        i, j = i[keep], j[keep]
        if len(i):
            used, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
            yield pa.RecordBatch.from_arrays([t.column("v")[:1].combine_chunks(), t.column("bi")[:1].combine_chunks(), t.column("bj")[:1].combine_chunks(), pa.array([rep[used]], pa.list_(pa.int64())), pa.array([flat.astype(np.uint16).tobytes()], pa.binary())], names=["v", "bi", "bj", "members", "pairs"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array([shingles(words_of(t), hasher).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["rep", "hashes"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarity of each proposed pair; of the links only a forest that connects the same members."""
    for t in _groups(batches, ["v", "bi", "bj"]):
        t = t.sort_by("pos")
        rep = t.column("rep").to_numpy()
        pairs = np.frombuffer(next(x for x in t.column("pairs").to_pylist() if x is not None), np.uint16).reshape(2, -1).astype(np.int64)
        rows = [np.frombuffer(x, np.int64) for x in t.column("hashes").to_pylist()]
        if len(rows) == 2:
            inter = np.array([len(np.intersect1d(rows[0], rows[1], assume_unique=True))])
        else:
            inter = _common(rows)[pairs[0], pairs[1]]
        n = np.array([len(r) for r in rows])
        linked = 100 * inter >= PERCENT * (n[pairs[0]] + n[pairs[1]] - inter)
        root = list(range(len(rows)))

        def find(x: int, root: list[int] = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs[:, linked].T.tolist():
            x, y = find(a), find(b)
            if x != y:
                x, y = (x, y) if rep[x] < rep[y] else (y, x)
                root[y] = x
        out = [(rep[i], rep[find(i)]) for i in range(len(rows)) if find(i) != i]
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_k, doc_id, n_shingles, component_id, kept) for each row of docs.

    Words are runs of bytes that are not ASCII white space, A-Z lower-cased; a text's set holds its distinct 5-word
    shingles, or its whole word sequence if shorter. Two texts link if 100 * intersection >= 75 * union.
    component_id is the smallest id that links reach, kept whether the row is the first of its component. Null, empty
    and blank texts have no shingles and link with nothing. Rows that repeat an id are documents of their own, ordered
    by text; a null id sorts first. An empty table gives an empty result. Other columns of docs play no part.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    source = keyed(docs, id_col, text_col)
    base = scratch.put(kernel(source, _sketches, "_k long, doc_id long, n long, hi long, lo long, sketch array<long>"))
    classes = base.filter("n > 0").groupBy("n", "hi", "lo").agg(F.min("_k").alias("rep"))
    reps = base.select(F.col("_k").alias("rep"), "n", "sketch").join(classes.select("rep"), "rep", "left_semi")
    reps = scratch.put(reps)
    values = reps.select("rep", F.explode(F.slice("sketch", 1, INDEX)).alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    hits = values.join(often, "v").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("hits"))  # INDEX at most
    least = F.when(F.col("n") <= INDEX * PERCENT // 100, F.ceil(F.col("n") * PERCENT / 100)).otherwise(MIN_SHARED).cast("int")
    rare = hits.join(reps, "rep").withColumn("prefix", F.slice("hits", 1, F.greatest(F.lit(0), F.size("hits") - least + 1)))
    postings = rare.select("rep", "n", "sketch", "prefix", F.posexplode("prefix").alias("at", "hit")).select("rep", "n", "sketch", F.col("hit.v").alias("v"), F.col("hit.df").alias("df"), F.transform(F.slice("prefix", 1, F.col("at")), lambda x: x["v"]).alias("earlier"))
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    postings = postings.withColumn("b", F.pmod(F.xxhash64("rep"), blocks).cast("int")).select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    postings = postings.select("v", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), (F.col("b") < F.col("o")).alias("side"), "rep", "n", "sketch", "earlier")
    tasks = kernel(postings.repartition("v", "bi", "bj").sortWithinPartitions("v", "bi", "bj"), _propose, "v long, bi int, bj int, members array<long>, pairs binary")
    tasks = scratch.put(tasks)
    scratch.drop(reps)
    members = tasks.select("v", "bi", "bj", F.posexplode("members").alias("pos", "rep"), "pairs").withColumn("pairs", F.when(F.col("pos") == 0, F.col("pairs")))
    wanted = source.join(members.select(F.col("rep").alias("_k")).distinct(), "_k", "left_semi")
    sets = scratch.put(kernel(wanted.select("_k", "text"), _sets, "rep long, hashes binary"))
    checked = kernel(members.join(sets, "rep").repartition("v", "bi", "bj").sortWithinPartitions("v", "bi", "bj"), _verify, "a long, b long")
    links = scratch.put(checked)
    scratch.drop(tasks, sets)
    found = connected_components(links, scratch)
    ids = base.select(F.col("_k").alias("first"), F.col("doc_id").alias("component_id"))
    firsts = classes.join(found, classes.rep == found.node, "left").select("n", "hi", "lo", F.coalesce("root", "rep").alias("first")).join(ids, "first")
    out = base.drop("sketch").join(firsts, ["n", "hi", "lo"], "left")
    alone = F.col("first").isNull()
    return out.select("_k", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | (F.col("_k") == F.col("first"))).alias("kept"))
