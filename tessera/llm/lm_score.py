"""Language-model scores of texts by a probabilistic suffix tree over words.

The root is the smoothed unigram distribution of all training tokens. A context of words becomes a state of the tree if
its next-word distribution diverges from that of its longest shorter state by more than its parameters cost: count times
Kullback-Leibler divergence against GAIN for each transition. Whatever occurs LEAST times is a transition, in a corpus
of any size. A state's transitions have a discounted share of its count; what is left goes to all other words in
proportion to the shorter state, so every state is a distribution over the known words and one unknown word. Depths are
added up to DEPTH words, or until no context of a depth becomes a state. A token is scored by the longest state that ends its context.

A run of words has one 64-bit key, made of the keys of its first and of its last words, so a context's key, that of a
transition and that of the shorter transition are keys of runs that end one word apart. Texts are tokenised once, into
blocks of about LOT tokens. All tables are dealt to shards by key and held as sorted arrays; what blocks and shards ask
of each other goes through shuffles as packed arrays, each key once from each block. A context's transitions meet in
one shard; those of contexts with over HOT occurrences are dealt by transition, and their sums are combined. Nothing of
the tables is collected but two tables of bits, of a bounded size, which tell blocks what isn't worth asking for; they
only ever let too much through.

A context that no longer one can diverge from isn't extended: a longer context's divergence is at most -log of the least
probability of the shorter one's transitions, and its count at most that one's.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import MIX, Scratch, distinct, kernel, keyed, words_of
from tessera.storage import cleaned

LEAST, DISCOUNT, GAIN = 2, 0.5, 4.0
LOT = 1_500_000  # tokens of a block; a longer text is a block of its own
SHARD = 2_000_000  # training tokens for each shard
HOT = 1 << 22  # occurrences of a context from which on its transitions are dealt over all shards
BITS, HOT_BITS, SLICES = 1 << 27, 1 << 20, 64  # of tables of bits, and the parts that they are made in
TURNS = 4  # in which blocks are scored
DEPTH = 3  # words of context at most; None: until no context of a depth becomes a state
END = np.uint64(0x5E4D0F7E87A6D1B3)  # stands for the end of a text
ROUTED = "to long, frm long, data binary"
TABLE = "shard long, data binary, size long, total long"


# --- arrays in rows ---------------------------------------------------------

def _planes(a: np.ndarray) -> np.ndarray:
    """The first bytes of all values, then the second ones, and so on: they compress better so."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)


def _pack(*arrays: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences in planes of bytes; others as they are, since few different ones repeat."""
    kinds, parts = "", []
    for a in map(np.ascontiguousarray, arrays):
        way = "r"
        if len(a) and a.itemsize > 1:
            if a.dtype.kind == "u" and (a[1:] >= a[:-1]).all():
                a, way = np.diff(a, prepend=a.dtype.type(0)), "d"
        kinds += way + a.dtype.str[1:].ljust(3)
        parts.append((a if way == "r" else _planes(a)).tobytes())
    head = struct.pack(f"<q{len(arrays)}q", len(arrays), *map(len, parts)) + kinds.encode()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = struct.unpack_from("<q", raw)[0]
    sizes, at, out = struct.unpack_from(f"<{n}q", raw, 8), 8 + 8 * n + 4 * n, []
    for i, size in enumerate(sizes):
        way, kind = chr(raw[8 + 8 * n + 4 * i]), np.dtype(raw[9 + 8 * n + 4 * i : 12 + 8 * n + 4 * i].decode().strip())
        a = np.frombuffer(raw, np.uint8, size, at)
        if way != "r":
            a = np.ascontiguousarray(a.reshape(kind.itemsize, -1).T)
        a = a.reshape(-1).view(kind)
        out.append(np.cumsum(a, dtype=kind) if way == "d" else a)
        at += size
    return out


def _joined(rows: list[list[np.ndarray]], kinds: str) -> list[np.ndarray]:
    """The arrays of several rows, one after the other; empty ones of these kinds if there is no row."""
    return [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.empty(0, k) for k in kinds.split()]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards in the order of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _dealt(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places that go there, in order."""
    if not len(to):
        return
    if (to[1:] >= to[:-1]).all():
        by = np.arange(len(to))
    else:
        by = np.argsort(to.astype(np.uint16) if to.max() < 1 << 16 else to, kind="stable")  # 16 bits are sorted by radix
    edges = np.flatnonzero(np.diff(to[by])) + 1
    for part in np.split(by, edges):
        if len(part):
            yield int(to[part[0]]), part


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    names = names.split()
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "data" else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)


def _each(df: DataFrame, f: Callable[..., list[tuple]], names: str, schema: str) -> DataFrame:
    """f of each row, which gives rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                yield _rows(f(*row), names)

    return kernel(df, run, schema)


def _gathered(routed: DataFrame, f: Callable[[int, list[tuple[int, list[np.ndarray]]]], list[tuple]], names: str = "shard data size total", schema: str = TABLE) -> DataFrame:
    """f of all that is routed to one place: (from, arrays)."""

    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_rows(f(t.column("to")[0].as_py(), [(x, _unpack(d)) for x, d in zip(t.column("frm").to_pylist(), t.column("data").to_pylist(), strict=True)]), names)])

    return routed.groupBy("to").applyInArrow(run, schema)


def _met(table: DataFrame, key: str, routed: DataFrame, f: Callable[[int, list[dict], list[tuple[int, list[np.ndarray]]]], pa.Table], schema: str) -> DataFrame:
    """f of a table's rows with one key and what is routed there."""

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        place = (rows.column(key) if rows.num_rows else sent.column("to"))[0].as_py()
        return f(place, rows.to_pylist(), [(x, _unpack(d)) for x, d in zip(sent.column("frm").to_pylist(), sent.column("data").to_pylist(), strict=True)])

    return table.groupBy(key).cogroup(routed.groupBy("to")).applyInArrow(run, schema)


def _found(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of the asked in the sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and where each key is among them."""
    by = np.argsort(keys)
    keys = keys[by]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    where = np.empty(len(keys), np.int64)
    where[by] = np.cumsum(new) - 1
    return keys[new], where


# --- keys and tables of bits ------------------------------------------------

def _run_key(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The key of a run of words, of the keys of all but its last and all but its first."""
    h = last * MIX[1]
    h >>= np.uint64(29)
    h += last
    h += first * MIX[0]
    for by, mix in ((np.uint64(32), MIX[2]), (np.uint64(29), MIX[3])):
        h ^= h >> by
        h *= mix
    h ^= h >> np.uint64(32)
    return h


def _probe(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    slot &= np.uint32(8 * len(bits) - 1)
    return ((bits[slot >> np.uint32(3)] >> (slot.astype(np.uint8) & np.uint8(7))) & np.uint8(1)).view(bool)


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return _probe(bits, keys.astype(np.uint32))


def _in_both(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of a table that has two bits of each key."""
    hit = _in(bits, keys)
    at = np.flatnonzero(hit)
    hit[at] = _probe(bits, (keys[at] >> np.uint64(32)).astype(np.uint32))
    return hit


def _bits(keys: DataFrame, size: int, tables: int = 1, both: bool = False) -> list[np.ndarray]:
    """Tables of `size` bits of the keys in the rows' first arrays, for the table at `to`, one bit or two of each key; their parts are made by tasks of their own."""
    part = size // SLICES

    def sent(table: int, data: bytes) -> list[tuple]:
        k = _unpack(data)[0]
        slot = (np.concatenate([k, k >> np.uint64(32)]) if both else k) & np.uint64(size - 1)
        slot = slot.astype(np.int64)
        return [(table * SLICES + to, 0, _pack((slot[own] % part).astype(np.uint32))) for to, own in _dealt(slot // part)]

    def made(to: int, rows: list[tuple[int, list[np.ndarray]]]) -> list[tuple]:
        bits = np.zeros(part, np.uint8)
        for _, (slot,) in rows:
            bits[slot] = 1
        return [(to, 0, _pack(np.packbits(bits, bitorder="little")))]

    out = np.zeros((tables, size // 8), np.uint8)
    with cleaned(keys.sparkSession):
        rows = _gathered(_each(keys.select("to", "data"), sent, "to frm data", ROUTED), made, "to frm data", ROUTED).collect()  # SLICES rows a table, `size` bits in all
    for r in rows:
        at = r.to % SLICES * part // 8
        out[r.to // SLICES, at : at + part // 8] = _unpack(r.data)[0]
    return list(out)


def _runs(words: np.ndarray, ids: np.ndarray, place: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each depth: places with a context of so many words, the contexts' keys, the shorter transitions' keys, the shorter contexts' key arrays by place.

    known: a table of bits of all runs of words that may matter; a run both of whose parts are there is looked at.
    """
    runs, held, depth = words[ids], _in(known, words)[ids], 1
    shorter = runs
    while True:
        at = np.flatnonzero(held[1:] & held[:-1] & (place[1:] >= depth)) + 1
        context, last = runs[at - 1], runs[at]
        yield at, context, last, shorter
        shorter, runs, held = runs, np.zeros(len(ids), np.uint64), np.zeros(len(ids), bool)
        k = runs[at] = _run_key(context, last)
        held[at] = _in(known, k)
        depth += 1
        if not len(at):
            return


# --- blocks -----------------------------------------------------------------

BLOCKS = "block long, docs binary, tokens binary, n long"


def _blocks(batches: Iterator[pa.RecordBatch], lot: int) -> Iterator[pa.RecordBatch]:
    """Rows of about `lot` tokens, training texts first: the texts' keys, ids, held_out and sizes; the distinct words, and which of them each token is."""
    held: list[tuple[bool, int, int | None, np.ndarray]] = []
    size = 0

    def block() -> pa.RecordBatch:
        rows = sorted(held, key=lambda x: x[0])
        words, ids = _distinct(np.concatenate([x[3] for x in rows]))
        docs = _pack(np.array([x[1] for x in rows], np.int64), np.array([x[2] or 0 for x in rows], np.int64), np.array([x[2] is None for x in rows], np.uint8), np.array([x[0] for x in rows], np.uint8), np.array([len(x[3]) for x in rows], np.int64))
        n = sum(len(x[3]) for x in rows if not x[0])
        return pa.RecordBatch.from_arrays([pa.array([rows[0][1]], pa.int64()), pa.array([docs], pa.binary()), pa.array([_pack(words, ids.astype(np.uint32))], pa.binary()), pa.array([n], pa.int64())], names=["block", "docs", "tokens", "n"])

    for b in batches:
        for k, d, t, h in zip(*(b.column(c).to_pylist() for c in ("_k", "doc_id", "text", "held_out")), strict=True):
            words = words_of(t)
            held.append((h, k, d, np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), END)))
            size += len(held[-1][3])
            if size >= lot:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _trained(docs: bytes, tokens: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's words, and the training tokens' numbers of words and places in their texts."""
    (words, ids), sizes = _unpack(tokens), _unpack(docs)[4]
    return words, ids[:n], _places(sizes)[:n]


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


# --- the tree ---------------------------------------------------------------

def _sums(p: np.ndarray, q: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    add = lambda x: np.add.reduceat(x, first)
    return add(p), add(q), add(np.ones(len(p))), add(p * np.log(p / q)), np.minimum.reduceat(p, first), np.minimum.reduceat(q, first)


def _verdict(total: np.ndarray, p: np.ndarray, q: np.ndarray, many: np.ndarray, diverged: np.ndarray, least_p: np.ndarray, least_q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts, from the sums over their transitions: whether they are states, the log10 share left for other words, and whether longer ones may be states."""
    share, other = 1 - p, 1 - q
    fit = (share > 1e-12) & (other > 1e-9)
    ratio = np.where(fit, share, 1) / np.where(fit, other, 1)
    kept = fit & (total * (diverged + np.where(fit, share, 0) * np.log(ratio)) > GAIN * (many + 1))
    # a longer context that isn't the state itself occurs less often
    least = np.where(kept, np.minimum(least_p, share), np.minimum(least_q, other))
    live = (total - kept) * -np.log(np.maximum(least, 1e-300)) > 2 * GAIN * (1 - 1e-9)
    return kept, np.log10(ratio), live


def _grown(c: np.ndarray, s: np.ndarray, n: np.ndarray, total: np.ndarray, q: np.ndarray, own: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Runs one word longer (key, count, log10 probability by the longest state, open), transitions of states (key, log10 probability), states (key, log10 share left), live contexts; own: the verdict on each row's context."""
    kept, left, live = own
    k, p = _run_key(c, s), np.log10((n - DISCOUNT) / total)
    states, shares = c[kept], left[kept]
    by = np.argsort(states)
    first = by[np.append(True, states[by][1:] != states[by][:-1])[: len(by)]]
    return [k, n, np.where(kept, p, q), live, k[kept], p[kept], states[first], shares[first], distinct(c[live])]


GROWN = "u8 i8 f8 ?  u8 f8 u8 f8 u8"


def _grow(blocks: DataFrame, table: DataFrame, hot: np.ndarray, bits: tuple[np.ndarray, np.ndarray], depth: int, shards: int, scratch: Scratch) -> DataFrame:
    """The packed arrays of _grown for the contexts of `depth` words, from the table of runs of so many words."""
    spark, limit = blocks.sparkSession, HOT
    sent = spark.sparkContext.broadcast((*bits, hot))

    def counted(docs: bytes, tokens: bytes, n: int) -> list[tuple]:
        known, live, hot = sent.value
        words, ids, place = _trained(docs, tokens, n)
        for d, (at, c, s, shorter) in enumerate(_runs(words, ids, place, known), 1):
            if d == depth:
                break
        else:
            return []
        if depth == 1:  # numbers of words sort faster than their keys
            pair = np.sort(ids[at - 1].astype(np.int64) << 32 | ids[at])
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(pair))).astype(np.uint32)
            c, s = words[pair[first] >> 32], words[pair[first] & 0xFFFFFFFF]
            to = _shard(np.where(_in(hot, c), _run_key(c, s), c), shards)
            return [(t, 0, _pack(c[own], s[own], n[own])) for t, own in _dealt(to)]
        # one of both contexts that are a word shorter is live: for a transition, or for the count of a longer context
        use = _in(live, shorter[at - 1]) | _in(live, shorter[at])
        c, s = c[use], s[use]
        c, s, n = _tally(c, s, np.ones(len(c), np.uint32))
        to = _shard(np.where(_in(hot, c), _run_key(c, s), c), shards)
        return [(t, 0, _pack(c[own], s[own], n[own])) for t, own in _dealt(to)]

    def summed(to: int, rows: list[tuple[int, list[np.ndarray]]]) -> list[tuple]:
        c, s, n = _joined([x for _, x in rows], "u8 u8 u4")
        c, s, n = _tally(c, s, n.astype(np.int64), LEAST)
        return [(to, _pack(c, s, n), len(c), 0)] if len(c) else []

    moves = scratch.put(_gathered(_each(blocks.select("docs", "tokens", "n"), counted, "to frm data", ROUTED), summed), "none")
    sent.destroy()

    def asked(shard: int, data: bytes) -> list[tuple]:
        c, s, _ = _unpack(data)
        keys = distinct(np.concatenate([c, s]))
        return [(to, shard, _pack(keys[own])) for to, own in _dealt(_shard(keys, shards))]

    def answered(_: int, rows: list[dict], sent: list[tuple[int, list[np.ndarray]]]) -> pa.Table:
        keys, n, q, is_open = _unpack(rows[0]["data"]) if rows else _joined([], "u8 i8 f8 ?")
        out = []
        for frm, (wanted,) in sent:
            at = _found(keys, wanted)
            at = at[at >= 0]
            out.append((frm, 0, _pack(keys[at], n[at], q[at], is_open[at])))
        return pa.Table.from_batches([_rows(out, "to frm data")])

    def resolved(_: int, rows: list[dict], answers: list[tuple[int, list[np.ndarray]]]) -> pa.Table:
        if not rows:
            return pa.Table.from_batches([_rows([], "shard data size total")])
        c, s, n = _unpack(rows[0]["data"])
        keys, count, q, is_open = _joined([x for _, x in answers], "u8 i8 f8 ?")
        by = np.argsort(keys)
        keys, count, q, is_open = keys[by], count[by], q[by], is_open[by]
        context, shorter = _found(keys, c), _found(keys, s)
        use = (context >= 0) & (shorter >= 0)  # bits that are shared let runs through that nothing needs
        c, s, n, total, q, moving = c[use], s[use], n[use], count[context[use]], q[shorter[use]], is_open[shorter[use]]
        is_hot = total > limit
        own = moving & ~is_hot
        grown = _decided(c[own], s[own], n[own], total[own], q[own])
        out = [(0, _pack(*grown), len(grown[6]), 0)]
        none = np.zeros((~moving).sum(), bool)  # runs that are only counted, for longer contexts
        out.append((0, _pack(*_grown(c[~moving], s[~moving], n[~moving], total[~moving], q[~moving], (none, none * 0.0, none))), 0, 0))
        own = moving & is_hot
        if own.any():
            out.append((1, _pack(c[own], s[own], n[own], total[own], q[own]), 0, 0))
        return pa.Table.from_batches([_rows(out, "shard data size total")])

    asks = _each(moves.select("shard", "data"), asked, "to frm data", ROUTED)
    answers = _met(table, "shard", asks, answered, ROUTED)
    found = scratch.put(_met(moves, "shard", answers, resolved, TABLE), "none")
    scratch.drop(moves)
    waiting = found.filter("shard = 1").select("data")
    if waiting.isEmpty():
        return found
    return scratch.put(found.filter("shard = 0").unionByName(_of_hot(waiting)), "none")


def _tally(c: np.ndarray, s: np.ndarray, n: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs with their sums, of `least` or more, in the order of c; pairs are told apart by their runs' keys."""
    if not len(c):
        return c, s, n
    key = _run_key(c, s)
    by = np.argsort(key)
    key = key[by]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    total, at = np.add.reduceat(n[by], first, dtype=n.dtype), by[first]
    at, total = at[total >= least], total[total >= least]
    order = np.argsort(c[at])
    at = at[order]
    return c[at], s[at], total[order]


def _decided(c: np.ndarray, s: np.ndarray, n: np.ndarray, total: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """_grown for contexts, sorted, all of whose transitions are here."""
    if not len(c):
        return _grown(c, s, n, total, q, (np.zeros(0, bool), np.zeros(0), np.zeros(0, bool)))
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    own = _verdict(total[first].astype(float), *_sums((n - DISCOUNT) / total, 10.0**q, first))
    size = np.diff(np.append(first, len(c)))
    return _grown(c, s, n, total, q, tuple(np.repeat(x, size) for x in own))


def _of_hot(waiting: DataFrame) -> DataFrame:
    """_grown for contexts whose transitions are in many shards: sums of each shard are added up, and joined to the transitions."""
    row = "c long, s long, n long, total long, q double"

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                c, s, n, total, q = _unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c.view(np.int64), s.view(np.int64), n, total, q)], names=["c", "s", "n", "total", "q"])

    moves = kernel(waiting, flat, row).withColumn("p", (F.col("n") - DISCOUNT) / F.col("total"))
    q = F.pow(F.lit(10.0), "q")
    sums = moves.groupBy("c").agg(F.sum("p").alias("sp"), F.sum(q).alias("sq"), F.count("*").cast("double").alias("many"), F.sum(F.col("p") * F.log(F.col("p") / q)).alias("diverged"), F.min("p").alias("lp"), F.min(q).alias("lq"))

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = {n: b.column(n).to_numpy() for n in b.schema.names}
                own = _verdict(x["total"].astype(float), *(x[n] for n in ("sp", "sq", "many", "diverged", "lp", "lq")))
                grown = _grown(x["c"].view(np.uint64), x["s"].view(np.uint64), x["n"], x["total"], x["q"], own)
                yield _rows([(0, _pack(*grown), len(grown[6]), 0)], "shard data size total")

    return kernel(moves.drop("p").join(sums.hint("merge"), "c"), done, TABLE)


def _table(found: DataFrame, shards: int) -> DataFrame:
    """The runs of _grown as a table: keys (sorted), counts, log10 probabilities, open."""

    def sent(data: bytes) -> list[tuple]:
        k, *rest = _unpack(data)[:4]
        return [(to, 0, _pack(k[own], *(x[own] for x in rest))) for to, own in _dealt(_shard(k, shards))]

    def merged(to: int, rows: list[tuple[int, list[np.ndarray]]]) -> list[tuple]:
        k, *rest = _joined([x for _, x in rows], "u8 i8 f8 ?")
        by = np.argsort(k)
        return [(to, _pack(k[by], *(x[by] for x in rest)), len(k), int(rest[0].max(initial=0)))]

    return _gathered(_each(found.select("data"), sent, "to frm data", ROUTED), merged)


def _values(found: DataFrame, shards: int) -> DataFrame:
    """What scoring needs of _grown, routed by key: transitions (from 1) and states (from 2)."""

    def sent(data: bytes) -> list[tuple]:
        k, p, c, left = _unpack(data)[4:8]
        moves = [(to, 1, _pack(k[own], p[own])) for to, own in _dealt(_shard(k, shards))]
        return moves + [(to, 2, _pack(c[own], left[own])) for to, own in _dealt(_shard(c, shards))]

    return _each(found.select("data"), sent, "to frm data", ROUTED)


def _part(df: DataFrame, *places: int) -> DataFrame:
    """Some of the rows' arrays, numbered from 0."""
    return _each(df.select("data"), lambda data: [(i, 0, _pack(x)) for i, x in enumerate(_unpack(data)[p] for p in places) if len(x)], "to frm data", ROUTED)


class Tree:
    """The tree as a table of (keys, counts, log10 probabilities, log10 shares left) dealt to shards, and tables of bits of the runs that may matter and of the table's own."""

    def __init__(self, blocks: DataFrame, scratch: Scratch, depth: int | None):
        self.shards = shards = max(1, (blocks.agg(F.sum("n")).first()[0] or 0) // SHARD)
        words = scratch.put(_gathered(_each(blocks.select("docs", "tokens", "n"), lambda docs, tokens, n: _word_counts(docs, tokens, n, shards), "to frm data", ROUTED), _word_table), "none")
        total = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        self.tokens, self.distinct, self.depth = total[0], total[1], 0
        n_all, kinds, limit = self.tokens, self.distinct, HOT

        def often(to: int, data: bytes) -> list[tuple]:
            k, n = _unpack(data)
            use = n >= LEAST
            return [(to, _pack(k[use], n[use], np.log10((n[use] + 0.5) / (n_all + 0.5 * (kinds + 1))), np.ones(use.sum(), bool)), int(use.sum()), int(n.max(initial=0)))]

        size = max(1 << 14, min(BITS, 1 << (2 * n_all).bit_length()))
        table = scratch.put(_each(words.select("shard", "data"), often, "shard data size total", TABLE), "none")
        known, live = _bits(_part(table, 0), size)[0], np.zeros(size >> 3, np.uint8)
        values = [_each(words.select("shard", "data"), lambda to, data: [(to, 0, data)], "to frm data", ROUTED)]
        while depth is None or self.depth < depth:
            heaviest = table.agg(F.max("total")).first()[0] or 0
            hot = _bits(_each(table.select("data"), lambda data: _heavy(data, limit), "to frm data", ROUTED), HOT_BITS)[0] if heaviest > limit else np.zeros(16, np.uint8)
            found = _grow(blocks, table, hot, (known, live), self.depth + 1, shards, scratch)
            scratch.drop(table)
            if not (found.agg(F.sum("size")).first()[0] or 0):
                scratch.drop(found)
                break
            self.depth += 1
            values.append(scratch.put(_values(found, shards), "none"))
            if self.depth != depth:
                table = scratch.put(_table(found, shards), "none")
                new = _bits(_part(found, 0, 8), size, 2)
                known, live = known | new[0], live | new[1]
            scratch.drop(found)
        merged = values[0]
        for v in values[1:]:
            merged = merged.unionByName(v)
        self.table = scratch.put(_gathered(merged, _value_table), "none")
        scratch.drop(words, *values[1:])
        self.own = _bits(_each(self.table.select("data"), _runs_only, "to frm data", ROUTED), size, both=True)[0]


def _heavy(data: bytes, limit: int) -> list[tuple]:
    k, n = _unpack(data)[:2]
    return [(0, 0, _pack(k[n > limit]))]


def _word_counts(docs: bytes, tokens: bytes, n: int, shards: int) -> list[tuple]:
    words, ids = _unpack(tokens)
    count = np.bincount(ids[:n], minlength=len(words))
    words, count = words[count > 0], count[count > 0]
    return [(to, 0, _pack(words[own], count[own])) for to, own in _dealt(_shard(words, shards))]


def _word_table(to: int, rows: list[tuple[int, list[np.ndarray]]]) -> list[tuple]:
    k, n = _joined([x for _, x in rows], "u8 i8")
    words, which = np.unique(k, return_inverse=True)
    n = np.bincount(which, n, len(words)).astype(np.int64)
    return [(to, _pack(words, n), len(words), int(n.sum()))]


def _value_table(to: int, rows: list[tuple[int, list[np.ndarray]]]) -> list[tuple]:
    """Of words (0), transitions (1) and states (2): one row for each key."""
    keys = distinct(np.concatenate([x[0] for _, x in rows]))
    n, p, left = np.zeros(len(keys), np.int64), np.full(len(keys), np.nan), np.full(len(keys), np.nan)
    for kind, (k, v) in rows:
        (n, p, left)[kind][np.searchsorted(keys, k)] = v
    return [(to, _pack(keys, n, p, left), len(keys), 0)]


def _runs_only(data: bytes) -> list[tuple]:
    keys, n, p, left = _unpack(data)
    return [(0, 0, _pack(keys[(n == 0) | ~np.isnan(left)]))]


# --- scores -----------------------------------------------------------------

def _wanted(words: np.ndarray, ids: np.ndarray, place: np.ndarray, own: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys of a block's runs that the tree may have, depth after depth, and the places of each depth's."""
    keys, places, runs = [np.empty(0, np.uint64)], [], words[ids]
    for d in range(1, depth + 1):
        k = np.zeros(len(ids), np.uint64)
        k[1:] = _run_key(runs[:-1], runs[1:])
        at = np.flatnonzero(_in_both(own, k) & (place >= d))
        keys.append(k[at])
        places.append(at)
        runs = k
    return np.concatenate(keys), places


SCORES = "_k long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int | None = DEPTH) -> DataFrame:
    """(_k, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    train: a condition on doc_id; null counts as true. depth: words of a context at most, None for any number. Tokens are the words between ASCII white space, A-Z lower-cased,
    and an end. base_score sums the log10 of the root's probabilities, score those of the longest states. Null and
    empty texts are their end; a text of over LOT tokens is scored in a block of its own. Rows that repeat an id are
    documents of their own; without training rows every token has the root's probability of one unknown word. An empty
    table gives an empty result. Other columns play no part.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    source = keyed(docs, id_col, text_col).withColumn("held_out", ~F.coalesce(train, F.lit(True)))
    lot = LOT  # what closures hold goes to the workers
    blocks = scratch.put(kernel(source.select("_k", "doc_id", "text", "held_out"), lambda batches: _blocks(batches, lot), BLOCKS), "none")
    tree = Tree(blocks, scratch, depth)
    sent, shards, depth = spark.sparkContext.broadcast(tree.own), tree.shards, tree.depth
    of_all, kinds = tree.tokens, tree.distinct

    def asked(block: int, docs: bytes, tokens: bytes) -> list[tuple]:
        words, ids = _unpack(tokens)
        runs = distinct(_wanted(words, ids, _places(_unpack(docs)[4]), sent.value, depth)[0])
        wanted = {to: [words[own], runs[:0]] for to, own in _dealt(_shard(words, shards))}
        for to, own in _dealt(_shard(runs, shards)):
            wanted.setdefault(to, [words[:0], runs[:0]])[1] = runs[own]
        return [(to, block, _pack(*x)) for to, x in wanted.items()]

    def answered(to: int, rows: list[dict], asks: list[tuple[int, list[np.ndarray]]]) -> pa.Table:
        keys, n, p, left = _unpack(rows[0]["data"]) if rows else _joined([], "u8 i8 f8 f8")
        n, p, left = np.append(n, 0), np.append(p, np.nan), np.append(left, np.nan)  # the last is the answer to what is absent
        out = []
        for block, (words, runs) in asks:
            w, r = _found(keys, words), _found(keys, runs)
            out.append((block, to, _pack(n[w], *_sparse(left[w]), *_sparse(p[r]), *_sparse(left[r]))))
        return pa.Table.from_batches([_rows(out, "to frm data")])

    def scored(_: int, rows: list[dict], answers: list[tuple[int, list[np.ndarray]]]) -> pa.Table:
        k, doc, null, held, sizes = _unpack(rows[0]["docs"])
        words, ids = _unpack(rows[0]["tokens"])
        place = _places(sizes)
        runs, levels = _wanted(words, ids, place, sent.value, depth)
        runs, where = _distinct(runs)
        ends = np.cumsum([0, *map(len, levels)])
        count, word_left = np.zeros(len(words), np.int64), np.full(len(words), np.nan)
        p, left = np.full(len(runs), np.nan), np.full(len(runs), np.nan)
        by_word, by_run = dict(_dealt(_shard(words, shards))), dict(_dealt(_shard(runs, shards)))
        for shard, (n, at, v, p_at, p_v, l_at, l_v) in answers:
            own, own_run = by_word.get(shard), by_run.get(shard)
            if own is not None:
                count[own] = n
                word_left[own[at]] = v
            if own_run is not None:
                p[own_run[p_at]], left[own_run[l_at]] = p_v, l_v
        known = count[ids]
        base = np.log10((count + 0.5) / (of_all + 0.5 * (kinds + 1)))[ids]
        full, before = base.copy(), word_left[ids]  # before: of each place, the share that the run which ends there leaves
        for d, at in enumerate(levels, 1):
            run = where[ends[d - 1] : ends[d]]
            to_next = np.full(len(ids), np.nan)
            to_next[1:] = before[:-1]
            to_next[place < d] = np.nan
            chance = np.full(len(ids), np.nan)
            chance[at] = p[run]
            full = np.where(np.isnan(chance), full + np.nan_to_num(to_next), chance)
            before = np.full(len(ids), np.nan)
            before[at] = left[run]
        first = np.cumsum(sizes) - sizes
        total = lambda x: np.add.reduceat(x, first)
        columns = [pa.array(k), pa.array(doc, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(sizes), pa.array(total((known > 0).astype(np.int64))), pa.array(np.full(len(k), of_all, np.int64)), pa.array(total(base)), pa.array(total(full))]
        return pa.table(dict(zip([x.split()[0] for x in SCORES.split(", ")], columns, strict=True)))

    def of_turn(own: DataFrame) -> DataFrame:
        answers = scratch.put(_met(tree.table, "shard", _each(own.select("block", "docs", "tokens"), asked, "to frm data", ROUTED), answered, ROUTED), "none")
        out = scratch.put(_met(own, "block", answers, scored, SCORES))
        scratch.drop(answers)
        return out

    # what blocks ask and are answered is the largest thing to hold, so they are scored in turns; one shard has few tokens
    turns = TURNS if shards > 1 else 1
    scores = [of_turn(blocks.filter(F.pmod(F.xxhash64("block"), F.lit(turns)) == i)) for i in range(turns)]
    scratch.drop(blocks, tree.table)
    return reduce(DataFrame.unionByName, scores)


def _sparse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(~np.isnan(x))
    return at.astype(np.uint32), x[at]
