"""Removal of long repeated byte strings, across and within documents.

Which strings of at least LENGTH bytes repeat is read off a suffix array: breadth-first backward extension on the
Burrows-Wheeler transform finds, level by level, where neighbouring suffixes stop sharing a prefix, so common prefixes
come out by increasing value, and it stops at the minimum length. What is left undivided at that level shares a prefix
of that length.

One transform over all text wouldn't fit one machine, so text is dealt out first, without losing a match. Every window
of LENGTH bytes has an anchor: the leftmost of its GRAM-byte strings with the least hash. Equal windows have equal
anchors at equal places, so only windows whose anchor's string occurs again can repeat, and these meet under its hash.
Windows with one anchor are neighbours; the stretch they cover is a context. A context that repeats an earlier one
byte for byte repeats in all its windows; of each distinct context the first goes, with those of the same anchor
string, into a block with a transform of its own. As all contexts of an anchor are aligned at it, the transform's
symbols are 4 bytes counted from the anchor: a window holds 24 or 25 whole symbols and at most 4 bytes beside them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import MIX, Scratch, kernel, keyed

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # GRAM-byte strings in a window
SYMBOL = 4
PIECE = 1 << 19  # bytes hashed at once
LOT = 1 << 18  # contexts of a task collapsed at once
BLOCK = 2 << 20  # bytes of contexts in one transform
HOT = 50_000  # contexts of one anchor string from which on its windows are dealt out one by one

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    h = (h ^ (h >> np.uint64(29))) * MIX[3]
    return h ^ (h >> np.uint64(32))


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(2 * PIECE + LENGTH, _BASE), np.full(2 * PIECE + LENGTH, _INVERSE)  # a piece is shorter than this
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _anchors(a: np.ndarray, valid: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, number of windows, anchor, its hash, the context's hash. valid: which places of a start a window."""
    h = a.astype(np.uint64) + np.uint64(1)
    m, p = 1, int(_BASE)
    while m < GRAM:
        h = h[:-m] * np.uint64(p) + h[m:]
        m, p = 2 * m, p * p % (1 << 64)
    h = _mixed(h)
    v, o, m = h, np.zeros(len(h), np.uint8), 1
    while m < SPAN:
        step = min(m, SPAN - m)
        later = v[step:] < v[:-step]
        o = np.where(later, o[step:] + np.uint8(step), o[:-step])
        v = np.minimum(v[:-step], v[step:])
        m += step
    at = np.arange(len(o)) + o
    starts = np.flatnonzero(valid[: len(o)])
    if not len(starts):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    at = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    s, at = starts[first], at[first]
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64, out=total[1:])
    c = (total[s + count + LENGTH - 1] - total[s]) * down[s]
    return s, count, at, h[at], _mixed(c + count.astype(np.uint64) * MIX[2])


def _pieces(keys: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents joined, or a long one cut so that each window lies in one piece: bytes, where windows start, and each document's key and shift, by place."""
    held: list[tuple[int, int, bytes, int]] = []
    size = 0

    def done() -> tuple[np.ndarray, ...]:
        a = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        valid = np.zeros(len(a), bool)
        begin = np.cumsum([0] + [len(x[2]) for x in held])
        for (_, _, _, windows), at in zip(held, begin.tolist(), strict=False):
            valid[at : at + windows] = True
        return a, valid, begin, np.array([x[:2] for x in held], np.int64)

    for k, t in zip(keys, texts, strict=True):
        windows = len(t) - LENGTH + 1
        for at in range(0, max(0, windows), PIECE):
            n = min(PIECE, windows - at)
            held.append((k, at, t[at : at + n + LENGTH - 1], n))
            size += n + LENGTH - 1
            if size >= PIECE:
                yield done()
                held, size = [], 0
    if held:
        yield done()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the shuffle."""
    c = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("doc_id"), pa.array([c.compress(t) for t in _encoded(b)], pa.binary())], names=["_k", "doc_id", "packed"])


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) for x in batch.column("packed").to_pylist()]


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, c, doc, place. Of LOT contexts at a time, the first of equal ones (state 0; 1 if its anchor string repeats in the lot) goes under the hash of its anchor string, the others (2, surely repeated) anywhere. The low bits of place hold the state. Contexts are equal if both 64-bit hashes are; a chance match of anchor strings alone only adds a context to compare."""
    parts: list[tuple[np.ndarray, ...]] = []

    def lot() -> pa.RecordBatch:
        h, c, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        by = np.lexsort((place, doc, c, h))
        h, c, doc, place = h[by], c[by], doc[by], place[by]
        again, more = np.zeros(len(h), bool), np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        again[1:] = same & (c[1:] == c[:-1])
        more[1:] |= same
        more[:-1] |= same
        state = np.where(again, 2, more.astype(np.int8)).astype(np.int8)
        k, c = np.where(again, doc, h.view(np.int64)), np.where(again, 0, c.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(doc), pa.array(place << 2 | state)], names=["k", "c", "doc", "place"])

    held, powers = 0, _power_tables()
    for b in batches:
        keys, texts = b.column("_k").to_pylist(), _encoded(b)
        order = sorted(range(len(keys)), key=keys.__getitem__)
        for a, valid, begin, of in _pieces([keys[i] for i in order], [texts[i] for i in order]):
            s, count, at, h, c = _anchors(a, valid, *powers)
            d = np.searchsorted(begin, s, side="right") - 1
            place = (s - begin[d] + of[d, 1]) << 16 | (count - 1) << 8 | (at - s)
            parts.append((h, c, of[d, 0], place))
            held += len(h)
            if held >= LOT:
                yield lot()
                held = 0
    if held:
        yield lot()


_CONTEXT = "g long, doc long, start long, stop long, anchor int, context binary"


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What repeats an earlier context whole, as ranges (context null), and first contexts under their anchor string's hash."""
    for b in batches:
        out: list[tuple] = []
        for k, t, marks in zip(b.column("_k").to_pylist(), _unpacked(b), b.column("marks").to_pylist(), strict=True):
            m = np.sort(np.array(marks, np.int64))
            kind, place = m & 3, m >> 2
            start, count, anchor = place >> 16, (place >> 8 & 255) + 1, place & 255
            stop = start + count + LENGTH - 1
            whole = kind == 0
            out += [(k ^ s, k, s, e, 0, None) for s, e in _merged(start[whole], stop[whole])]
            for s, e, o, q in zip(start[~whole].tolist(), stop[~whole].tolist(), anchor[~whole].tolist(), kind[~whole].tolist(), strict=True):
                if q == 1:
                    out.append((xxhash.xxh3_64_intdigest(t[s + o : s + o + GRAM]), k, s, e, o, t[s:e]))
                else:  # of a hot anchor string: each window under its own hash
                    for w in range(s, e - LENGTH + 1):
                        out.append((xxhash.xxh3_64_intdigest(t[w : w + LENGTH]), k, w, w + LENGTH, s + o - w, t[w : w + LENGTH]))
            if len(out) > 20_000:
                yield _as_batch(out)
                out = []
        if out:
            yield _as_batch(out)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    g, k, s, e, o, c = zip(*rows, strict=True)
    g = np.array([x & 0xFFFFFFFFFFFFFFFF for x in g], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(o, pa.int32()), pa.array(c, pa.binary())], names=["g", "doc", "start", "stop", "anchor", "context"])


def _merged(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Sorted ranges, joined where they touch."""
    if not len(start):
        return []
    reach = np.maximum.accumulate(stop)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), reach[np.append(first[1:], len(start)) - 1].tolist(), strict=True))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of symbols by prefix doubling; t ends with a symbol that occurs once."""
    n, k = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        sa = np.argsort(key)
        key = key[sa]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(key[1:] != key[:-1])
        rank[sa] = new
        if new[-1] == n - 1 or k >= n:
            return sa
        k *= 2


def common_prefix_levels(t: np.ndarray, sa: np.ndarray, levels: list[int]) -> dict[int, np.ndarray]:
    """For each level, whether a row of the suffix array shares fewer symbols with the row before.

    Backward extension of all intervals at once: extending by a symbol maps the rows that it precedes, in order, to
    the rows of its first column. Two neighbours there share one symbol more than the rows that they come from, so
    what is divided at one level divides its image at the next.
    """
    bwt = t[sa - 1]
    back = np.argsort(bwt, kind="stable")  # row i of the first column comes from row back[i]
    other = np.ones(len(t), bool)
    other[1:] = bwt[back[1:]] != bwt[back[:-1]]
    divided = np.zeros(len(t), bool)
    divided[0] = True
    out = {}
    for level in range(1, max(levels) + 1):
        interval = np.cumsum(divided)[back]
        divided = other.copy()
        divided[1:] |= interval[1:] != interval[:-1]
        if level in levels:
            out[level] = divided
    return out


def repeated_windows(contexts: list[bytes], anchors: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each window of each context equals an earlier window; contexts come in order of (document, start). Windows of one document at the same start are the same."""
    n = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(n) - n
    data = np.frombuffer(b"".join(contexts), np.uint8)
    phase = anchors % SYMBOL
    symbols = (n - phase) // SYMBOL
    at = np.cumsum(np.append(0, symbols + 1))
    owner = np.repeat(np.arange(len(n)), symbols)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(symbols) - symbols, symbols)
    byte = begin[owner] + phase[owner] + inside * SYMBOL
    code = np.zeros(len(owner), np.int64)
    for j in range(SYMBOL):
        code |= data[byte + j].astype(np.int64) << (8 * (SYMBOL - 1 - j))
    t = np.empty(at[-1], np.int64)
    t[at[owner] + inside] = code + len(n)
    t[at[1:] - 1] = np.arange(len(n))[::-1]  # each context ends with a symbol of its own
    sa = suffix_array(t)
    row = np.empty(len(t), np.int64)
    row[sa] = np.arange(len(t))
    low, high = (LENGTH - SYMBOL + 1) // SYMBOL, LENGTH // SYMBOL
    levels = common_prefix_levels(t, sa, [low, high])
    windows = n - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), windows)
    w = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    head = (phase[owner] - w) % SYMBOL
    suffix = row[at[owner] + (w + head - phase[owner]) // SYMBOL]
    group = np.where(head == 0, (np.cumsum(levels[high]) - 1)[suffix], (np.cumsum(levels[low]) - 1)[suffix] + len(t))
    many = np.bincount(group, minlength=2 * len(t))[group] > 1
    left = np.flatnonzero(many)
    rest = np.zeros(len(left), np.uint64)
    base = begin[owner[left]] + w[left]
    for j in range(SYMBOL):  # the bytes beside the whole symbols
        place = np.where(j < head[left], j, low * SYMBOL + j)
        rest = rest << np.uint64(8) | np.where(head[left] == 0, 0, data[base + place]).astype(np.uint64)
    key = (group[left] * SYMBOL + head[left]).astype(np.uint64) << np.uint64(32) | rest
    by = np.argsort(key, kind="stable")
    again = np.zeros(len(left), bool)
    again[by[1:]] = key[by[1:]] == key[by[:-1]]
    out = np.zeros(len(owner), bool)
    out[left[again]] = True
    return out


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (doc, start, stop) to remove, of rows in the order of g, doc and start."""
    rows: list[tuple[int, int, int, int, bytes]] = []
    size, last = 0, None
    seen: set[bytes] = set()

    def work() -> pa.RecordBatch | None:
        rows.sort(key=lambda r: (r[1], r[2]))
        start = np.array([r[2] for r in rows], np.int64)
        doc = np.array([r[1] for r in rows], np.int64)
        contexts = [r[4] for r in rows]
        again = repeated_windows(contexts, np.array([r[3] for r in rows], np.int64), start)
        windows = np.array([len(c) - LENGTH + 1 for c in contexts])
        owner = np.repeat(np.arange(len(rows)), windows)
        w = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = np.flatnonzero(again)
        if not len(hit):
            return None
        new, end = np.ones(len(hit), bool), np.ones(len(hit), bool)
        new[1:] = (owner[hit[1:]] != owner[hit[:-1]]) | (hit[1:] != hit[:-1] + 1)
        end[:-1] = new[1:]
        a, z = hit[new], hit[end]
        return pa.RecordBatch.from_arrays([pa.array(doc[owner[a]]), pa.array(start[owner[a]] + w[a]), pa.array(start[owner[z]] + w[z] + LENGTH)], names=["doc", "start", "stop"])

    for b in batches:
        null = b.column("context").is_null()
        plain = b.filter(null)
        if plain.num_rows:
            yield pa.RecordBatch.from_arrays([plain.column(c) for c in ("doc", "start", "stop")], names=["doc", "start", "stop"])
        real = b.filter(pa.compute.invert(null))
        whole: list[tuple[int, int, int]] = []
        for g, doc, start, stop, anchor, context in zip(*(real.column(c).to_pylist() for c in ("g", "doc", "start", "stop", "anchor", "context")), strict=True):
            if g != last:
                if size >= BLOCK:
                    if (out := work()) is not None:
                        yield out
                    rows.clear()
                    size = 0
                seen.clear()
                last = g
            if context in seen:
                whole.append((doc, start, stop))
                continue
            seen.add(context)
            rows.append((g, doc, start, anchor, context))
            size += len(context)
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*whole, strict=True)], names=["doc", "start", "stop"])
    if rows and (out := work()) is not None:
        yield out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, removed, spans, kept, digest = [], [], [], [], []
        for t, s, e in zip(_unpacked(b), b.column("starts").to_pylist(), b.column("stops").to_pylist(), strict=True):
            order = sorted(zip(s or (), e or (), strict=True))
            ranges = _merged(np.array([x[0] for x in order], np.int64), np.array([x[1] for x in order], np.int64))
            rest, at = [], 0
            for x, y in ranges:
                rest.append(t[at:x])
                at = y
            rest = b"".join([*rest, t[at:]])
            size.append(len(t))
            removed.append(len(t) - len(rest))
            spans.append([{"start": x, "stop": y} for x, y in ranges])
            kept.append(rest)
            digest.append(hashlib.sha256(rest).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(digest)], names=["_k", "doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(_k, doc_id, n_bytes, n_removed, spans, kept, kept_sha256) for each row of docs.

    A byte goes if a 100-byte string that covers it also starts earlier: in a document with a smaller id, or at a
    smaller start in the same one. Strings are those of the input and may overlap; none crosses documents. spans are
    the maximal removed ranges of bytes, kept the rest. Null text counts as empty; texts under 100 bytes stay whole.
    Rows that repeat an id are documents of their own, ordered by text; a null id sorts first. An empty table gives an
    empty result. Other columns of docs play no part. Anchor strings with over `hot` contexts are dealt out by window.
    """
    source, scratch = keyed(docs, id_col, text_col), Scratch(docs.sparkSession)
    anchors = kernel(source.select("_k", "text"), _anchor_rows, "k long, c long, doc long, place long").repartition("k")
    state = F.col("place").bitwiseAND(F.lit(3))
    met = anchors.withColumn("turn", F.row_number().over(Window.partitionBy("k", "c").orderBy("doc", "place"))).withColumn("met", F.sum(F.when(state < 2, 1).otherwise(0)).over(Window.partitionBy("k")))
    kind = F.when((state == 2) | (F.col("turn") > 1), 0).when(F.col("met") > hot, 2).otherwise(1)
    mark = F.shiftright("place", 2) * 4 + kind
    marks = met.filter((state > 0) | (F.col("met") > 1)).select("doc", mark.alias("mark")).groupBy("doc").agg(F.collect_list("mark").alias("marks"))
    marks = scratch.put(marks)
    text = kernel(source, _packed, "_k long, doc_id long, packed binary")
    contexts = kernel(text.join(marks, F.col("_k") == F.col("doc")).select("_k", "doc_id", "packed", "marks"), _context_rows, _CONTEXT)
    ranges = kernel(contexts.repartition("g").sortWithinPartitions("g", "doc", "start"), _repeats, "doc long, start long, stop long")
    ranges = scratch.put(ranges.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")))
    scratch.drop(marks)
    out = text.join(ranges, F.col("_k") == F.col("doc"), "left").select("_k", "doc_id", "packed", "starts", "stops")
    return kernel(out, _cut, "_k long, doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary, kept_sha256 string")
