"""Benchmark items in documents, up to edits.

An item is found where a window, which may start at any character, is within RATE times the item's length of edits of it, both
lower-cased with white space as one blank. Windows of an item's size are embedded by CGK random walks, under which
strings a few edits apart fall in step again and differ in few places. Each of several walks is sampled at a few
places, several times; windows that agree with an item in AGREE whole samples are that item's candidates, and are
verified by exact edit distance (bit-parallel).

Before that, windows that can't match any item of a class of like lengths are skipped by a bound: within e edits of an
item of m characters, a window has at least m - q + 1 - q * e of its q-grams, each at most e places from where the item
has it. q is GRAM, or for short items what keeps the bound at 1 or more, m // (e + 1), so no match is skipped.

Recall of the sampling is what tests/llm measures against exact search for items of 1 to 400 characters and up to all
their edits: at least 0.95 in each range of lengths; exact copies are always found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.llm.common import MIX, kernel

RATE = 0.08  # edits for each character of an item
GRAM = 10
WALKS, SAMPLES, PLACES, AGREE = 9, 12, 4, 2
STEP = 1.15  # items up to so many times as long share windows
BLOCK = 1 << 20  # characters at once
WINDOW_CODES = 1 << 21  # characters of windows embedded at once
ITEM_CHARS = 20_000_000  # of items held by each worker at once; more are searched for in several passes


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    h = np.zeros(max(0, len(codes) - q + 1), np.uint32)
    for j in range(q):
        h = (h + codes[j : j + len(h)] + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h


def bounded_distance(item: str, window: str, most: int) -> tuple[int, int] | None:
    """The least edit distance of the item to a start of the window, and that start's length; None if over most."""
    m = len(item)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best[0]:
            best = (score, j)
        elif score - (len(window) - j) > most:
            break
    return best if best[0] <= most else None


class ItemIndex:
    """Items in classes of like length, their q-grams and the sampled walks of each."""

    def __init__(self, items: list[tuple[int | None, str]]):
        known = [(i, n) for i, t in items if (n := normalised(t))]
        self.edits = [int(RATE * len(t)) for _, t in known]
        # q-grams short enough that an item with all its edits keeps one at least
        grams = [min(GRAM, len(t) // (e + 1)) for (_, t), e in zip(known, self.edits, strict=True)]
        by = sorted(range(len(known)), key=lambda x: (grams[x], len(known[x][1]), known[x][1], known[x][0] is None, known[x][0] or 0))
        self.items, self.edits, self.q = [known[x] for x in by], np.array([self.edits[x] for x in by], np.int64), np.array([grams[x] for x in by], np.int64)
        self.length = np.array([len(t) for _, t in self.items], np.int64)
        self.needed = self.length + 1 - self.q * (1 + self.edits)
        self.classes: list[tuple[int, int]] = []  # the first item, one past the last
        first = 0
        for i in range(len(self.items)):
            if i + 1 == len(self.items) or self.q[i + 1] != self.q[first] or self.length[i + 1] > STEP * self.length[first]:
                self.classes.append((first, i + 1))
                first = i + 1
        self.class_of = np.repeat(np.arange(len(self.classes)), [b - a for a, b in self.classes])
        self.steps = [max(2, int(1.8 * self.length[a])) for a, _ in self.classes]
        self.grams = {int(q): self._grams(int(q)) for q in np.unique(self.q)}
        rng = np.random.default_rng(7)
        self.turns = [rng.integers(0, 2, (max(self.steps, default=0), 256), dtype=np.int64) for _ in range(WALKS)]
        places = PLACES if len(self.items) else 0
        self.places = [[np.sort(rng.integers(0, n, (SAMPLES, places)), axis=1) for n in self.steps] for _ in range(WALKS)]
        self.keys = [self._item_keys(k) for k in range(len(self.classes))]

    def _grams(self, q: int) -> tuple[np.ndarray, ...]:
        """Sorted hashes of the q-grams of the items that are searched by q-grams of this length, with item and offset, and a table of the hashes' leading bits."""
        own = np.flatnonzero(self.q == q)
        hashes = [_gram_hashes(_codes(self.items[i][1]), q) for i in own.tolist()]
        grams, of = np.concatenate(hashes), np.repeat(own, [len(h) for h in hashes])
        offset = np.concatenate([np.arange(len(h)) for h in hashes])
        by = np.argsort(grams, kind="stable")
        table = np.zeros(1 << 22, bool)
        table[grams >> np.uint32(10)] = True
        return grams[by], of[by], offset[by], table

    def _item_keys(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.classes[k]
        width, keys, rows = self.steps[k] + 1, [], []
        for at in range(a, b, most := max(1, WINDOW_CODES // width)):
            part = np.zeros((min(most, b - at), width), np.uint32)
            for j in range(len(part)):
                c = _codes(self.items[at + j][1])[:width]
                part[j, : len(c)] = c
            own, row = self.sampled(part, k)
            keys.append(own)
            rows.append(row + at)
        keys, rows = np.concatenate(keys), np.concatenate(rows)
        by = np.argsort(keys, kind="stable")
        return keys[by], rows[by]

    def sampled(self, windows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the windows (rows of codes) of class k, and the windows they are of."""
        keys, rows, n = [], [], len(windows)
        text, starts, own = windows.ravel(), np.arange(n) * windows.shape[1], np.arange(n)
        for walk in range(WALKS):
            p, seen = starts.copy(), np.empty((self.steps[k], n), np.uint32)
            turns = self.turns[walk]
            for j in range(self.steps[k]):
                c = seen[j] = text[p]
                p += turns[j][c & np.uint32(255)]
            for sample in range(SAMPLES):
                h = np.full(n, (walk * SAMPLES + sample) * 1009 + 1, np.uint64)
                for place in self.places[walk][k][sample].tolist():
                    h = (h ^ seen[place].astype(np.uint64)) * MIX[0]
                    h ^= h >> np.uint64(29)
                keys.append(h)
                rows.append(own)
        return np.concatenate(keys), np.concatenate(rows)

    def search(self, texts: list[str]) -> list[list[tuple[int | None, int, int, int]]]:
        """Of each normalised text: (item, start, stop, distance) of the best match of each item found."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in self.classes]  # windows of each class that wait for more
        size = [0] * len(self.classes)
        pad, at = max(self.steps, default=0) + 1, 0
        while at < len(texts) and self.items:
            to, n = at, 0
            while to < len(texts) and (to == at or n + len(texts[to]) < BLOCK):
                n += len(texts[to]) + 1
                to += 1
            codes = _codes("\0".join(["", *texts[at:to], ""]) + "\0" * pad)
            begin = np.flatnonzero(codes == 0)[: to - at] + 1
            start, kind = self._candidates(codes, begin, pad)
            doc = np.searchsorted(begin, start, side="right") - 1
            for k in np.unique(kind).tolist():
                own, most = np.flatnonzero(kind == k), max(1, WINDOW_CODES // (self.steps[k] + 1))
                for x in range(0, len(own), most):
                    part = own[x : x + most]
                    held[k].append((codes[start[part, None] + np.arange(self.steps[k] + 1)], doc[part] + at, (start - begin[doc])[part]))
                    size[k] += len(part)
                    if size[k] >= most:
                        self._match(k, held[k], texts, found)
                        held[k], size[k] = [], 0
            at = to
        for k, windows in enumerate(held):
            if windows:
                self._match(k, windows, texts, found)
        return [[(self.items[i][0], s, e, d) for i, (d, s, e) in sorted(f.items())] for f in found]

    def _candidates(self, codes: np.ndarray, begin: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows start that can match an item, and the item's class."""
        starts, kinds = [], []
        far = 1 << 40
        for q, (grams, gram_item, gram_offset, table) in self.grams.items():
            h = _gram_hashes(codes, q)
            place = np.flatnonzero(table[h >> np.uint32(10)])
            lo, hi = np.searchsorted(grams, h[place]), np.searchsorted(grams, h[place], side="right")
            place, lo, n = np.repeat(place, hi - lo), np.repeat(lo, hi - lo), hi - lo
            entry = lo + np.arange(len(lo)) - np.repeat(np.cumsum(n) - n, n)
            item, origin = gram_item[entry], place - gram_offset[entry]
            key = np.sort(item * far + origin + (1 << 20))
            item = key // far
            edits, needed = self.edits[item], self.needed[item]
            last = np.minimum(np.arange(len(key)) + needed - 1, len(key) - 1)
            ok = (np.arange(len(key)) + needed <= len(key)) & (key[last] <= key + 2 * edits)
            first, final, edits, item = (key % far - (1 << 20))[ok], (key % far - (1 << 20))[last][ok], edits[ok], item[ok]
            if not len(item):
                continue
            # a whole copy is a match that no other one betters, so an item that must be whole is tried where it first is in a text
            whole = np.flatnonzero(edits == 0)
            whole = whole[np.unique(item[whole] * far + np.searchsorted(begin, first[whole], side="right"), return_index=True)[1]] if len(whole) else whole
            use = edits > 0
            use[whole] = True
            first, final, edits, item = first[use], final[use], edits[use], item[use]
            # the ranges of starts, overlapping ones of a class as one
            low, high = np.maximum(final - edits, 1), np.minimum(first + edits, len(codes) - pad - 1)
            use = low <= high
            kind = self.class_of[item[use]] * far
            by = np.argsort(kind + low[use], kind="stable")
            low, high = (kind + low[use])[by], np.maximum.accumulate((kind + high[use])[by])
            new = np.flatnonzero(np.append(True, low[1:] > high[:-1])[: len(low)])
            low, high = low[new], high[np.append(new[1:], len(high)) - 1] if len(new) else high
            n = high - low + 1
            start = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, kind = start % far, start // far
            use = codes[start] != 0
            starts.append(start[use])
            kinds.append(kind[use])
        empty = np.empty(0, np.int64)
        return np.concatenate([empty, *starts]), np.concatenate([empty, *kinds])

    def _match(self, k: int, windows: list[tuple[np.ndarray, ...]], texts: list[str], found: list[dict]) -> None:
        """Windows and items that agree in AGREE whole samples are compared exactly."""
        codes, doc, start = (np.concatenate(x) for x in zip(*windows, strict=True))
        keys, rows = self.sampled(codes, k)
        item_keys, owner = self.keys[k]
        lo, hi = np.searchsorted(item_keys, keys), np.searchsorted(item_keys, keys, side="right")
        hit = np.repeat(np.arange(len(keys)), hi - lo)
        item = owner[np.arange(len(hit)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[hit]]
        pairs, votes = np.unique(rows[hit] * len(self.items) + item, return_counts=True)
        for x in pairs[votes >= AGREE].tolist():
            w, i = x // len(self.items), x % len(self.items)
            d, s, text, most = int(doc[w]), int(start[w]), self.items[i][1], int(self.edits[i])
            if found[d].get(i, (1,))[0] == 0:
                continue
            got = bounded_distance(text, texts[d][s : s + len(text) + most], most)
            if got and (got[0], s) < found[d].get(i, (1 << 60, 0))[:2]:
                found[d][i] = (got[0], s, s + got[1])


MATCH = ArrayType(StructType([StructField(n, LongType()) for n in ("item_id", "start", "stop", "distance")]))


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", matches_col: str = "matches") -> DataFrame:
    """docs with the items found in each whole text: item_id, start and stop in the normalised text, edit distance, of each item's best match.

    Null and blank texts hold no item; null and blank items are never found; items of up to 12 characters allow no edit.
    Very long texts are searched whole, in turns of whole texts of BLOCK characters or one longer text. Repeated rows are searched alike, and
    repeated items are all found. An empty table on either side gives no match. An added column replaces one of the
    same name. Each worker holds at most ITEM_CHARS characters of items, whatever the size of the benchmark; more
    items are searched for in further passes over docs.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).filter(F.length(F.trim("t")) > 0)
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = max(1, -(-chars // ITEM_CHARS))
    out = docs.drop(matches_col)
    for p in range(passes):
        part = items if passes == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == p)
        index = spark.sparkContext.broadcast(ItemIndex([(r.i, r.t) for r in part.collect()]))  # ITEM_CHARS at most
        place = out.columns.index(text_col)
        old = out.columns.index(matches_col) if p else None
        names = [c for c in out.columns if c != matches_col]
        schema = type(out.schema)([f for f in out.schema.fields if f.name != matches_col]).add(matches_col, MATCH)
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "start", "stop", "distance")]))

        def run(batches: Iterator[pa.RecordBatch], index=index, place=place, old=old, names=names, kind=kind) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [[dict(zip(("item_id", "start", "stop", "distance"), m, strict=True)) for m in ms] for ms in index.value.search([normalised(t) for t in b.column(place).to_pylist()])]
                if old is not None:
                    rows = [x + y for x, y in zip(b.column(old).to_pylist(), rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(rows, kind)], names=[*names, matches_col])

        out = kernel(out, run, schema)
    return out
