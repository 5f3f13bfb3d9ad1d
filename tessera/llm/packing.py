"""Best-fit packing of token pieces into sequences, planned on a histogram of lengths.

How many pieces there are of each length is all that best-fit-decreasing needs, and lengths are bounded by the size of
a sequence, so the plan is made on the driver from at most that many counts, over kinds of sequences rather than
sequences. It gives each length a list of slots: runs of ranks that go to runs of sequences at one offset. Pieces then
take slots by their rank within their length. Ranks come from counts of small groups (a group: one length in one
partition of the ids' hashes), so that a length which many pieces share is not ordered in one task.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, kernel, keyed

SEQUENCE, END = 2048, 0
PER_GROUP = 2_500  # pieces of a group, if all had one length


class ChunkTokenizer:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and splits at it, so texts are cut at white space, and the ids of chunks are
    remembered in two generations of bounded size. A new chunk of printable ASCII and accented Latin-1 letters is
    lower-cased and cut as the tokenizer's own rules cut it, and goes to its merges alone; any other goes through the
    whole tokenizer. Tokenizers with other rules than these take the whole way for all chunks.
    """

    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+|_")
    PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    SPACES = str.maketrans(dict.fromkeys("\t\n\r\x0b\x0c", " "))
    KEPT = re.compile("[\x1c-\x1f]")
    LIMIT = 250_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.new, self.old = self._generation(), {}
        kept = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        other = [b for b in range(256) if b not in set(kept)]  # bytes without a character of their own get those from 256 on
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(other)}
        about = json.loads(self.tokenizer.to_str())
        kinds = [x.get("type") for x in (about["normalizer"] or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (about["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.direct = kinds == ["NFC", "Replace", "Lowercase"] and split[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]

    def _generation(self) -> dict[str, bytes]:
        compute = self._compute

        class Memo(dict):
            def __missing__(self, chunk: str) -> bytes:
                v = self[chunk] = compute(chunk)
                return v

        return Memo()

    def _compute(self, chunk: str) -> bytes:
        if (got := self.old.get(chunk)) is not None:
            return got
        if self.direct and chunk.isascii():  # most are letters with or without a mark at the end
            if chunk.isalpha():
                return self._part(chunk.lower())
            if chunk[-1] in ".,!?" and chunk[:-1].isalpha():
                return self._part(chunk[:-1].lower()) + self._part(chunk[-1])
        if not self.direct or "<|" in chunk or "_" in chunk or not self.PLAIN.fullmatch(chunk):
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self._part, self.PARTS.findall(chunk.lower())))

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) > self.LIMIT:
                self.parts.clear()
            word = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            got = self.parts[part] = struct.pack(f"<{len(ids := [t.id for t in self.model.tokenize(word)])}I", *ids)
        return got

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        # str.split also splits at four separators that the tokenizer keeps
        chunks = [c for c in text.translate(self.SPACES).split(" ") if c] if self.KEPT.search(text) else text.split()
        if len(self.new) > self.LIMIT:
            self.old, self.new = self.new, self._generation()
        return b"".join(map(self.new.__getitem__, chunks))


def _pieces(path: str, size: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ChunkTokenizer(path)
        end = np.array([END], "<u4").tobytes()
        names = ["_k", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
        for b in batches:
            rows: list[tuple] = []
            for k, d, t in zip(*(b.column(c).to_pylist() for c in ("_k", "doc_id", "text")), strict=True):
                ids = tokenizer(t) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[at : at + 4 * size]
                    rows.append((k, d, piece, at // 4, len(cut) // 4, zlib.crc32(cut), *[cut] * keep_ids))
            if rows:
                cols = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * keep_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=names)

    return run


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first: (length, first rank, ranks, first sequence, ranks in a row in each sequence, offset) for each run of slots.

    Sequences with the same room are kept as runs of numbers; a step fills whole runs of them, with as many pieces of
    the length as fit, so the work follows the number of lengths and not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    rooms: list[int] = []
    slots: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                r = rooms[at]
                first, n = room[r].pop()
                if not room[r]:
                    del room[r]
                    rooms.pop(at)
            else:
                r, first = size, made
                n = -(-left // (size // length))
                made += n
            each = r // length
            if each > left:  # the last sequence gets fewer
                each = left
            use = min(n, left // each)
            slots.append((length, rank, use * each, first, each, size - r))
            put(r - each * length, first, use)
            put(r, first + use, n - use)
            rank, left = rank + use * each, left - use * each
    return slots


def best_fit(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """(_k, doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece of each row of docs.

    tokenizer is the path of a tokenizers file. A document is its ids without special tokens, then id 0; only one of
    more than `size` is cut, into pieces of `size`, the last as long as what is left. Sequences hold pieces gapless
    from offset 0. Null text counts as empty and packs as its id 0. Rows that repeat an id are documents of their own;
    a null id is kept. An empty table gives an empty result. Other columns of docs play no part.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    schema = "_k long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    pieces = scratch.put(kernel(keyed(docs, id_col, text_col), _pieces(tokenizer, size, keep_ids), schema))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row a length, `size` at most
    total = sum(counts.values())
    groups = max(1, total // PER_GROUP)
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("_k", "piece"), F.lit(groups)))
    before = pieces.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = before.select("length", "group", (F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "group").orderBy("_k", "piece"))
    ranked = pieces.withColumn("within", within).join(before, ["length", "group"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    slots = plan(counts, size)
    # a few runs for each length: their number is bounded by `size` and not by the data
    names = ["length", "first_rank", "ranks", "first_sequence", "each", "at"]
    table = spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*(slots or [(0,) * 6]), strict=True), strict=True)}))  # Arrow: rows would start workers
    joined = ranked.join(F.broadcast(table), "length").filter("rank >= first_rank and rank < first_rank + ranks")
    inside = F.col("rank") - F.col("first_rank")
    return joined.select("_k", "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.expr("(rank - first_rank) div each")).alias("sequence_id"), (F.col("at") + inside % F.col("each") * F.col("length")).alias("offset"), *["ids"] * keep_ids)
