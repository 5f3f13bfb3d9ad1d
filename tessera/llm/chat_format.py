"""Chat formatting: logged snapshots of one conversation collapse to the longest, which is rendered, in DataFrame operations only.

A conversation's log often holds it several times, each time with more turns. Each turn has a hash of its place and
content; the sum of a conversation's first i hashes is the rolling hash of its prefix of i turns (four 32-bit lanes, so
sums never overflow). A conversation goes if another one has a longer sequence of turns that begins with all of its own,
or the same turns and a smaller id: two anti-joins, against the distinct proper prefixes and against the first of each
distinct whole. Turns are ranked and summed in blocks of 1024 turn numbers, with the blocks' own sums carried over, so
a conversation with very many turns isn't ordered in one task; distinct prefixes are combined before they are shuffled.
What is rendered are parts of BLOCK turns, by rank, so that no row holds more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, LANES = 1_024, 4
START, END, UNKNOWN = "<|im_start|>", "<|im_end|>", "unknown"


def _lanes(place: Column) -> list[Column]:
    """Four 32-bit numbers from the hashes of a turn's place and content."""
    out = []
    for seed in range(LANES // 2):
        h = F.xxhash64(F.lit(seed), place, F.col("role"), F.col("role").isNull(), F.col("text"), F.col("text").isNull())
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return out


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Distinct turns with their rank in the conversation (from 1) and block."""
    d = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    d = d.filter("conv_id is not null").distinct().withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    return d.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)).cast("long"))


def maximal_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, i) of the turns of the conversations that no other one extends or repeats.

    Turns come in the order of turn, role and text (null first); repeated rows count once. Nulls in role and text are
    content like other values; rows without conv_id belong to no conversation and go. Of conversations with the same
    turns the one with the smallest id stays. An empty table gives an empty result. Other columns play no part.
    """
    d = _turns(rows, conv_col, turn_col, role_col, text_col)
    blocks = d.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = blocks.select("conv_id", "block", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("n")).alias("before"))
    d = d.join(before, ["conv_id", "block"]).withColumn("i", F.col("i") + F.col("before"))
    names = [f"h{j}" for j in range(LANES)]
    hashed = d.select("conv_id", "block", "i", *[h.alias(n) for h, n in zip(_lanes(F.col("i")), names, strict=True)])
    w = Window.partitionBy("conv_id", "block").orderBy("i")
    inside = hashed.select("conv_id", "block", "i", *[F.sum(n).over(w).alias(n) for n in names])
    sums = hashed.groupBy("conv_id", "block").agg(*[F.sum(n).alias(n) for n in names])
    w = Window.partitionBy("conv_id").orderBy("block")
    carried = sums.select("conv_id", "block", *[(F.sum(n).over(w) - F.col(n)).alias(f"c{n}") for n in names])
    prefixes = inside.join(carried, ["conv_id", "block"]).select("conv_id", "i", *[(F.col(n) + F.col(f"c{n}")).alias(n) for n in names])
    whole = hashed.groupBy("conv_id").agg(F.count("*").alias("n"), *[F.sum(n).alias(n) for n in names])
    proper = prefixes.join(whole.select("conv_id", "n"), "conv_id").filter("i < n").select(F.col("i").alias("n"), *names).distinct()
    first = whole.groupBy("n", *names).agg(F.min("conv_id").alias("conv_id"))
    kept = first.join(proper, ["n", *names], "left_anti").select("conv_id")
    return d.drop("before").join(kept, "conv_id", "left_semi").select("conv_id", "turn", "role", "text", "i")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, rendered): the turns of maximal_conversations as chat text, in parts (from 0) of BLOCK turns, the last as long as what is left."""
    line = F.concat(F.lit(START), F.coalesce("role", F.lit(UNKNOWN)), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    rows = turns.select("conv_id", F.expr(f"(i - 1) div {BLOCK}").alias("part"), F.struct("i", line.alias("line")).alias("x"))
    return rows.groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "").alias("rendered"))


def format_chats(rows: DataFrame, **columns: str) -> DataFrame:
    return render(maximal_conversations(rows, **columns))


#: DuckDB.
ORACLE = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, count(*) AS n, string_agg(md5(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '')), '' ORDER BY i) AS d FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT substr(d, 1, 32 * i) AS d FROM (SELECT d, unnest(range(1, n)) AS i FROM c)),
k AS (SELECT min(conv_id) AS conv_id FROM c WHERE d NOT IN (SELECT d FROM p) GROUP BY d)
SELECT t.conv_id, CAST((i - 1) // {BLOCK} AS BIGINT) AS part, CAST(count(*) AS BIGINT) AS n_turns,
  string_agg('{START}' || coalesce(role, '{UNKNOWN}') || chr(10) || coalesce(text, '') || '{END}' || chr(10), '' ORDER BY i) AS rendered
FROM t JOIN k USING (conv_id) GROUP BY ALL
"""
