"""Directory rows that arrive over time: normalized as a stream, and matched by exact name in each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import normalize_source
from tessera.operators.blocking import exact_name
from tessera.settings import DEFAULTS, Settings


def stream_directory(spark: SparkSession, folder: str, s: Settings = DEFAULTS) -> DataFrame:
    """A folder of tab-separated files as an unbounded directory with normalized columns."""
    schema = ", ".join(f"{c} string" for c in s.directory_columns)
    raw = spark.readStream.schema(schema).options(sep="\t", header=True, quote='"', escape='"').csv(folder)
    return normalize_source(raw.na.fill(""), s)


def match_stream(stream: DataFrame, directory: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, s: Settings = DEFAULTS) -> StreamingQuery:
    """Each micro-batch's candidate pairs with a static directory, by exact name under the common-key cap, handed to sink with the batch's number."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(exact_name(rows, directory, s), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
