"""A pipeline over documents: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
runner writes each stage's rows as Parquet and hands them to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, minhash_dedup, packing, suffix_dedup
from tessera.llm.catalogue import table, tokenizer_path
from tessera.llm.common import kernel, with_key
from tessera.storage import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_OUTPUT = -0.5  # of a language's own regression, which is 1 for its typical text and -1 for another's


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, or that no language's classifier takes for its own, go. The label of the others becomes the prediction where it is null."""
    model = language_id.fit(docs, "doc_id", "text", "lang")
    found = language_id.identify(docs, model, lang_col="lang_pred", score_col="lang_score", output_col="lang_output")
    kept = found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("lang_output") >= LEAST_OUTPUT))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id; of rows that repeat an id, each is a document of its own."""
    d = with_key(docs.select(COLUMNS))
    kept = minhash_dedup.near_duplicates(d, id_col="_k").filter("kept").select("_k")
    return d.join(kept, "_k", "left_semi").select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of at least 100 bytes that start earlier in the corpus; a character cut by a removal goes. Documents of which nothing is left go."""

    def text(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for b in batches:
            texts = [k.decode("utf-8", "ignore") for k in b.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_k", "text", "n_chars"])

    d = with_key(docs.select(COLUMNS))
    rest = suffix_dedup.remove_repeats(d, id_col="_k").filter("n_bytes = 0 or n_removed < n_bytes").select("_k", "kept")
    return kernel(rest, text, "_k long, text string, n_chars long").join(d.drop("text", "n_chars"), "_k").select(COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), matches_col="leaks")
    return found.filter(F.size("leaks") == 0).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.best_fit(docs, tokenizer_path()).drop("_k")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("pack", pack)]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        before, docs = docs, scratch.put(done) if i + 1 < len(STAGES) else done
        if i and i + 1 < len(STAGES):
            scratch.drop(before)
    return docs
