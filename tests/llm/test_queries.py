"""The registered queries on small tables, and on empty ones: the columns, the splits and what each contract fixes."""

import random
import zlib

import pytest

from pyspark.sql import functions as F

import __spark_entry__
from tessera.llm import catalogue

COLUMNS = {
    "op1_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op2_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op3_chat_format": ["conv_id", "part", "n_turns", "rendered"],
    "op4_simhash": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"],
    "op5_minhash_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op6_license_scan": ["doc_id", "license", "dice", "line", "n_matches"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_decontaminate": ["doc_id", "item_id", "start", "stop", "distance"],
    "op10_url_filter": ["page_id", "host", "path", "rule", "verdict", "score"],
}
LETTERS = {"en": "etaoin shr", "fr": "éàèaeui pl", "de": "ßäöüen sch"}


def write(spark, folder, docs, pages, items, turns):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    docs = [(i, " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(3, 80))), lang, "s", 1) for i in range(90) for lang in [rng.choice(sorted(LETTERS))]]
    return docs + [(90, docs[0][1], "en", "s", 1), (91, None, None, None, None), (92, "", "en", "s", 0), (93, "x" * 70_000 + " all of these are words that no other text has, nor will have", None, "s", 1), (93, docs[2][1], "en", "t", 1), (None, docs[3][1], "en", "t", 1), (94, docs[5][1] + " Released under the MIT License.", "fr", "s", 1)]


@pytest.fixture(scope="module")
def full(spark, rows, tmp_path_factory):
    pages = [(i, u, None) for i, u in enumerate([f"http://a{i}.com/x/{i}" for i in range(40)] + [f"https://b{i}.net/es/win{i}" for i in range(40)] + ["http://c.org/x/3", "https://d.org/es/win9", None, "none", "http://long.org/" + "q" * 5_000])]
    items = [(1, rows[4][1][:90]), (2, "nowhere at all in these texts"), (3, None)]
    turns = [(c, t, "user", f"{c % 3} {t}") for c in range(9) for t in range(3 + c % 2)]
    return write(spark, tmp_path_factory.mktemp("full"), rows, pages, items, turns)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_tables(spark, empty, name):
    out = catalogue.QUERIES[name](spark, empty)
    assert out.columns == COLUMNS[name] and out.count() == 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, full, rows, name):
    out = catalogue.QUERIES[name](spark, full)
    assert out.columns == COLUMNS[name]
    got = [r.asDict() for r in out.collect()]
    ids = sorted((r[0] is not None, r[0] or 0) for r in rows)
    if "doc_id" in COLUMNS[name] and name not in ("op2_packing", "op9_decontaminate"):
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == ids
    held = lambda d, n: d is not None and zlib.crc32(str(d).encode()) % n == 1
    if name == "op5_minhash_dedup":
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    if name == "op7_language_id":
        assert all(r["held_out"] == held(r["doc_id"], 3) and 0 <= r["score"] <= 1 for r in got)
        lang = {r[0]: r[2] for r in rows}
        asked = [r for r in got if r["held_out"] and r["doc_id"] < 90]
        assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in asked) >= 0.9 * len(asked)
    if name == "op8_lm_score":
        assert all(r["held_out"] == held(r["doc_id"], 5) and r["n_known"] <= r["n_tokens"] and r["score"] < 0 for r in got)
        assert {r["train_tokens"] for r in got} == {sum(len((t or "").split()) + 1 for d, t, *_ in rows if not held(d, 5))}
    if name == "op9_decontaminate":
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(4, 1)}
    if name == "op10_url_filter":
        by = {r["page_id"]: r for r in got}
        assert all((r["score"] is None) == (r["rule"] is not None) for r in got) and len(got) == 85
        assert by[80]["verdict"] == "allow" and by[81]["verdict"] == "block" and (by[82]["host"], by[82]["path"]) == ("", "")


def test_pipeline_on_odd_rows(spark, full, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{full}/documents.parquet")
    out = corpus_pipeline.near_duplicates(spark, docs, full).collect()
    assert sorted((r.source, r.n_chars) for r in out if r.doc_id == 93) == [("s", 1)]  # the other row of this id is a copy
    again = corpus_pipeline.repeated_passages(spark, docs, full).collect()
    assert {(r.lang, r.source) for r in again if r.doc_id == 93} <= {(None, "s"), ("en", "t")}
    assert corpus_pipeline.run(spark, full).count() > 80 and corpus_pipeline.run(spark, empty).count() == 0


def test_registry():
    assert set(COLUMNS) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {"op3_chat_format", "op6_license_scan"} <= set(__spark_entry__.oracle_sql())


def test_long_words_and_texts(spark):
    """A text of several megabytes, with one very long word, through the kernels that cut or batch texts."""
    from tessera.llm import lm_score, minhash_dedup, packing, suffix_dedup

    rng = random.Random(1)
    long = " ".join(f"w{rng.randint(0, 9_999)}" for _ in range(300_000)) + " " + "z" * 200_000
    d = spark.createDataFrame([(1, long), (2, "short " + long[1_000_000:1_000_400]), (3, long)], "doc_id long, text string")
    cut = {r.doc_id: r for r in suffix_dedup.remove_repeats(d).collect()}
    assert cut[3].n_removed == len(long) and 400 <= cut[2].n_removed <= 402 and cut[1].n_removed == 199_999
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(d).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.n_tokens for r in lm_score.score(d, F.col("doc_id") > 0).collect()}[1] == 300_002
    pieces = packing.best_fit(d, catalogue.tokenizer_path()).filter("doc_id = 1").agg({"piece": "max", "length": "sum"}).first()
    assert pieces[0] > 100
