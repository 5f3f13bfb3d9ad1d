import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions.text import normalize_source
from tessera.operators import blocking, metrics, pairs, profiling, training
from tessera.plans import workflow
from tessera.settings import DEFAULTS
from tessera.sources import tsv
from tessera.streaming import incremental

D = "entity_id string, business_name string, business_address string, country string"
LEFT = [("S1-1", "Blue Moon Café", "12 High St", "US"), ("S1-2", "राम स्टोर्स", "7 MG Road", "India"), ("S1-3", "Acme Tools", "", ""), ("S1-4", "X", "9 Elm", "US"), ("S1-5", "", "", "")]
RIGHT = [("S2-1", "Blue Moon Cafe", "12 High Street", "USA"), ("S2-2", "राम स्टोर्स", "Near temple", "India"), ("S2-3", "Acme-Tools", "5 Oak", "US"), ("S2-4", "Zeta", "9 Elm", "US"), ("S2-5", "Acme Tools", "", ""), ("S2-6", "Blue Whale", "", "France")]


def directories(spark):
    return normalize_source(spark.createDataFrame(LEFT, D)), normalize_source(spark.createDataFrame(RIGHT, D))


def found(df):
    return {tuple(r) for r in df.collect()}


def test_blocking(spark):
    left, right = directories(spark)
    c = blocking.generate_candidates(left, right, 2)
    assert c.columns == ["source1_entity_id", "candidate_entity_id"]
    got = found(c)
    assert len(got) == c.count()
    assert {("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-4", "S2-4"), ("S1-3", "S2-3"), ("S1-3", "S2-5")} <= got
    assert not any(a == "S1-5" for a, _ in got)
    with pytest.raises(ValueError):
        blocking.generate_candidates(left.drop("name_norm"), right)


def test_common_keys_are_capped(spark):
    left, right = directories(spark)
    assert found(blocking.exact_name(left, right, cap=1)) == {("S1-2", "S2-2")}
    assert ("S1-3", "S2-3") in found(blocking.exact_name(left, right, cap=2))
    assert found(blocking.name_country(left, right)) == {("S1-2", "S2-2"), ("S1-3", "S2-5")} - {("S1-3", "S2-5")}


def test_character_ratio_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert sim.lcs_length(a, b) == row[-1]
        assert sim.char_ratio(a, b) == sim.char_ratio(b, a)
        assert 0 <= sim.char_ratio(a, b) <= 1
    assert sim.char_ratio("tide", "diet", "gestalt") == 0.25


def test_features(spark):
    left, right = directories(spark)
    p = spark.createDataFrame([("S1-1", "S2-1"), ("S1-5", "S2-4"), ("S1-9", "S2-1"), ("S1-3", "S2-3")], "source1_entity_id string, candidate_entity_id string")
    rows = {r.source1_entity_id: r for r in pairs.build_features(p, left, right).collect()}
    assert list(rows["S1-1"].asDict())[2:] == pairs.get_feature_names()
    assert len(pairs.get_feature_names()) == 26
    assert rows["S1-1"].country_match == 1 and rows["S1-1"].house_number_match == 1
    assert rows["S1-9"].name_missing_s1 == 1 and rows["S1-9"].name_len_diff == 1 and rows["S1-9"].name_low_address_high_support == 0
    assert rows["S1-3"].name_exact_match == 1 and rows["S1-3"].address_len_diff == 1
    assert pairs.build_features(p.limit(0), left, right).count() == 0


def test_labels(spark):
    truth = spark.createDataFrame([("S1-1", "S2-1, S2-1,"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    assert pairs.build_training_labels(truth).count() == 2
    assert pairs.build_training_labels(truth, dedupe=True).count() == 1
    p = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2")], "source1_entity_id string, candidate_entity_id string")
    assert sorted(r.label for r in pairs.attach_labels(p, truth, dedupe=True).collect()) == [0, 1]


def scored_toy(spark):
    rows = [("a", "1", 1, 0.9), ("b", "2", 1, 0.8), ("b", "3", 1, 0.6), ("c", "4", 0, 0.7), ("d", "5", 0, 0.2), ("a", "6", 0, 0.4)]
    truth = [("a", "1"), ("b", "2,3"), ("c", ""), ("d", "9"), ("e", "")]
    return spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, label int, proba double"), spark.createDataFrame(truth, "source1_entity_id string, matched_entity_ids string")


def test_metrics(spark):
    scored, truth = scored_toy(spark)
    n = metrics.true_match_counts(truth, truth)
    f = {r.source1_entity_id: r for r in metrics.evaluate_at_threshold(scored, n, 0.5).collect()}
    assert f["a"].f_beta == 1 and f["b"].f_beta == 1 and f["c"].f_beta == 0 and f["e"].f_beta == 1
    assert (f["d"].fn, f["d"].f_beta) == (1, 0)
    t, curve = metrics.select_best_threshold(scored, truth, truth)
    at = {r.threshold: r for r in curve.collect()}
    assert len(at) == 99 and at[t].macro_f_beta >= at[0.5].macro_f_beta
    one = metrics.macro_fbeta_at_threshold(scored, n, 0.35).first()
    assert abs(one.macro_f_beta - at[0.35].macro_f_beta) < 1e-12
    assert t == min(x for x, r in at.items() if round(r.macro_f_beta, 12) == round(at[t].macro_f_beta, 12))
    got = dict(found(metrics.build_predictions(scored, truth, 0.5)))
    assert got == {"a": "1", "b": "2,3", "c": "4", "d": "", "e": ""}
    with pytest.raises(ValueError):
        metrics.search_thresholds(scored, n, [])


def test_split_and_sampling(spark):
    rows = [(f"S1-{i % 40}", f"S2-{i}", int(i % 10 == 0), (i * 37 % 101) / 101) for i in range(400)]
    d = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, label int, name_char_sim double")
    train, val = training.grouped_split(d)
    ids = lambda x: {r[0] for r in x.select("source1_entity_id").distinct().collect()}
    assert len(ids(val)) == 6 and not ids(train) & ids(val) and train.count() + val.count() == 400
    s = training.sample_training_pairs(d)
    assert s.filter("label = 1").count() == 40 and s.filter("label = 0").count() == 160 and s.distinct().count() == 200
    hard = sorted((r[3] for r in rows if not r[2]), reverse=True)[79]
    assert s.filter(f"label = 0 and name_char_sim >= {hard}").count() >= 80
    assert training.sample_training_pairs(d.filter("label = 0")).count() == 360


def test_tsv(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('country\tentity_id\tbusiness_name\tbusiness_address\textra\nUS\tS1-01\t"say ""hi"" \\ x"\tNA\t1\n\tS10-2\t"a\tb"\t\t\n', encoding="utf-8")
    rows = tsv.load_source(spark, str(p), "S1").orderBy("entity_id").collect()
    assert rows[0].business_name == 'say "hi" \\ x' and rows[0].business_address == "NA" and rows[0].entity_id == "S1-01"
    assert rows[1].business_name == "a\tb" and rows[1].country == "" and rows[1].business_address == ""
    with pytest.raises(ValueError):
        tsv.load_source(spark, str(p), "S2")
    with pytest.raises(ValueError):
        tsv.load_ground_truth(spark, str(p))
    out = tmp_path / "out"
    tsv.save_predictions(spark.createDataFrame([("S1-1", ""), ("S1-2", "S2-1,S3-1")], "source1_entity_id string, matched_entity_ids string").orderBy("source1_entity_id"), str(out))
    text = out.read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\t\nS1-2\tS2-1,S3-1\n"
    assert tsv.discover(spark, str(tmp_path), ["a.tsv", "b.tsv"]).keys() == {"a.tsv"}


def test_profile(spark):
    d = spark.createDataFrame([("S1-1", "n/a", "  ", "US"), ("S1-1", "A_b", "x", ""), ("zz", "a_B", "x", "France"), ("S2-3", "é", "", "India")], D)
    m = {r.column: r for r in profiling.missing_counts(d).collect()}
    assert (m["business_name"].n_missing, m["business_name"].n_empty, m["business_address"].n_missing) == (1, 0, 2)
    assert tuple(profiling.id_counts(d).first()) == (4, 3, 1)
    assert dict(found(profiling.prefix_counts(d))) == {"S1": 2, "S2": 1, "<OTHER>": 1}
    dup = {r.column: r for r in profiling.duplicate_rates(d).collect()}
    assert (dup["business_name"].n_nonempty, dup["business_name"].n_distinct) == (4, 3)
    assert {r.kind for r in profiling.observations({"f": d}).collect()} == {"missing", "duplicates", "countries"}
    truth = spark.createDataFrame([("S1-1", "S2-1,S2-1,bad"), ("S1-1", ""), ("S1-2", "S3-1")], "source1_entity_id string, matched_entity_ids string")
    s = profiling.truth_summary(truth).first()
    assert (s.rows, s.zero, s.single, s.multi, s.links, s.malformed, s.most, s.duplicate_rows) == (3, 1, 1, 1, 3, 1, 2, 1)
    assert "A_b" not in profiling.report({"f": d}, truth)


def test_end_to_end(spark, tmp_path):
    rng = random.Random(1)
    names = [" ".join(rng.choice(["red", "blue", "moon", "star", "cafe", "shop", "tool", "acme"]) for _ in range(3)) + f" {i}" for i in range(40)]
    make = lambda p, change: spark.createDataFrame([(f"{p}-{i}", change(n), f"{i} main st {10000 + i}", "US") for i, n in enumerate(names)], D)
    raw = (make("S1", str), make("S2", str.upper), make("S3", lambda n: n.replace("a", "e")))
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i},S3-{i}") for i in range(40)], "source1_entity_id string, matched_entity_ids string")
    s = replace(DEFAULTS, max_iter=3, max_depth=3, top_k=3)
    out = workflow.link(raw, truth, raw, s)
    rows = out.predictions.collect()
    assert len(rows) == 40 and sum("S2-" in r.matched_entity_ids for r in rows) >= 30
    assert 0.01 <= out.threshold <= 0.99


def test_model_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(float(i % 2), float(i), i % 2) for i in range(20)], "x double, y double, label int")
    m = training.PairwiseMatcher(replace(DEFAULTS, max_iter=2, max_depth=2), ["x", "y"])
    with pytest.raises(RuntimeError):
        m.predict_proba(d)
    m.fit(d).save(str(tmp_path / "m"))
    again = training.load_model(spark, str(tmp_path / "m"))
    assert [r.proba for r in again.predict_proba(d).collect()] == [r.proba for r in m.predict_proba(d).collect()]
    with pytest.raises(ValueError):
        again.predict_proba(d.drop("x"))


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-7\tZETA\t\t\n")
    got = []
    q = incremental.match_stream(incremental.stream_directory(spark, str(src)), directories(spark)[1], lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [tuple(r) for r in got] == [("S1-7", "S2-4")]


def test_registry():
    import __spark_entry__ as e

    assert {"candidates_union", "threshold_curve"} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_token_similarities(spark):
    df = spark.createDataFrame([("a b c", "c a"), ("x", ""), ("b a", "a b")], "a string, b string")
    rows = df.select(sim.token_sort_sim(F.col("a"), F.col("b")).alias("s"), sim.token_set_sim(F.col("a"), F.col("b")).alias("t"), sim.containment(F.split("a", " "), F.split("b", " ")).alias("c")).collect()
    assert (rows[0].s, rows[0].t, rows[0].c) == (0.75, 0.75, 1.0)  # "a b c" with "a c"; "a c b" with "a c"
    assert (rows[1].s, rows[1].t) == (0, 0) and (rows[2].s, rows[2].t) == (1, 1)


def test_tolerant_scan_and_report(spark, tmp_path, caplog):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "train_source1.tsv").write_text(head + "S1-1\ta\tb\tUS\nS1-2\tc\td\tUS\textra\nS1-3\te\n")
    rows, over = tsv.read_tolerant(spark, str(tmp_path / "deep" / "train_source1.tsv"))
    assert sorted(tuple(r) for r in rows.collect()) == [("S1-1", "a", "b", "US"), ("S1-3", "e", "", "")] and over.count() == 1
    with caplog.at_level("WARNING"):
        text = workflow.profile(spark, str(tmp_path))
    assert "1 lines have more fields" in caplog.text and "train_source1.tsv" in text
    tsv.write_report(spark, text, str(tmp_path / "r.txt"))
    assert (tmp_path / "r.txt").read_text() == text
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        workflow.profile(spark, str(tmp_path / "none"))


def test_run_over_files(spark, tmp_path):
    """The whole workflow from files to files, and options of the split and of repeated truth."""
    names = [f"{a} {b} {i}" for i, (a, b) in enumerate([("red", "cafe"), ("blue", "shop"), ("green", "tool"), ("moon", "acme")] * 8)]
    s = replace(DEFAULTS, max_iter=2, max_depth=2, top_k=3, split_universe="all_s1", data_dir=str(tmp_path / "in"), output_dir=str(tmp_path / "out"))
    for part in ("train", "test"):
        for i in (1, 2, 3):
            d = spark.createDataFrame([(f"S{i}-{j}", n.upper() if i == 2 else n, f"{j} main st", "US") for j, n in enumerate(names)], D)
            tsv.write_table(d, f"{s.data_dir}/{part}/{part}_source{i}.tsv", single_file=True)
    truth = spark.createDataFrame([(f"S1-{j}", f"S2-{j},S3-{j},S3-{j}") for j in range(len(names))], "source1_entity_id string, matched_entity_ids string")
    tsv.write_table(truth, f"{s.data_dir}/train/train_ground_truth.tsv", single_file=True)
    workflow.run_pipeline(spark, s)
    lines = (tmp_path / "out" / s.predictions_name).read_text().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and len(lines) == 33 and lines[1:] == sorted(lines[1:])
    assert (tmp_path / "out" / s.candidates_name).read_text().startswith("source1_entity_id\tcandidate_entity_id\n")
    assert sum("S2-" in x for x in lines) >= 28
    assert workflow.main(["profile", "--data-dir", str(tmp_path / "nowhere")]) == 1
