"""Matrices of measures, and the queries that make their pairs by them."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import crossed
from tessera.functions import similarity as sim
from tessera.operators import blocking, pairs, training
from tessera.plans import catalogue
from tessera.settings import DEFAULTS

DIR = "/root/testdata/sf0.001"
WORDS = ["brand", "large", "ring", "12", "7", "é", "𝒳y", "aa", "b", "10403", "x" * 30, "y" * 70]


def texts(n, seed):
    r = random.Random(seed)
    some = [" ".join(r.choice(WORDS[: r.choice([3, 10, 12])]) for _ in range(r.randint(0, 7))) for _ in range(n)]
    return [*some, "", "  ", "x" * 64, "y" * 65, " ".join(f"w{i}" for i in range(seed, 70 + seed)), "a" * 63 + " b"]


def test_matrices_are_the_measures_of_each_pair():
    left, right = texts(40, 1), texts(50, 2)
    s = crossed.Sides(left, right)
    for i, a in enumerate(left):
        for k, b in enumerate(right):
            x, y = (sorted(set(crossed.words(t))) for t in (a, b))
            common = " ".join(t for t in x if t in y)
            one, other = (f"{common} {' '.join(t for t in p if t not in q)}".strip(" ") for p, q in ((x, y), (y, x)))
            assert s.char_sim[i, k] == sim.char_ratio(a, b)
            assert s.token_sort_sim[i, k] == sim.char_ratio(" ".join(sorted(crossed.words(a))), " ".join(sorted(crossed.words(b))))
            assert s.token_set_sim[i, k] == sim.char_ratio(one, other), (a, b)


def test_pairs_are_compared_many_at_a_time():
    left, right = texts(3000, 1), texts(3000, 2)
    assert crossed.char_sims_of_pairs(left + right[:9] * 2, right + right[:9] * 2).tolist() == [sim.char_ratio(a, b) for a, b in zip(left + right[:9] * 2, right + right[:9] * 2, strict=True)]
    assert crossed.char_sims_of_pairs([], []).tolist() == []


def test_candidates_are_ranked_once_for_each_distinct_name(spark):
    rows = lambda p, n: spark.createDataFrame([(f"{p}-{i:04}", f"ab{'cdefg'[i % 5]}", "", "") for i in range(n)], "entity_id string, name_norm string, address_norm string, country_norm string")
    out = blocking.ngram_topk(rows("S1", 40), rows("S2", 30), 8)
    plan = str(out._jdf.queryExecution().optimizedPlan())
    top = plan.split("Window")[0]  # what is done after the ranking
    assert "Join" in top and out.count() == 40 * 8


@pytest.mark.parametrize("sizes", [(256, 2048, 1 << 15), (3, 4, 5)])
def test_crossed_features_are_those_of_pairs(spark, monkeypatch, sizes):
    for name, size in zip(("LEFT_ROWS", "RIGHT_ROWS", "OUT_ROWS"), sizes, strict=True):
        monkeypatch.setattr(pairs, name, size)
    rows = lambda prefix, n: [(f"{prefix}-{i}", t, texts(n, 7)[-i], ["us", "", "fr"][i % 3], i % 2) for i, t in enumerate(texts(n, len(prefix) + n))]
    one, two = (spark.createDataFrame(rows(p, n), "entity_id string, name_norm string, address_norm string, country_norm string, key int") for p, n in (("S1", 9), ("S2", 12)))
    left, right = (d.withColumnsRenamed({"entity_id": i, "name_norm": f"n{k}", "address_norm": f"a{k}", "country_norm": f"c{k}"}) for d, i, k in ((one, "source1_entity_id", 1), (two, "candidate_entity_id", 2)))
    own = pairs.crossed_features(left, right, ["key"], pairs.FEATURES)
    ids = left.join(right, "key").select("source1_entity_id", "candidate_entity_id")
    other = pairs.build_features(ids, one.drop("key"), two.drop("key"))
    assert own.schema.simpleString() == other.schema.simpleString()
    assert own.count() == ids.count() and sorted(map(tuple, own.collect())) == sorted(map(tuple, other.collect()))


@pytest.mark.parametrize("name", ["char_similarity", "pair_features_full"])
def test_pairs_are_made_in_the_kernel(spark, name):
    plan = str(catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan())
    above = plan[: plan.index("MapInArrow")]
    assert not any(x in above for x in ("Join", "Repartition", "ArrowEvalPython"))
    assert "RepartitionByExpression" in plan  # bundles of rows are dealt to a stated number of tasks


def test_labels_and_scores_in_the_kernel_are_those_of_the_steps(spark):
    one = spark.createDataFrame([(f"S1-{i}", t, t[::-1], "us", 1) for i, t in enumerate(texts(6, 3))], "source1_entity_id string, n1 string, a1 string, c1 string, key int")
    two = spark.createDataFrame([(f"S2-{i}", t, t, "fr", 1) for i, t in enumerate(texts(9, 3))], "candidate_entity_id string, n2 string, a2 string, c2 string, key int")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}, S2-{i + 1},S2-{i},S9-1") for i in range(0, 12, 2)], "source1_entity_id string, matched_entity_ids string")
    own = pairs.crossed_features(pairs.with_matches(one, truth), two, ["key"], pairs.FEATURES)
    other = pairs.attach_labels(pairs.crossed_features(one, two, ["key"], pairs.FEATURES), truth).select(own.columns)
    assert own.schema.simpleString() == other.schema.simpleString()
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, other.collect())) and own.count() > one.count() * two.count()
    matcher = training.train_model(own, replace(DEFAULTS, max_iter=4, max_depth=3))
    scored = pairs.crossed_features(pairs.with_matches(one, truth), two, ["key"], pairs.FEATURES, score=matcher.trees())
    plain = matcher.predict_proba(own).select(scored.columns)
    for a, b in zip(sorted(scored.collect()), sorted(plain.collect()), strict=True):
        assert a[:3] == b[:3] and a.proba == pytest.approx(b.proba, abs=1e-14)
    assert scored.select("proba").distinct().count() > 2


def test_matcher_scores_keeps_no_pairs(spark):
    out = catalogue.QUERIES["matcher_scores"](spark, DIR)
    assert "InMemoryRelation" not in str(out._jdf.queryExecution().optimizedPlan())
    assert out.columns == ["source1_entity_id", "candidate_entity_id", "label", "proba"]
    assert out.filter("proba > 0.5 and label = 1").count() > 0.8 * out.filter("label = 1").count() > 0


def test_pairs_are_not_shuffled_for_their_texts(spark):
    one, two = (spark.createDataFrame([(f"{p}-1", "a b", "c", "us")], "entity_id string, name_norm string, address_norm string, country_norm string") for p in ("S1", "S2"))
    plan = str(pairs.build_features(spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, candidate_entity_id string"), one, two)._jdf.queryExecution().optimizedPlan())
    assert "Join" not in plan[: plan.index("ArrowEvalPython")] and plan.count("ArrowEvalPython") == 1 and plan.count("Join") == 2


def test_native_features_are_made_in_the_kernel_and_are_those_of_pairs(spark):
    out = catalogue.QUERIES["pair_features_native"](spark, DIR)
    plan = str(out._jdf.queryExecution().optimizedPlan())
    assert not any(x in plan[: plan.index("MapInArrow")] for x in ("Join", "Repartition"))
    one, two = (spark.createDataFrame([(f"{p}-{i}", t, texts(40, 9)[-i], ["us", "", "fr"][i % 3], 1) for i, t in enumerate(texts(40, len(p) + i0))], f"{side} string, n{k} string, a{k} string, c{k} string, key int") for p, i0, side, k in (("S1", 1, "source1_entity_id", 1), ("S2", 2, "candidate_entity_id", 2)))
    own = pairs.crossed_features(one, two, ["key"], pairs.NATIVE_FEATURES, kind="code").select("source1_entity_id", "candidate_entity_id", *[c.alias(f) for f, c in pairs.decoded(pairs.NATIVE_FEATURES).items()])
    other = sim.rounded(one.join(two, "key").select(own.columns[0], own.columns[1], *[c.alias(f) for f, c in pairs.native_features().items()]), 6, *pairs.RATIO_FEATURES).select(own.columns)
    assert own.dtypes == other.dtypes and sorted(map(tuple, own.collect())) == sorted(map(tuple, other.collect()))


def test_rounding_in_the_kernel_is_that_of_round(spark):
    x = [a / b for b in range(1, 130) for a in range(b + 1)] + [k / 2e6 for k in range(1, 4001, 2)] + [k / 2e6 + e for k in (1, 777777) for e in (-1e-12, 1e-12)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert (crossed.rounded(np.array(x)) / 1e6).tolist() == want


def test_texts_of_a_side_are_taken_apart_before_they_are_paired(spark):
    schema = "entity_id string, name_norm string, address_norm string, country_norm string"
    one = spark.createDataFrame([(f"S1-{i}", t, t[::-1], "us") for i, t in enumerate(texts(6, 3))], schema)
    two = spark.createDataFrame([(f"S2-{i}", t, t, "fr") for i, t in enumerate(texts(9, 3))] + [("S2-none", "", "", "")], schema)
    ids = one.crossJoin(two.withColumnRenamed("entity_id", "candidate_entity_id")).select(F.col("entity_id").alias("source1_entity_id"), "candidate_entity_id")
    out = pairs.build_features(ids, one, two.filter("entity_id <> 'S2-none'"))  # an id that no directory has is one without texts
    plan = str(out._jdf.queryExecution().optimizedPlan())
    assert "regexp_extract" not in plan[: plan.index("Join")] and "regexp_extract" in plan
    d = pairs.with_attributes(ids, one, two, None)
    cols = pairs.native_features()
    other = d.select("source1_entity_id", "candidate_entity_id", *[c.cast("float").alias(f) for f, c in cols.items()])
    assert out.count() == other.count() == ids.count()
    assert sorted(map(tuple, out.select(other.columns).collect())) == sorted(map(tuple, other.collect()))
