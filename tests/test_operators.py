"""Operators against loops, invariants and each other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kindred.functions.similarity import ratio
from kindred.functions.text import address_digits
from kindred.operators import blocking, features, graph, sampling, scoring
from kindred.options import Budget
from kindred.sources.views import doc_truth, normal_entities

SF = "/root/testdata/sf0.001"


def made_entities(spark, n=150, seed=7):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for i in range(n):
        source = i % 3 + 1
        name = "" if i % 7 == 0 else " ".join(rng.sample(words, rng.randint(1, 3)))
        address = "" if i % 5 == 0 else " ".join(rng.sample(words, 2)) + f" {rng.randrange(4)} {rng.randrange(4)}"
        rows.append((f"S{source}-{i}", source, i, name, address, "".join(x if x.isdigit() else " " for x in address).strip().replace("   ", " "), rng.choice(["de", "fr", ""])))
    return spark.createDataFrame(rows, "entity_id string, source int, row_id long, name_norm string, address_norm string, address_dig string, country string"), rows


def retrieved_by_loop(rows, budget):
    """One record at a time: exact channels, then rare tokens until the budget is full."""
    found = {}
    for q in (r for r in rows if r[1] == 1):
        for source in (2, 3):
            targets = [r for r in rows if r[1] == source]
            held = {}
            for bit, col, cap in ((1, 3, budget.exact_cap), (2, 4, budget.exact_cap), (4, 5, budget.digit_cap)):
                for t in [t for t in targets if q[col] and t[col] == q[col]][:cap]:
                    held[t[0]] = held.get(t[0], 0) | bit
            n = len(held)
            for index in (3, 4):
                for field in (3, 4):
                    tokens = list(dict.fromkeys(w for w in q[field].split() if len(w) >= 3))
                    lists = [[t for t in targets if w in t[index].split()] for w in tokens]
                    order = sorted((k for k in range(len(tokens)) if 0 < len(lists[k]) <= min(budget.max_token_df, budget.token_bucket_cap)), key=lambda k: len(lists[k]))
                    for t in (t for k in order for t in lists[k]):
                        if t[0] not in held and n < budget.per_s1:
                            held[t[0]] = 8
                            n += 1
            found |= {(q[0], c): b for c, b in held.items()}
    return found


@pytest.mark.parametrize("budget", [Budget(per_s1=4, exact_cap=2, digit_cap=1, max_token_df=12), Budget(per_s1=30, max_token_df=100, token_bucket_cap=15)])
def test_retrieval_is_the_loop(spark, budget):
    df, rows = made_entities(spark)
    got = blocking.retrieve(df.where("source = 1"), df.where("source > 1"), budget).collect()
    assert {(r["s1_id"], r["candidate_id"]): r["bits"] for r in got} == retrieved_by_loop(rows, budget)


def test_result_does_not_depend_on_partitions(spark):
    df, _ = made_entities(spark)
    runs = [sorted(map(tuple, blocking.retrieve(d.where("source = 1"), d.where("source > 1"), Budget(per_s1=3)).collect())) for d in (df.repartition(1), df.repartition(7))]
    assert runs[0] == runs[1]


def test_features(spark):
    df, rows = made_entities(spark)
    by = {r[0]: r for r in rows}
    pairs = blocking.exact_union(df.where("source = 1"), df.where("source > 1"))
    got = features.pair_features(pairs, df)
    assert got.columns[3:] == features.NAMES and len(features.NAMES) == 41
    for r in got.collect():
        a, b = by[r["s1_id"]], by[r["candidate_id"]]
        x, y = set(a[3].split()), set(b[3].split())
        assert abs(r["name_edit_sim"] - ratio(a[3], b[3])) < 1e-4 and abs(r["name_token_jaccard"] - (len(x & y) / len(x | y) if x | y else 1)) < 1e-4
        assert r["digit_count_diff"] == abs(len(a[5].split()) - len(b[5].split())) and r["country_match"] == float(bool(a[6]) and a[6] == b[6])
        assert r["contr_same_name_diff_addr"] == float(bool(a[3] and a[3] == b[3] and a[4] and b[4] and a[4] != b[4] and ratio(a[4], b[4]) < 0.5))
        assert r["prov_n_channels"] == r["prov_exact_name"] + r["prov_exact_address"] + r["prov_address_digits"]
    missing = features.with_fields(spark.createDataFrame([("S1-0", "gone", 2, 1)], "s1_id string, candidate_id string, source int, bits int"), df).first()
    assert missing["n2"] == "" == missing["c2"]
    assert features.features_of_pairs(got, spark.createDataFrame([("a", "b")], "s1_id string, candidate_id string")).first()["name_exact"] == 0


def test_split_and_sample(spark):
    rows = normal_entities(spark, SF, "doc")
    truth, ids = doc_truth(spark, SF), rows.where("source = 1").select(F.col("entity_id").alias("s1_id"))
    parts = sampling.stratified_split(truth, ids).collect()
    assert len(parts) == ids.count() == len({r["s1_id"] for r in parts})
    for s in {r["stratum"] for r in parts}:
        own = [r["part"] for r in parts if r["stratum"] == s]
        assert own.count("val") == (0 if len(own) <= 1 else min(max(1, int(len(own) * 0.15)), len(own) - 1))
    pairs = features.with_fields(blocking.retrieve(rows.where("source = 1"), rows.where("source > 1"), Budget(per_s1=20)), rows)
    sample = sampling.training_pairs(pairs, truth, ids).collect()
    true = {(r["s1_id"], r["candidate_id"]) for r in truth.collect()}
    assert all(((r["s1_id"], r["candidate_id"]) in true) == bool(r["label"]) for r in sample)
    for s1 in {r["s1_id"] for r in sample}:
        own = [r["pool"] for r in sample if r["s1_id"] == s1]
        n = own.count("positive")
        assert own.count("hard") <= min(3 * n, 10) and own.count("random") <= (3 * n or 3)


def test_sweep_is_macro_f05(spark):
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.4), ("b", "z", 0.6), ("c", "x", 0.2)], "s1_id string, candidate_id string, score double")
    truth = spark.createDataFrame([("a", "x"), ("a", "w"), ("c", "x")], "s1_id string, candidate_id string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    grid = [0.1, 0.5, 0.95]
    swept = {r["threshold"]: r["macro_f05"] for r in scoring.sweep(scored, truth, ids, grid).collect()}
    for t in grid:
        assert swept[t] == scoring.macro_f05(scoring.decide(scored, t), truth, ids).first()["macro_f05"]
    assert scoring.best_threshold(scoring.sweep(scored, truth, ids, grid)).count() == 1
    wide = scored.selectExpr("*", "'n' n1", "if(candidate_id = 'z', 'n', 'm') n2", "'' a1", "'' a2")
    assert {r["error"]: r["n"] for r in scoring.error_taxonomy(scoring.errors(wide, truth, ids, 0.5)).collect()} == {"same_name_diff_addr": 1, "retrieval_failure": 1, "threshold_too_high": 1}


def test_components(spark):
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e"), ("z", "y"), *[(f"n{i:03}", f"n{i + 1:03}") for i in range(100)]], "a string, b string")
    got = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert got["c"] == "a" and got["e"] == "d" and got["z"] == "y" and {got[f"n{i:03}"] for i in range(101)} == {"n000"}
    assert {(r["size"], r["n"]) for r in graph.component_sizes(graph.components(links)).collect()} == {(3, 1), (2, 2), (101, 1)}


def test_compared_in_the_channels_joins(spark, monkeypatch):
    """no pair carries texts, caps and busy keys hold, features are those of whole fields."""
    monkeypatch.setattr(blocking, "SPREAD", 7)
    rows = [(f"S{i % 3 + 1}-{i}", i % 3 + 1, i, ("one name", "other name", "")[i % 7 % 3], ("", f"road {i % 5} of town {i % 4}", "road road 3")[i % 11 % 3], ("de", "FR", "")[i % 2]) for i in range(240)]
    df = spark.createDataFrame(rows, "entity_id string, source int, row_id long, name_norm string, address_norm string, country string").withColumn("address_dig", address_digits("address_norm"))
    budget = Budget(exact_cap=9, digit_cap=6)
    got = blocking.exact_compared(features.word_sets(df), features.SET_KEYS, budget, features.set_features, features.SET_UNNEEDED)
    names = [c for c in got.columns if c not in ("s1_id", "candidate_id", "source", "bits")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Union")]
    assert "_norm" not in above and "split" not in above
    found = features.sql_features()
    wide = features.with_fields(blocking.exact_union(df.where("source = 1"), df.where("source > 1"), budget), df)
    want = wide.select("s1_id", "candidate_id", "source", "bits", *[found[n].alias(n) for n in names])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 1000


def test_pair_features_read_their_pairs_once(spark):
    """no join on strings repeats the plan below it; repeats in a batch get the same values."""
    rows, _ = made_entities(spark, 60)
    pairs = blocking.exact_union(rows.where("source = 1"), rows.where("source > 1"))
    found = features.pair_features(pairs.unionByName(pairs), rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    once = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 2 * once.count("Scan") + 2
    got = sorted(map(tuple, found.collect()))
    assert got[::2] == got[1::2] and got[::2] == sorted(map(tuple, features.pair_features(pairs, rows).collect()))


def test_training_pairs_bring_columns(spark):
    """F8, F11, F14: a sample brings the bits its features need, so those of all candidates needn't be made."""
    rows = normal_entities(spark, SF, "doc")
    pairs = features.with_fields(blocking.exact_union(rows.where("source = 1"), rows.where("source > 1"), Budget(per_s1=20)), features.digested(rows)).persist()
    ids = rows.where("source = 1").selectExpr("entity_id as s1_id")
    plain, more = (sampling.training_pairs(pairs, doc_truth(spark, SF), ids, also=also) for also in ((), ("source", "bits")))
    assert more.columns[-2:] == ["source", "bits"] and sorted(map(tuple, plain.collect())) == sorted(tuple(r)[:-2] for r in more.collect())
    assert more.join(pairs, ["s1_id", "candidate_id", "source", "bits"], "left_anti").count() == 0
