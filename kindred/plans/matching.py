"""The whole matching job: split, retrieve, recall, features, scorers, threshold, hard negatives, outputs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import blocking, features, metrics, ml, sampling, scoring
from kindred.options import BUDGET, SAMPLE, Budget, SampleOptions
from kindred.sources import tables


@dataclass
class Trained:
    """What training found: the chosen scorer, its threshold and the scores of all."""

    name: str
    model: object
    threshold: float
    scores: dict[str, float] = field(default_factory=dict)
    recall: dict[str, float] = field(default_factory=dict)


def score_with(name: str, model: object, found: DataFrame) -> DataFrame:
    if name == "rule":
        rule: Column = scoring.rule_score()
        return found.select("s1_id", "candidate_id", rule.alias("score"))
    return ml.score(model, found)


def retrieve(rows: DataFrame, folder: str, budget: Budget = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Candidates and their features, written below ``folder`` and read again."""
    spark = rows.sparkSession
    pairs = blocking.retrieve(rows.where("source = 1"), rows.where("source > 1"), budget)
    tables.write_candidates(pairs, f"{folder}/candidates")
    pairs = spark.read.parquet(f"{folder}/candidates")
    features.pair_features(pairs, rows).write.mode("overwrite").parquet(f"{folder}/features")
    return pairs, spark.read.parquet(f"{folder}/features")


def train(rows: DataFrame, truth: DataFrame, folder: str, budget: Budget = BUDGET, options: SampleOptions = SAMPLE, boosting: dict | None = None) -> Trained:
    """Train the scorers on one part of source 1 and choose scorer and threshold on the other.

    The threshold is chosen on the same records that it is reported on, as is the hard-negative
    round: the scores are of validation, not of a test. ``rows`` carries normal forms and source,
    ``boosting`` parameters of the boosted trees.
    """
    boosting = boosting or {}
    everyone = rows.where("source = 1").select(F.col("entity_id").alias("s1_id"))
    parts = sampling.stratified_split(truth, everyone, options).persist()
    learn, val = parts.where("part = 'train'"), parts.where("part = 'val'")
    pairs, found = retrieve(rows, folder, budget)
    true_val = truth.join(val, "s1_id", "left_semi")
    recall = metrics.candidate_recall(pairs.join(val, "s1_id", "left_semi"), true_val).first().asDict()

    sample = sampling.training_pairs(features.with_fields(pairs, features.digested(rows)).join(learn, "s1_id", "left_semi"), truth, learn, options).persist()
    training = features.features_of_pairs(found, sample).join(sample.select("s1_id", "candidate_id", "label"), ["s1_id", "candidate_id"])
    val_features = found.join(val, "s1_id", "left_semi").persist()
    grid = scoring.thresholds()

    def judge(name: str, model: object) -> tuple[float, float]:
        scored = score_with(name, model, val_features).withColumn("score", F.round("score", 6))
        best = scoring.best_threshold(scoring.sweep(scored, true_val, val, grid)).first()
        return best["macro_f05"], best["threshold"]

    models: dict[str, object] = {"rule": None, "logistic": ml.fit_logistic(training), "boosted": ml.fit_boosted(training, **boosting)}
    judged = {name: judge(name, model) for name, model in models.items()}
    best = ml.best_of({name: f for name, (f, _) in judged.items()})
    if best != "rule":
        scored = score_with(best, models[best], found.join(learn, "s1_id", "left_semi"))
        mined = sampling.hard_negatives(scored, truth, learn, options)
        more = sampling.add_mined(sample, mined).persist()
        again_rows = features.features_of_pairs(found, more).join(more, ["s1_id", "candidate_id"])
        again = ml.fit_logistic(again_rows) if best == "logistic" else ml.fit_boosted(again_rows, **boosting)
        f, t = judge(best, again)
        if f > judged[best][0]:  # kept only if strictly better
            models[best], judged[best] = again, (f, t)
    return Trained(best, models[best], judged[best][1], {k: f for k, (f, _) in judged.items()}, recall)


def infer(rows: DataFrame, trained: Trained, folder: str, budget: Budget = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Matching and candidate lists of new tables, written as two delimited files; raises if they don't hold together."""
    everyone = rows.where("source = 1").select(F.col("entity_id").alias("s1_id"))
    pairs, found = retrieve(rows, folder, budget)
    matching = tables.id_lists(scoring.decide(score_with(trained.name, trained.model, found), trained.threshold), everyone, "matched_entity_ids")
    candidates = tables.id_lists(pairs, everyone, "candidate_entity_ids")
    problems = [r.asDict() for r in tables.validate_outputs(matching, candidates, everyone).where("n > 0").collect()]
    if problems:
        raise ValueError(f"outputs don't hold together: {problems}")
    tables.write_lists(matching, f"{folder}/matching")
    tables.write_lists(candidates, f"{folder}/candidate_lists")
    return matching, candidates


def save(trained: Trained, path: str) -> None:
    """Write what training found below ``path``: the model (unless it is the rule), its importances, and the rest as JSON."""
    from pyspark.sql import SparkSession

    facts = {"name": trained.name, "threshold": trained.threshold, "scores": trained.scores, "recall": {k: float(v) if v is not None else None for k, v in trained.recall.items()}}
    if trained.model is not None:
        ml.save(trained.model, f"{path}/model")
        ml.write_importances(trained.model, f"{path}/importances")
    SparkSession.active().createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def is_saved(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/facts/_SUCCESS")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def load(spark: SparkSession, path: str) -> Trained:
    """What ``save`` wrote."""
    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    return Trained(facts["name"], None if facts["name"] == "rule" else ml.load(f"{path}/model"), facts["threshold"], facts["scores"], facts["recall"])


def report(trained: Trained) -> str:
    """The training summary as JSON."""
    return json.dumps({"model": trained.name, "threshold": trained.threshold, "macro_f05": trained.scores, "recall": trained.recall}, indent=2, default=str)
