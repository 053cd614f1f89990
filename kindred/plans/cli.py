"""Command line: normalise, retrieve, featurise, train and infer over delimited tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.ml import FAST
from kindred.options import BUDGET, Budget
from kindred.plans import matching
from kindred.sources import tables


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("step", choices=["normalise", "retrieve", "train", "infer"])
    p.add_argument("--sources", nargs=3, required=True, metavar="TSV", help="tables of source 1, 2 and 3")
    p.add_argument("--test-sources", nargs=3, metavar="TSV", help="tables to infer on")
    p.add_argument("--truth", help="ground-truth table")
    p.add_argument("--out", required=True)
    p.add_argument("--per-s1", type=int, default=BUDGET.per_s1)
    p.add_argument("--exact-cap", type=int, default=BUDGET.exact_cap)
    p.add_argument("--digit-cap", type=int, default=BUDGET.digit_cap)
    p.add_argument("--max-df", type=int, default=BUDGET.max_token_df)
    p.add_argument("--bucket-cap", type=int, default=BUDGET.token_bucket_cap)
    p.add_argument("--rounds", type=int, default=500)
    p.add_argument("--fast", action="store_true", help="the fast preset of the boosted trees")
    p.add_argument("--split", choices=["train", "test"], default="train", help="retrieve: from which sources")
    p.add_argument("--source", type=int, choices=[2, 3], help="retrieve: from one target source only")
    p.add_argument("--limit", type=int, help="retrieve: so many source 1 records, the first by id")
    p.add_argument("--force", action="store_true", help="make cached tables anew")
    p.add_argument("--model", help="where train writes the model and infer reads it, if it is there")
    return p.parse_args(argv)


def load(spark: SparkSession, paths: list[str], cache: str, force: bool = False) -> DataFrame:
    """The normalised rows of three tables with ``source`` and a row order by id."""
    parts = [tables.load_cached(spark, path, cache, force=force).withColumn("source", F.lit(i)) for i, path in enumerate(paths, 1)]
    return tables.union_candidates(parts).withColumn("row_id", F.col("entity_id"))


def chosen(rows: DataFrame, source: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows of source 1, at most ``limit`` of them by id, and of the target sources or the one asked for."""
    queries = rows.where("source = 1")
    if limit is not None:
        queries = queries.orderBy("row_id").limit(limit)
    return queries.unionByName(rows.where("source > 1" if source is None else f"source = {int(source)}"))


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("kindred").getOrCreate()
    budget = Budget(per_s1=a.per_s1, exact_cap=a.exact_cap, digit_cap=a.digit_cap, max_token_df=a.max_df, token_bucket_cap=a.bucket_cap)
    rows = load(spark, (a.test_sources or a.sources) if a.split == "test" and a.step == "retrieve" else a.sources, f"{a.out}/cache", a.force)
    if a.step == "infer" and a.model and matching.is_saved(spark, a.model):
        matching.infer(load(spark, a.test_sources or a.sources, f"{a.out}/cache"), matching.load(spark, a.model), f"{a.out}/test", budget)
    elif a.step == "retrieve":
        matching.retrieve(chosen(rows, a.source, a.limit), a.out, budget)
    elif a.step in ("train", "infer"):
        truth = tables.load_cached_truth(spark, a.truth, f"{a.out}/cache").select("s1_id", F.explode("matched").alias("candidate_id"))
        truth = truth.join(rows.select(F.col("entity_id").alias("candidate_id"), "source"), "candidate_id")
        trained = matching.train(rows, truth, f"{a.out}/train", budget, boosting=FAST if a.fast else {"rounds": a.rounds})
        print(matching.report(trained))
        if a.model:
            matching.save(trained, a.model)
        if a.step == "infer":
            matching.infer(load(spark, a.test_sources or a.sources, f"{a.out}/cache"), trained, f"{a.out}/test", budget)


if __name__ == "__main__":
    main()
