"""Scoring of newly arriving source 1 records against static targets, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators import blocking, features, scoring
from kindred.options import BUDGET, Budget
from kindred.sources.tables import load_cached_postings


def match_arrivals(arrivals: DataFrame, targets: DataFrame, out: str, checkpoint: str, threshold: float = 0.5, budget: Budget = BUDGET) -> StreamingQuery:
    """Start a stream that writes matches of each batch to ``out/batch_id=...``.

    ``arrivals`` and ``targets`` carry normal forms, source and row_id. A batch that runs again
    after a failure overwrites its own folder, so each record is matched once. The targets'
    postings are written below ``checkpoint`` before the stream starts, and read by every batch.
    """
    listed = load_cached_postings(targets, f"{checkpoint}-postings", "targets", budget, force=True)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("source", F.lit(1))
        pairs = blocking.retrieve(batch, targets, budget, listed)
        rows = batch.unionByName(targets.select(*batch.columns))
        scored = features.pair_features(pairs, rows).withColumn("score", scoring.rule_score())
        scoring.decide(scored, threshold).select("s1_id", "candidate_id", "score").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
