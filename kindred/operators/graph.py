"""Links as a graph: inverse uniqueness, cardinality and connected components."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inverse_links(truth: DataFrame) -> DataFrame:
    """``n_s1, n_targets``: how many targets are linked by so many records."""
    return truth.groupBy("candidate_id").agg(F.countDistinct("s1_id").alias("n_s1")).groupBy("n_s1").agg(F.count(F.lit(1)).alias("n_targets"))


def cardinalities(truth: DataFrame, everyone: DataFrame) -> DataFrame:
    """One row: records with 0, 1, 2, 3 or more links, mean, percentiles, most, rates in percent and the kind of mapping."""
    n = truth.groupBy("s1_id").agg(F.countDistinct("candidate_id").alias("n"))
    whole = everyone.select("s1_id").distinct().join(n, "s1_id", "left").fillna(0)
    shared = truth.groupBy("candidate_id").agg(F.countDistinct("s1_id").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).alias("most_shared"))
    out = whole.agg(*[F.count_if(F.col("n") == k).alias(f"n_{k}") for k in range(3)], F.count_if(F.col("n") >= 3).alias("n_3_plus"), F.round(F.avg("n"), 6).alias("mean"), *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n)").cast("long").alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)],
        F.max("n").alias("most"), *[F.round(100 * F.avg(c.cast("int")), 4).alias(k) for k, c in {"zero_percent": F.col("n") == 0, "one_percent": F.col("n") == 1, "many_percent": F.col("n") > 1}.items()]).join(F.broadcast(shared), F.lit(True))
    kind = F.when(F.col("most_shared") > 1, "many-to-many").when(F.col("most") > 1, "one-to-many").otherwise("one-to-one")
    return out.withColumn("mapping", kind).drop("most_shared")


def _saved(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's folder, or, in a local session only, in one of our own."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="kindred-"))
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the least id that links(a, b) reach.

    Labels fall to the least around each node and then to that label's own label, so rounds
    grow with the logarithm of a component.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = _saved(both)
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        over = new.select(F.col("node").alias("label"), F.col("label").alias("over"))
        new = _saved(new.join(over, "label").select("node", "old", F.least("label", "over").alias("label")))
        if new.where("label <> old").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


def component_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
