"""Recall of candidates: overall, by source, by channel, over budgets and token frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.channels import CHANNELS, has
from kindred.operators import cells
from kindred.operators.blocking import PAIR, evidence_score, tokens_of


def per_record(pairs: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``s1_id, n_true, n_cand, recalled`` of records with truth; those without candidates count zero."""
    on = ["s1_id", *keys]
    true = truth.select(*on, "candidate_id").distinct()
    # of pairs only those of records with truth travel
    cand = pairs.join(cells.sent(true.select(*on).distinct()), on, "left_semi").select(*on, "candidate_id").distinct()
    hit = true.join(cand, [*on, "candidate_id"], "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("recalled"))
    return true.groupBy(*on).agg(F.count(F.lit(1)).alias("n_true")).join(cand.groupBy(*on).agg(F.count(F.lit(1)).alias("n_cand")), on, "left").join(hit, on, "left").fillna(0, ["n_cand", "recalled"])


def _summary() -> list:
    p = F.percentile("n_cand", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return [
        F.sum("n_true").alias("true_pairs"), F.sum("recalled").alias("recalled"), F.round(F.sum("recalled") / F.sum("n_true"), 6).alias("recall"),
        F.round(F.avg("n_cand"), 1).alias("mean_candidates"), *[p[i].cast("int").alias(n) for i, n in enumerate(("p50", "p95", "p99"))], F.count(F.lit(1)).alias("n_s1"),
    ]


def candidate_recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: pairs recalled, their share, and candidates a record (mean and percentiles)."""
    return per_record(pairs, truth).agg(*_summary())


def recall_by_source(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return per_record(pairs, truth, ("source",)).groupBy("source").agg(*_summary())


def channel_recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """``channel, recall, union_recall``: of each channel alone, and with all before it."""
    hit = truth.select(*PAIR).distinct().join(pairs.select(*PAIR, "bits"), PAIR, "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    flags = [has("bits", b).cast("int") for b in CHANNELS]
    alone = [F.avg(f) for f in flags]
    union = [F.avg(F.greatest(F.lit(0), *flags[: i + 1])) for i in range(len(flags))]
    rows = F.array(*[F.struct(F.lit(n).alias("channel"), F.round(alone[i], 6).alias("recall"), F.round(union[i], 6).alias("union_recall")) for i, n in enumerate(CHANNELS.values())])
    return hit.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def channel_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("channels", "n_channels").agg(F.count(F.lit(1)).alias("n"))


def budget_grid(pairs: DataFrame, truth: DataFrame, budgets: list[int], full_size: int) -> DataFrame:
    """``per_s1, recall, mean_candidates, p50, p95, full_pairs, full_gb`` for budgets by evidence; ``full_pairs`` and their GB (12 bytes each) at ``full_size`` records.

    Pairs are ranked once; each budget counts those up to its rank.
    """
    rank = F.row_number().over(Window.partitionBy("source", "s1_id").orderBy(F.desc(evidence_score()), "candidate_id"))
    ranked = pairs.withColumn("rank", rank).where(F.col("rank") <= max(budgets)).select(*PAIR, "rank")
    true = truth.select(*PAIR).distinct()
    counts = [F.count_if(F.col("rank") <= b).alias(f"n{b}") for b in budgets] + [F.count_if((F.col("rank") <= b) & F.col("hit")).alias(f"h{b}") for b in budgets]
    found = ranked.join(true.withColumn("hit", F.lit(True)), PAIR, "left").withColumn("hit", F.coalesce("hit", F.lit(False))).groupBy("s1_id").agg(*counts)
    each = true.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true")).join(found, "s1_id", "left").fillna(0)
    rows = F.array(*[
        F.struct(
            F.lit(b).alias("per_s1"), F.round(F.sum(f"h{b}") / F.sum("n_true"), 6).alias("recall"), F.round(F.avg(f"n{b}"), 4).alias("mean_candidates"), F.percentile(f"n{b}", F.lit(0.5)).alias("p50"), F.percentile(f"n{b}", F.lit(0.95)).alias("p95"),
            F.round(F.avg(f"n{b}") * full_size).cast("long").alias("full_pairs"), F.round(F.avg(f"n{b}") * full_size * 12 / 2**30, 6).alias("full_gb"),
        ) for b in budgets
    ])
    return each.agg(rows.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


def rarity_curve(rows: DataFrame, truth: DataFrame, column: str, limits: list[int]) -> DataFrame:
    """``max_df, recall``: share of true pairs whose rarest shared token is in at most ``max_df`` records of the target's source; and of pairs sharing one or two tokens at all (max_df null)."""
    tokens = tokens_of(rows, column)
    df = tokens.groupBy("source", "token").agg(F.count(F.lit(1)).alias("df"))
    true = truth.select(*PAIR, "source").distinct()
    left = tokens.select(F.col("entity_id").alias("s1_id"), "token")
    right = tokens.select(F.col("entity_id").alias("candidate_id"), "source", "token")
    shared = true.join(left, "s1_id").join(right, ["candidate_id", "source", "token"]).join(df, ["source", "token"]).groupBy(*PAIR).agg(F.min("df").alias("rarest"), F.count(F.lit(1)).alias("n_shared"))
    whole = true.join(shared, PAIR, "left")
    cells = [F.struct(F.lit(f"max_df {x}").alias("measure"), F.round(F.avg(F.coalesce(F.col("rarest") <= x, F.lit(False)).cast("int")), 6).alias("share")) for x in limits]
    cells += [F.struct(F.lit(f"shares {k}").alias("measure"), F.round(F.avg((F.coalesce("n_shared", F.lit(0)) >= k).cast("int")), 6).alias("share")) for k in (1, 2)]
    return whole.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def expected_rows(queries: DataFrame, targets: DataFrame, column: str, most: int) -> DataFrame:
    """One row: posting rows a record expects through its rare tokens, and the share of records with one."""
    df = tokens_of(targets, column).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= most)
    own = tokens_of(queries, column).select(F.col("entity_id").alias("s1_id"), "token").join(df, "token").groupBy("s1_id").agg(F.sum("df").alias("rows"))
    whole = queries.select(F.col("entity_id").alias("s1_id")).join(own, "s1_id", "left")
    n = F.coalesce("rows", F.lit(0))
    return whole.agg(F.round(F.avg(n), 4).alias("mean_rows"), F.percentile(n, F.lit(0.5)).alias("p50_rows"), F.percentile(n, F.lit(0.95)).alias("p95_rows"), F.round(100 * F.avg(F.col("rows").isNotNull().cast("int")), 4).alias("pct_with_rare"))
