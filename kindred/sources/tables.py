"""Sources and sinks: delimited tables, ground truth, caches, lookups, outputs and their checks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.text import address_digits, norm_text, trimmed
from kindred.options import NORM, Budget, NormOptions

COLUMNS = ["entity_id", "business_name", "business_address", "country"]
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
#: Changes when normal forms do, so that cached tables are made again.
NORMALISER = "1"


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated source table; the header must match ``COLUMNS``; blanks are '', ends are trimmed."""
    header = spark.read.option("sep", "\t").option("header", True).csv(path).columns
    if [h.strip().lstrip("﻿") for h in header] != COLUMNS:
        raise ValueError(f"unexpected header {header}")
    rows = spark.read.schema(SCHEMA).option("sep", "\t").option("header", True).csv(path)
    return rows.select(*[trimmed(c).alias(c) for c in COLUMNS])


def read_malformed(spark: SparkSession, path: str) -> DataFrame:
    """Rows, with those of a wrong number of fields marked ``malformed`` instead of failing."""
    lines = spark.read.text(path)
    parts = F.split("value", "\t", -1)
    header = "\t".join(COLUMNS)
    rows = lines.where(F.regexp_replace("value", "^﻿", "") != header)
    return rows.select(*[F.coalesce(F.get(parts, i), F.lit("")).alias(c) for i, c in enumerate(COLUMNS)], (F.size(parts) != len(COLUMNS)).alias("malformed"))


def normalised(rows: DataFrame, options: NormOptions = NORM) -> DataFrame:
    """Add ``name_norm, address_norm, address_dig``."""
    return rows.withColumn("name_norm", norm_text("business_name", options)).withColumn("address_norm", norm_text("business_address", options)).withColumn("address_dig", address_digits("business_address"))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Twelve hex digits over names, sizes and times of a path's files and the normaliser's version, by Spark's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    status = [s for s in (fs.globStatus(p) or []) for s in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    facts = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in status)
    return hashlib.md5(json.dumps([facts, NORMALISER]).encode()).hexdigest()[:12]


def load_cached(spark: SparkSession, path: str, cache: str, options: NormOptions = NORM, load: bool = True, force: bool = False) -> DataFrame | None:
    """The normalised table of a source, kept as Parquet under ``cache`` by fingerprint; ``load=False`` only makes it, ``force`` makes it anew."""
    at = f"{cache}/{fingerprint(spark, path)}-{int(options.delete_hyphen)}{int(options.keep_all_marks)}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if force or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        normalised(read_source(spark, path), options).write.mode("overwrite").option("compression", "snappy").parquet(at)
    return spark.read.parquet(at) if load else None


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``s1_id, matched``: lines split at the first tab, ids at commas, blanks dropped; of a repeated id the last line counts.

    Lines are ordered by file, then block, then place in the block, however blocks are dealt to tasks.
    """
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("at"))
    at = F.instr("value", "\t")
    s1 = F.trim(F.when(at > 0, F.expr("substring(value, 1, instr(value, '\t') - 1)")).otherwise(F.col("value")))
    rest = F.when(at > 0, F.expr("substring(value, instr(value, '\t') + 1)")).otherwise(F.lit(""))
    ids = F.filter(F.transform(F.split(rest, ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.select(s1.alias("s1_id"), ids.alias("matched"), "at").where("s1_id not in ('', 'source1_entity_id')")
    return rows.groupBy("s1_id").agg(F.max_by("matched", "at").alias("matched"))


def load_cached_truth(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """The ground truth of a file, kept as Parquet under ``cache`` by its fingerprint."""
    at = f"{cache}/truth-{fingerprint(spark, path)}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        read_ground_truth(spark, path).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def load_cached_postings(targets: DataFrame, cache: str, name: str, budget: Budget, force: bool = False) -> DataFrame:
    """The targets' postings as Parquet under ``cache``, by ``name`` (of the targets) and the limits that made them: others are made anew."""
    from kindred.operators.blocking import listed_postings

    spark = targets.sparkSession
    at = f"{cache}/postings-{name}-{min(budget.max_token_df, budget.token_bucket_cap)}-{budget.min_token_len}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if force or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        listed_postings(targets, budget).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def lookup(rows: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows whose id is among ``ids``."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def write_candidates(pairs: DataFrame, path: str) -> None:
    """Candidate pairs as Parquet, a folder a source."""
    pairs.write.mode("overwrite").partitionBy("source").parquet(path)


def union_candidates(parts: Iterable[DataFrame]) -> DataFrame:
    """All pairs of all parts, repeats kept."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first


def id_lists(pairs: DataFrame, everyone: DataFrame, column: str) -> DataFrame:
    """``source1_entity_id`` and the comma-joined candidate ids in order, blank for none; sorted by id."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("candidate_id")), ",").alias(column))
    ids = everyone.select("s1_id").distinct()
    return ids.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column)).orderBy("source1_entity_id")


def write_lists(lists: DataFrame, path: str, files: int | None = None) -> None:
    """Tab-separated files with headers, in the order of ids; one file only if asked for, since one task then writes all."""
    (lists.coalesce(files) if files else lists).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def validate_outputs(matching: DataFrame, candidates: DataFrame, everyone: DataFrame) -> DataFrame:
    """Problems of outputs as ``problem, n``: ids missing, unknown or repeated, and matches that aren't candidates."""
    ids = everyone.select(F.col("s1_id").alias("source1_entity_id")).distinct()

    def exploded(df: DataFrame, column: str) -> DataFrame:
        return df.select("source1_entity_id", F.explode(F.filter(F.split(column, ","), lambda x: x != "")).alias("id"))

    strange = exploded(matching, "matched_entity_ids").join(exploded(candidates, "candidate_entity_ids"), ["source1_entity_id", "id"], "left_anti")
    found = [
        ("missing", ids.join(matching, "source1_entity_id", "left_anti")),
        ("unknown", matching.join(ids, "source1_entity_id", "left_anti")),
        ("repeated", matching.groupBy("source1_entity_id").count().where("count > 1")),
        ("not_candidate", strange),
    ]
    return union_candidates(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n") for name, df in found)
