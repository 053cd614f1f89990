"""The driver's tables seen as entities: a third of the rows each is source 1, 2 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.text import address_digits, norm_plain, trimmed


def entities(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """``entity_id, source, row_id, business_name, business_address, country`` of view ``part``, ``doc`` or ``bench``.

    ``doc``: the first line of a text is the name, all the rest the address. ``bench``: benchmark
    items (source 1) against whole documents (sources 2 and 3) by name alone; nothing has an address.
    """
    if view == "part":
        base = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as row_id", "p_name as business_name", "concat(p_brand, ', ', p_type, ' ', p_size) as business_address", "p_type as country")
    elif view == "doc":
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
        base = docs.withColumn("first", F.substring_index("text", "\n", 1)).selectExpr("doc_id as row_id", "first as business_name", "substring(text, length(first) + 2) as business_address", "lang as country")
    else:
        items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id * 3 as row_id", "text as business_name", "'' as business_address", "'' as country")
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + (doc_id - doc_id % 2) div 2 + 1 as row_id", "text as business_name", "'' as business_address", "lang as country")
        base = items.unionByName(docs)
    source = (F.col("row_id") % 3 + 1).cast("int")
    return base.select(F.concat(F.lit("S"), source, F.lit("-"), F.col("row_id")).alias("entity_id"), source.alias("source"), "row_id", *[trimmed(c).alias(c) for c in ("business_name", "business_address", "country")])


def normal_entities(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """With native normal forms; those of ASCII texts are the script-aware ones."""
    rows = entities(spark, sf_dir, view)
    return rows.withColumn("name_norm", norm_plain("business_name")).withColumn("address_norm", norm_plain("business_address")).withColumn("address_dig", address_digits("business_address"))


def part_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s1_id, candidate_id, source``: source 1 parts and those of the others with the same name, brand and type."""
    same = ["p_name", "p_brand", "p_type"]
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(*same, "p_partkey", (F.col("p_partkey") % 3 + 1).cast("int").alias("source"))
    name = F.concat(F.lit("S"), F.col("source"), F.lit("-"), F.col("p_partkey"))
    left = parts.where("source = 1").select(*same, name.alias("s1_id"))
    return left.join(parts.where("source > 1").select(*same, name.alias("candidate_id"), "source"), same).select("s1_id", "candidate_id", "source")


def part_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity_id, same``: of a source 1 part and another, ``same`` is equal if ``part_truth`` has the pair; null where a name, brand or type is."""
    same = ["p_name", "p_brand", "p_type"]
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("source", (F.col("p_partkey") % 3 + 1).cast("int"))
    known = F.when(F.expr(" and ".join(f"{c} is not null" for c in same)), F.unhex(F.md5(F.to_json(F.struct(*same)))))
    return parts.select(F.concat(F.lit("S"), "source", F.lit("-"), "p_partkey").alias("entity_id"), known.alias("same"))


def doc_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``s1_id, candidate_id, source``: source 1 documents and those of the others with the same text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5("text").alias("same"), (F.col("doc_id") % 3 + 1).cast("int").alias("source"))
    name = F.concat(F.lit("S"), F.col("source"), F.lit("-"), F.col("doc_id"))
    left = docs.where("source = 1").select("same", name.alias("s1_id"))
    return left.join(docs.where("source > 1").select("same", name.alias("candidate_id"), "source"), "same").select("s1_id", "candidate_id", "source")
