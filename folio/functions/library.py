"""Describing a library interface from its base address, and model ids per provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def library_info(bases: DataFrame, overrides: DataFrame) -> DataFrame:
    """Handle base, host, code, label and version of each ``api_base``; ``overrides`` wins by base.

    overrides: api_base, o_label, o_code, o_handle (a few rows, joined by value).
    """
    base = F.regexp_replace(F.coalesce("api_base", F.lit("")), "/+$", "")
    handle = F.when(F.col("_b").contains("/api/"), F.substring_index("_b", "/api/", 1)).when(
        F.col("_b").endswith("/api"), F.regexp_replace("_b", "/api$", "")).otherwise(F.col("_b"))
    low = F.lower("_b")
    rows = bases.withColumn("_b", base).join(overrides.withColumnRenamed("api_base", "_b"), "_b", "left")
    host = F.coalesce(F.regexp_extract(F.col("handle_base"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    return (
        rows.withColumn("handle_base", F.coalesce("o_handle", handle))
        .withColumn("netloc", host)
        .select(
            F.col("_b").alias("api_base"),
            "handle_base",
            "netloc",
            F.coalesce("o_label", F.when(F.col("netloc") != "", F.col("netloc")), F.col("_b")).alias("label"),
            F.coalesce("o_code", F.substring_index("netloc", ".", 1)).alias("code"),
            F.when(low.contains("api/client/v7.0"), "K7").when(low.contains("search/api/v5.0"), "K5").otherwise("").alias("version"),
        )
    )


def scoped_model(model: Column, provider: Column) -> Column:
    """Model id as its provider wants it: the maker's prefix is dropped only for that maker."""
    return F.when((F.lower(F.trim(provider)) == "openai") & model.startswith("openai/"), F.substr(model, F.lit(8))).otherwise(model)
