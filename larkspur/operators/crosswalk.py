"""Field-of-research codes: vintage, upgrade and names through tables that the caller supplies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vintage(code: Column) -> Column:
    """'2008' for divisions 01 to 22, '2020' for 30 to 52, null for others; codes are strings, as leading zeros count."""
    division = F.substring(code, 1, 2).try_cast("int")
    return F.when(division.between(1, 22), "2008").when(division.between(30, 52), "2020")


def upgrade(codes: DataFrame, old_to_new: DataFrame, code: str = "code") -> DataFrame:
    """codes with code_2020 and n_targets: codes of 2020 stay; older ones by old_to_new (old, new), the least of several; null if unknown."""
    one = old_to_new.groupBy("old").agg(F.min("new").alias("_new"), F.countDistinct("new").alias("_n"))
    joined = codes.join(one, codes[code] == one.old, "left")
    new = F.when(vintage(F.col(code)) == "2020", F.col(code)).otherwise(F.col("_new"))
    return joined.withColumn("code_2020", new).withColumn("n_targets", F.coalesce("_n", F.lit(0))).drop("old", "_new", "_n")


def names_of(codes: DataFrame, concordance: DataFrame, key: str, code: str = "code_2020") -> DataFrame:
    """key, fields, subfields: sorted sets of names by concordance (for_code, field, subfield), by the group (four digits), then the division; codes of neither are left out."""
    group = concordance.select(F.col("for_code").alias("_g"), F.col("field").alias("_gf"), F.col("subfield").alias("_gs"))
    division = concordance.where(F.length("for_code") == 2).select(F.col("for_code").alias("_d"), F.col("field").alias("_df"))
    found = codes.join(group, F.substring(F.col(code), 1, 4) == F.col("_g"), "left").join(division, F.substring(F.col(code), 1, 2) == F.col("_d"), "left")
    return found.groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce("_gf", "_df"))).alias("fields"), F.array_sort(F.collect_set("_gs")).alias("subfields"))


def mismatch(codes: Column) -> Column:
    """Whether an array of codes spans several divisions (two digits)."""
    return F.size(F.array_distinct(F.transform(codes, lambda c: F.substring(c, 1, 2)))) >= 2


def division_mismatch(codes: Column, fields: Column, allowed: Column) -> Column:
    """Over one field and several divisions, of which not every pair ('30-31', the smaller first) is allowed."""
    divisions = F.array_sort(F.array_distinct(F.transform(codes, lambda c: F.substring(c, 1, 2))))
    pairs = F.flatten(F.transform(divisions, lambda a: F.transform(F.filter(divisions, lambda b: a < b), lambda b: F.concat_ws("-", a, b))))
    return (F.size(F.array_distinct(fields)) > 1) & (F.size(divisions) >= 2) & ~F.forall(pairs, lambda p: F.array_contains(allowed, p))


def suspicious(n_grants: Column, tf: Column, mismatched: Column, common: float = 1e-5) -> Column:
    """Several grants under a common name across divisions that don't go together; a name of unknown frequency is rare."""
    return (n_grants > 1) & (F.coalesce(tf, F.lit(0.0)) >= common) & F.coalesce(mismatched, F.lit(False))


def panel(rows: DataFrame, groups: DataFrame, divisions: DataFrame, code: str = "code") -> DataFrame:
    """rows with panel: by the code's group (four digits), else by its division (two), else (unmapped)."""
    by_group = groups.select(F.col("group").alias("_g"), F.col("panel").alias("_gp"))
    by_division = divisions.select(F.col("division").alias("_d"), F.col("panel").alias("_dp"))
    got = rows.join(by_group, F.substring(code, 1, 4) == F.col("_g"), "left").join(by_division, F.substring(code, 1, 2) == F.col("_d"), "left")
    return got.withColumn("panel", F.coalesce("_gp", "_dp", F.lit("(unmapped)"))).drop("_g", "_gp", "_d", "_dp")
