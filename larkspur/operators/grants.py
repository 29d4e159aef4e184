"""Grants: investigators, organisations, field codes and scope, from nested records to relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: fixed values: roles and schemes in scope, and early-career roles
KEEP_ROLES = ("CI", "CI-DORA", "DECRA", "FT", "FL", "FF", "APD", "APF", "ARF", "QEII", "APDI", "ARFI", "DAATSIA", "IRF")
KEEP_SCHEMES = ("DP", "LP", "DE", "FT", "FL", "FF")
ECR_ROLES = ("DECRA", "APD", "APDI")


def in_scope(role: Column, grant: Column) -> Column:
    return role.isin(*KEEP_ROLES) & F.substring(grant, 1, 2).isin(*KEEP_SCHEMES)


def investigators(grants: DataFrame) -> DataFrame:
    """One row for each person of a grant (grant, announced, current: arrays of struct<name, role, orcid>): the first time they are named, announced before current, with the first ORCID given.

    A person of a grant is known by the letters and digits of the name.
    """
    named = F.concat(F.coalesce("announced", F.array().cast("array<struct<name:string,role:string,orcid:string>>")), F.coalesce("current", F.array().cast("array<struct<name:string,role:string,orcid:string>>")))
    one = grants.select("grant", F.posexplode(named).alias("at", "p")).select("grant", "at", "p.*").withColumn("uid", F.concat_ws("_", "grant", F.regexp_replace("name", "[^A-Za-z0-9]", "")))
    first = F.min_by(F.struct("name", "role"), "at")
    orcid = F.min(F.when(F.col("orcid").isNotNull(), F.struct("at", "orcid")))
    return one.groupBy("grant", "uid").agg(first.alias("f"), orcid.alias("o"), F.count("*").alias("times")).select("grant", "uid", "f.name", "f.role", F.col("o.orcid").alias("orcid"), "times")


def organisations(grants: DataFrame, roles: tuple[str, ...], wide: tuple[str, ...]) -> DataFrame:
    """grant, n_eligible (different names in roles) and the sorted names in the wider roles; orgs: array of struct<name, role>."""
    names = lambda of: F.array_distinct(F.transform(F.filter("orgs", lambda o: o["role"].isin(*of)), lambda o: o["name"]))
    return grants.select("grant", F.size(names(roles)).alias("n_eligible"), F.array_sort(names(wide)).alias("eligible"))


def field_codes(grants: DataFrame) -> DataFrame:
    """grant and its codes of four digits, each once: primary ones first, then by name; codes: array of struct<code, name, primary>."""
    one = grants.select("grant", F.explode("codes").alias("c")).select("grant", F.substring("c.code", 1, 4).alias("code"), F.col("c.name").alias("name"), F.col("c.primary").alias("primary"))
    each = one.groupBy("grant", "code").agg(F.bool_or("primary").alias("primary"), F.min("name").alias("name"))
    order = F.array_sort(F.collect_list(F.struct((~F.col("primary")).alias("late"), F.lower("name").alias("low"), "code")))
    return each.groupBy("grant").agg(F.transform(order, lambda x: x["code"]).alias("codes"))


def long_codes(grants: DataFrame) -> DataFrame:
    return grants.select("grant", F.inline("codes"))


def code_union(codes: DataFrame) -> DataFrame:
    """cluster and its codes: primary in any record, highest confidence, times seen; ordered by times primary, times seen, name. codes: cluster, code, name, primary, confidence."""
    each = codes.groupBy("cluster", "code").agg(F.bool_or("primary").alias("primary"), F.max("confidence").alias("confidence"), F.count_if("primary").alias("n_primary"), F.count("*").alias("n_seen"), F.min("name").alias("name"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n_primary")).alias("a"), (-F.col("n_seen")).alias("b"), F.lower("name").alias("c"), "code", "primary", "confidence")))
    return each.groupBy("cluster").agg(order.alias("o")).select("cluster", F.transform("o", lambda x: x["code"]).alias("codes"), F.transform("o", lambda x: x["primary"]).alias("primary"), F.transform("o", lambda x: x["confidence"]).alias("confidence"))


def code_totals(counts: DataFrame) -> DataFrame:
    """cluster and its codes by their summed counts, the largest first, then by code."""
    each = counts.groupBy("cluster", "code").agg(F.sum("n").alias("n"))
    return each.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "code"))).alias("o")).select("cluster", F.transform("o", lambda x: x["code"]).alias("codes"), F.transform("o", lambda x: -x["m"]).alias("counts"))


def override(rows: DataFrame, table: DataFrame, key: str, column: str) -> DataFrame:
    """rows with column from the override table where it lists the key: a blank there means null, not the old value."""
    new = table.select(key, F.col(column).alias("_new"), F.lit(True).alias("_listed"))
    joined = rows.join(new, key, "left")
    return joined.withColumn(column, F.when(F.col("_listed"), F.nullif("_new", F.lit(""))).otherwise(F.col(column))).drop("_new", "_listed")


def searchable(aliases: DataFrame) -> DataFrame:
    """alias to the institution name it is searched by (alias, name, at): both not blank, the last of several."""
    return aliases.where((F.trim("alias") != "") & (F.trim("name") != "")).groupBy("alias").agg(F.max_by("name", "at").alias("name"))


def coinvestigators(items: DataFrame) -> DataFrame:
    """uid and the sorted names of the others on its grant (uid, grant, name): names of a grant are gathered once."""
    names = items.groupBy("grant").agg(F.collect_set("name").alias("_all"))
    return items.join(names, "grant", "left").select("uid", F.array_sort(F.array_except(F.coalesce("_all", F.array().cast("array<string>")), F.array("name"))).alias("others"))


def projection(counts: DataFrame, target: float) -> DataFrame:
    """counts with n scaled to a total of target (halves to even) and the difference from it."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    scaled = F.bround(F.col("n") / float(total) * target).cast("long")
    return counts.withColumn("projected", scaled).withColumn("delta", F.col("projected") - F.col("n"))


def anchored(rows: DataFrame, by: str, year: str, anchors: tuple[int, ...], width: int = 5) -> DataFrame:
    """Rows of each group in `width` years from each anchor on, one column for each, and their total; the largest first."""
    label = F.lit(None).cast("string")
    for a in anchors:
        label = F.when(F.col(year).between(a, a + width - 1), F.lit(f"{a}s")).otherwise(label)
    wide = rows.withColumn("_at", label).where("_at is not null").groupBy(by).pivot("_at", [f"{a}s" for a in anchors]).count().fillna(0)
    return wide.withColumn("total", sum((F.col(f"{a}s") for a in anchors), F.lit(0))).orderBy(F.col("total").desc(), by)


def exploded_frequencies(lists: DataFrame, column: str) -> DataFrame:
    """Share of each element among all elements of the lists."""
    total = lists.agg(F.sum(F.size(column))).first()[0] or 1
    return lists.select(F.explode(column).alias("value")).groupBy("value").agg((F.count("*") / float(total)).alias("tf"))


def profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n for each column: value counts of all of them in one pass."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(each)).groupBy("column", "value").agg(F.count("*").alias("n"))


def field_words(c: Column) -> Column:
    return T.field_tokens(c)
