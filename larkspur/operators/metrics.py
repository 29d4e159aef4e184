"""Bibliometric operators: h-index, yearly metrics, quantiles, co-occurrence, title dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def h_index(works: DataFrame, keys: list[str], cites: str = "cites", order: str = "work") -> DataFrame:
    """keys and h: the largest rank that its work's citations reach; null where none does."""
    w = Window.partitionBy(*keys).orderBy(F.col(cites).desc(), F.col(order))
    ranked = works.withColumn("rk", F.row_number().over(w))
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col(cites) >= F.col("rk"), F.col("rk"))).cast("long").alias("h_index"))


def national_h_index(works: DataFrame, keys: list[str], cites: str = "cites") -> DataFrame:
    """The same for groups of any size: ranks come from counts by citation value, so no group is sorted whole."""
    counts = works.groupBy(*keys, cites).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col(cites).desc())
    upto = counts.withColumn("m", F.sum("n").over(w))
    return upto.groupBy(*keys).agg(F.max(F.least(F.col(cites), F.col("m"))).cast("long").alias("h"))


def spread_years(works: DataFrame, year: str, first: int, last: int) -> DataFrame:
    """Each work in every year from its own on: a spine join without a cross join."""
    return works.where(F.col(year) <= last).withColumn("year", F.explode(F.sequence(F.greatest(F.col(year), F.lit(first)), F.lit(last))))


def yearly(works: DataFrame, first: int, last: int) -> DataFrame:
    """person, year: cumulative h-index, works and citations; career age from the first work.

    Works of one year and citation count are counted first, so what is spread over the years and
    ranked is the different counts.
    """
    counts = works.groupBy("person", "yr", "cites").agg(F.count("*").alias("n"))
    spread = spread_years(counts, "yr", first, last).groupBy("person", "year", "cites").agg(F.sum("n").alias("n"), F.min("yr").alias("first_year"))
    upto = spread.withColumn("m", F.sum("n").over(Window.partitionBy("person", "year").orderBy(F.col("cites").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    out = upto.groupBy("person", "year").agg(
        F.nullif(F.max(F.least("cites", "m")), F.lit(0)).cast("long").alias("h_index"), F.sum("n").alias("n_works"), F.sum(F.col("n") * F.col("cites")).alias("citations"), F.min("first_year").alias("first_year"),
    )
    return out.withColumn("career_age", F.col("year") - F.col("first_year"))


def best_topic(topics: DataFrame, work: str, score: str, ties: list[str]) -> DataFrame:
    """The highest-scored topic of each work, ties by the given columns."""
    w = Window.partitionBy(work).orderBy(F.col(score).desc(), *ties)
    return topics.withColumn("rk", F.row_number().over(w)).where("rk = 1").drop("rk")


def quantiles(works: DataFrame, keys: list[str], cites: str = "cites") -> DataFrame:
    return works.groupBy(*keys).agg(F.percentile(cites, F.lit(0.9)).alias("p90"), F.percentile(cites, F.lit(0.99)).alias("p99"), F.count("*").alias("n"))


def cooccurrence(topics: DataFrame, least: float = 0.1) -> DataFrame:
    """lo, hi, year: cumulative weight of pairs of subfields that share works; shares under least dropped, the rest renormalised."""
    each = topics.groupBy("work", "year", "subfield").agg(F.sum("score").alias("s")).groupBy("work", "year").agg(F.array_sort(F.collect_list(F.struct("subfield", "s"))).alias("l"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x["s"])
    each = each.withColumn("l", F.filter("l", lambda x: x["s"] / total(F.col("l")) >= least)).withColumn("t", total(F.col("l")))
    pair = lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x["subfield"].alias("lo"), y["subfield"].alias("hi"), ((x["s"] + y["s"]) / F.col("t")).alias("w")))
    pairs = each.where(F.size("l") > 1).select("year", F.inline(F.flatten(F.transform("l", pair)))).groupBy("lo", "hi", "year").agg(F.sum("w").alias("w"))
    run = Window.partitionBy("lo", "hi").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return pairs.select("lo", "hi", "year", F.round(F.sum("w").over(run), 6).alias("cumulative"))


def title_dedup(works: DataFrame, key: Column, priority: Column, least: int = 20) -> DataFrame:
    """person, k: the version that stays (by priority, then id), with the earliest year and summed citations.

    A title of at least `least` characters is known by its key, a shorter one by its work; rows meet by
    a 128-bit digest of that, so long keys are neither shuffled nor compared for the grouping.
    """
    k = works.withColumn("k", F.when(F.length("title") >= least, key).otherwise(F.col("work").cast("string"))).withColumn("_k", F.md5("k"))
    group = Window.partitionBy("person", "_k")
    ranked = k.select("person", "work", "_k", "year", "cites", priority.alias("_p")).withColumn("year", F.min("year").over(group)).withColumn("cites", F.sum("cites").over(group)).withColumn("rk", F.row_number().over(group.orderBy("_p", "work")))
    return ranked.where("rk = 1").drop("rk", "_k", "_p").join(k.select("person", "work", "k"), ["person", "work"])


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that holds; null if none does."""
    out = None
    for name, rule in rules:
        out = F.when(rule, F.lit(name)) if out is None else out.when(rule, F.lit(name))
    return out
