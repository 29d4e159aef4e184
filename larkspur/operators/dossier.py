"""One nested row and one Markdown text for each person, set-based."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dossiers(works: DataFrame, yearly: DataFrame) -> DataFrame:
    """person, works (most cited first), years (in order); works: person, work, yr, cites; yearly: person, year, h_index, n_works, citations."""
    of_works = works.groupBy("person").agg(F.count("*").alias("n_works"), F.sum("cites").alias("citations"), F.array_sort(F.collect_list(F.struct((-F.col("cites")).alias("order"), "work", "yr", "cites"))).alias("w"))
    of_years = yearly.groupBy("person").agg(F.max("h_index").alias("h_index"), F.array_sort(F.collect_list(F.struct("year", "h_index", "n_works", "citations"))).alias("years"))
    plain = F.transform("w", lambda x: F.struct(x.work.alias("work"), x.yr.alias("yr"), x.cites.alias("cites")))
    return of_works.join(of_years, "person", "left").select("person", "n_works", "citations", "h_index", plain.alias("works"), F.coalesce("years", F.array().cast("array<struct<year:int,h_index:bigint,n_works:bigint,citations:bigint>>")).alias("years"))


def markdown(nested: DataFrame) -> DataFrame:
    """person, text."""
    work = F.transform("works", lambda x: F.concat(F.lit("| "), x.work.cast("string"), F.lit(" | "), x.yr.cast("string"), F.lit(" | "), x.cites.cast("string"), F.lit(" |")))
    year = F.transform("years", lambda x: F.concat(F.lit("| "), x.year.cast("string"), F.lit(" | "), F.coalesce(x.h_index, F.lit(0)).cast("string"), F.lit(" | "), x.n_works.cast("string"), F.lit(" |")))
    head = F.concat(F.lit("# "), F.col("person").cast("string"), F.lit("\n\nWorks: "), F.col("n_works").cast("string"), F.lit("; citations: "), F.col("citations").cast("string"), F.lit("; h-index: "), F.coalesce("h_index", F.lit(0)).cast("string"))
    return nested.select("person", F.concat_ws("\n", head, F.lit("\n| year | h-index | works |\n|-|-|-|"), F.concat_ws("\n", year), F.lit("\n| work | year | citations |\n|-|-|-|"), F.concat_ws("\n", work)).alias("text"))
