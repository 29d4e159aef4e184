"""Works of candidates: quality reasons, topics, field filters, version dedup, yearly and collaboration metrics.

Every operator is a restriction first, aggregates next, and joins last; what decides about a row is
one boolean or reason column, so survivors and exclusion counts split the same frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .metrics import first_reason

#: fixed values: types of works that count, in no order, and the order in which versions of one title stay
ALLOWED_TYPES = ("article", "preprint", "report", "review", "book", "book-chapter", "dissertation", "software", "software-paper")
VERSION_ORDER = ("article", "review", "book-chapter", "book", "preprint")
FIRST_YEAR, LAST_YEAR, FIRST_ORCID_YEAR = 1950, 2026, 2012
FILE_NAME = r"(?i)^[A-Za-z0-9_-]+\.pdf$"


def is_file_name(title: Column) -> Column:
    return F.trim(title).rlike(FILE_NAME)


def malformed_orcid(orcid: Column) -> Column:
    return ~orcid.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$")


def initial_only(name: Column) -> Column:
    return name.rlike(r"^[A-Z]\.?$")


def mojibake(s: Column) -> Column:
    return s.contains("â€")


def quality_reason(first: int = FIRST_YEAR, last: int = LAST_YEAR, orcid_year: int = FIRST_ORCID_YEAR, strict: bool = False) -> Column:
    """The first of nine reasons why a work does not count, or null: over type, doi, title, year, null_author, null_inst, raw_orcid, source.

    A null type is no reason by itself, unless strict is set, which also leaves the rule on raw ORCIDs out.
    """
    c = F.col
    type_ok = F.coalesce(c("type").isin(*ALLOWED_TYPES), F.lit(False)) if strict else c("type").isin(*ALLOWED_TYPES)
    rules = [
        ("type_not_allowed", ~type_ok), ("filename_artifact", c("doi").isNull() & c("title").isNotNull() & is_file_name(c("title"))), ("missing_year", c("year").isNull()),
        ("implausible_year", c("year") < first), ("future_year", c("year") > last), ("missing_doi", c("doi").isNull()), ("corrupt_authorship", c("null_author") | c("null_inst")),
        ("raw_orcid_impossible", c("raw_orcid") & (c("year") < orcid_year)), ("missing_source", c("source").isNull() & (c("type") == "article")),
    ]
    return first_reason([r for r in rules if not (strict and r[0] == "raw_orcid_impossible")])


def exclude_reason(title: Column, type_: Column, doi: Column) -> Column:
    """type_not_allowed (null too), filename_artifact, or null: the scope of version dedup."""
    return first_reason([("type_not_allowed", ~F.coalesce(type_.isin(*ALLOWED_TYPES), F.lit(False))), ("filename_artifact", doi.isNull() & (title != "") & is_file_name(title))])


def corruption(authorships: DataFrame) -> DataFrame:
    """Per work: whether an author, an institution is missing, whether a raw ORCID is there."""
    return authorships.groupBy("work").agg(F.bool_or(F.col("author").isNull()).alias("null_author"), F.bool_or(F.col("inst").isNull()).alias("null_inst"), F.bool_or(F.col("raw_orcid").isNotNull()).alias("raw_orcid"))


def candidate_works(candidates: DataFrame, authorships: DataFrame) -> DataFrame:
    """cluster, work, and the sorted candidates of the cluster that the work names (cluster, author) x (work, author)."""
    return candidates.join(authorships.select("work", "author"), "author").groupBy("cluster", "work").agg(F.array_sort(F.collect_set("author")).alias("authors"))


def topics_of_works(topics: DataFrame) -> DataFrame:
    """work, the best topic's subfield and field, and all different ones, sorted (null where there are none): one aggregate."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "subfield", "field"))
    every = lambda c: F.nullif(F.array_sort(F.collect_set(c)), F.array().cast("array<string>"))
    return topics.groupBy("work").agg(best.alias("b"), every("field").alias("fields"), every("subfield").alias("subfields")).select("work", F.col("b.subfield").alias("subfield"), F.col("b.field").alias("field"), "fields", "subfields")


def stage1(candidates: DataFrame, authorships: DataFrame, details: DataFrame, topics: DataFrame, **bounds: int) -> DataFrame:
    """A row for each cluster and work with its details, topics and reason (null for survivors)."""
    mine = candidate_works(candidates, authorships)
    ids = mine.select("work").distinct()
    judged = details.join(ids, "work", "left_semi").join(corruption(authorships.join(ids, "work", "left_semi")), "work").withColumn("reason", quality_reason(**bounds)).drop("null_author", "null_inst", "raw_orcid")
    return mine.join(judged, "work").join(topics_of_works(topics.join(ids, "work", "left_semi")), "work", "left")


def survivors(judged: DataFrame) -> DataFrame:
    return judged.where("reason is null").drop("reason")


def exclusions(judged: DataFrame) -> DataFrame:
    return judged.where("reason is not null").groupBy("cluster", "reason").agg(F.count("*").alias("n"))


def field_filter(works: DataFrame, allowed: DataFrame, pools: DataFrame, matched: DataFrame, small: int = 10) -> DataFrame:
    """works with keep, never null: no reference field, no field, a small pool, an allowed field, or a work of an ORCID-matched author of a small pool.

    allowed: cluster, field; pools: cluster, candidates; matched: cluster, author. Each side is one row a cluster when joined.
    """
    fields = allowed.groupBy("cluster").agg(F.collect_set("field").alias("_allowed"))
    authors = matched.join(pools.where(F.col("candidates") < small), "cluster", "left_semi").groupBy("cluster").agg(F.collect_set("author").alias("_matched"))
    wide = works.join(fields, "cluster", "left").join(pools, "cluster", "left").join(authors, "cluster", "left")
    no = F.lit(False)
    keep = (
        F.col("_allowed").isNull() | F.col("fields").isNull() | F.coalesce(F.col("candidates") < small, no)
        | F.coalesce(F.arrays_overlap("fields", "_allowed"), no) | F.coalesce(F.arrays_overlap("authors", "_matched"), no)
    )
    return wide.withColumn("keep", keep).drop("_allowed", "_matched", "candidates")


def subfield_filter(works: DataFrame, primary: DataFrame) -> DataFrame:
    """works with keep: the best topic's subfield is one of the cluster's primary ones; a null subfield or no reference keeps."""
    wanted = primary.groupBy("cluster").agg(F.collect_set("subfield").alias("_wanted"))
    wide = works.join(wanted, "cluster", "left")
    return wide.withColumn("keep", F.coalesce(F.array_contains("_wanted", F.col("subfield")), F.lit(True))).drop("_wanted")


def coherence(works: DataFrame, least: int = 3, shared: int = 2) -> DataFrame:
    """cluster, work, coherent: of works with the same candidates, one shares a subfield with another; null for small groups or no subfields."""
    group = Window.partitionBy("cluster", "authors")
    size = works.withColumn("size", F.count("*").over(group))
    one = size.select("cluster", "work", "authors", "size", F.explode_outer("subfields").alias("subfield"))
    times = one.withColumn("times", F.when(F.col("subfield").isNotNull(), F.count("*").over(Window.partitionBy("cluster", "authors", "subfield"))))
    return times.groupBy("cluster", "work").agg(F.when(F.max("size") >= least, F.bool_or(F.col("times") >= shared)).alias("coherent"))


def hep_match(works: DataFrame, institutions: DataFrame, own: DataFrame) -> DataFrame:
    """cluster, work, hep_match: some institution of the work is one of the cluster's; null where the work's or the cluster's are not known."""
    of_work = institutions.groupBy("work").agg(F.collect_set("hep").alias("_work"))
    of_cluster = own.groupBy("cluster").agg(F.collect_set("hep").alias("_own"))
    return works.select("cluster", "work").join(of_work, "work", "left").join(of_cluster, "cluster", "left").select("cluster", "work", F.arrays_overlap("_work", "_own").alias("hep_match"))


def deduped_works(works: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR, least: int = 20) -> DataFrame:
    """One version of each person's titles: earliest year, summed citations, the version by type, then id.

    A title of at least `least` characters is known by its key, a shorter one by its work. Rows meet by a
    128-bit digest of the key, so no title is shuffled or sorted; the title itself stays with its row.
    """
    kept = works.where(F.col("year").between(first, last) & exclude_reason(F.col("title"), F.col("type"), F.col("doi")).isNull()).distinct()
    key = F.when(F.length("title") >= least, T.title_key(F.col("title"))).otherwise(F.col("work").cast("string"))
    group = Window.partitionBy("person", "_key")
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, VERSION_ORDER)), F.col("type")), F.lit(0)), F.lit(len(VERSION_ORDER) + 1))
    ranked = kept.withColumn("_key", F.md5(F.coalesce(key, F.lit("")))).withColumn("year", F.min("year").over(group)).withColumn("cites", F.sum("cites").over(group))
    return ranked.withColumn("_rk", F.row_number().over(group.orderBy(rank, "work"))).where("_rk = 1").drop("_rk", "_key")


def exclusion_counts(works: DataFrame) -> DataFrame:
    reason = exclude_reason(F.col("title"), F.col("type"), F.col("doi"))
    return works.select("person", reason.alias("reason")).where("reason is not null").groupBy("person", "reason").agg(F.count("*").alias("n"))


def author_map(resolved: DataFrame, shared: tuple[str, ...] = ("oax_orcid_dedup", "oax_topic_dedup")) -> DataFrame:
    """person, author, is_primary: the chosen author of each person, and the others where they are the same person's split records."""
    first = resolved.select("person", T.author_id(F.col("url")).alias("author"), F.lit(True).alias("is_primary"))
    rest = resolved.where(F.col("resolved_by").isin(*shared)).select("person", F.explode("others").alias("url")).select("person", T.author_id(F.col("url")).alias("author"), F.lit(False).alias("is_primary"))
    return first.unionByName(rest).where("author is not null")


def oeuvres(authors: DataFrame, authorships: DataFrame, details: DataFrame, topics: DataFrame) -> DataFrame:
    """person, work, whether the primary author is on it, the work's details and best topic."""
    mine = authors.join(authorships.select("work", "author").distinct(), "author").groupBy("person", "work").agg(F.bool_or("is_primary").alias("is_primary"))
    ids = mine.select("work").distinct()
    return mine.join(details.join(ids, "work", "left_semi"), "work").join(topics_of_works(topics.join(ids, "work", "left_semi")).select("work", "subfield", "field"), "work", "left")


def annual_metrics(works: DataFrame, first: int = 2000, last: int = 2025, quantiles: DataFrame | None = None) -> DataFrame:
    """person, year: cumulative h-index, works, citations (null counts as 0); that year's works, citations, commonest field; career age; with quantiles, highly cited works so far.

    Works are counted by person, year and citations before they are spread over the years, so that what
    is spread and ranked is the different citation counts, not the works.
    """
    works = works.withColumn("cites", F.coalesce("cites", F.lit(0)))
    w = works.join(quantiles.withColumnRenamed("yr", "year"), ["field", "year"], "left") if quantiles is not None else works.withColumn("p90", F.lit(None).cast("double")).withColumn("p99", F.lit(None).cast("double"))
    high = [F.sum(F.coalesce((F.col("cites") >= F.col(p)).cast("long"), F.lit(0))).alias(p) for p in ("p90", "p99")]
    counts = w.groupBy("person", "year", "cites").agg(F.countDistinct("work").alias("n"), *high)
    start = F.min("year").over(Window.partitionBy("person"))
    spread = counts.withColumn("first_year", start).where(F.col("year") <= last).withColumn("at", F.explode(F.sequence(F.greatest("year", F.lit(first)), F.lit(last))))
    spread = spread.groupBy("person", "at", "cites").agg(F.sum("n").alias("n"), F.sum("p90").alias("p90"), F.sum("p99").alias("p99"), F.min("first_year").alias("first_year"))
    upto = F.sum("n").over(Window.partitionBy("person", "at").orderBy(F.col("cites").desc()).rowsBetween(Window.unboundedPreceding, 0))
    total = spread.withColumn("m", upto).groupBy("person", F.col("at").alias("year")).agg(
        F.nullif(F.max(F.least("cites", "m")), F.lit(0)).cast("long").alias("h_index"), F.sum("n").alias("n_works_cumul"), F.sum(F.col("n") * F.col("cites")).alias("citations_cumul"),
        F.min("first_year").alias("first_year"), F.sum("p90").alias("n_highly_cited"), F.sum("p99").alias("n_highly_cited_p99"),
    )
    by_field = works.where(F.col("year").between(first, last)).groupBy("person", "year", "field").agg(F.countDistinct("work").alias("k"), F.sum("cites").alias("c"))
    that = by_field.groupBy("person", "year").agg(F.sum("k").alias("n_pubs"), F.sum("c").alias("n_citations"), F.min(F.when(F.col("field").isNotNull(), F.struct((-F.col("k")).alias("k"), "field"))).alias("b")).select("person", "year", "n_pubs", "n_citations", F.col("b.field").alias("top_field"))
    return total.join(that, ["person", "year"], "left").withColumn("career_age", F.col("year") - F.col("first_year")).fillna(0, ["n_pubs", "n_citations"])


def collaborations(works: DataFrame, authorships: DataFrame, linked: DataFrame, first: int = 2000, last: int = 2025) -> DataFrame:
    """person, year, country, inst: different works shared with authors that nobody is linked to."""
    mine = works.where(F.col("year").between(first, last)).select("person", "work", "year").distinct()
    others = authorships.where("author is not null and country is not null").join(linked.select("author").distinct(), "author", "left_anti")
    return mine.join(others, "work").groupBy("person", "year", "country", "inst").agg(F.countDistinct("work").alias("n_shared"))


def domain_outliers(works: DataFrame, top: int = 3, share: float = 0.05, least: int = 20) -> DataFrame:
    """person, domain, n: domains outside a person's first `top` with under `share` of at least `least` works."""
    counts = works.groupBy("person", "domain").agg(F.count("*").alias("n"))
    mine = Window.partitionBy("person")
    ranked = counts.withColumn("total", F.sum("n").over(mine)).withColumn("rk", F.row_number().over(mine.orderBy(F.col("n").desc(), "domain")))
    return ranked.where((F.col("total") >= least) & (F.col("rk") > top) & (F.col("n") < share * F.col("total"))).select("person", "domain", "n")


def counters(works: DataFrame, by: str, through: int) -> DataFrame:
    """Works up to a year by one column, with mean citations that ignore nulls."""
    return works.where(F.col("year") <= through).groupBy(by).agg(F.count("*").alias("n"), F.avg("cites").alias("mean_cites"))
