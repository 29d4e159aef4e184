"""Which author a person with several probable links is: narrowing steps as windows over one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DOMINANT = 0.7


def _arc() -> WindowSpec:
    return Window.partitionBy("arc")


def _narrow(df: DataFrame, keep: Column, label: str) -> DataFrame:
    """Unsettled persons lose the links that keep is not true for; one link left settles them under label."""
    df = df.withColumn("alive", F.col("alive") & (F.col("by").isNotNull() | F.coalesce(keep, F.lit(False))))
    left = F.count_if("alive").over(_arc())
    return df.withColumn("by", F.when(F.col("by").isNull() & (left == 1), F.lit(label)).otherwise(F.col("by")))


def _of_alive(c: str) -> Column:
    return F.when(F.col("alive"), F.col(c))


def _topic_secondary(df: DataFrame) -> DataFrame:
    """arc, oax of links that share a topic with a compatible name of more works."""
    t = df.where("alive and by is null").select("arc", "oax", "works", "orcid_match", "family", "prefix", F.explode(F.array_distinct("topics")).alias("topic"))
    w = Window.partitionBy("arc", "topic")
    alike = (F.min("family").over(w) == F.max("family").over(w)) & F.coalesce(F.min("prefix").over(w) == F.max("prefix").over(w), F.lit(True))
    ranked = t.withColumn("alike", alike).withColumn("rk", F.row_number().over(w.orderBy(F.col("works").desc(), "oax")))
    return ranked.where("alike and rk > 1 and not orcid_match").select("arc", "oax").distinct().withColumn("secondary", F.lit(True))


def cascade(links: DataFrame) -> DataFrame:
    """links with alive and resolved_by: arc, oax, p, works, oax_orcid, orcid_match, topics, family, prefix,
    name_ok, single_org, inst_overlap, field_score. A person is resolved where resolved_by is not null, by the
    link that is alive; the others of the person are secondary. Null resolved_by: deferred. prefix: the first
    three letters of the first name, null if it is shorter.
    """
    df = links.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("orcid_match", "name_ok", "single_org")} | {c: F.coalesce(c, F.lit(0)) for c in ("works", "inst_overlap", "field_score")})
    df = df.withColumn("alive", F.lit(True)).withColumn("by", F.when(F.count("*").over(_arc()) == 1, "single"))
    same = Window.partitionBy("arc", "oax_orcid")
    top, total = F.max("works").over(same), F.sum("works").over(same)
    df = _narrow(df, F.col("oax_orcid").isNull() | (F.col("works") == top) | (top <= DOMINANT * total), "oax_orcid_dedup")
    df = df.join(_topic_secondary(df), ["arc", "oax"], "left")
    df = _narrow(df, F.col("secondary").isNull(), "oax_topic_dedup").drop("secondary")
    any_ok = F.bool_or(_of_alive("name_ok")).over(_arc())
    df = _narrow(df, F.col("name_ok") | ~F.coalesce(any_ok, F.lit(False)), "name_filter")
    one = F.count_if(F.col("alive") & F.col("orcid_match")).over(_arc()) == 1
    df = _narrow(df, F.col("orcid_match") | ~one, "orcid")
    most = F.max(_of_alive("inst_overlap")).over(_arc())
    df = _narrow(df, ~F.col("single_org") | (most == 0) | (F.col("inst_overlap") > 0), "inst_gate")
    # what follows chooses among the links without striking any: a person not settled keeps them all
    df = df.withColumn("pool", F.col("alive") & F.col("by").isNull()).withColumn("most", F.max(F.when(F.col("pool"), F.col("inst_overlap"))).over(_arc()))
    df = df.withColumn("pool", F.col("pool") & (F.col("inst_overlap") == F.col("most")))
    of_pool = lambda c: F.when(F.col("pool"), F.col(c))
    df = df.withColumn("fs_hi", F.max(of_pool("field_score")).over(_arc())).withColumn("fs_lo", F.min(of_pool("field_score")).over(_arc()))
    by_field = (F.col("fs_hi") >= 1) & (F.col("fs_lo") == 0)
    df = df.withColumn("pool", F.col("pool") & (~by_field | (F.col("field_score") == F.col("fs_hi"))))
    df = df.withColumn("pool", F.col("pool") & (F.col("p") == F.max(of_pool("p")).over(_arc()))).withColumn("n", F.count_if("pool").over(_arc()))
    df = df.withColumn("w_hi", F.max(of_pool("works")).over(_arc())).withColumn("w_all", F.sum(of_pool("works")).over(_arc()))
    works = (F.col("n") > 1) & (F.col("w_hi") > DOMINANT * F.col("w_all"))
    label = F.when(F.col("n") == 1, F.when(by_field, "field").when(F.col("most") > 0, "inst_overlap").otherwise("probability")).when(works, "works_count")
    df = df.withColumn("late", F.when(F.col("by").isNull(), label))
    chosen = F.when(F.col("late").isNull(), F.col("alive")).otherwise(F.col("pool") & ((F.col("n") == 1) | (F.col("works") == F.col("w_hi"))))
    return df.withColumn("alive", chosen).withColumn("resolved_by", F.coalesce("by", "late")).select(*links.columns, "alive", "resolved_by")


def resolved(decided: DataFrame) -> DataFrame:
    """arc, oax, p, resolved_by, secondary (sorted ids) of the persons that cascade() settled."""
    rows = decided.where("resolved_by is not null")
    return rows.groupBy("arc", "resolved_by").agg(F.max(F.when(F.col("alive"), F.col("oax"))).alias("oax"), F.max(F.when(F.col("alive"), F.col("p"))).alias("p"), F.array_sort(F.collect_set(F.when(~F.col("alive"), F.col("oax")))).alias("secondary"))


def rescue(links: DataFrame, low: float = 0.7, high: float = 0.9) -> DataFrame:
    """Persons with no link of high probability: the single most probable compatible link from low on."""
    none = links.groupBy("arc").agg(F.max("p").alias("best")).where(F.col("best") < high).select("arc")
    ok = links.join(none, "arc").where(F.col("name_ok") & (F.col("p") >= low)).withColumn("top", F.max("p").over(_arc()))
    return ok.where("p = top").groupBy("arc").agg(F.min("oax").alias("oax"), F.max("p").alias("p"), F.count("*").alias("n")).where("n = 1").drop("n")


def keyword_assist(scores: DataFrame, least: float = 0.10, gap: float = 0.08) -> DataFrame:
    """arc, oax, score: the best link if it scores enough and enough more than the second."""
    w = _arc().orderBy(F.col("score").desc(), "oax")
    ranked = scores.withColumn("rk", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return ranked.where((F.col("rk") == 1) & (F.col("score") >= least) & (F.col("score") - F.col("second") >= gap)).select("arc", "oax", "score")


def with_certain(links: DataFrame, same_orcid: DataFrame) -> DataFrame:
    """links (arc, oax, p) and the pairs of one ORCID that they lack, at probability 1."""
    more = same_orcid.select("arc", "oax").distinct().join(links, ["arc", "oax"], "left_anti").withColumn("p", F.lit(1.0))
    return links.unionByName(more.select("arc", "oax", "p"))


def candidates(links: DataFrame, least: float = 0.5) -> DataFrame:
    """arc and the sorted authors that reach the least probability."""
    return links.where(F.col("p") >= least).groupBy("arc").agg(F.array_sort(F.collect_set("oax")).alias("candidates"))


def dedupe_candidates(links: DataFrame, unlinked: DataFrame | None = None, dominant: float = DOMINANT) -> DataFrame:
    """links (arc, oax, works, orcid, topics, name) without those that another of the same person stands for.

    Unlinked pairs go. Of links with one ORCID, one with over `dominant` of their works stays alone. Of links that
    share a topic and a name, those with the most works stay; a link with an ORCID is not dropped by topic.
    """
    if unlinked is not None:
        links = links.join(unlinked.select("arc", "oax"), ["arc", "oax"], "left_anti")
    own = Window.partitionBy("arc", "orcid")
    top = F.max("works").over(own)
    links = links.withColumn("_gone", F.col("orcid").isNotNull() & (top > dominant * F.sum("works").over(own)) & (F.col("works") < top)).where("not _gone").drop("_gone")
    each = links.where("orcid is null").select("arc", "oax", "works", "name", F.explode(F.array_distinct("topics")).alias("topic"))
    every = links.select("arc", "oax", "works", "name", F.explode(F.array_distinct("topics")).alias("topic"))
    best = every.groupBy("arc", "topic", "name").agg(F.max(F.struct("works", -F.col("oax"))).alias("_best"))
    gone = each.join(best, ["arc", "topic", "name"]).where(F.struct("works", -F.col("oax")) < F.col("_best")).select("arc", "oax").distinct()
    return links.join(gone, ["arc", "oax"], "left_anti")


def by_hand(resolved_rows: DataFrame, chosen: DataFrame, unlinked: DataFrame) -> DataFrame:
    """resolved rows (arc, oax, resolved_by) with pairs unlinked by hand taken out, and those chosen by hand in place of any other."""
    kept = resolved_rows.join(unlinked.select("arc", "oax"), ["arc", "oax"], "left_anti").join(chosen.select("arc").distinct(), "arc", "left_anti")
    return kept.select("arc", "oax", "resolved_by").unionByName(chosen.select("arc", "oax", F.lit("manual").alias("resolved_by")))


def keyword_overlap(people: DataFrame, authors: DataFrame) -> DataFrame:
    """arc, oax, score: Jaccard of a person's and an author's words (arc, oax, words on either side, met by arc)."""
    from ..functions.similarity import jaccard

    return people.select("arc", F.col("words").alias("_own")).join(authors, "arc").select("arc", "oax", jaccard(F.col("_own"), F.col("words")).alias("score"))


def search_result(found: Column, n_own: Column, any_institution: Column) -> Column:
    """Confidence of a search by name (found: hits; n_own: hits of the country; any_institution: one institution gave exactly one hit)."""
    return F.when(any_institution, "institution_match").when(found > 10, "too_common").when(found == 1, "high").when((found > 1) & (n_own == 1), "au_match").when(found > 1, "low").otherwise("not_found")
