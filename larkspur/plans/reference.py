"""Queries over the driver's tables for the relational operators, each with SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import names
from ..operators import clusters, crosswalk, dense, dossier, linkage, metrics, resolve
from ..operators.graph import connected_components

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: works, people and citations from orders and their lines
WORKS = """WITH lines AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
works AS (SELECT o_orderkey AS work, o_custkey AS person, CAST(year(o_orderdate) AS BIGINT) AS yr, CAST(floor(coalesce(q, 0) / 10) AS BIGINT) AS cites, o_orderpriority AS type FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)"""

_spark: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracle: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in TABLES:
        if name in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, WORKS + " SELECT * FROM works")


def both(name: str, sql: str, spark_sql: str | None = None) -> None:
    """A query that is SQL on either side; spark_sql where the dialects differ."""
    _spark[name] = lambda spark, d, q=spark_sql or sql: run(spark, d, q)
    _oracle[name] = sql


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        _spark[f.__name__] = f
        if oracle:
            _oracle[f.__name__] = oracle
        return f

    return add


_YEARLY = WORKS + """, s AS (SELECT person, work, yr, cites, y.year AS year FROM works JOIN (SELECT unnest(generate_series(1995, 2001)) AS year) y ON yr <= y.year),
r AS (SELECT *, row_number() OVER (PARTITION BY person, year ORDER BY cites DESC, work) AS rk FROM s)
SELECT person, year, CAST(max(rk) FILTER (WHERE cites >= rk) AS BIGINT) AS h_index, count(*) AS n_works, CAST(sum(cites) AS BIGINT) AS citations, min(yr) AS first_year, year - min(yr) AS career_age FROM r GROUP BY person, year"""


@query(_YEARLY)
def entry_h_index_yearly(spark: SparkSession, d: str) -> DataFrame:
    return metrics.yearly(works(spark, d), 1995, 2001).withColumn("year", F.col("year").cast("long"))


@query(WORKS + """, r AS (SELECT *, row_number() OVER (PARTITION BY yr, c_nationkey ORDER BY cites DESC, work) AS rk FROM works JOIN customer ON c_custkey = person)
SELECT yr, c_nationkey, CAST(max(rk) FILTER (WHERE cites >= rk) AS BIGINT) AS h FROM r GROUP BY yr, c_nationkey HAVING max(cites) > 0""")
def national_annual_h_index(spark: SparkSession, d: str) -> DataFrame:
    w = works(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("person"), "c_nationkey"), "person")
    return metrics.national_h_index(w, ["yr", "c_nationkey"]).where("h > 0")


_TOPICS = "SELECT l_orderkey AS work, p_brand AS subfield, p_type AS field, l_extendedprice AS score, l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey"


@query(f"SELECT work, subfield, field, score FROM ({_TOPICS}) QUALIFY row_number() OVER (PARTITION BY work ORDER BY score DESC, subfield, field, l_partkey) = 1")
def best_topic_per_work(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_topic(run(spark, d, _TOPICS), "work", "score", ["subfield", "field", "l_partkey"]).select("work", "subfield", "field", "score")


@query(WORKS + " SELECT type, yr, quantile_cont(cites, 0.9) AS p90, quantile_cont(cites, 0.99) AS p99, count(*) AS n FROM works GROUP BY type, yr")
def citation_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.quantiles(works(spark, d), ["type", "yr"])


_CO = """SELECT l_orderkey AS work, CAST(year(o_orderdate) AS BIGINT) AS year, p_type AS subfield, CAST(l_linenumber AS DOUBLE) AS score FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey"""


@query(f"""WITH b AS (SELECT work, year, subfield, sum(score) AS s FROM ({_CO}) GROUP BY ALL), c AS (SELECT *, s / sum(s) OVER (PARTITION BY work) AS share FROM b),
e AS (SELECT work, year, subfield, share / sum(share) OVER (PARTITION BY work) AS share FROM c WHERE share >= 0.1),
p AS (SELECT a.subfield AS lo, z.subfield AS hi, a.year AS year, sum(a.share + z.share) AS w FROM e a JOIN e z ON a.work = z.work AND a.subfield < z.subfield GROUP BY ALL)
SELECT lo, hi, year, round(sum(w) OVER (PARTITION BY lo, hi ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative FROM p""")
def cooccurrence_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cooccurrence(run(spark, d, _CO))


both("highly_cited_backfill", WORKS + """, q AS (SELECT type, yr, quantile_cont(cites, 0.9) AS p90 FROM works GROUP BY type, yr)
SELECT person, count(*) FILTER (WHERE cites >= p90) AS n_highly_cited FROM works JOIN q USING (type, yr) GROUP BY person""", WORKS + """, q AS (SELECT type, yr, percentile(cites, 0.9) AS p90 FROM works GROUP BY type, yr)
SELECT person, count(*) FILTER (WHERE cites >= p90) AS n_highly_cited FROM works JOIN q USING (type, yr) GROUP BY person""")
both("world_annual", WORKS + " SELECT yr, count(*) AS n_works, count(DISTINCT person) AS n_people, CAST(sum(cites) AS BIGINT) AS citations, round(avg(cites), 6) AS mean_cites FROM works GROUP BY yr")
both("primary_flag_dedupe", "SELECT l_orderkey AS work, l_suppkey AS author, bool_or(l_linenumber = 1) AS is_primary, max(l_shipdate) AS latest FROM lineitem GROUP BY l_orderkey, l_suppkey")
both("oeuvre_fetch", WORKS + """, t AS (SELECT l_orderkey AS work, p_brand AS subfield, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, p_brand, l_partkey) AS rk FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT person, works.work AS work, yr, cites, subfield FROM works LEFT JOIN t ON t.work = works.work AND rk = 1""")
both("semi_join_scope", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
both("anti_join_no_lines", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
both("exclusion_counts", """SELECT o_custkey, reason, count(*) AS n FROM (SELECT o_custkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'type_not_allowed' WHEN year(o_orderdate) < 1996 THEN 'implausible_year'
WHEN year(o_orderdate) > 2000 THEN 'future_year' WHEN o_totalprice < 1000 THEN 'missing_doi' END AS reason FROM orders) t WHERE reason IS NOT NULL GROUP BY o_custkey, reason""")


@query("""WITH f AS (SELECT l_orderkey, bool_or(l_discount > 0.09) AS corrupt FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS work, CASE WHEN NULLIF(o_orderstatus, 'P') NOT IN ('F', 'O') THEN 'type_not_allowed' WHEN year(o_orderdate) < 1996 THEN 'implausible_year' WHEN year(o_orderdate) > 2000 THEN 'future_year' WHEN corrupt THEN 'corrupt_authorship' END AS reason
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def stage1_reason_case(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_discount") > 0.09).alias("corrupt"))
    o = table(spark, d, "orders").join(flags, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    kind, year = F.nullif("o_orderstatus", F.lit("P")), F.year("o_orderdate")
    rules = [("type_not_allowed", ~kind.isin("F", "O")), ("implausible_year", year < 1996), ("future_year", year > 2000), ("corrupt_authorship", F.col("corrupt"))]
    return o.select(F.col("o_orderkey").alias("work"), metrics.first_reason(rules).alias("reason"))


both("field_filter_keep", """WITH a AS (SELECT l_orderkey, array_agg(DISTINCT p_type) AS fields FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT o_orderkey AS work, fields IS NULL OR list_has_any(fields, ['ECONOMY', 'PROMO']) AS keep FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""",
"""WITH a AS (SELECT l_orderkey, collect_set(p_type) AS fields FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT o_orderkey AS work, fields IS NULL OR arrays_overlap(fields, array('ECONOMY', 'PROMO')) AS keep FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
both("group_coherence", """WITH t AS (SELECT DISTINCT o_custkey, o_orderstatus, l_orderkey AS work, p_brand AS subfield FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT o_custkey, o_orderstatus, count(DISTINCT work) AS size FROM t GROUP BY o_custkey, o_orderstatus), s AS (SELECT o_custkey, o_orderstatus, subfield, count(DISTINCT work) AS shared FROM t GROUP BY o_custkey, o_orderstatus, subfield)
SELECT work, CASE WHEN max(size) < 3 THEN NULL ELSE bool_or(shared >= 2) END AS coherent FROM t JOIN g USING (o_custkey, o_orderstatus) JOIN s USING (o_custkey, o_orderstatus, subfield) GROUP BY work""")
both("gap_years", "SELECT o_custkey, CAST(max(year(o_orderdate)) - min(year(o_orderdate)) + 1 - count(DISTINCT year(o_orderdate)) AS BIGINT) AS gaps FROM orders GROUP BY o_custkey")
both("accuracy_shared_ids", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) > 1")
both("reconciliation_flags", """SELECT o_orderkey, coalesce(n, 0) AS n_lines, CASE WHEN coalesce(n, 0) = 0 THEN 'under' WHEN n > 7 THEN 'over' ELSE 'ok' END AS flag FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) t ON l_orderkey = o_orderkey""")
both("type_mix_pct", "SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY o_orderpriority",
     "SELECT o_orderpriority, count(*) AS n, round(CAST(100.0 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY o_orderpriority")
both("career_gap_profile", "SELECT gaps, count(*) AS n FROM (SELECT o_custkey, CAST(max(year(o_orderdate)) - min(year(o_orderdate)) + 1 - count(DISTINCT year(o_orderdate)) AS BIGINT) AS gaps FROM orders GROUP BY o_custkey) t GROUP BY gaps")
both("top20_by_citations", WORKS + " SELECT person, CAST(sum(cites) AS BIGINT) AS citations FROM works GROUP BY person ORDER BY citations DESC, person LIMIT 20")
both("h_index_buckets", WORKS + """, r AS (SELECT person, cites, row_number() OVER (PARTITION BY person ORDER BY cites DESC, work) AS rk FROM works), h AS (SELECT person, max(CASE WHEN cites >= rk THEN rk END) AS h FROM r GROUP BY person)
SELECT CASE WHEN h < 3 THEN '0-2' WHEN h < 5 THEN '3-4' WHEN h < 8 THEN '5-7' ELSE '8+' END AS bucket, count(*) AS n, CAST(min(h) AS BIGINT) AS least FROM h GROUP BY 1""")
both("median_trajectory", WORKS + """, a AS (SELECT person, min(yr) AS award FROM works GROUP BY person) SELECT yr - award AS delta, median(cites) AS med, count(DISTINCT person) AS people FROM works JOIN a USING (person) GROUP BY yr - award HAVING count(DISTINCT person) >= 2""")
both("cohort_crosstab", "SELECT coalesce(c_mktsegment, 'Total') AS seg, CAST(yr AS VARCHAR) AS yr, n FROM (SELECT c_mktsegment, year(o_orderdate) AS yr, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY CUBE (c_mktsegment, year(o_orderdate))) t",
     "SELECT coalesce(c_mktsegment, 'Total') AS seg, CAST(yr AS STRING) AS yr, n FROM (SELECT c_mktsegment, year(o_orderdate) AS yr, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY CUBE (c_mktsegment, year(o_orderdate))) t")
both("proportional_projection", "SELECT c_mktsegment, count(*) AS n, CAST(round_even(count(*) * 1000.0 / sum(count(*)) OVER (), 0) AS BIGINT) AS target FROM customer GROUP BY c_mktsegment",
     "SELECT c_mktsegment, count(*) AS n, CAST(bround(CAST(count(*) * 1000.0 AS DOUBLE) / sum(count(*)) OVER (), 0) AS BIGINT) AS target FROM customer GROUP BY c_mktsegment")
both("term_frequency", "SELECT p_brand, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM part), 9) AS tf, round(-ln(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM part)), 6) AS idf FROM part GROUP BY p_brand")
both("idf_six_blocks", """SELECT block, value, round(-ln(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lineitem)), 6) AS idf FROM (SELECT 'coauthor' AS block, CAST(l_suppkey AS VARCHAR) AS value FROM lineitem
UNION ALL SELECT 'field', p_type FROM lineitem JOIN part ON p_partkey = l_partkey UNION ALL SELECT 'subfield', p_brand FROM lineitem JOIN part ON p_partkey = l_partkey
UNION ALL SELECT 'year', CAST(CAST(floor(year(l_shipdate) / 5) * 5 AS BIGINT) AS VARCHAR) FROM lineitem UNION ALL SELECT 'institution', n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT 'topic', CAST(l_partkey AS VARCHAR) FROM lineitem) t GROUP BY block, value""".replace("'year', CAST(CAST(floor(year(l_shipdate) / 5) * 5 AS BIGINT) AS VARCHAR)", "'year', CAST(CAST(floor(year(l_shipdate) / 5) * 5 AS BIGINT) AS VARCHAR)"))
_spark["idf_six_blocks"] = lambda spark, d: run(spark, d, _oracle["idf_six_blocks"].replace("VARCHAR", "STRING"))
both("field_distribution_struct", """WITH c AS (SELECT l_suppkey AS author, p_type AS field, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, p_type),
f AS (SELECT author, field, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY author), 6) AS share, n FROM c) SELECT author, list(field ORDER BY n DESC, field)[1:3] AS top_fields, max(share) AS top_share FROM f GROUP BY author""",
"""WITH c AS (SELECT l_suppkey AS author, p_type AS field, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, p_type),
f AS (SELECT author, field, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY author), 6) AS share, n FROM c) SELECT author, transform(slice(array_sort(collect_list(struct(-n AS a, field))), 1, 3), x -> x.field) AS top_fields, max(share) AS top_share FROM f GROUP BY author""")
both("json_props", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2", "SELECT event_type, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " ")).alias("plain"))


@query("SELECT source AS person, lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) AS k, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def title_dedup_loose(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "documents").select(F.col("source").alias("person"), T.loose_title_key(F.col("text")).alias("k"), "doc_id")
    return k.groupBy("person", "k").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""WITH k AS (SELECT source AS person, doc_id AS work, CAST(doc_id % 7 + 2000 AS BIGINT) AS yr, n_chars AS cites, lang, lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) AS t, length(text) AS len FROM documents),
g AS (SELECT person, work, lang, min(yr) OVER w AS year, CAST(sum(cites) OVER w AS BIGINT) AS cites, CASE WHEN len >= 20 THEN t ELSE CAST(work AS VARCHAR) END AS k FROM k WINDOW w AS (PARTITION BY person, CASE WHEN len >= 20 THEN t ELSE CAST(work AS VARCHAR) END))
SELECT person, work, year, cites, k FROM g QUALIFY row_number() OVER (PARTITION BY person, k ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, work) = 1""")
def title_dedup(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select(F.col("source").alias("person"), F.col("doc_id").alias("work"), (F.col("doc_id") % 7 + 2000).alias("yr"), F.col("n_chars").alias("cites"), "lang", F.col("text").alias("title"))
    w = w.withColumnRenamed("yr", "year")
    return metrics.title_dedup(w, T.loose_title_key(F.col("title")), F.when(F.col("lang") == "en", 0).otherwise(1))


_EDGES = "SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem"


@query()  # a recursive query over the whole table is too slow; tested against a plain search
def components_of_supply(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(run(spark, d, _EDGES))


@query("""WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm, label FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (a.norm * b.norm), 6) AS distance FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (a.norm * b.norm), 6) <= 0.75""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dense.pairs(table(spark, d, "embeddings"), 0.75)


@query()
def dbscan_piles(spark: SparkSession, d: str) -> DataFrame:
    """With two as the least neighbourhood, density clusters are components of close pairs; alone is -1."""
    pile = connected_components(dense.links(table(spark, d, "embeddings"), 0.75))
    v = table(spark, d, "embeddings").select("vec_id")
    return v.join(pile, v.vec_id == pile.node, "left").select("vec_id", F.coalesce("component", F.lit(-1).cast("long")).alias("pile"))


def _people(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.concat(F.lit("f"), F.col("c_custkey") % 300).alias("family"), F.substring("c_mktsegment", 1, 1).alias("initial"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") % 400).alias("orcid"), F.col("c_nationkey").alias("institution"))
    return c


@query("""WITH p AS (SELECT c_custkey AS uid, 'f' || (c_custkey % 300) AS family, substr(c_mktsegment, 1, 1) AS initial, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 400 END AS orcid FROM customer)
SELECT a.uid AS l, b.uid AS r FROM p a JOIN p b ON a.uid < b.uid AND ((a.family = b.family AND a.initial = b.initial) OR a.orcid = b.orcid)""")
def blocking_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = _people(spark, d)
    return linkage.candidates(p, p, [["family", "initial"], ["orcid"]]).select(F.col("l.uid").alias("l"), F.col("r.uid").alias("r"))


def _levels() -> dict:
    same = lambda c: F.col(f"l.{c}") == F.col(f"r.{c}")
    null = lambda c: F.col(f"l.{c}").isNull() | F.col(f"r.{c}").isNull()
    return {c: linkage.level(null(c), same(c)) for c in ("family", "initial", "orcid", "institution")}


U = {"family": {1: 0.004, 0: 0.996}, "initial": {1: 0.2, 0: 0.8}, "orcid": {1: 0.003, 0: 0.997}, "institution": {1: 0.04, 0: 0.96}}
M = {"family": {1: 0.9, 0: 0.1}, "initial": {1: 0.95, 0: 0.05}, "orcid": {1: 0.85, 0: 0.15}, "institution": {1: 0.6, 0: 0.4}}


@query("""WITH p AS (SELECT c_custkey AS uid, 'f' || (c_custkey % 300) AS family, substr(c_mktsegment, 1, 1) AS initial, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 400 END AS orcid, c_nationkey AS inst FROM customer),
c AS (SELECT a.uid AS l, b.uid AS r, log2(0.001 / 0.999) + CASE WHEN a.family = b.family THEN log2(0.9 / 0.004) ELSE log2(0.1 / 0.996) END + CASE WHEN a.initial = b.initial THEN log2(0.95 / 0.2) ELSE log2(0.05 / 0.8) END
+ CASE WHEN a.orcid IS NULL OR b.orcid IS NULL THEN 0 WHEN a.orcid = b.orcid THEN log2(0.85 / 0.003) ELSE log2(0.15 / 0.997) END + CASE WHEN a.inst = b.inst THEN log2(0.6 / 0.04) ELSE log2(0.4 / 0.96) END AS w
FROM p a JOIN p b ON a.uid < b.uid AND ((a.family = b.family AND a.initial = b.initial) OR a.orcid = b.orcid)) SELECT l, r, round(w, 6) AS weight, round(1 / (1 + pow(2.0, -w)), 6) AS probability FROM c""")
def fs_score_fixed_weights(spark: SparkSession, d: str) -> DataFrame:
    p = _people(spark, d)
    scored = linkage.score(linkage.candidates(p, p, [["family", "initial"], ["orcid"]]), _levels(), M, U, 0.001)
    return scored.select(F.col("l.uid").alias("l"), F.col("r.uid").alias("r"), F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))


@query()
def fs_em_training(spark: SparkSession, d: str) -> DataFrame:
    p = _people(spark, d)
    levels = _levels()
    rows = [r.asDict() for r in linkage.patterns(linkage.candidates(p, p, [["family", "initial"], ["orcid"]]), levels).collect()]
    prior, m = linkage.em(rows, list(levels), U, 0.1)
    return spark.createDataFrame([("prior", 0, prior)] + [(c, k, v) for c in m for k, v in m[c].items()], "comparison string, level int, m double")


@query("""WITH l AS (SELECT l_orderkey AS arc, l_suppkey AS oax, sum(l_quantity) AS p, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey), r AS (SELECT *, max(p) OVER (PARTITION BY arc) AS top, count(*) OVER (PARTITION BY arc) AS k FROM l),
t AS (SELECT *, sum(CASE WHEN p = top THEN 1 ELSE 0 END) OVER (PARTITION BY arc) AS tops, sum(p) OVER (PARTITION BY arc) AS total FROM r)
SELECT arc, oax, CASE WHEN k = 1 THEN 'single' WHEN p > 0.7 * total THEN 'dominance' ELSE 'max_p' END AS resolved_by FROM t WHERE p = top AND tops = 1""")
def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("arc"), F.col("l_suppkey").alias("oax")).agg(F.sum("l_quantity").alias("p"))
    w = Window.partitionBy("arc")
    t = links.withColumn("k", F.count("*").over(w)).withColumn("top", F.max("p").over(w)).withColumn("total", F.sum("p").over(w)).withColumn("tops", F.sum((F.col("p") == F.col("top")).cast("int")).over(w))
    step = F.when(F.col("k") == 1, "single").when(F.col("p") > 0.7 * F.col("total"), "dominance").otherwise("max_p")
    return t.where("p = top and tops = 1").select("arc", "oax", step.alias("resolved_by"))


both("points_scoring", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 45 ELSE 0 END + CASE WHEN n_regionkey = 1 THEN 25 ELSE 15 END AS points FROM customer JOIN nation ON n_nationkey = c_nationkey",
     "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 45 ELSE 0 END + CASE WHEN n_regionkey = 1 THEN 25 ELSE 15 END AS points FROM customer JOIN nation ON n_nationkey = c_nationkey")
both("duplicate_groups", "SELECT text, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
both("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
both("order_nulls_last", "SELECT d.doc_id AS doc_id, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY toxic DESC NULLS LAST, d.doc_id")
both("modal_type", "SELECT o_custkey, o_orderpriority AS top FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rk FROM orders GROUP BY o_custkey, o_orderpriority) t WHERE rk = 1")
both("latest_year_scalar", "SELECT count(*) AS n, CAST(max(year(o_orderdate)) AS BIGINT) AS yr FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items: customers as clusters, the clerk's share as an ORCID that some rows lack."""
    return run(spark, d, _ITEMS)


_ITEMS = """SELECT o_orderkey AS uid, o_custkey AS cluster, CASE WHEN o_orderstatus = 'F' THEN o_custkey * 10 + month(o_orderdate) % 2 END AS orcid, o_orderkey % 1000 AS grant, concat('n', o_custkey % 50) AS name_key, o_orderpriority = '1-URGENT' AS single_org FROM orders"""


@query(f"""WITH i AS ({_ITEMS}), c AS (SELECT cluster, min(orcid) < max(orcid) AS two FROM i GROUP BY cluster)
SELECT uid, coalesce(CASE WHEN two THEN min(uid) OVER (PARTITION BY i.cluster, coalesce(concat('k', CAST(orcid AS VARCHAR)), '') || CASE WHEN orcid IS NULL THEN concat('u', CAST(uid AS VARCHAR)) ELSE '' END) END, i.cluster) AS cluster FROM i JOIN c ON c.cluster = i.cluster""".replace("concat('k', CAST(orcid AS VARCHAR))", "'k' || CAST(orcid AS VARCHAR)"))
def split_orcid_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return clusters.split_conflicts(_items(spark, d)).select("uid", "cluster")


@query()
def refine_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.refine(_items(spark, d)).select("uid", "cluster")


@query(f"""WITH i AS ({_ITEMS}), c AS (SELECT cluster, count(*) AS n_items, count(DISTINCT grant) AS n_grants, count(DISTINCT orcid) AS k FROM i GROUP BY cluster)
SELECT cluster, n_items, n_grants, CASE k WHEN 0 THEN 'NO_ORCID' WHEN 1 THEN 'HAS_ORCID' ELSE 'MULTI_ORCID' END AS orcid_status, CASE WHEN k > 0 THEN '1a' WHEN n_grants >= 2 THEN '3' WHEN n_items > 1 THEN '4u' ELSE '4' END AS tier FROM c""")
def reliability_tiers(spark: SparkSession, d: str) -> DataFrame:
    c = clusters.aggregate(_items(spark, d)).withColumn("events", F.array().cast("array<string>")).withColumn("tf", F.lit(None).cast("double")).withColumn("has_gap", F.col("n_items") > 1)
    return c.select("cluster", "n_items", "n_grants", "orcid_status", clusters.reliability().alias("tier"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, """SELECT l_orderkey AS arc, l_suppkey AS oax, max(l_quantity) AS p, max(l_partkey) AS works, max(l_suppkey) % 7 AS oax_orcid, bool_or(l_returnflag = 'A') AS orcid_match,
collect_set(l_linestatus) AS topics, concat('f', l_suppkey % 3) AS family, CASE WHEN l_suppkey % 2 = 0 THEN 'abc' END AS prefix, bool_or(l_shipdate > '1995-01-01') AS name_ok, bool_or(l_tax > 0.04) AS single_org,
count(*) AS inst_overlap, max(l_linenumber) % 3 AS field_score FROM lineitem GROUP BY l_orderkey, l_suppkey""")


@query()
def resolve_all_steps(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolved(resolve.cascade(_links(spark, d)))


@query("""WITH l AS (SELECT l_orderkey AS arc, l_suppkey AS oax, max(l_quantity) / 50.0 AS p, bool_or(l_returnflag = 'N') AS ok FROM lineitem GROUP BY l_orderkey, l_suppkey),
t AS (SELECT *, max(p) OVER (PARTITION BY arc) AS best FROM l), k AS (SELECT *, max(p) OVER (PARTITION BY arc) AS top FROM t WHERE best < 0.9 AND ok AND p >= 0.7)
SELECT arc, min(oax) AS oax, max(p) AS p FROM k WHERE p = top GROUP BY arc HAVING count(*) = 1""")
def rescue_below_threshold(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("arc"), F.col("l_suppkey").alias("oax")).agg((F.max("l_quantity").cast("double") / 50.0).alias("p"), F.bool_or(F.col("l_returnflag") == "N").alias("name_ok"))
    return resolve.rescue(links)


@query("""WITH s AS (SELECT l_orderkey AS arc, l_suppkey AS oax, CAST(max(l_discount) AS DOUBLE) AS score FROM lineitem GROUP BY l_orderkey, l_suppkey),
r AS (SELECT *, row_number() OVER w AS rk, coalesce(lead(score) OVER w, 0.0) AS second FROM s WINDOW w AS (PARTITION BY arc ORDER BY score DESC, oax))
SELECT arc, oax, score FROM r WHERE rk = 1 AND score >= 0.05 AND score - second >= 0.035""")
def keyword_assist(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("arc"), F.col("l_suppkey").alias("oax")).agg(F.max("l_discount").cast("double").alias("score"))
    return resolve.keyword_assist(s, 0.05, 0.035)


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 22 THEN '2008' WHEN p_size BETWEEN 30 AND 50 THEN '2020' END AS vintage FROM part")
def code_vintage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", crosswalk.vintage(F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("vintage"))


@query()
def person_dossiers(spark: SparkSession, d: str) -> DataFrame:
    return dossier.markdown(dossier.dossiers(works(spark, d), metrics.yearly(works(spark, d), 1995, 2001)))


@query()
def parsed_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.regexp_replace("c_name", "#", " ").alias("name"))
    return c.select("c_custkey", names.parse_name("name").alias("p"), names.given_names(F.col("name")).alias("g")).select("c_custkey", "p.first", "p.last", "g.f_init")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_spark)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)
