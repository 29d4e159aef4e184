"""Names, cluster refinement, resolution, crosswalk and dossier on small golden cases."""

import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.functions import names as N
from larkspur.operators import clusters, crosswalk, dossier, metrics, resolve
from larkspur.plans import reference
from test_reference import SF, canon


@pytest.mark.parametrize("name", ["split_orcid_conflicts", "reliability_tiers", "rescue_below_threshold", "keyword_assist", "code_vintage", "title_dedup_loose", "duplicate_groups", "order_nulls_last"])
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    cur = con.execute(reference.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    got = reference.queries()[name](spark, SF)
    assert sorted(cols) == sorted(got.columns)
    want = sorted(str([canon(v) for v in r]) for r in cur.fetchall())
    assert want and sorted(str([canon(v) for v in r]) for r in got.select(*cols).collect()) == want


@pytest.mark.parametrize(("name", "want"), [
    ("Dr. Jane Mary van den Berg AO", ("Dr.", "Jane", "Mary", "van den Berg", "AO")),
    ("Smith, John Q.", (None, "John", "Q.", "Smith", None)), ("Anthony Kinloch FRS, FREng", (None, "Anthony", None, "Kinloch", "FRS FREng")), ("Jane Smith FAA", (None, "Jane", None, "Smith", "FAA")),
    ("Plato", (None, "Plato", None, None, None)), ("", (None,) * 5), (None, (None,) * 5),
])
def test_parse(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string").select(N.parse_name("n").alias("p")).select("p.*")
    assert tuple(df.first()) == want


def test_forms(spark):
    df = spark.createDataFrame([("Dr José Ånd Müller",), (None,)], "n string").select(N.strip_diacriticals(F.col("n")).alias("a"), N.spellings(F.col("n")).alias("v"), N.given_names(F.col("n")).alias("g"))
    one, none = df.collect()
    assert one.a == "Dr Jose And Muller" and none.a is None and none.v == [] and none.g.first is None
    assert one.v == ["dr jose aand mueller", "dr jose aand muller", "dr jose and mueller", "dr jose and muller"]
    assert tuple(one.g) == ("jose", "and", "jose and", "j", "a")
    row = spark.range(1).select(N.with_initials(F.array(F.lit("mary"), F.lit("j"))).alias("w"), N.first_initial(F.array(F.lit("j"), F.lit("mary"))).alias("i"), N.first_canonical(F.array(F.lit("j"), F.lit("mary"), F.lit("anne"))).alias("c")).first()
    assert row.w == ["j", "m", "mary"] and row.i == "m" and row.c == "mary"


ITEM = "uid long, cluster long, orcid string, grant string, name_key string, single_org boolean"


def labels(df):
    return {r.uid: r.cluster for r in df.collect()}


def test_merge_split(spark):
    items = spark.createDataFrame([(1, 1, "a", "g1", "s_j", True), (2, 2, "a", "g2", "s_j", True), (3, 2, "b", "g3", "s_j", False), (4, 4, "b", "g3", "t_k", True), (5, 5, None, "g1", "s_j", True), (6, 6, None, None, None, None)], ITEM)
    merged = clusters.merge_by(items, "orcid")
    assert labels(merged) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}
    assert labels(clusters.split_conflicts(merged)) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
    assert labels(clusters.refine(items)) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1, 6: 6}
    assert labels(clusters.refine(items.limit(0))) == {}
    manual = spark.createDataFrame([(2, "g2", "x")], "cluster long, grant string, label string")
    assert labels(clusters.split_manually(items, manual)) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6}


def test_enrich_promote(spark):
    items = spark.createDataFrame([(1, 1, None, "g", "a_b", True), (2, 2, None, "g", "c_d", True), (3, 3, "z", "g", "a_b", True)], ITEM)
    found = spark.createDataFrame([("a_b", "n1", "high"), ("c_d", "n2", "low"), ("c_d", "n3", "au_match")], "name_key string, orcid string, confidence string")
    assert [tuple(r) for r in clusters.enrich(items, found).orderBy("cluster").collect()] == [(1, "n1"), (2, "n3")]
    assert clusters.enrich(items, found, items.select("cluster")).count() == 0
    c = spark.createDataFrame([(1, "a", ["x", "y"], ["x", "y"]), (1, "b", ["x"], ["x", "y"]), (2, "c", ["x"], ["x"]), (3, "d", ["x"], ["x"]), (3, "e", ["x"], ["x"])], "cluster long, orcid string, tokens array<string>, cluster_tokens array<string>")
    assert [tuple(r) for r in clusters.promote(c).collect()] == [(1, "a", 2)]


def test_cascade(spark):
    schema = "arc long, oax long, p double, works long, oax_orcid string, orcid_match boolean, topics array<string>, family string, prefix string, name_ok boolean, single_org boolean, inst_overlap long, field_score long"

    def link(arc, oax, p=0.95, works=10, oax_orcid=None, orcid_match=False, topics=(), family="f", prefix="abc", name_ok=True, single_org=False, inst_overlap=0, field_score=0):
        return (arc, oax, p, works, oax_orcid, orcid_match, list(topics), family, prefix, name_ok, single_org, inst_overlap, field_score)

    rows = [
        link(1, 1), link(2, 1, works=90, oax_orcid="o"), link(2, 2, oax_orcid="o"), link(3, 1, topics="t", works=20), link(3, 2, topics="t"),
        link(4, 1, name_ok=False), link(4, 2), link(5, 1, orcid_match=True), link(5, 2), link(6, 1, single_org=True, inst_overlap=1), link(6, 2, single_org=True),
        link(7, 1, inst_overlap=2), link(7, 2, inst_overlap=1), link(8, 1, field_score=1), link(8, 2), link(9, 1, p=0.99), link(9, 2),
        link(10, 1, works=95), link(10, 2, works=5), link(11, 1), link(11, 2), link(12, 1, topics="t", family="g"), link(12, 2, topics="t"),
    ]
    got = {r.arc: (r.oax, r.resolved_by, r.secondary) for r in resolve.resolved(resolve.cascade(spark.createDataFrame(rows, schema))).collect()}
    by = ["single", "oax_orcid_dedup", "oax_topic_dedup", "name_filter", "orcid", "inst_gate", "inst_overlap", "field", "probability", "works_count"]
    want = {k + 1: (1, b, [2] if k else []) for k, b in enumerate(by)}
    want[4] = (2, "name_filter", [1])
    assert got == want


def test_crosswalk(spark):
    codes = spark.createDataFrame([(1, "0101"), (1, "4605"), (2, "9999"), (3, None)], "k long, code string")
    up = crosswalk.upgrade(codes, spark.createDataFrame([("0101", "4904"), ("0101", "4901")], "old string, new string"))
    assert {(r.k, r.code_2020, r.n_targets) for r in up.collect()} == {(1, "4901", 2), (1, "4605", 0), (2, None, 0), (3, None, 0)}
    known = spark.createDataFrame([("49", "Mathematics", None), ("4605", "Computing", "Data")], "for_code string, field string, subfield string")
    got = {r.k: (r.fields, r.subfields) for r in crosswalk.names_of(up, known, "k").collect()}
    assert got == {1: (["Computing", "Mathematics"], ["Data"]), 2: ([], []), 3: ([], [])}


def test_components_of_supply(spark):
    got = {r.node: r.component for r in reference.components_of_supply(spark, SF).collect()}
    near = defaultdict(set)
    for r in reference.run(spark, SF, reference._EDGES).collect():
        near[r.a].add(r.b)
        near[r.b].add(r.a)
    want = {}
    for n in sorted(near):
        stack = [n] if n not in want else []
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = n
                stack.extend(near[x])
    assert got == want


def test_dossier(spark):
    w = spark.createDataFrame([("p", 1, 2010, 5), ("p", 2, 2012, 9)], "person string, work long, yr int, cites long")
    nested = dossier.dossiers(w, metrics.yearly(w, 2010, 2012))
    row = nested.first()
    assert [x.work for x in row.works] == [2, 1] and row.h_index == 2 and [y.year for y in row.years] == [2010, 2011, 2012]
    assert dossier.markdown(nested).first().text.startswith("# p\n\nWorks: 2; citations: 14; h-index: 2\n")
