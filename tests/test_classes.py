"""Classes of equal people in place of the people: the same pairs, scores and clusters."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import clusters, linkage


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(linkage, "MEMBERS", 3)
    monkeypatch.setattr(linkage, "CLASSES", 2)
    monkeypatch.setattr(linkage, "PARTS", 3)


def test_classes_give_all_pairs_and_clusters(spark, small):
    """Levels here depend on the side, nulls never meet, and one class falls into several rows."""
    rows = [(k, f"f{k % 3}" if k % 7 else None, k % 5, None if k % 4 else f"o{k % 6}") for k in range(60)] + [(100 + k, "f1", 9, None) for k in range(8)]
    p = spark.createDataFrame(rows, "uid long, family string, age long, orcid string")
    rules, by = [["family"], ["orcid"]], ["family", "age", "orcid"]
    levels = {"age": linkage.level(F.col("l.age").isNull(), F.col("l.age") < F.col("r.age"))}
    m, u = {"age": {1: 0.9, 0: 0.1}}, {"age": {1: 0.1, 0: 0.9}}
    flat = linkage.score(linkage.candidates(p, p, rules), levels, m, u, 0.5)
    c = linkage.packed(p, by)
    assert c.agg(F.sum(F.size("_uids"))).first()[0] == 68 and c.agg(F.max(F.size("_uids"))).first()[0] < 8
    scored = linkage.score(linkage.class_candidates(c, c, rules), levels, m, u, 0.5)
    want = sorted((r.l.uid, r.r.uid, r.weight) for r in flat.collect())
    assert sorted(map(tuple, linkage.expanded(scored.select("l", "r", "weight")).collect())) == want
    assert sorted(map(tuple, linkage.clustered_classes(p, c, scored, 0.5).collect())) == sorted(map(tuple, linkage.clustered(p, flat, 0.5).collect()))
    even, odd = p.where("uid % 2 = 0"), p.where("uid % 2 = 1")
    apart = linkage.expanded(linkage.class_candidates(linkage.packed(even, by), linkage.packed(odd, by), rules), dedupe=False)
    assert sorted(map(tuple, apart.collect())) == sorted((r.l.uid, r.r.uid) for r in linkage.candidates(even, odd, rules, dedupe=False).collect())


def test_few_rows_meet_when_many_people_are_equal(spark):
    people = spark.range(2000).selectExpr("id AS uid", "'f' AS family", "array('ann') AS firsts", "array('x') AS fields", "array('o') AS orcids")
    assert linkage.packed(people, ["family", "firsts", "fields", "orcids"]).count() <= 8
    assert clusters.gap_candidates(people.where("uid < 600")).count() == 600 * 599 // 2


def test_gap_candidates_with_several_shared_initials(spark, small):
    rows = [(k, f"f{k % 2}", [["ann", "bo"], ["b", "a"], ["bob"], ["ann"], []][k % 5], ["x"] if k % 3 else ["y", "x"], [[], ["o"], ["q"]][k % 4 % 3]) for k in range(40)]
    p = spark.createDataFrame(rows, "uid long, family string, firsts array<string>, fields array<string>, orcids array<string>")
    fit = lambda a, b: any(x == y or (len(x) == 1 and y.startswith(x)) or (len(y) == 1 and x.startswith(y)) for x in a for y in b)
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and fit(a[2], b[2]) and set(a[3]) & set(b[3]) and not (a[4] and b[4] and not set(a[4]) & set(b[4]))]
    assert sorted(map(tuple, clusters.gap_candidates(p).collect())) == sorted(want)
