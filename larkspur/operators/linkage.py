"""Probabilistic record linkage after Fellegi and Sunter: blocking, comparison levels, EM, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _checkpointed, connected_components, reduced

MEMBERS = 512  # of a class in one row
CLASSES = 512  # rows of a block that each row of one part meets
PARTS = 48  # tasks that pairs of classes are dealt over: their number says little about their bytes, by which Spark would gather them


def candidates(left: DataFrame, right: DataFrame, rules: list[list[str]], uid: str = "uid", dedupe: bool = True) -> DataFrame:
    """Pairs (l, r structs) that agree on all columns of some rule, each pair once: a rule leaves out pairs of earlier ones."""
    a, b = left.select(F.struct(*left.columns).alias("l")), right.select(F.struct(*right.columns).alias("r"))
    out = None
    for k, rule in enumerate(rules):
        on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in rule]
        pairs = a.join(b, on)
        for earlier in rules[:k]:
            same = F.lit(True)
            for c in earlier:
                same &= F.coalesce(F.col(f"l.{c}") == F.col(f"r.{c}"), F.lit(False))
            pairs = pairs.where(~same)
        if dedupe:
            pairs = pairs.where(F.col(f"l.{uid}") < F.col(f"r.{uid}"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def packed(people: DataFrame, by: list[str], uid: str = "uid") -> DataFrame:
    """People that are equal in all columns of `by` as one row with their sorted uids; classes of very many fall into several rows."""
    one = people.select(uid, *by)
    large = one.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > MEMBERS).select(*[F.col(c).alias(f"_of_{c}") for c in by], "_n")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    dealt = one.join(F.broadcast(large), same, "left").withColumn("_chunk", F.coalesce(F.pmod(F.xxhash64(uid), F.ceil(F.col("_n") / MEMBERS)), F.lit(0)))
    return dealt.groupBy(*by, "_chunk").agg(F.sort_array(F.collect_list(uid)).alias("_uids")).drop("_chunk")


def meeting(left: DataFrame, right: DataFrame, rule: list[str]) -> DataFrame:
    """Pairs (l, r structs) that agree on all columns of the rule; a block of many rows is dealt over tasks, its right side to each of them."""
    sizes = right.dropna(subset=rule).groupBy(*rule).agg(F.count("*").alias("_n")).where(F.col("_n") > CLASSES)
    hot = F.broadcast(sizes.select(*rule, F.ceil(F.col("_n") / CLASSES).cast("int").alias("_parts")))
    many, key = F.coalesce("_parts", F.lit(1)), [*rule, "_part"]
    a = left.dropna(subset=rule).join(hot, rule, "left").withColumn("_part", F.pmod(F.xxhash64(F.col("_uids")[0]), many).cast("int"))
    b = right.dropna(subset=rule).join(hot, rule, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1)))
    sides = [x.select(*[F.col(c).alias(f"{side}_{c}") for c in key], F.struct(*y.columns).alias(side)).repartition(PARTS, *[f"{side}_{c}" for c in key]) for side, x, y in (("l", a, left), ("r", b, right))]
    on = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in key]
    return sides[0].join(sides[1].hint("merge"), on).select("l", "r")


def class_candidates(left: DataFrame, right: DataFrame, rules: list[list[str]]) -> DataFrame:
    """candidates() of rows from packed(): each class with each, itself too, and both ways, as levels may depend on the side."""
    out = None
    for k, rule in enumerate(rules):
        pairs = meeting(left, right, rule)
        for earlier in rules[:k]:
            same = F.lit(True)
            for c in earlier:
                same &= F.coalesce(F.col(f"l.{c}") == F.col(f"r.{c}"), F.lit(False))
            pairs = pairs.where(~same)
        out = pairs if out is None else out.unionByName(pairs)
    return out


def expanded(pairs: DataFrame, a: str = "l", b: str = "r", dedupe: bool = True) -> DataFrame:
    """Pairs of classes with other columns beside l and r as pairs of their members, a < b if it is one set of people."""
    rest = [c for c in pairs.columns if c not in ("l", "r")]
    one = pairs.select(F.col("l._uids").alias("_x"), F.col("r._uids").alias("_y"), *rest)
    one = one.where(F.col("_x")[0] < F.element_at("_y", -1)) if dedupe else one
    met = one.select(F.explode("_x").alias(a), "_y", *rest).select(a, F.explode("_y").alias(b), *rest)
    return met.where(F.col(a) < F.col(b)) if dedupe else met


def level(*conditions: Column) -> Column:
    """The number of the first condition that holds, counted down; 0 if none does, -1 if a side is null (first condition)."""
    null, *rest = conditions
    out = F.when(null, -1)
    for k, c in enumerate(rest):
        out = out.when(c, len(rest) - k)
    return out.otherwise(0)


def patterns(pairs: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """Counts of comparison vectors: a few hundred rows whatever the number of pairs."""
    return pairs.select(*[v.alias(k) for k, v in levels.items()]).groupBy(*levels).agg(F.count("*").alias("n"))


def em(rows: list[dict], names: list[str], u: dict[str, dict[int, float]], prior: float, rounds: int = 25, fixed: dict[str, dict[int, float]] | None = None) -> tuple[float, dict[str, dict[int, float]]]:
    """m probabilities and the match share from vector counts, with u fixed.

    Comparisons in `fixed` keep the m given there and take no part in the training: those of columns that
    the pairs were blocked on.
    """
    fixed = fixed or {}
    given, names = names, [c for c in names if c not in fixed]
    m = {c: {k: 0.9 if k == max(u[c]) else 0.1 / max(1, len(u[c]) - 1) for k in u[c]} for c in names}
    for _ in range(rounds):
        acc = {c: dict.fromkeys(u[c], 1e-9) for c in names}
        match = total = 0.0
        for r in rows:
            a, b = prior, 1 - prior
            for c in names:
                if r[c] >= 0:
                    a *= m[c][r[c]]
                    b *= u[c][r[c]]
            p = a / (a + b) if a + b else 0.0
            match += p * r["n"]
            total += r["n"]
            for c in names:
                if r[c] >= 0:
                    acc[c][r[c]] += p * r["n"]
        prior = min(0.999, max(1e-9, match / max(total, 1)))
        m = {c: {k: v / sum(acc[c].values()) for k, v in acc[c].items()} for c in names}
    return prior, {c: fixed.get(c) or m[c] for c in given}


def shared_level(a: Column, b: Column, *least: int) -> Column:
    """For arrays: len(least) if they share at least least[0] elements, and so on down; -1 if either is null or empty."""
    n = F.size(F.array_intersect(a, b))
    return level(F.coalesce(F.size(a), F.lit(0)).isin(0, -1) | F.coalesce(F.size(b), F.lit(0)).isin(0, -1), *[n >= k for k in least])


def given_name_level(a: str = "l", b: str = "r") -> Column:
    """Seven levels of first, middle and compound: compound; first; first against middle, either way; both initials; first initial of a bare one; first initial; else."""
    c = lambda side, name: F.col(f"{side}.{name}")
    initial = lambda side, name: F.substring(c(side, name), 1, 1)
    cross = (c(a, "first") == c(b, "middle")) | (c(a, "middle") == c(b, "first"))
    firsts = initial(a, "first") == initial(b, "first")
    bare = (F.length(c(a, "first")) == 1) | (F.length(c(b, "first")) == 1)
    return level(
        c(a, "first").isNull() | c(b, "first").isNull(), (c(a, "middle").isNotNull()) & (c(a, "compound") == c(b, "compound")), c(a, "first") == c(b, "first"), F.coalesce(cross, F.lit(False)),
        F.coalesce(firsts & bare & (initial(a, "middle") == initial(b, "middle")), F.lit(False)), firsts & bare, firsts,
    )


def with_frequencies(people: DataFrame, columns: list[str]) -> DataFrame:
    """people with tf_<column>: the share of non-null values that equal theirs."""
    for c in columns:
        counts = people.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"))
        total = people.agg(F.count(c)).first()[0]
        people = people.join(counts, c, "left").withColumn(f"tf_{c}", F.col("_n") / float(max(1, total))).drop("_n")
    return people


def estimate_u(people: DataFrame, levels: dict[str, Column], kinds: dict[str, list[int]], most: int = 1_000_000, seed: int = 42, uid: str = "uid") -> dict[str, dict[int, float]]:
    """Shares of each level among about `most` pairs taken at random: rows meet in random blocks, so no cross join is made."""
    n = people.count()
    blocks = max(1, n * n // (2 * most))
    block = people.withColumn("_block", F.pmod(F.xxhash64(F.col(uid), F.lit(seed)), F.lit(blocks)))
    rows = [r.asDict() for r in patterns(candidates(block, block, [["_block"]], uid), levels).collect()]
    out = {}
    for c, of in kinds.items():
        count = {k: sum(r["n"] for r in rows if r[c] == k) + 0.5 for k in of}
        out[c] = {k: v / sum(count.values()) for k, v in count.items()}
    return out


def prior_from_rule(people: DataFrame, rule: list[str], recall: float = 0.8) -> float:
    """The share of matches among all pairs, if the pairs that agree on the rule are matches and `recall` of them all."""
    n = people.count()
    sizes = people.dropna(subset=rule).groupBy(*rule).agg(F.count("*").alias("k"))
    pairs = sizes.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("p")).first()["p"] or 0.0
    return min(0.99, max(1e-9, pairs / recall / max(1.0, n * (n - 1) / 2)))


def score(pairs: DataFrame, levels: dict[str, Column], m: dict[str, dict[int, float]], u: dict[str, dict[int, float]], prior: float, tf: dict[str, tuple[str, int, float]] | None = None) -> DataFrame:
    """pairs with weight (log2 odds) and probability.

    tf: comparison to (column, level, share): at that exact level the weight also gets share * log2(u / the larger
    of the two sides' tf_<column>), so that agreeing on a common value says less.
    """
    weight: Column = F.lit(math.log2(prior / (1 - prior)))
    kept, pairs = pairs.columns, pairs.withColumns({f"_level_{c}": expr for c, expr in levels.items()})  # each found once
    for c in levels:
        by = F.lit(0.0)
        for k in u[c]:
            gain = F.lit(math.log2(m[c][k] / u[c][k]))
            if tf and c in tf and tf[c][1] == k:
                column, _, share = tf[c]
                gain = gain + share * F.log2(F.lit(u[c][k]) / F.greatest(F.col(f"l.tf_{column}"), F.col(f"r.tf_{column}")))
            by = F.when(F.col(f"_level_{c}") == k, gain).otherwise(by)
        weight = weight + by
    return pairs.select(*kept, weight.alias("weight")).withColumn("probability", F.lit(1.0) / (1 + F.pow(F.lit(2.0), -F.col("weight"))))


def clustered(people: DataFrame, scored: DataFrame, least: float = 0.9, uid: str = "uid") -> DataFrame:
    """uid and cluster, the smallest uid that links of at least `least` lead to."""
    links = scored.where(F.col("probability") >= least).select(F.col(f"l.{uid}").alias("a"), F.col(f"r.{uid}").alias("b"))
    return people.select(uid).join(connected_components(links), F.col(uid) == F.col("node"), "left").select(uid, F.coalesce("component", uid).alias("cluster"))


def clustered_classes(people: DataFrame, classes: DataFrame, scored: DataFrame, least: float = 0.9, uid: str = "uid") -> DataFrame:
    """clustered() of scored pairs of classes (of packed()), without a row for each pair of members.

    A link from class x to class y links every member of x below y's last to it, and every member of y above x's first to that
    one; so of all members only those that some link reaches join their class's first or last.
    """
    first, last = (lambda side: F.col(f"{side}._uids")[0]), (lambda side: F.element_at(f"{side}._uids", -1))
    linked = scored.where(F.col("probability") >= least).where(first("l") < last("r"))
    reach = _checkpointed(reduced(linked.select(first("l").alias("a"), last("r").alias("b"), first("r").alias("c"))))
    most = reach.where("kind = 1").groupBy(F.col("a").alias("_first")).agg(F.max("b").alias("_to"))
    least_of = reach.where("kind = 2").groupBy(F.col("a").alias("_first")).agg(F.min("b").alias("_to"))
    mine = classes.select("_uids", F.col("_uids")[0].alias("_first"), F.element_at("_uids", -1).alias("_last"))
    below = mine.join(most, "_first").select(F.explode("_uids").alias("a"), F.col("_first").alias("b"), "_to").where("a < _to")
    above = mine.join(least_of, "_first").select(F.explode("_uids").alias("a"), F.col("_last").alias("b"), "_to").where("a > _to")
    links = reach.where("kind = 0").select("a", "b").unionByName(below.select("a", "b")).unionByName(above.select("a", "b"))
    return people.select(uid).join(connected_components(links), F.col(uid) == F.col("node"), "left").select(uid, F.coalesce("component", uid).alias("cluster"))
