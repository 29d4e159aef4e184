"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting ASCII white space; null counts as empty. Of equal
texts the row with the most code points in its original text, then the smallest doc_id, stays.

One scan counts (length, prefix hash) pairs with map-side partial counts; lengths that occur once
settle their rows, then pairs that occur once. A second scan hashes whole texts only of the rows
whose pair is shared. Only keys and ids are shuffled, never texts. The list of shared pairs is
shipped to the scan while it has at most `most_pairs` entries (counted first); beyond that every
text is hashed, which gives the same groups.

Defined cases: null and empty texts are one group; a null doc_id counts as the largest; rows that
repeat entirely are members like any other, and exactly one row of a group is kept; an empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

PREFIX = 256


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")


def _keys(docs: DataFrame) -> DataFrame:
    norm = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), normalised().alias("norm"))
    return norm.withColumn("len", F.octet_length("norm")).withColumn("prefix", F.xxhash64(F.substring("norm", 1, PREFIX)))


def survivors(docs: DataFrame) -> DataFrame:
    """(len, prefix) pairs that more than one row has, refined from lengths that more than one row has."""
    pairs = _keys(docs).groupBy("len", "prefix").agg(F.count("*").alias("n"))
    pairs = written(pairs, "op8-pairs")
    lengths = pairs.groupBy("len").agg(F.sum("n").alias("rows")).where("rows > 1").select("len")
    return pairs.where("n > 1").join(lengths, "len", "left_semi").select("len", "prefix")


def decide(docs: DataFrame, digest: bool = False, most_pairs: int = 2_000_000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    text_sha256 is null for rows that length or prefix already set apart, unless digest is set.
    """
    shared = written(survivors(docs), "op8-shared")
    keyed = _keys(docs)
    if shared.count() <= most_pairs:
        keyed = keyed.join(F.broadcast(shared.withColumn("shared", F.lit(True))), ["len", "prefix"], "left")
    else:
        keyed = keyed.withColumn("shared", F.lit(True))
    sha = F.sha2("norm", 256)
    narrow = keyed.select(
        "doc_id", F.length("text").alias("points"), F.coalesce("shared", F.lit(False)).alias("shared"),
        (sha if digest else F.when(F.col("shared"), sha)).alias("text_sha256"), F.monotonically_increasing_id().alias("row"),
    )
    narrow = written(narrow, "op8-rows")
    order = F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id", "row")
    groups = (
        narrow.where("shared").groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("first"))
        .where("group_size > 1").select("text_sha256", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    )
    one = F.lit(1).cast("long")
    # with a second key the join is dealt anew, apart from the grouping, so that a hot group's rows can be split
    salt = F.hash("text_sha256")
    met = narrow.where("shared").withColumn("salt", salt).join(groups.withColumn("salt", salt), ["text_sha256", "salt"], "left").select(
        "doc_id", F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", one).alias("group_size"), (F.col("keep_row").isNull() | (F.col("keep_row") == F.col("row"))).alias("kept"), "text_sha256",
    )
    alone = narrow.where("not shared").select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return met.unionByName(alone)


def deduplicated(docs: DataFrame, most_pairs: int = 2_000_000) -> DataFrame:
    """The kept rows of docs, with docs' columns; one row where rows repeat entirely.

    Every row is settled by its own text, size, id and a hash of all its columns, never by its id
    alone, so rows that share an id or have none are told apart. Rows that length and prefix set
    apart pass straight through; only the rest meets the groups, dealt by text so that a large
    group's rows can be split.
    """
    columns = docs.columns
    whole = docs.select(F.struct(*columns).alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("_text"), normalised().alias("_norm"))
    whole = whole.withColumn("len", F.octet_length("_norm")).withColumn("prefix", F.xxhash64(F.substring("_norm", 1, PREFIX)))
    shared = written(survivors(docs), "op8-shared")
    if shared.count() <= most_pairs:
        some, alone = whole.join(F.broadcast(shared), ["len", "prefix"], "left_semi"), whole.join(F.broadcast(shared), ["len", "prefix"], "left_anti").select("_row.*")
    else:
        some, alone = whole, None
    order = F.struct((-F.length("_text")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("_row").alias("hash"))
    some = some.select("_row", F.sha2("_norm", 256).alias("_sha"), order.alias("_order"))
    keys = some.groupBy("_sha", "_order").agg(F.count("*").alias("times"))
    groups = written(keys.groupBy("_sha").agg(F.sum("times").alias("size"), F.min("_order").alias("first"), F.min_by("times", "_order").alias("times")).where("size > 1"), "op8-groups")
    salt = F.hash("_sha")
    met = some.withColumn("salt", salt).join(groups.withColumn("salt", salt), ["_sha", "salt"], "left")
    stay = met.where(F.col("first").isNull() | ((F.col("_order") == F.col("first")) & (F.col("times") == 1))).select("_row.*")
    # the kept row itself is there several times: any of the equal rows
    again = met.where((F.col("times") > 1) & (F.col("_order") == F.col("first"))).groupBy("_sha").agg(F.first("_row").alias("_row")).select("_row.*")
    kept = stay.unionByName(again)
    return kept if alone is None else alone.unionByName(kept)


def digest(docs: DataFrame) -> DataFrame:
    return decide(docs.select("doc_id", "text"), digest=True)


ORACLE = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS k,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
