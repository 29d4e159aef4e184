"""Readers and writers: explicit schemas in, Parquet, CSV and JSON lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """All values trimmed, rows with a blank first column left out (override tables)."""
    df = spark.read.csv(path, header=True, sep=sep, schema=schema)
    df = df.select(*[F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    return df.where(F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("")) != "")


def json_column(df: DataFrame, column: str, schema: StructType | str, code: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with the parsed struct as `parsed`, and rows that can't be parsed; null is neither and is left out.

    With code, that field of the struct becomes a column, UNKNOWN_ and a number of the row's own where it is missing.
    """
    parsed = df.where(F.col(column).isNotNull()).withColumn("parsed", F.from_json(column, schema, {"mode": "PERMISSIVE"})).withColumn("_bad", F.expr(f"try_parse_json(`{column}`) is null"))
    good = parsed.where("not _bad").drop("_bad")
    if code:
        good = good.withColumn(code, F.coalesce(F.col(f"parsed.{code}"), F.concat(F.lit("UNKNOWN_"), F.monotonically_increasing_id().cast("string"))))
    return good, parsed.where("_bad").drop("_bad", "parsed")


def sheet_codes(df: DataFrame) -> DataFrame:
    """title, code, name from a sheet saved as CSV (title, code, name): titles in lower case, codes that may read '801.0' whole, each entry once."""
    code = F.col("code").try_cast("double").cast("long").cast("string")
    return df.select(F.lower(F.trim("title")).alias("title"), code.alias("code"), F.trim("name").alias("name")).where("code is not null").dropDuplicates()


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(df: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A small table (at most `most` rows, else an error) as text lines under a title, in its own order."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report takes {most} rows")
    lines = [title, *("  ".join("" if v is None else str(v) for v in r) for r in rows)]
    df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def registered(spark: SparkSession, values: list, name: str, kind: str = "long") -> DataFrame:
    """A parameter list as a table and temporary view with the column `value`."""
    df = spark.createDataFrame([(v,) for v in values], f"value {kind}")
    df.createOrReplaceTempView(name)
    return df


def seed(cache: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """cache and the entries of old that it lacks; old entries that hold an error are left out."""
    more = old.join(cache, key, "left_anti")
    if "_error" in old.columns:
        more = more.where("_error is null")
    return cache.unionByName(more, allowMissingColumns=True)


def tolerant(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Parquet of a folder without the files that can't be read."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)


def has_columns(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def optional(df: DataFrame, name: str, kind: str) -> Column:
    """The column where the table has it, else nulls of its kind."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def write_persons(df: DataFrame, path: str, provenance: str = "provenance") -> None:
    """Nested records as Parquet, their provenance as a JSON string."""
    write_parquet(df.withColumn(provenance, F.to_json(provenance)), path)


def read_persons(spark: SparkSession, path: str, provenance_schema: str, provenance: str = "provenance") -> DataFrame:
    return spark.read.parquet(path).withColumn(provenance, F.from_json(provenance, provenance_schema))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def append_by_name(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays become '; '-joined text."""
    flat = [F.concat_ws("; ", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def reservoir(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same every time."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def missing(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys that a cache of fetched records lacks; an injectable fetcher fills them."""
    return wanted.join(cache, key, "left_anti")


def check_fresh(inputs: dict[str, float | None], outputs: dict[str, float | None], warn_only: bool = False) -> list[str]:
    """Modification times by name (None: missing): an output must exist and be no older than any input."""
    wrong = [f"missing output {n}" for n, t in outputs.items() if t is None] + [f"missing input {n}" for n, t in inputs.items() if t is None]
    oldest = min((t for t in outputs.values() if t is not None), default=None)
    wrong += [f"{n} is newer than the oldest output" for n, t in inputs.items() if t is not None and oldest is not None and t > oldest]
    if wrong and not warn_only:
        raise RuntimeError("; ".join(wrong))
    return wrong
