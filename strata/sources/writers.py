"""Sinks: canonical JSON lines, written once and read again to be sure; CSV; schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _sorted(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def canonical_json_lines(df: DataFrame, key: str, path: str, replace: bool = False) -> None:
    """Compact JSON with sorted keys and nulls kept, in the order of the key over all files. An existing target is an error unless it may be replaced."""
    lines = df.orderBy(key).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite" if replace else "errorifexists").text(path)


def verify_json_lines(spark: SparkSession, df: DataFrame, path: str) -> int:
    """Reads what was written and compares it row by row, duplicates counted; an error if it differs. Returns the rows."""
    again = spark.read.schema(_sorted(df).schema).option("mode", "FAILFAST").json(path)
    mine, theirs = _sorted(df), _sorted(again)
    if mine.exceptAll(theirs).limit(1).count() or theirs.exceptAll(mine).limit(1).count():
        raise ValueError(f"{path} does not hold what was written")
    return again.count()


def write_verified(df: DataFrame, key: str, path: str) -> DataFrame:
    """Writes, verifies, and last of all a receipt (rows and a hash of all rows, whatever their order)."""
    spark = df.sparkSession
    canonical_json_lines(df, key, path)
    rows = verify_json_lines(spark, df, path)
    digest = df.agg(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string").alias("digest"))
    receipt = digest.select(F.lit(rows).cast("long").alias("rows"), "digest")
    receipt.write.mode("errorifexists").json(f"{path.rstrip('/')}.receipt")
    return receipt


def csv_export(df: DataFrame, path: str) -> None:
    """A long UTF-8 CSV with a header; quotes are doubled, null and the empty text stay apart."""
    df.write.mode("errorifexists").option("header", "true").option("escape", '"').option("nullValue", "\\N").option("emptyValue", '""').csv(path)


def snapshot(tables: dict[str, DataFrame], path: str, references: list[tuple[str, str, str, str]]) -> dict[str, int]:
    """Writes all tables of a store below a folder once, after every reference (table, column, to, key) is found to hold. Returns the rows of each."""
    for name, column, to, key in references:
        missing = tables[name].where(F.col(column).isNotNull()).join(tables[to].select(F.col(key).alias(column)), column, "left_anti")
        if missing.limit(1).count():
            raise ValueError(f"{name}.{column} refers to nothing in {to}")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return {name: df.sparkSession.read.parquet(f"{path}/{name}").count() for name, df in tables.items()}
