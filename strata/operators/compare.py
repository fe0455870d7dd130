"""Comparison of relations by key, set operations with duplicates, and versions laid over each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def pair_compare(a: DataFrame, b: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Each key of either side with its class: matched, boundary_disagreement (other values), a_only or b_only. Keys are unique on each side."""
    x, y = a.select(*key, F.struct(*value).alias("v")).alias("a"), b.select(*key, F.struct(*value).alias("v")).alias("b")
    kind = F.when(F.col("b.v").isNull(), "a_only").when(F.col("a.v").isNull(), "b_only").when(F.col("a.v").eqNullSafe(F.col("b.v")), "matched").otherwise("boundary_disagreement")
    return x.join(y, _same(key, "a", "b"), "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], kind.alias("class"))


def bucket_compare(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys that may repeat: equal bags of values, duplicates on either side, or differences, with how many of each."""
    side = lambda df, n: df.select(*key, F.col(value).alias("v"), F.lit(n).alias("s"))
    both = side(a, 1).unionByName(side(b, -1))
    per = both.groupBy(*key, "v").agg(F.sum(F.when(F.col("s") > 0, 1).otherwise(0)).alias("x"), F.sum(F.when(F.col("s") < 0, 1).otherwise(0)).alias("y"))
    sums = per.groupBy(*key).agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b"), F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("only_a"), F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("only_b"))
    kind = F.when(F.col("n_b") == 0, "unmatched_a").when(F.col("n_a") == 0, "unmatched_b").when((F.col("only_a") == 0) & (F.col("only_b") == 0), "equal").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "duplicate").otherwise("different")
    return sums.withColumn("class", kind)


def overlay(base: DataFrame, corrections: DataFrame, key: list[str]) -> DataFrame:
    """The base with each key's correction in its place, and corrections of new keys added."""
    x, y = base.withColumn("_b", F.lit(1)).alias("a"), corrections.withColumn("_c", F.lit(1)).alias("b")
    rest = [c for c in base.columns if c not in key]
    pick = [F.when(F.col("b._c").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in rest]
    return x.join(y, _same(key, "a", "b"), "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], *pick, F.col("b._c").isNotNull().alias("corrected"))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other: extra for a's, missing for b's."""
    return a.exceptAll(b).withColumn("difference", F.lit("extra")).unionByName(b.exceptAll(a).withColumn("difference", F.lit("missing")))


def partition_faults(whole: DataFrame, parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Keys that are not in exactly one of the parts, or not in the whole."""
    union = whole.select(*key, F.lit(1).alias("w"), F.lit(0).alias("p"))
    for part in parts:
        union = union.unionByName(part.select(*key, F.lit(0).alias("w"), F.lit(1).alias("p")))
    return union.groupBy(*key).agg(F.sum("w").alias("in_whole"), F.sum("p").alias("in_parts")).where("in_whole <> 1 OR in_parts <> 1")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n <> 1")


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def insert_once(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Appends rows of unknown keys; the same key with the same row is nothing new, with another row an error."""
    rest = [c for c in existing.columns if c not in key]
    rows = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    kept = rows.groupBy(*key).agg(F.min(F.struct("_new", *rest)).alias("r"), F.min(row).alias("lo"), F.max(row).alias("hi"))
    ok = F.when(F.col("lo") == F.col("hi"), False).otherwise(F.raise_error(F.lit("one key has two rows")).cast("boolean"))
    return kept.withColumn("_conflict", ok).where("not _conflict").select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def only_in(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a whose key b lacks."""
    return a.alias("a").join(b.select(*key).alias("b"), _same(key, "a", "b"), "left_anti")


def known_in(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a whose key b has."""
    return a.alias("a").join(b.select(*key).alias("b"), _same(key, "a", "b"), "left_semi")


def current(rows: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    old = rows.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)).distinct()
    return rows.join(old, key, "left_anti")


def role_pivot(cells: DataFrame, row: list[str], role: str, roles: list, value: list[str]) -> DataFrame:
    """One row for each that has a cell of every role, with the cells' values by role; rows that lack one are left out."""
    of = lambda r, c: F.max(F.when(F.col(role) == r, F.col(c)))
    wide = cells.where(F.col(role).isin(roles)).groupBy(*row).agg(F.count_distinct(role).alias("_n"), *[of(r, c).alias(f"{c}_{r}") for r in roles for c in value])
    return wide.where(F.col("_n") == len(roles)).drop("_n")
