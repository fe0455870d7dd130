"""Cells of source-addressed tables: a planned grid, filled where the source has a cell; what is missing stays told apart from null, empty, zero and false."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import json_kind


def cells_of(tables: DataFrame) -> DataFrame:
    """(input_id, table_index, row, column, value JSON) of tables given as JSON: tables -> cells -> rows of values."""
    rows = tables.select("input_id", F.posexplode(F.from_json(F.get_json_object("document", "$.tables"), "array<struct<cells:array<array<string>>>>", {"mode": "PERMISSIVE"})).alias("table_index", "t"))
    v = tables.select("input_id", F.try_parse_json("document").alias("v"))
    grid = rows.select("input_id", "table_index", F.posexplode("t.cells").alias("row", "r")).select("input_id", "table_index", "row", F.explode(F.sequence(F.lit(0), F.size("r") - 1)).alias("column"), F.size("r").alias("n")).where("n > 0")
    return grid.join(v, "input_id").select("input_id", "table_index", "row", "column", F.to_json(F.expr("try_variant_get(v, concat('$.tables[', table_index, '].cells[', row, '][', column, ']'), 'variant')")).alias("value"))


def outcome(present, value):
    """missing, null, empty, boolean, number, text or nested."""
    kind = json_kind(value)
    return F.when(~F.coalesce(present, F.lit(False)), "missing").when(value == '""', "empty").when(kind == "string", "text").when(kind.isin("array", "object"), "nested").otherwise(kind)


def planned_grid(plan: DataFrame) -> DataFrame:
    """(input_id, table_index, row, column, field) of plans (input_id, table_index, first_row, last_row, columns: array of column and field)."""
    rows = plan.select("input_id", "table_index", F.explode(F.sequence("first_row", "last_row")).alias("row"), "columns")
    return rows.select("input_id", "table_index", "row", F.explode("columns").alias("c")).select("input_id", "table_index", "row", F.col("c.column").alias("column"), F.col("c.field").alias("field"))


def extract(plan: DataFrame, cells: DataFrame, processed: DataFrame) -> DataFrame:
    """Every planned cell with what became of it; cells of inputs not in ``processed`` (input_id) stay unprocessed."""
    key = ["input_id", "table_index", "row", "column"]
    have = cells.select(*key, "value", F.lit(True).alias("present"))
    out = planned_grid(plan).join(have, key, "left").join(processed.select("input_id").distinct().withColumn("done", F.lit(True)), "input_id", "left")
    state = F.when(F.col("done").isNull(), "unprocessed").otherwise(outcome(F.col("present"), F.col("value")))
    return out.select(*key, "field", "value", state.alias("status"))


def accounting(extracted: DataFrame) -> DataFrame:
    """How many cells of each input have each status, and whether the input is complete or partial."""
    n = extracted.groupBy("input_id").agg(F.count("*").alias("cells"), F.count_if(F.col("status") == "unprocessed").alias("unprocessed"), F.count_if(F.col("status") == "missing").alias("missing"))
    return n.withColumn("state", F.when(F.col("unprocessed") == F.col("cells"), "unprocessed").when(F.col("unprocessed") + F.col("missing") > 0, "partial").otherwise("complete"))


def row_partition_faults(rows: DataFrame, header: DataFrame, selected: DataFrame, fragments: DataFrame, key: list[str]) -> DataFrame:
    """Rows that are not in exactly one of header, selected rows and fragments."""
    from .compare import partition_faults

    return partition_faults(rows, [header, selected, fragments], key)
