"""The six named queries on an inspection store of 22 tables, over temporary views that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES_PRIORITY = ("place_text", "case_description", "published_situation")
ROLES_REGIONAL = ("category", "count", "percentage")
QUERIES = ("units", "priority", "regional", "dependencies", "limits", "trace")


class Store:
    """The tables of a store by name. Methods give DataFrames in the documented order."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.t = tables

    def order(self) -> DataFrame:
        """(ordinal, unit_key) in the order that the source manifest lists views: as many rows as it has. A table unit_order serves where the manifest is too long for one row."""
        if "unit_order" in self.t:
            return self.t["unit_order"].select("unit_ordinal", "unit_key")
        manifest = self.t["snapshot_metadata"].where("key = 'source_manifest'")
        views = F.from_json("value_json", "views ARRAY<STRUCT<sha256 STRING>>")
        return manifest.select(F.posexplode(views["views"]["sha256"]).alias("unit_ordinal", "unit_key"))

    def body_rows(self) -> DataFrame:
        return self.t["documentary_rows"].where("row_class = 'body'").join(self.t["units"].select("unit_key", "label", "physical_page"), "unit_key")

    def body_cells(self) -> DataFrame:
        rows = self.t["documentary_rows"].select("row_key", F.col("ordinal").alias("row_ordinal"), "local_label_json", "documentary_role_json")
        columns = self.t["documentary_columns"].select("column_key", "column_role", "source_index", "label_json")
        links = self.t["row_cells"].select("row_key", F.col("ordinal").alias("cell_ordinal"), "cell_key")
        units = self.t["units"].select("unit_key", "physical_page", "label")
        return self.t["cells"].where("cell_class = 'body'").join(links, "cell_key").join(rows, "row_key").join(columns, "column_key").join(units, "unit_key")

    def cell_qualifiers(self) -> DataFrame:
        """Qualifiers of each body cell: those of the whole table, and those of its column."""
        c = self.t["cells"].where("cell_class = 'body'").join(self.t["documentary_columns"].select("column_key", "column_role"), "column_key")
        q = self.t["qualifiers"].select("unit_key", "qualifier_key", F.col("kind").alias("kind"), "target_kind", "target_column")
        on = (c.unit_key == q.unit_key) & ((F.col("target_kind") == "table_proposal") | ((F.col("target_kind") == "column") & (F.col("target_column") == F.col("column_key"))))
        return c.join(q, on).select("cell_key", "qualifier_key", "kind", "target_kind", "column_role")

    def cell_context(self) -> DataFrame:
        return self.t["cells"].select("cell_key", "unit_key").join(self.t["contexts"].select("unit_key", "context_key", "kind"), "unit_key")

    def _literal(self, name: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("ordinal", "exact_text")))
        return self.t["segments"].groupBy(F.col("owner_key").alias("context_key")).agg(F.array_join(F.transform(parts, lambda p: p["exact_text"]), "\n").alias(name))

    def _pivot(self, roles: tuple[str, ...], names: tuple[str, ...], literal: str) -> DataFrame:
        """Body rows with a cell of every role; a row that has two of one role gives a row for each, as the joins do."""
        cells, out = self.body_cells().select("row_key", "column_role", "value_json", "cell_key"), self.body_rows().join(self.order(), "unit_key")
        for role, name in zip(roles, names):
            out = out.join(cells.where(F.col("column_role") == role).select("row_key", F.col("value_json").alias(f"{name}_json"), F.col("cell_key").alias(f"{name}_address")), "row_key")
        return out.join(self.t["contexts"].select("unit_key", "context_key"), "unit_key").join(self._literal(literal), "context_key", "left")

    def units(self) -> DataFrame:
        n = lambda df, name: df.groupBy("unit_key").agg(F.count("*").alias(name))
        out = self.t["units"].join(self.order(), "unit_key")
        counts = {"body_rows": self.body_rows(), "body_cells": self.body_cells(), "header_cells": self.t["cells"].where("cell_class = 'header'"), "dependencies": self.t["dependencies"]}
        for name, df in counts.items():
            out = out.join(n(df, name), "unit_key", "left")
        return out.fillna(0, list(counts)).orderBy("unit_ordinal").drop("unit_ordinal")

    def priority(self) -> DataFrame:
        names = ("Lugar", "Caso", "Situacion")
        out = self._pivot(ROLES_PRIORITY, names, "introduction_literal").orderBy("unit_ordinal", "ordinal")
        return out.select("ordinal", "row_key", "documentary_role_json", *[f"{n}_{x}" for n in names for x in ("json", "address")], "context_key", "introduction_literal")

    def regional(self) -> DataFrame:
        unknown = self.t["dependencies"].where("state = 'unknown'").groupBy("unit_key").agg(F.count("*").alias("unknown_dependencies"))
        out = self._pivot(ROLES_REGIONAL, ROLES_REGIONAL, "caption_literal").join(unknown, "unit_key", "left").fillna(0, ["unknown_dependencies"]).orderBy("unit_ordinal", "ordinal")
        return out.select("ordinal", "row_key", "documentary_role_json", "category_json", "count_json", "percentage_json", "context_key", "caption_literal", "unknown_dependencies")

    def dependencies(self) -> DataFrame:
        return self.t["dependencies"].join(self.t["units"].select("unit_key", "physical_page"), "unit_key").join(self.order(), "unit_key").orderBy("unit_ordinal", "ordinal").drop("unit_ordinal")

    def limits(self) -> DataFrame:
        of = lambda suffix, column: self.t["units"].select(F.concat(F.lit("unit:"), F.col("physical_page"), F.lit(suffix)).alias("key"), F.col(column).alias("value_json"))
        meta = self.t["snapshot_metadata"].where(F.col("key").isin("scope", "permissions", "authorship")).select("key", "value_json")
        return meta.unionByName(of(":provenance", "provenance_json")).unionByName(of(":coverage-and-exposure", "exposure_json")).unionByName(of(":permissions", "permissions_json"))

    def first_cell(self) -> DataFrame:
        """The first body cell in the manifest's order: one row."""
        return self.body_cells().join(self.order(), "unit_key").orderBy("unit_ordinal", "row_ordinal", "cell_ordinal").select("cell_key").limit(1)

    def trace(self, cell: str | None = None) -> DataFrame:
        """A cell (the first by default) with all its words, their evidence and the assertions of its context."""
        t = self.t
        cells = t["cells"].where(F.col("cell_key") == cell) if cell is not None else t["cells"].join(F.broadcast(self.first_cell()), "cell_key")  # one row
        out = cells.select("cell_key", "unit_key", "value_type", "value_json").join(t["source_records"].select(F.col("address").alias("cell_key"), "document_sha256", "pointer", "historical_record_sha256"), "cell_key")
        out = out.join(t["owner_words"].select(F.col("owner_key").alias("cell_key"), F.col("ordinal").alias("word_ordinal"), "word_key"), "cell_key").join(t["words"].select("word_key", "text", "span_json", "bbox_json", "frame"), "word_key")
        out = out.join(t["word_links"].select("word_key", F.col("ordinal").alias("link_ordinal"), F.col("kind").alias("evidence_kind"), F.col("record_key").alias("evidence_address")), "word_key", "left")
        out = out.join(t["contexts"].select("unit_key", "context_key"), "unit_key")
        out = out.join(t["assertion_links"].select(F.col("owner_key").alias("context_key"), F.col("ordinal").alias("assertion_ordinal"), "assertion_key"), "context_key", "left")
        out = out.join(t["assertions"].select("assertion_key", F.col("source_record").alias("assertion_source"), "attribution_json", "stage_presence", "stage_json"), "assertion_key", "left")
        out = out.orderBy("word_ordinal", "evidence_kind", "link_ordinal", "assertion_ordinal")
        return out.select("cell_key", "value_type", "value_json", "document_sha256", "pointer", "historical_record_sha256", "word_key", "text", "span_json", "bbox_json", "frame", "evidence_kind", "evidence_address", "context_key", "assertion_source", "attribution_json", "stage_presence", "stage_json")

    def query(self, name: str, cell: str | None = None) -> DataFrame:
        if name not in QUERIES:
            raise ValueError(f"the queries are {', '.join(QUERIES)}")
        return self.trace(cell) if name == "trace" else getattr(self, name)()
