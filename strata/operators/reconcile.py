"""Reconciliation of repeated observations into one manifest, with every gap registered.

``occurrences``: run_id, record_id, source_line, number, period, entry_title,
page_title, description.  ``links``: run_id, record_id, number, url,
role.  ``relations``: run_id, record_id, number, relation_id,
observation_id, related_id, rationale.  ``acquired``: number, association, sha256, bytes.  Each gap
branch is one aggregation; the register is their union.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import joined_id, months, normalize_url

_GAP = ("gap_id", "dimension", "expected_value", "evidence_status", "classification", "manual", "disposition", "number", "refs")


def identity_map(occurrences: DataFrame, strict: bool = True) -> DataFrame:
    """The period of each number. A number of two periods, or a period of two numbers, is an error, or marked if not ``strict``."""
    pairs = occurrences.where("number IS NOT NULL AND period IS NOT NULL").select("number", "period").distinct()
    by_number = pairs.groupBy("number").agg(F.count("*").alias("periods"), F.min("period").alias("period"))
    shared = pairs.groupBy("period").agg(F.count("*").alias("numbers"))
    out = by_number.join(shared, "period")
    bad = (F.col("periods") > 1) | (F.col("numbers") > 1)
    if not strict:
        return out.select("number", "period", (~bad).alias("one_to_one"))
    return out.where(F.when(bad, F.raise_error(F.lit("numbers and periods must map one to one")).cast("boolean")).otherwise(True)).select("number", "period")


def _ref():
    return F.concat_ws(":", "run_id", "record_id")


def _gap(df: DataFrame, gap_id, dimension, expected, status, kind, manual, disposition, number=None, refs=None) -> DataFrame:
    none = F.lit(None)
    columns = (gap_id, F.lit(dimension), expected.cast("string"), F.lit(status), F.lit(kind), F.lit(manual), F.lit(disposition), (number if number is not None else none).cast("long"), refs if refs is not None else F.array().cast("array<string>"))
    return df.select(*[c.alias(n) for c, n in zip(columns, _GAP)])


def month_gaps(spark, occurrences: DataFrame, first: str, last: str) -> DataFrame:
    """Months of a range that no occurrence has."""
    grid = spark.range(1).select(F.explode(months(F.lit(first), F.lit(last))).alias("month"))
    return grid.join(occurrences.select(F.col("period").alias("month")).distinct(), "month", "left_anti")


def gap_register(spark, occurrences: DataFrame, links: DataFrame, acquired: DataFrame, first: str, last: str, numbers: int, years: list[str]) -> DataFrame:
    """All gaps of seven kinds: historical months and numbers, unnumbered leads, ambiguous or missing bytes, opaque files, conflicting titles."""
    grid = spark.range(1).select(F.explode(months(F.lit(first), F.lit(last))).alias("month"))
    known = identity_map(occurrences, strict=False).select("number").distinct()
    n = F.col("number")
    text = F.concat_ws("\n", "page_title", "entry_title", "description")
    lead = occurrences.where("number IS NULL").select(_ref().alias("ref"), F.explode(F.filter(F.array(*map(F.lit, years)), lambda y: text.contains(y))).alias("year"))
    lead = lead.groupBy("year").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    direct = links.where("role = 'direct_download'").join(known, "number").groupBy("number").agg(F.count_distinct(normalize_url(F.col("url"))).alias("urls")).where("urls > 1")
    last_ref = occurrences.join(known, "number").where("entry_title IS NOT NULL AND entry_title <> ''").groupBy("number", "entry_title").agg(F.max_by(_ref(), F.struct("run_id", "record_id", "source_line")).alias("ref"))
    titles = last_ref.groupBy("number").agg(F.count("*").alias("titles"), F.array_sort(F.collect_set("ref")).alias("refs")).where("titles > 1")
    of = lambda prefix: F.concat(F.lit(f"gap-{prefix}-"), n.cast("string"))
    parts = [
        _gap(grid, F.concat(F.lit("gap-reference-month-"), "month"), "reference_month", F.col("month"), "unobserved", "historical_month_unresolved", True, "pending_human_review"),
        _gap(spark.range(1, numbers + 1).withColumnRenamed("id", "number"), of("report-number"), "report_number", n, "unobserved", "unobserved_report_number", True, "pending_human_review"),
        _gap(lead, F.concat(F.lit("gap-historical-unnumbered-lead-"), "year"), "source_evidence", F.col("year"), "lead_only", "historical_unnumbered_source_lead", True, "retain_as_unnumbered_lead", refs=F.col("refs")),
        _gap(direct, of("multiple-direct-url-bytes"), "version_ambiguity", n, "ambiguous", "multiple_direct_url_bytes_unknown", True, "pending_human_review", n),
        _gap(known.join(acquired.select("number"), "number", "left_anti"), of("byte-acquisition"), "byte_acquisition", n, "not_acquired", "byte_acquisition_not_established", False, "deferred_future_acquisition", n),
        _gap(acquired.where("association = 'unresolved_opaque_filename'").select("number").distinct(), of("opaque-direct-file-association"), "identity_ambiguity", n, "ambiguous", "opaque_direct_file_association", True, "pending_human_review", n),
        _gap(titles, of("source-title-review"), "source_evidence", n, "conflicting", "source_metadata_requires_review", True, "pending_human_review", n, F.col("refs")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def version_edges(occurrences: DataFrame, links: DataFrame, relations: DataFrame, acquired: DataFrame) -> DataFrame:
    """Edges between observations of one report: claimed, by several official URLs, and by equal bytes."""
    known = identity_map(occurrences, strict=False).select("number").distinct()
    claimed = relations.join(known, "number").select(joined_id("edge", F.lit("candidate"), F.col("run_id"), F.col("record_id"), F.col("relation_id"), length=24).alias("edge_id"), "number", F.lit("candidate_same_report_without_byte_evidence").alias("relation"), F.array_sort(F.array("observation_id", "related_id")).alias("members"))
    urls = links.where("role = 'direct_download'").join(known, "number").groupBy("number").agg(F.array_sort(F.collect_set(normalize_url(F.col("url")))).alias("members")).where(F.size("members") > 1)
    several = urls.select(joined_id("edge", F.lit("urls"), F.col("number"), length=24).alias("edge_id"), "number", F.lit("multiple_official_urls").alias("relation"), "members")
    equal = acquired.select(joined_id("edge", F.lit("bytes"), F.col("number"), F.col("sha256"), length=24).alias("edge_id"), "number", F.lit("exact_identical_bytes").alias("relation"), F.array("sha256").alias("members"))
    return claimed.unionByName(several).unionByName(equal)


def manifest(occurrences: DataFrame, acquired: DataFrame, gaps: DataFrame) -> DataFrame:
    """A row for each known report: its titles, the preferred one if there is just one, how far it is acquired and what review it needs."""
    known = identity_map(occurrences, strict=False)
    titles = occurrences.where("entry_title IS NOT NULL AND entry_title <> ''").groupBy("number").agg(F.array_sort(F.collect_set("entry_title")).alias("titles"))
    open_ = gaps.where("manual AND number IS NOT NULL").select("number").distinct().withColumn("open", F.lit(True))
    have = acquired.select("number").distinct().withColumn("have", F.lit(True))
    rows = known.select("number", "period").join(titles, "number", "left").join(have, "number", "left").join(open_, "number", "left")
    return rows.select(
        joined_id("manifest", F.col("number"), length=24).alias("manifest_id"), "number", "period", F.coalesce("titles", F.array().cast("array<string>")).alias("titles"),
        F.when(F.size("titles") == 1, F.get("titles", F.lit(0))).alias("preferred_title"), F.when(F.col("have"), "byte_verified_identical").otherwise("not_acquired").alias("acquisition_state"),
        F.when(F.col("open"), "requires_human_review").when(F.col("have"), "verified").otherwise("candidate").alias("review_status"),
    )


def coverage(df: DataFrame, key: str, value: str) -> DataFrame:
    """How many different values there are, and the range of another column: one row."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys"), F.min(value).alias("first"), F.max(value).alias("last"))


def content_versions(observations: DataFrame, key: list[str], sha: str, size: str) -> DataFrame:
    """One object per hash, however many URLs lead to it; one hash with two sizes is an error."""
    out = observations.groupBy(sha).agg(F.min(size).alias("bytes"), F.max(size).alias("_most"), F.count("*").alias("observations"), F.count_distinct(*key).alias("urls"))
    return out.where(F.when(F.col("bytes") == F.col("_most"), True).otherwise(F.raise_error(F.lit("one hash has two sizes")).cast("boolean"))).drop("_most")
