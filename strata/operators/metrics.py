"""Comparison of predictions with references: bags, sets, slots, pages, evidence, and the acceptance gate.

Every function takes long DataFrames and returns one row per group, or one row
in all.  Counts meet only after partial aggregation, so a frequent signature
costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import at_least, safe_ratio

# The types of objects, each with the fields that make two objects the same.
OBJECT_FIELDS = {
    "actor": ("name_original", "actor_type_original", "role_original"),
    "alert": ("alert_date_original", "alert_date_precision_original", "alert_type_original", "risk_original", "location_text_original", "text_original"),
    "agreement": ("agreement_date_original", "agreement_date_precision_original", "case_description_original", "text_original", "responsibility_original", "deadline_original", "compliance_progress_original"),
    "case_observation": ("unit_id",),
    "dp_action": ("action_date_original", "action_date_precision_original", "action_type_original", "intervention_category_original", "intervention_subtype_original", "intervention_hierarchy_original", "description_original"),
    "demand": ("text_original", "theme_original", "category_original", "competent_entity_original"),
    "dialogue_event": ("event_date_original", "event_date_precision_original", "description_original", "status_original"),
    "location": ("location_text_original", "department_original", "province_original", "district_original", "population_center_original", "relationship_original"),
    "mediation_observation": ("unit_id", "start_date_original", "start_date_precision_original", "status_original", "requester_original", "actors_original", "mediation_type_original", "mediator_original", "case_description_original", "demands_original", "progress_original"),
    "protest_event": ("event_date_original", "event_date_precision_original", "measure_type_original", "actors_text_original", "location_text_original", "demand_text_original"),
    "violence_event": ("event_date_original", "event_date_precision_original", "violence_type_original", "description_original", "fatalities_total", "injured_total", "casualty_components"),
}

_COUNTERS = ("missing_evidence", "wrong_report_id", "wrong_report_number", "missing_source_sha", "wrong_source_sha", "missing_pages", "extra_pages", "missing_section", "wrong_section", "missing_required_locator", "invalid_granularity")


def detection(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Counts, precision and recall, named."""
    return [tp.alias("true_positive"), fp.alias("false_positive"), fn.alias("false_negative"), safe_ratio(tp, tp + fp).alias("precision"), safe_ratio(tp, tp + fn).alias("recall")]


def _long(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def bag_metrics(gold: DataFrame, predicted: DataFrame, on: list[str], by: list[str] | None = None) -> DataFrame:
    """Precision and recall of bags of objects: each signature matches as often as both sides have it. Nulls are values."""
    by = by or []
    keys = [*by, *on]
    sides = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    counts = sides.groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    sums = counts.groupBy(*by).agg(_long(F.least("g", "p")).alias("tp"), _long(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), _long(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))
    return sums.select(*by, *detection(F.col("tp"), F.col("fp"), F.col("fn")))


def set_metrics(gold: DataFrame, predicted: DataFrame, on: list[str]) -> DataFrame:
    """Precision and recall of sets of ids."""
    return bag_metrics(gold.select(*on).distinct(), predicted.select(*on).distinct(), on)


def _paired(gold: DataFrame, predicted: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Both sides' values by key, with how often each side has the key; a repeated key is an error."""
    side = lambda df, k: df.select(*key, F.struct(*value).alias("v"), F.lit(k).alias("side"))
    both = side(gold, "g").unionByName(side(predicted, "p"))
    of = lambda k, c: F.max(F.when(F.col("side") == k, c))
    n = lambda k: F.sum((F.col("side") == k).cast("int"))
    out = both.groupBy(*key).agg(n("g").alias("g"), n("p").alias("p"), of("g", F.to_json("v", {"ignoreNullFields": "false"})).alias("gv"), of("p", F.to_json("v", {"ignoreNullFields": "false"})).alias("pv"))
    checked = F.when((F.col("g") > 1) | (F.col("p") > 1), F.raise_error(F.lit("annotation keys must be unique")).cast("int"))
    return out.withColumn("g", F.coalesce(checked, F.col("g")))


def strict_metrics(gold: DataFrame, predicted: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Exact accuracy over the reference's slots and all additional predicted ones."""
    p = _paired(gold, predicted, key, value)
    g, q, eq = F.col("g") > 0, F.col("p") > 0, F.col("gv").eqNullSafe(F.col("pv"))
    n = lambda c: _long(c.cast("int"))
    sums = p.agg(n(g & q & eq).alias("correct"), n(g & q & ~eq).alias("incorrect"), n(g & ~q).alias("missing"), n(~g & q).alias("extra"), n(g).alias("gold_total"), n(q).alias("prediction_total"))
    denominator = F.col("gold_total") + F.col("extra")
    return sums.select("*", denominator.alias("strict_denominator"), safe_ratio(F.col("correct"), denominator).alias("strict_exact_accuracy"))


def gold_accuracy(gold: DataFrame, predicted: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Exact accuracy over the reference's keys alone; works for slots and for arrays of pages."""
    p = _paired(gold, predicted, key, value)
    n = lambda c: _long(c.cast("int"))
    sums = p.agg(n((F.col("g") > 0) & (F.col("p") > 0) & F.col("gv").eqNullSafe(F.col("pv"))).alias("correct"), n(F.col("g") > 0).alias("total"))
    return sums.select("*", safe_ratio(F.col("correct"), F.col("total")).alias("accuracy"))


def completeness(flags: DataFrame, flag: str) -> DataFrame:
    """The share of true flags."""
    sums = flags.agg(_long(F.col(flag).cast("int")).alias("correct"), F.count("*").alias("total"))
    return sums.select("*", safe_ratio(F.col("correct"), F.col("total")).alias("accuracy"))


def has_locator(anchor: str = "") -> Column:
    """Whether an evidence anchor holds what its granularity asks for."""
    c = lambda name: F.col(f"{anchor}{name}")
    text = lambda name: F.coalesce(c(name) != "", F.lit(False))
    g = c("granularity")
    return (
        F.when(g == "section", True).when(g == "span", c("source_span").isNotNull()).when(g == "bounding_box", c("source_bbox").isNotNull())
        .when(g == "table_cell", text("source_table") & text("table_row_original") & text("table_column_original"))
        .when(g == "page_only", text("page_only_rationale")).otherwise(False)
    )


def evidence_audit(requirements: DataFrame, anchors: DataFrame, slot: list[str]) -> DataFrame:
    """Counts of what is missing or wrong in the evidence, and how many slots are complete.

    ``requirements``: the slot, report_id, report_number, source_sha256, pages,
    sections, allowed_granularities.  ``anchors``: the slot, report_id,
    report_number, source_sha256, page, section, granularity, located (whether
    its locator is there).
    """
    names = ("report_id", "report_number", "source_sha256", "page", "section", "granularity", "located")
    a = anchors.select(*[F.col(s).alias(f"_{s}") for s in slot], *[F.col(n).alias(f"a_{n}") for n in names], F.lit(True).alias("held"))
    on = F.lit(True)
    for s in slot:
        on = on & F.col(s).eqNullSafe(F.col(f"_{s}"))
    pairs = requirements.join(a, on, "left")
    held, r = F.col("held").isNotNull(), {n: F.col(n) for n in ("report_id", "report_number", "source_sha256", "sections", "allowed_granularities")}
    n = lambda c: _long((held & c).cast("int"))
    no_section = F.coalesce(F.trim("a_section") == "", F.lit(True))
    other = lambda x, y: ~x.eqNullSafe(y)
    per = pairs.groupBy(*slot).agg(
        n(F.lit(True)).alias("anchors"), F.first("pages").alias("pages"), F.collect_list(F.when(held, F.col("a_page"))).alias("seen"),
        n(other(F.col("a_report_id"), r["report_id"])).alias("wrong_report_id"), n(other(F.col("a_report_number"), r["report_number"])).alias("wrong_report_number"),
        n(F.col("a_source_sha256").isNull()).alias("missing_source_sha"), n(F.col("a_source_sha256").isNotNull() & other(F.col("a_source_sha256"), r["source_sha256"])).alias("wrong_source_sha"),
        n(no_section).alias("missing_section"), n(~no_section & ~F.coalesce(F.array_contains(r["sections"], F.col("a_section")), F.lit(False))).alias("wrong_section"),
        n(~F.coalesce(F.array_contains(r["allowed_granularities"], F.col("a_granularity")), F.lit(False))).alias("invalid_granularity"), n(~F.coalesce(F.col("a_located"), F.lit(False))).alias("missing_required_locator"),
    )
    surplus = lambda x, y: F.aggregate(F.array_distinct(x), F.lit(0), lambda s, p: s + F.greatest(F.lit(0), _times(x, p) - _times(y, p)))
    none = F.col("anchors") == 0
    per = per.withColumns({
        "missing_evidence": none.cast("long"),
        "missing_pages": F.when(none, F.size("pages")).otherwise(surplus(F.col("pages"), F.col("seen"))).cast("long"),
        "extra_pages": F.when(none, 0).otherwise(surplus(F.col("seen"), F.col("pages"))).cast("long"),
    })
    moved = sum((F.col(c) for c in _COUNTERS), F.lit(0))
    sums = per.agg(_long((moved == 0).cast("int")).alias("complete"), F.count("*").alias("total"), *[_long(F.col(c)).alias(c) for c in _COUNTERS])
    return sums.select("complete", "total", safe_ratio(F.col("complete"), F.col("total")).alias("completeness"), *_COUNTERS)


def _times(items: Column, item: Column) -> Column:
    return F.size(F.filter(items, lambda x: x == item))


def by_type(gold: DataFrame, predicted: DataFrame, types: DataFrame, kind: str, on: list[str]) -> DataFrame:
    """Bag metrics of every type in ``types``, also of those that neither side has."""
    found = bag_metrics(gold, predicted, on, [kind])
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    joined = types.select(kind).distinct().join(found, kind, "left")
    return joined.select(kind, *detection(n("true_positive"), n("false_positive"), n("false_negative")))


def signature(fields: Column, object_type: str) -> Column:
    """The signature of an object (a map of its fields): exactly the type's fields, else an error."""
    wanted = F.array_sort(F.array(*map(F.lit, OBJECT_FIELDS[object_type])))
    whole = F.array_sort(F.map_keys(fields)) == wanted
    return F.when(whole, F.to_json(F.map_from_arrays(wanted, F.transform(wanted, lambda k: fields[k])), {"ignoreNullFields": "false"})).otherwise(F.raise_error(F.lit("an object must have exactly the fields of its type")))


def acceptance_gate(metrics: DataFrame, thresholds: DataFrame, closed: bool = True, approved: bool = False) -> DataFrame:
    """Each threshold with what was observed, and the final state of the whole: what is missing comes first, then failed thresholds, open reviews, lacking approval."""
    rows = thresholds.join(metrics, "metric_name", "left").withColumn("missing", F.col("observed").isNull()).withColumn("passed", at_least(F.col("observed"), F.col("threshold")))
    state = rows.agg(F.coalesce(F.bool_or("missing"), F.lit(False)).alias("m"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("q"))
    final = (
        F.when(F.col("m"), "MISSING_REQUIRED_METRICS").when(~F.col("q"), "QUANTITATIVE_THRESHOLDS_FAILED")
        .when(~F.lit(closed), "REVIEW_CLOSURE_FAILED").when(~F.lit(approved), "OWNER_APPROVAL_REQUIRED").otherwise("ACCEPTED")
    )
    # the state is one row
    return rows.crossJoin(F.broadcast(state.select(final.alias("final_acceptance")))).select("metric_name", "threshold", "observed", "missing", "passed", "final_acceptance")
