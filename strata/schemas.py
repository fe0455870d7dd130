"""The 26 canonical relations: their columns, and the rules that a row must keep beyond its types.

Values that may be of any scalar kind are JSON texts, so that zero, false, the
empty text and null stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .functions.scalars import is_period
from .operators import checks

VERSION = "0.3.1"

# Columns of each relation. A name stands for a text; types follow a colon; [] is an array of texts, # a whole number, d a date, t a time, ? true or false, ~ a fraction.
TABLES = {
    "report": "report_id source_version_id report_number:# reference_period report_number_evidence_types:[] report_number_provenance_ids:[] reference_period_evidence_types:[] reference_period_provenance_ids:[] publication_date:d title_original source_url_original source_filename canonical_filename sha256 byte_size:# page_count:# source_status native_text_status format_regime supersedes_source_version_id provenance_ids:[]",
    "report_month": "report_month_id report_id metric_original indicator_basis value unit_original scope_original provenance_ids:[] derivation_name derivation_version upstream_record_ids:[]",
    "case": "case_id official_code canonical_name identity_method identity_confidence:~ provenance_ids:[]",
    "case_name": "case_name_id case_id report_id name_original name_normalized provenance_ids:[]",
    "case_month": "case_month_id case_id report_id reference_period official_code_original name_original stock_status_original stock_status_normalized phase_original phase_normalized conflict_type_original conflict_type_normalized case_description_original transitions:transitions monthly_facts_original provenance_ids:[]",
    "case_reported_indicator": "case_reported_indicator_id case_month_id case_id report_id metric_original value unit_original scope_original provenance_ids:[]",
    "location": "location_id location_text_original department_original department_normalized province_original province_normalized district_original district_normalized population_center_original population_center_normalized ubigeo match_method crosswalk_version match_confidence:~ provenance_ids:[]",
    "case_location": "case_location_id case_id report_id location_id relationship_original provenance_ids:[]",
    "actor": "actor_id name_original name_normalized actor_type_original actor_type_normalized provenance_ids:[]",
    "case_actor": "case_actor_id case_id report_id actor_id role_original role_normalized provenance_ids:[]",
    "demand": "demand_id text_original text_normalized theme_original theme_normalized category_original category_normalized competent_entity_original provenance_ids:[]",
    "case_demand": "case_demand_id case_id report_id demand_id provenance_ids:[]",
    "protest_event": "protest_event_id report_id event_date:d event_date_original event_date_precision_original measure_type_original measure_type_normalized actors_text_original location_text_original demand_text_original violence_explicit:? provenance_ids:[]",
    "case_protest_link": "case_protest_link_id case_id protest_event_id link_method confidence:~ provenance_ids:[]",
    "violence_event": "violence_event_id report_id case_id protest_event_id event_date:d event_date_original event_date_precision_original violence_type_original description_original fatalities_total:# injured_total:# casualty_components:casualties provenance_ids:[]",
    "dialogue_event": "dialogue_event_id report_id case_id mediation_process_id event_date:d event_date_original event_date_precision_original description_original status_original provenance_ids:[]",
    "mediation_process": "mediation_process_id case_id canonical_label identity_method identity_confidence:~ provenance_ids:[]",
    "mediation_observation": "mediation_observation_id report_id mediation_process_id case_id start_date:d start_date_original start_date_precision_original status_original requester_original actors_original mediation_type_original mediator_original case_description_original demands_original progress_original provenance_ids:[]",
    "agreement": "agreement_id report_id case_id agreement_date:d agreement_date_original agreement_date_precision_original case_description_original text_original compliance_progress_original responsibility_original deadline_original provenance_ids:[]",
    "dp_action": "dp_action_id report_id case_id action_date:d action_date_original action_date_precision_original action_type_original intervention_category_original intervention_category_normalized intervention_subtype_original intervention_subtype_normalized intervention_hierarchy_original:[] description_original provenance_ids:[]",
    "alert": "alert_id report_id case_id alert_date:d alert_date_original alert_date_precision_original text_original alert_type_original risk_original location_text_original provenance_ids:[]",
    "case_relationship": "case_relationship_id case_id_from case_id_to relationship_type_original relationship_type_normalized effective_period confidence:~ provenance_ids:[]",
    "provenance": "provenance_id object_type object_id field_name source_report_id source_sha256 source_page:# source_section source_table source_bbox:box source_span:span source_text extraction_method extractor_version parser_version model_invocation confidence:~ review_status",
    "discrepancy": "discrepancy_id report_id discrepancy_type severity value_a value_b provenance_a_ids:[] provenance_b_ids:[] status classification_rationale parser_version review_id",
    "manual_review": "review_id object_type object_id issue_type candidate_payloads_json:[] machine_suggestion_json machine_model_invocation evidence_provenance_ids:[] neighboring_periods:[] review_status second_review_required:? created_at:t parser_version",
    "adjudication": "adjudication_id review_id decision_original decision_action decision_payload_json rationale reviewer_id decided_at:t parser_version evidence_provenance_ids:[] supersedes_adjudication_id second_reviewer_id second_reviewed_at:t",
}
_TYPES = {
    "": "string", "[]": "array<string>", "#": "bigint", "~": "double", "d": "date", "t": "timestamp", "?": "boolean",
    "transitions": "array<struct<transition_original:string,transition_normalized:string,provenance_ids:array<string>>>",
    "casualties": "array<struct<component_original:string,fatalities:bigint,injured:bigint>>",
    "box": "struct<x0:double,y0:double,x1:double,y1:double>", "span": "struct<start:bigint,end:bigint>",
}


def ddl(name: str) -> str:
    columns = [c.partition(":") for c in TABLES[name].split()]
    return ", ".join([f"`{n}` {_TYPES[t]}" for n, _, t in columns] + ["`schema_version` string"])


def schema(name: str) -> StructType:
    return StructType.fromDDL(ddl(name))


def rules(name: str) -> dict[str, Column]:
    """Faults of a row of a relation, by rule."""
    c, names = F.col, [x.partition(":")[0] for x in TABLES[name].split()]
    none = lambda x: F.coalesce(F.size(c(x)) == 0, F.lit(True))
    blank = lambda x: ~F.coalesce(c(x).rlike(r"\S"), F.lit(False))
    qualified = lambda x: F.coalesce(F.arrays_overlap(c(x), F.array(F.lit("document_visible"), F.lit("official_metadata"))), F.lit(False))
    out = {"schema_version": ~c("schema_version").eqNullSafe(F.lit(VERSION)), "identifier": blank(names[0])}
    out |= {f"fraction_{x}": ~c(x).between(0, 1) for x in names if x.endswith("confidence")}
    out |= {f"period_{x}": c(x).isNotNull() & ~is_period(c(x)) for x in names if x in ("reference_period", "effective_period")}
    own = {
        "report": {
            "number": c("report_number") < 1, "number_evidence": c("report_number").isNotNull() & (~qualified("report_number_evidence_types") | none("report_number_provenance_ids")),
            "period_evidence": c("reference_period").isNotNull() & (~qualified("reference_period_evidence_types") | none("reference_period_provenance_ids")), "sha256": ~c("sha256").rlike("^[a-f0-9]{64}$"),
        },
        "report_month": {
            "reported": (c("indicator_basis") == "source_reported") & (none("provenance_ids") | c("derivation_name").isNotNull() | c("derivation_version").isNotNull()),
            "derived": (c("indicator_basis") == "derived") & (c("derivation_name").isNull() | c("derivation_version").isNull() | none("upstream_record_ids")),
        },
        "case_month": {"transitions": F.exists("transitions", lambda t: F.coalesce(F.size(t["provenance_ids"]) == 0, F.lit(True)))},
        "case_reported_indicator": {"value": c("value").isNull() | (c("value") == "null"), "provenance": none("provenance_ids")},
        "demand": {"dimension": blank("text_original") & blank("theme_original") & blank("category_original")},
        "violence_event": {"casualties": (c("fatalities_total") < 0) | (c("injured_total") < 0)},
        "dialogue_event": {"link": c("mediation_process_id").isNotNull() & none("provenance_ids")},
        "mediation_observation": {"link": (c("mediation_process_id").isNotNull() | c("case_id").isNotNull()) & none("provenance_ids")},
        "provenance": {
            "model": (c("extraction_method") == "probabilistic_model") != c("model_invocation").isNotNull(), "page": c("source_page") < 1,
            "box": ~((c("source_bbox.x1") >= c("source_bbox.x0")) & (c("source_bbox.y1") >= c("source_bbox.y0"))), "span": c("source_span.end") < c("source_span.start"),
        },
        "manual_review": {"suggestion": c("machine_suggestion_json").isNotNull() != c("machine_model_invocation").isNotNull(), "evidence": none("evidence_provenance_ids")},
        "adjudication": {
            "own": c("supersedes_adjudication_id") == c("adjudication_id"), "evidence": none("evidence_provenance_ids"),
            "second": (c("second_reviewer_id").isNotNull() != c("second_reviewed_at").isNotNull()) | (c("second_reviewer_id") == c("reviewer_id")),
        },
    }
    own |= {t: {"provenance": none("provenance_ids")} for t in ("case_protest_link", "mediation_process", "case_relationship")}
    return out | own.get(name, {})


def faults(name: str, df: DataFrame) -> DataFrame:
    """All rule violations of a relation, as (rule_id, key, detail)."""
    key = TABLES[name].split()[0]
    return checks.together(checks.row_rules(df, F.col(key), rules(name)), checks.unique(df, "unique_key", [key]))


def conform(name: str, df: DataFrame) -> DataFrame:
    """The relation with its columns in order; an unknown, missing or differently typed column is an error."""
    wanted = schema(name)
    wrong = checks.columns_exactly(df, wanted.names) + [f"type of {f.name}" for f in wanted if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*wanted.names)
