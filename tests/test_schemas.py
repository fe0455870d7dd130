import pytest
from pyspark.sql import functions as F

from strata import schemas as S


def test_relations(spark):
    assert len(S.TABLES) == 26
    for name in S.TABLES:
        empty = spark.createDataFrame([], S.schema(name))
        assert S.conform(name, empty).columns == S.schema(name).names
        assert S.faults(name, empty).collect() == []
    with pytest.raises(ValueError):
        S.conform("actor", spark.createDataFrame([], S.schema("actor")).withColumn("extra", F.lit(1)))


def row(spark, name, **values):
    s = S.schema(name)
    return spark.createDataFrame([tuple(values.get(f) for f in s.names)], s)


def test_rules(spark):
    ids = lambda df, name: {r.rule_id for r in S.faults(name, df).collect()}
    good = dict(schema_version="0.3.1", provenance_ids=["p"])
    assert ids(row(spark, "mediation_process", mediation_process_id="m", **good), "mediation_process") == set()
    assert ids(row(spark, "mediation_process", mediation_process_id=" ", identity_confidence=1.5, schema_version="0.3.0"), "mediation_process") == {"schema_version", "identifier", "fraction_identity_confidence", "provenance"}
    assert ids(row(spark, "report", report_id="r", report_number=5, sha256="a" * 64, **good), "report") == {"number_evidence"}
    assert ids(row(spark, "report", report_id="r", report_number=5, sha256="a" * 64, report_number_evidence_types=["document_visible"], report_number_provenance_ids=["p"], **good), "report") == set()
    assert ids(row(spark, "demand", demand_id="d", text_original=" ", **good), "demand") == {"dimension"}
    assert ids(row(spark, "provenance", provenance_id="p", extraction_method="probabilistic_model", source_bbox=(2.0, 0.0, 1.0, 1.0), schema_version="0.3.1"), "provenance") == {"model", "box"}
    two = row(spark, "actor", actor_id="a", **good)
    assert ids(two.union(two), "actor") == {"unique_key"}
