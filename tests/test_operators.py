"""Expected values and refusals that the queries on the driver's tables do not show."""

import pytest
from pyspark.sql import functions as F

from strata.functions import scalars as S
from strata.operators import checks as V
from strata.operators import compare as C
from strata.operators import ledger as L
from strata.operators import metrics as M
from strata.operators import reconcile as R


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_bags_count_duplicates(spark):
    gold, predicted = df(spark, "a string", ("x",), ("x",), ("y",), (None,)), df(spark, "a string", ("x",), ("z",), (None,), (None,))
    r = M.bag_metrics(gold, predicted, ["a"]).collect()[0]
    assert (r.true_positive, r.false_positive, r.false_negative) == (2, 2, 2)
    empty = df(spark, "a string")
    r = M.bag_metrics(empty, empty, ["a"]).collect()[0]
    assert (r.precision, r.recall) == (1.0, 1.0)


def test_unsupported_predictions_widen_the_denominator(spark):
    gold = df(spark, "k int, v string", *[(k, "v") for k in range(10)])
    extra = gold.unionByName(df(spark, "k int, v string", *[(k, "v") for k in range(100, 200)]))
    r = M.strict_metrics(gold, extra, ["k"], ["v"]).collect()[0]
    assert (r.correct, r.extra, r.strict_denominator) == (10, 100, 110)
    with pytest.raises(Exception, match="unique"):
        M.strict_metrics(gold.union(gold.limit(1)), gold, ["k"], ["v"]).collect()


def test_states_are_values(spark):
    gold, predicted = df(spark, "k int, state string, v string", (1, "explicit_zero", "0"), (2, "not_reported", None)), df(spark, "k int, state string, v string", (1, "not_reported", None), (2, "not_reported", None))
    assert M.gold_accuracy(gold, predicted, ["k"], ["state", "v"]).collect()[0].correct == 1


@pytest.mark.parametrize("observed, closed, approved, state", [
    (None, True, True, "MISSING_REQUIRED_METRICS"), (0.98999999, True, True, "QUANTITATIVE_THRESHOLDS_FAILED"),
    (0.99, False, True, "REVIEW_CLOSURE_FAILED"), (0.99, True, False, "OWNER_APPROVAL_REQUIRED"), (0.99, True, True, "ACCEPTED"),
])
def test_gate(spark, observed, closed, approved, state):
    metrics, limits = df(spark, "metric_name string, observed double", ("m", observed)), df(spark, "metric_name string, threshold double", ("m", 0.99))
    assert M.acceptance_gate(metrics, limits, closed, approved).collect()[0].final_acceptance == state


def test_signature(spark):
    row = df(spark, "f map<string,string>", ({"role_original": None, "name_original": "n", "actor_type_original": "t"},))
    assert row.select(M.signature(F.col("f"), "actor").alias("s")).collect()[0].s == '{"actor_type_original":"t","name_original":"n","role_original":null}'
    with pytest.raises(Exception, match="exactly"):
        row.select(M.signature(F.col("f"), "demand")).collect()


def test_refusals(spark):
    a, b = df(spark, "k int, v string", (1, "x")), df(spark, "k int, v string", (1, "y"))
    with pytest.raises(Exception, match="two rows"):
        C.insert_once(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="one to one"):
        R.identity_map(df(spark, "number int, period string", (1, "2020-01"), (1, "2020-02"))).collect()
    with pytest.raises(Exception, match="two sizes"):
        R.content_versions(df(spark, "u string, s string, n long", ("a", "h", 1), ("b", "h", 2)), ["u"], "s", "n").collect()
    with pytest.raises(Exception, match="after the last"):
        spark.range(1).select(S.months(F.lit("2020-02"), F.lit("2020-01"))).collect()


def test_gaps_do_not_depend_on_order(spark):
    occ = df(spark, "run_id string, record_id string, source_line int, number int, period string, entry_title string, page_title string, description string", ("r2", "a", 1, 5, "2020-01", "T", "p 2004", None), ("r1", "b", 2, 5, "2020-01", "T", "p", None), ("r1", "c", 3, 5, "2020-01", "U", "p", None), ("r1", "d", 4, None, None, None, "p 2004", None))
    links = df(spark, "run_id string, record_id string, number int, url string, role string", ("r1", "a", 5, "https://x.org/1", "direct_download"), ("r1", "a", 5, "https://x.org/1?utm_id=2", "direct_download"))
    acq = df(spark, "number int, association string, sha256 string, bytes long", (5, "resolved", "h", 1))
    got = [sorted(map(tuple, R.gap_register(spark, o, links, acq, "2004-04", "2004-05", 2, ["2004"]).collect()), key=str) for o in (occ, occ.orderBy(F.desc("source_line")))]
    assert got[0] == got[1]
    kinds = {r[4]: r for r in got[0]}
    assert kinds["source_metadata_requires_review"][-1] == ["r1:c", "r2:a"] and kinds["historical_unnumbered_source_lead"][-1] == ["r1:d"]
    assert "multiple_direct_url_bytes_unknown" not in kinds and "byte_acquisition_not_established" not in kinds


def test_checks(spark):
    t = df(spark, "a int, b string", (1, "x"))
    assert V.columns_exactly(t, ["a", "c"]) == ["unknown b", "missing c"]
    assert not V.schema_drift(t, t.schema.json()) and V.schema_drift(t, t.drop("b").schema.json())
    files = df(spark, "p string, n long", ("a/b.parquet", 1), (".env", 1), ("x/big.txt", 99), ("ok.py", 1))
    assert [r.f for r in files.select(V.repository_fault(F.col("p"), F.col("n"), 10).alias("f")).collect()] == ["extension", "filename", "size", None]
    dates = df(spark, "d boolean, p boolean, u boolean", (True, True, False), (False, True, False), (True, False, False), (True, False, True))
    assert [r.f for r in dates.select(V.date_pair_faults(F.col("d"), F.col("p"), F.col("u")).alias("f")).collect()] == [None, "precision without date", "date without precision", None]


def test_ledger_parts(spark):
    plan = L.action_plan(df(spark, "run_id string, place int, action string", ("r", 2, "b"), ("r", 1, "a")), df(spark, "run_id string, place int, action string", ("r", 1, "c")))
    assert [(r.sequence, r.action) for r in plan.orderBy("sequence").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    seen = df(spark, "run_id string, step int, start long, end long", ("r", 1, 0, 10), ("r", 2, 5, 20), ("r", 4, 30, 40))
    got = L.schedule_faults(seen, df(spark, "step int", (1,), (2,), (3,))).collect()
    assert {(r.step, r.fault) for r in got} == {(2, "overlap"), (3, "missing"), (4, "extra")}
    obs = df(spark, "e string, o string, c boolean", ("allow", "allow", True), ("allow", "deny", True), ("allow", None, True), ("allow", "allow", False))
    state, reason = L.classify_observation(F.col("e"), F.col("o"), F.col("c"))
    assert [tuple(r) for r in obs.select(state, reason).collect()] == [("PASS", "as_expected"), ("FAIL", "differs"), ("INCONCLUSIVE", "not_observed"), ("INCONCLUSIVE", "evidence_incomplete")]
    docs = df(spark, "v string", ('{"aggregate_contract":"v1"}',), ('{"a":1}',), ('{"aggregate_contract":"v9"}',), ("[]",))
    assert [r.x for r in docs.select(S.contract_of(F.col("v"), "aggregate_contract", ["v1"], "base").alias("x")).collect()] == ["v1", "base", None, None]
